"""Shared numpy/Arrow helpers for the text operators.

Everything here works on one bounded slice of an Arrow batch at a time; Spark
decides how rows are partitioned and shuffled.  A *word* is a maximal run of
bytes outside ``\\x20`` and ``\\x09-\\x0D`` (all of them ASCII, so words of UTF-8
text can be cut at the byte level).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised code.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, step in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, step, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Words:
    """Words of a slice of rows: byte spans, row of each word, words per row."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # index of each row's first word; one more entry closes the last row

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every process."""
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = _POWERS.get(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * down[self.start])

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``width`` words inside one row."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        acc = hashes[at].copy()
        for k in range(1, width):
            acc = acc * _STEP + hashes[at + k]
        return at, mix64(acc + np.uint64(width))


def split_words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the rows ``buf[offsets[i]:offsets[i + 1]]``; ``lower`` folds A-Z."""
    if lower:
        buf = _LOWER[buf]
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    start, end = np.flatnonzero(step[:-1] == 1), np.flatnonzero(step == -1)
    # A row boundary inside a run of non-space bytes also ends a word.
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(buf))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(buf, start, end, row, first)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``size`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_slices(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, text: str = "text"
) -> DataFrame:
    """``mapInArrow`` over bounded slices; ``function`` sees one slice at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs with the same bits."""
    return pa.array(h.view(np.int64))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the folder all executors share (``spark.checkpoint.dir``).

    Only where the setting is missing, as in tests, a local folder is made.
    """
    return f"{checkpoint_root(spark)}/{name}-{spark.sparkContext.applicationId}-{os.urandom(6).hex()}"


#: Local folders of sessions without a shared one, by application.
_OWN_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:  # the setting cannot be changed in a running session
        import tempfile

        application = spark.sparkContext.applicationId
        if application not in _OWN_ROOTS:
            _OWN_ROOTS[application] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        root = _OWN_ROOTS[application]
    return root.rstrip("/")


def release(spark: SparkSession) -> int:
    """Removes what this application wrote under the shared folder; for when its results have been stored.  The number of folders."""
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(checkpoint_root(spark))
    mine = f"-{spark.sparkContext.applicationId}-"
    found = [i.path for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if mine in i.base_name]
    for path in found:
        fs.delete_dir(path)
    return len(found)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, computed once."""
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table of groups up to which it is broadcast (a few hundred bytes each), and salts of its keys beyond.
BROADCAST_ROWS, SALTS = 100_000, 64


def attach(rows: DataFrame, small: DataFrame, on: list[str], how: str = "left", salt_by: list[str] | None = None, size: int | None = None) -> DataFrame:
    """Join with a table that has a row per key, without gathering a key's rows in one task.

    The table is counted (it should be written, or cheap) unless its ``size`` is known: up to ``BROADCAST_ROWS`` it is
    broadcast, beyond it is repeated under ``SALTS`` salts, over which the rows of a key are dealt.
    """
    if (small.count() if size is None else size) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*(salt_by or rows.columns)), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of text in the table, to size chunks by (one aggregate, no shuffle of rows)."""
    return int(df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)
