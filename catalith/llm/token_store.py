"""Token-id shards with a minimal perfect hash index.

``write_store`` encodes documents in ascending doc_id order into shard files of raw
little-endian ids, and builds an index over the document keys: keys are hashed into
buckets of bounded size, each bucket holds a hash-and-displace minimal perfect hash
whose slots store a fingerprint, the shard, the offset and the length.  A lookup
reads one displacement and one slot, whatever the size of the store.

Layout under ``root``::

    shards/<name>.ids     raw ids, ascending doc_id
    index/<bucket>.mph    header (keys, groups, seed), displacements, slots (SLOT records)
    entries/              Parquet: one row per document, as written

Edge cases: a null or empty text is the end id alone.  A key is the doc_id with the
ordinal of its repetition, so repeated doc_ids keep all their rows; a null doc_id is
a key of its own.  An empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import mix64, slices, text_bytes
from .wordcache import WordCache

SLOT = np.dtype([("fingerprint", "<u8"), ("shard", "<i4"), ("n", "<i8"), ("offset", "<i8")])
#: Keys in a bucket of the index, and keys that share a displacement, on average.
BUCKET_KEYS, GROUP_KEYS = 16_384, 2
#: Bytes of text in a shard.
SHARD_TEXT_BYTES = 16 << 20
#: Bytes of text encoded at once.
ENCODED_BYTES = 4 << 20
#: Seeds tried for a bucket before its keys are taken to share both hashes.
SEEDS = 8


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


#: Words of these characters alone are cut into pieces here: no normal form reaches across them.
_PLAIN, _PLAIN_LINES = re.compile("[!-~À-ÖØ-öø-ÿ]+"), re.compile("[!-~À-ÖØ-öø-ÿ\n]+")


class WordEncoder:
    """The tokenizers library over the distinct pieces of words.

    Exact for tokenizers that drop white space and never merge across it; others are
    refused.  Where the file names the pattern that cuts text before merging, each plain
    word is cut by that pattern, so words that differ in case or punctuation share the
    library's work; all other words go to the library whole.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ids(" one  two\n") != ids("one") + ids("two") or ids(" \t\n"):
            raise ValueError("only tokenizers that drop white space are supported")
        self.width = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.end = np.array([end_id], dtype=self.width).tobytes()
        added = self.tokenizer.get_added_tokens_decoder()
        special = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip)]
        self.mark = min(special, default=None)
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or "(?!)", re.IGNORECASE)
        self.pattern, self.lower = self._cutter()  # the pattern also finds line ends
        self.pieces = WordCache(self._encode, limit=600_000)
        self.cache = WordCache(self._joined, limit=400_000)

    def _cutter(self):
        """(pattern of the pieces, whether they are lower-cased), or (None, False) for tokenizers of another form."""
        import regex

        spec = json.loads(self.tokenizer.to_str())
        listed = lambda part, name: part.get(name, [part]) if part else []
        normal = [n["type"] for n in listed(spec["normalizer"], "normalizers")]
        cut = listed(spec["pre_tokenizer"], "pretokenizers")
        known = set(normal) <= {"NFC", "Replace", "Lowercase"} and cut and cut[0]["type"] == "Split"
        if self.mark and known and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and "Regex" in cut[0]["pattern"]:
            pattern = regex.compile(f"(?:{cut[0]['pattern']['Regex']})|\n")
            if not pattern.groups:
                return pattern, "Lowercase" in normal
        return None, False

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from those of its pieces; the words' pieces are found in one text of a word a line."""
        whole = "\n".join(words)
        if self.pattern and _PLAIN_LINES.fullmatch(whole) and not self.added.search(whole):
            return self._from_pieces(whole)
        plain = [bool(self.pattern and _PLAIN.fullmatch(w) and not self.added.search(w)) for w in words]
        known = self.pieces.ensure({w for w, p in zip(words, plain, strict=True) if not p})
        others = [None if p else known[w] for w, p in zip(words, plain, strict=True)]
        found = iter(self._from_pieces("\n".join(w for w, p in zip(words, plain, strict=True) if p)) if any(plain) else ())
        return [next(found) if p else ids for ids, p in zip(others, plain, strict=True)]

    def _from_pieces(self, lines: str) -> list[bytes]:
        pieces = self.pattern.findall(lines.lower() if self.lower else lines)
        known = self.pieces.ensure(set(pieces) - {"\n"})
        known["\n"] = np.array([self.mark[0]], dtype=self.width).tobytes()
        return self._parted(b"".join([known[p] for p in pieces]))

    def _parted(self, data: bytes) -> list[bytes]:
        """Runs of ids between special tokens."""
        size = np.dtype(self.width).itemsize
        at = np.flatnonzero(np.frombuffer(data, dtype=self.width) == self.mark[0]) * size
        begin, end = [0, *(at + size).tolist()], [*at.tolist(), len(data)]
        return [data[a:b] for a, b in zip(begin, end, strict=True)]

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each piece; pieces go in by the hundred, parted by a special token, which the library never merges."""
        size = 500 if self.mark else 1
        runs = [words[at : at + size] for at in range(0, len(words), size)]
        joined = [self.mark[1].join(run) for run in runs] if self.mark else words
        for run, encoded in zip(runs, self._batches(joined), strict=True):
            data = np.array(encoded.ids, dtype=self.width).tobytes()
            parts = self._parted(data) if self.mark else [data]
            if len(parts) == len(run):
                yield from parts
            else:  # a word holds the special token itself
                yield from (np.array(e.ids, dtype=self.width).tobytes() for e in self._batches(run))

    def _batches(self, texts: list[str]):
        for at in range(0, len(texts), 64):
            yield from self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with the end id; number of ids of each text)."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        # No word holds a line end, so one text of all words is taken to Python at once.
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")[0].as_py().split("\n")
        known = self.cache.ensure(set(words) - {""})
        parts = [known[w] if w else b"" for w in words] + [self.end]
        size = np.dtype(self.width).itemsize
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // size
        begin = np.cumsum(lengths) - lengths
        # Every text is its words' codes and the code of the end.
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(words))
        n = lengths[codes]
        after = np.cumsum(n)
        gather = np.repeat(begin[codes] - after + n, n) + np.arange(after[-1] if len(after) else 0)
        counts = np.diff(after[ends + np.arange(len(ends))], prepend=0)
        return np.frombuffer(b"".join(parts), dtype=self.width)[gather], counts


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


@dataclass(frozen=True)
class Store:
    root: str
    buckets: int
    width: str


def _key(df: DataFrame) -> DataFrame:
    """Adds the two hashes of a document key (doc_id and repetition)."""
    key = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("repeat").cast("string"))
    return df.withColumns({"h": F.xxhash64(key), "print": F.xxhash64(F.lit("fingerprint"), key)})


def write_store(docs: DataFrame, tokenizer_path: str, root: str, end_id: int) -> Store:
    """Encode ``docs`` (doc_id, text) into a store under ``root`` (a shared folder)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shards = max(1, -(-text_bytes(docs) // SHARD_TEXT_BYTES))
    width = encoder(tokenizer_path, end_id).width

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(root)
        fs.create_dir(f"{path}/shards", recursive=True)
        name, offset, out = uuid.uuid4().hex, 0, None
        started, last, repeat = False, None, 0
        for batch in batches:
            for part in slices(batch, size=ENCODED_BYTES):
                if out is None:
                    out = fs.open_output_stream(f"{path}/shards/{name}.ids")
                ids, n = encoder(tokenizer_path, end_id).encode_all(part.column("text"))
                repeats = []
                for doc_id in part.column("doc_id").to_pylist():
                    repeat = repeat + 1 if started and doc_id == last else 0
                    started, last = True, doc_id
                    repeats.append(repeat)
                out.write(ids.tobytes())
                begin = offset + np.cumsum(n) - n
                offset += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(repeats, pa.int64()), pa.array([name] * len(n)), pa.array(begin), pa.array(n)],
                    names=["doc_id", "repeat", "file", "offset", "n"],
                )
        if out is not None:
            out.close()

    ordered = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, "doc_id long, repeat long, file string, offset long, n long").write.parquet(f"{root}/entries")
    entries = spark.read.parquet(f"{root}/entries")
    # One row per shard file, in order of its first document.
    order = Window.orderBy(F.col("first").asc_nulls_first())
    files = entries.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n").alias("total"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    files = files.withColumn("first", F.when(F.col("nulls") > 0, F.lit(None)).otherwise(F.col("first")))
    files.select("file", "total", (F.row_number().over(order) - 1).cast("int").alias("shard")).write.parquet(f"{root}/files")
    files = spark.read.parquet(f"{root}/files")
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))

    def build(table: pa.Table) -> pa.Table:
        fs, path = open_fs(root)
        bucket = table.column("bucket")[0].as_py()
        slots = np.zeros(table.num_rows, dtype=SLOT)
        h, fingerprint = (table.column(c).to_numpy().view(np.uint64) for c in ("h", "print"))
        seed = next((k for k in range(SEEDS) if len(np.unique(seeded(h, fingerprint, k))) == len(h)), None)
        if seed is None:
            raise ValueError("two keys share 128 bits of hash")
        displacement, at = perfect_hash(seeded(h, fingerprint, seed))
        for name, column in (("shard", "shard"), ("n", "n"), ("offset", "offset")):
            slots[name][at] = table.column(column).to_numpy()
        slots["fingerprint"][at] = fingerprint
        fs.create_dir(f"{path}/index", recursive=True)
        temporary = f"{path}/index/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as out:
            out.write(np.array([len(slots), len(displacement), seed], dtype="<i8").tobytes() + displacement.tobytes() + slots.tobytes())
        fs.move(temporary, f"{path}/index/{bucket}.mph")
        return pa.table({"bucket": [bucket], "keys": pa.array([len(slots)], pa.int64())})

    keyed = _key(entries.join(files.select("file", "shard"), "file")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    built = keyed.select("bucket", "h", "print", "shard", "offset", "n").groupBy("bucket").applyInArrow(build, "bucket long, keys long")
    built.write.parquet(f"{root}/buckets")
    return Store(root, buckets, width)


def seeded(h: np.ndarray, fingerprint: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of keys for a bucket's seed; seeds over 0 bring in the fingerprints, for buckets where two keys share ``h``."""
    return h if not seed else mix64(h + mix64(fingerprint ^ np.uint64(seed)))


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key) of a minimal perfect hash of distinct 64-bit keys.

    Groups of keys are placed from the largest; a group tries displacements until all its
    keys fall on free slots.  A group of one key stores its slot itself, as -1 - slot.
    """
    n = len(h)
    groups = max(1, -(-n // GROUP_KEYS))
    group = _group(h, groups)
    sizes = np.bincount(group, minlength=groups)
    order, begin = np.argsort(group, kind="stable"), np.cumsum(sizes) - sizes
    displacement, slot = np.zeros(groups, dtype="<i8"), np.zeros(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    for g in np.argsort(-sizes, kind="stable").tolist():
        keys = order[begin[g] : begin[g] + sizes[g]]
        if not len(keys):
            break
        if len(keys) == 1:
            break
        tried = 0
        while True:
            d = np.arange(tried, tried + 64, dtype=np.uint64)
            to = _slots(h[keys][:, None], d[None, :], n)
            good = free[to].all(axis=0)
            ordered = np.sort(to, axis=0)
            good &= (ordered[1:] != ordered[:-1]).all(axis=0)
            if good.any():
                k = int(np.argmax(good))
                displacement[g], slot[keys], free[to[:, k]] = tried + k, to[:, k], False
                break
            tried += 64
    single = np.flatnonzero(sizes == 1)
    spare = np.flatnonzero(free)[: len(single)]
    displacement[single], slot[order[begin[single]]] = -1 - spare, spare
    return displacement, slot


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    """Group of a key, from other bits than its bucket's remainder."""
    return (((h * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = (h >> np.uint64(16)) + (d + np.uint64(1)) * ((h << np.uint64(1)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


class Bucket:
    """One bucket of the index, opened for lookups."""

    def __init__(self, store: Store, bucket: int) -> None:
        fs, path = open_fs(store.root)
        with fs.open_input_file(f"{path}/index/{bucket}.mph") as f:
            data = f.read()
        n, groups, self.seed = np.frombuffer(data, dtype="<i8", count=3).tolist()
        self.displacement = np.frombuffer(data, dtype="<i8", count=groups, offset=24)
        self.slots = np.frombuffer(data, dtype=SLOT, count=n, offset=24 + 8 * groups)

    def find(self, h: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slot records) of keys; a key that was not stored fails its fingerprint."""
        h = seeded(h, fingerprint, self.seed)
        d = self.displacement[_group(h, len(self.displacement))]
        to = np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0).astype(np.uint64), len(self.slots)))
        records = self.slots[to]
        return records["fingerprint"] == fingerprint, records


def lookup(store: Store, keys: DataFrame) -> DataFrame:
    """Places of keys (doc_id, repeat), by the index alone: adds shard, offset, n; unknown keys go."""

    def find(table: pa.Table) -> pa.Table:
        index = Bucket(store, table.column("bucket")[0].as_py())
        h, fingerprint = (table.column(c).to_numpy().view(np.uint64) for c in ("h", "print"))
        found, records = index.find(h, fingerprint)
        out = table.select(["doc_id", "repeat"])
        for name, kind in (("shard", pa.int32()), ("offset", pa.int64()), ("n", pa.int64())):
            out = out.append_column(name, pa.array(np.ascontiguousarray(records[name]), kind))
        return out.filter(pa.array(found))

    keyed = _key(keys).withColumn("bucket", F.pmod("h", F.lit(store.buckets)))
    return keyed.groupBy("bucket").applyInArrow(find, "doc_id long, repeat long, shard int, offset long, n long")


def read_store(spark: SparkSession, store: Store, keys: DataFrame) -> DataFrame:
    """Per key: start (ids of all documents before it), n_tokens and the crc32 of its ids."""
    files = spark.read.parquet(f"{store.root}/files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    placed = lookup(store, keys).join(files.select("shard", "file", "base"), "shard")

    def read(table: pa.Table) -> pa.Table:
        fs, path = open_fs(store.root)
        table = table.sort_by("offset")
        size = np.dtype(store.width).itemsize
        crcs = []
        with fs.open_input_stream(f"{path}/shards/{table.column('file')[0].as_py()}.ids", buffer_size=1 << 20) as f:
            at, buffered = 0, b""
            for offset, n in zip(table.column("offset").to_pylist(), table.column("n").to_pylist(), strict=True):
                if offset != at:
                    f.read((offset - at) * size)
                buffered, at = f.read(n * size), offset + n
                crcs.append(zlib.crc32(np.frombuffer(buffered, dtype=store.width).astype("<u4").tobytes()))
        start = np.add(table.column("base").to_numpy(), table.column("offset").to_numpy())
        return pa.table({"doc_id": table.column("doc_id"), "start": start, "n_tokens": table.column("n"), "ids_crc32": pa.array(crcs, pa.int64())})

    return (
        placed.select("shard", "doc_id", "file", "base", "offset", "n")
        .groupBy("shard")
        .applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def document_keys(docs: DataFrame) -> DataFrame:
    """The keys of a table's documents: doc_id and the ordinal of each repetition."""
    counted = docs.groupBy("doc_id").count()
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("repeat"))
