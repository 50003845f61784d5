"""Substring dedup by difference-cover anchors.

A window is ``WIDTH`` consecutive words of one document.  Words are removed where a
window covers them whose word sequence also starts in a document with a smaller
doc_id; windows are judged on the input.

Hashing every window would shuffle a row per word.  The residues ``COVER`` are a
difference cover modulo ``PERIOD``: for any two positions some shift below PERIOD
brings both onto cover positions.  So two equal windows of WIDTH words share an equal
run of ``WIDTH - PERIOD + 1`` words that starts at a cover position in both, and only
those runs, the anchors, are hashed and shuffled.  Anchors found in two documents or
more mark the few windows around them, which are then compared whole.

Documents are dealt to chunks of about ``CHUNK_BYTES`` of text by a hash of doc_id and text.
A chunk sends each distinct hash once, so a passage held by a third of all documents
makes a row per chunk, not per document.  Three passes over the chunks share one
shuffle of the texts: anchors, candidate windows (with the least doc_id in the chunk),
removal.

Edge cases: a null or empty text has no words and is returned with zeros; a null
doc_id sorts before all others; rows with equal doc_ids do not remove each other's
words; texts of any length are processed whole.  Windows are compared by a 64-bit hash
of their 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import signed, split_words, text_buffer, text_bytes

WIDTH, PERIOD, COVER = 13, 7, (0, 1, 3)
CHUNK_BYTES = 1 << 20
_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _table_words(table: pa.Table):
    """Words and their hashes of the documents of a chunk."""
    words = split_words(*text_buffer(table.column("text")))
    return words, words.hashes()


def _doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(-(1 << 63)).to_numpy()


def anchors(words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs that start at cover positions of their document."""
    at, h = words.windows(hashes, WIDTH - PERIOD + 1)
    on_cover = np.isin((at - words.first[words.row[at]]) % PERIOD, COVER)
    return at[on_cover], h[on_cover]


def _by_hash(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the least and the greatest document of each."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)
    last = np.r_[first[1:], len(h)] - 1 if len(h) else first
    return h[first], doc[first], doc[last]


def _chunk_anchors(table: pa.Table) -> pa.Table:
    words, hashes = _table_words(table)
    at, h = anchors(words, hashes)
    h, least, greatest = _by_hash(h, _doc_ids(table)[words.row[at]])
    code = table.column("chunk")[0].as_py() * 2 + (least != greatest)
    return pa.table({"h": signed(h), "code": pa.array(code.astype(np.int64))})


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _hash_column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().view(np.uint64)


def _chunk_windows(table: pa.Table, shared: pa.Table) -> pa.Table:
    """Distinct windows of a chunk that hold a shared anchor: hash, least doc_id, and twice the chunk plus
    whether several documents of the chunk have it.  Rows are in order of documents, so that a shuffle's
    compression finds the same numbers beside each other."""
    empty = np.zeros(0, dtype=np.uint64)
    h, least, greatest = empty, empty.view(np.int64), empty.view(np.int64)
    if table.num_rows and shared.num_rows:
        words, hashes = _table_words(table)
        at, anchor = anchors(words, hashes)
        at = at[_member(anchor, np.sort(_hash_column(shared, "h")))]
        # Windows that hold the run from ``at``: they start at most PERIOD - 1 words before it.
        near = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        start, window = words.windows(hashes, WIDTH)
        picked = np.cumsum(near)[start] > 0
        h, least, greatest = _by_hash(window[picked], _doc_ids(table)[words.row[start[picked]]])
    chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
    order = np.argsort(least, kind="stable")
    code = chunk * 2 + (least != greatest)
    return pa.table({"w": signed(h[order]), "code": pa.array(code[order].astype(np.int64)), "least": pa.array(least[order])})


def _chunk_removal(table: pa.Table, repeated: pa.Table) -> pa.Table:
    """The result rows of a chunk; ``repeated`` has the least doc_id anywhere of its repeated windows."""
    words, hashes = _table_words(table)
    gone = np.zeros(len(hashes) + 1, dtype=np.int64)
    if repeated.num_rows:
        start, window = words.windows(hashes, WIDTH)
        known, source = _hash_column(repeated, "w"), repeated.column("source").to_numpy()
        order = np.argsort(known)
        known, source = known[order], source[order]
        place = np.minimum(np.searchsorted(known, window), len(known) - 1)
        earlier = (known[place] == window) & (source[place] < _doc_ids(table)[words.row[start]])
        np.add.at(gone, start[earlier], 1)
        np.add.at(gone, start[earlier] + WIDTH, -1)
    keep = np.cumsum(gone)[:-1] == 0
    kept_before = np.r_[0, np.cumsum(keep)]
    kept = kept_before[words.first[1:]] - kept_before[words.first[:-1]]
    digests = []
    for k, text in enumerate(table.column("text").to_pylist()):
        parts = (text or "").encode().split()
        if kept[k] < len(parts):
            parts = compress(parts, keep[words.first[k] : words.first[k + 1]].tolist())
        digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
    return pa.table({
        "doc_id": table.column("doc_id"),
        "n_words": pa.array(words.counts.astype(np.int64)),
        "n_removed": pa.array((words.counts - kept).astype(np.int64)),
        "kept_sha256": pa.array(digests, pa.string()),
    })


def chunk_of(chunks: int) -> Column:
    """The chunk of a row, by its id and text, so that rows of one id, or without one, do not meet in one chunk."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): n_words, n_removed and the digest of the kept words."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    chunks = max(1, -(-size // CHUNK_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (16 * CHUNK_BYTES)))
    dealt = docs.select("doc_id", "text", chunk_of(chunks).alias("chunk")).repartition(parts, "chunk")
    found = dealt.groupBy("chunk").applyInArrow(_chunk_anchors, "h long, code long")
    same = Window.partitionBy("h")
    shared = (
        found.select("h", "code", F.count(F.lit(1)).over(same).alias("chunks"))
        .filter((F.col("chunks") > 1) | (F.col("code") % 2 == 1))
        .select("h", F.shiftright("code", 1).alias("chunk"))
        .sortWithinPartitions("chunk")
    )
    windows = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_chunk_windows, "w long, code long, least long")
    source = F.min("least").over(Window.partitionBy("w"))
    repeated = windows.withColumn("source", source).filter((F.col("least") > F.col("source")) | (F.col("code") % 2 == 1))
    repeated = repeated.select(F.shiftright("code", 1).alias("chunk"), "w", "source").sortWithinPartitions("chunk", "source")
    return dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_chunk_removal, _SCHEMA)


#: The same result in SQL, over a table ``documents``; quadratic in nothing, but it holds a row per window.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(generate_series(0, 12)) AS k)
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
