"""Hard-negative mining by distributed radix selection over exact integer scores.

Vectors become integers, ``floor(scale * x)``, and a score is an integer inner product,
so every comparison is exact.  For each anchor the first positives (rows of its label by
score, then vec_id) are selected, and for each anchor and positive the first negatives
whose score lies in a band below the positive's.  Both are the same selection, over
*windows*: an anchor, a relation of labels, and a range of scores.

Selection is a radix search from the top of a window downwards.  A round counts, per
window, the rows by the next ``DIGIT`` bits of their distance from the window's top,
among those that share the digits found before; Spark adds the histograms up, the digit
in which the wanted place falls is kept, and the next round refines it.  A chunk of rows
returns its best buckets only until they hold the wanted number: later ones cannot hold
the place.  Where more than ``TIES`` rows share a window's last score, further rounds
refine by the digits of vec_id.  Then only rows at or before the found key are gathered.

Rows are packed once into chunks of ``CHUNK`` vectors, anchors into blocks of about
``BLOCK``; a pass meets ``BLOCKS`` blocks at a time, broadcast (some MB whatever the
table), with every chunk where it lies, so vectors are never shuffled.  Passes grow with
anchors times rows, as the stated queries do; memory and shuffles do not.

Edge cases: rows with a null label, vec_id or vector, a null or non-finite component, or
a squared norm of ``2**55`` or more after scaling (scores would not fit) take no part;
scores are taken between vectors of equal length; rows that share an anchor's vec_id are
repeats of it, never its positives or negatives; other repeated rows count each; anchors
that repeat with the same label and vector count once, others each for themselves; an
empty table, or one without anchors, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .centroids import integer_rows
from .textkit import cut

#: Vectors in a chunk, anchors in a block (about), blocks in a broadcast, bits of a digit, equal scores gathered at most.
CHUNK, BLOCK, BLOCKS, DIGIT, TIES = 2048, 512, 16, 8, 1000
#: Squared norms stay below this, so 100 times a score fits a long.
NORM = 2.0**55
WIDE = 1 << DIGIT
_ON = ["dim", "block", "anchor", "win"]
_WINDOW = "anchor int, win int, top long, low long, want long, prefix long, place long"


def _chunks(rows: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, packed: dim, ids, labels and integers of up to ``CHUNK`` vectors, and the largest squared norm."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, lengths, values = integer_rows(batch, "embedding", scale)
            ends = np.cumsum(lengths)
            named = np.asarray(batch.column("vec_id").is_valid()) & np.asarray(batch.column("label").is_valid())
            ids, labels = (np.asarray(batch.column(c).cast(pa.int64()).fill_null(0)) for c in ("vec_id", "label"))
            for dim in np.unique(lengths):
                which = np.flatnonzero((lengths == dim) & named[good])
                matrix = values[(ends[which] - dim)[:, None] + np.arange(dim)]
                norms = (matrix**2).sum(axis=1)
                small = norms < NORM
                which, matrix, norms = good[which[small]], matrix[small].astype("<i4"), norms[small]
                for at in range(0, len(which), CHUNK):
                    part = which[at : at + CHUNK]
                    packed = [ids[part].astype("<i8"), labels[part].astype("<i8"), matrix[at : at + CHUNK]]
                    row = [[int(dim)], *([x.tobytes()] for x in packed), [float(norms[at : at + CHUNK].max())]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 3, pa.float64()), strict=True)], names=["dim", "ids", "labels", "q", "norm"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, "dim int, ids binary, labels binary, q binary, norm double")


def _anchor_rows(chunks: DataFrame, every: int) -> DataFrame:
    """(dim, anchor_id, label, q) of the distinct rows whose vec_id is divisible by ``every``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, labels, q in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "labels", "q")), strict=True):
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                which = np.flatnonzero(ids % every == 0)
                blobs = [q[4 * dim * k : 4 * dim * (k + 1)] for k in which]
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(which), pa.int32()), pa.array(ids[which]), pa.array(labels[which]), pa.array(blobs, pa.binary())], names=["dim", "anchor_id", "label", "q"])

    return chunks.select("dim", "ids", "labels", "q").mapInArrow(run, "dim int, anchor_id long, label long, q binary").distinct()


def _blocks(anchors: DataFrame) -> DataFrame:
    """Anchors dealt by hash into blocks, as one row each: dim, block, members (id, label, q) in a fixed order."""
    blocks = -(-anchors.count() // BLOCK)
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_id", "label", "q"), F.lit(max(blocks, 1))))
    return dealt.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("anchor_id", "label", "q"))).alias("members"))


def _scores(rows: np.ndarray, anchors: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: float64 holds every partial sum below ``2**53``, else integers."""
    if bound < 2.0**52:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    return rows.astype(np.int64) @ anchors.astype(np.int64).T


def _keys(batch: pa.RecordBatch, k: int, same: bool) -> tuple:
    """Of chunk and block ``k`` of a batch: windows, and for every row in a window its window's place, key digits and score."""
    dim = batch.column("dim")[k].as_py()
    ids, labels = (np.frombuffer(batch.column(c)[k].as_py(), "<i8") for c in ("ids", "labels"))
    rows = np.frombuffer(batch.column("q")[k].as_py(), "<i4").reshape(len(ids), dim)
    members = batch.column("members")[k].values.flatten()
    anchor_ids, anchor_labels = np.asarray(members[0]), np.asarray(members[1])
    anchors = np.frombuffer(b"".join(members[2].to_pylist()), "<i4").reshape(len(anchor_ids), dim)
    wins = {f.split()[0]: np.asarray(c) for f, c in zip(_WINDOW.split(", "), batch.column("wins")[k].values.flatten(), strict=True)}
    norm = max(batch.column("norm")[k].as_py(), float((anchors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    score = _scores(rows, anchors, norm)
    # Windows stand in order of their anchor; a pair of row and anchor is tried in all of the anchor's windows.
    first, count = np.searchsorted(wins["anchor"], np.arange(len(anchor_ids))), np.bincount(wins["anchor"], minlength=len(anchor_ids))
    least = np.full(len(anchor_ids), np.iinfo(np.int64).max)
    np.minimum.at(least, wins["anchor"], wins["low"])
    related = (labels[:, None] == anchor_labels[None, :]) == same
    row, anchor = np.nonzero(related & (ids[:, None] != anchor_ids[None, :]) & (score >= least[None, :]))
    times = count[anchor]
    win = np.repeat(first[anchor] - np.cumsum(times) + times, times) + np.arange(times.sum())
    row, value = np.repeat(row, times), np.repeat(score[row, anchor], times)
    inside = (value >= wins["low"][win]) & (value <= wins["top"][win])
    return wins, win[inside], value[inside], ids[row[inside]]


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """Ids in an order that shifts keep."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def _histogram(pairs: DataFrame, same: bool, shift: int, by_id: bool) -> DataFrame:
    """(dim, block, anchor, win, bucket, n): rows by the next digit among those with the digits found before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                wins, win, score, ids = _keys(batch, k, same)
                ahead = wins["top"][win] - score
                if by_id:
                    there, key = ahead == wins["place"][win], _unsigned(ids)
                else:
                    there, key = np.ones(len(win), dtype=bool), ahead.view(np.uint64)
                found = (key >> np.uint64(shift + DIGIT)) if shift + DIGIT < 64 else np.zeros_like(key)
                there &= found == wins["prefix"][win].view(np.uint64)
                digit = (key[there] >> np.uint64(shift)) & np.uint64(WIDE - 1)
                n = np.bincount(win[there] * WIDE + digit.astype(np.int64), minlength=len(wins["win"]) * WIDE).reshape(-1, WIDE)
                before = np.cumsum(n, axis=1) - n
                at, bucket = np.nonzero((n > 0) & (before < wins["want"][:, None]))
                same_for_all = [pa.array(np.full(len(at), batch.column(c)[k].as_py())) for c in ("dim", "block")]
                columns = [*same_for_all, *map(pa.array, (wins["anchor"][at], wins["win"][at], bucket, n[at, bucket]))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=[*_ON, "bucket", "n"])

    out = pairs.mapInArrow(run, "dim int, block long, anchor int, win int, bucket long, n long")
    return out.groupBy(*_ON, "bucket").agg(F.sum("n").alias("n"))


def _gathered(pairs: DataFrame, same: bool, shift: int) -> DataFrame:
    """(dim, block, anchor, win, score, vec_id, n) of the rows at or before each window's key; n counts repeated rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                wins, win, score, ids = _keys(batch, k, same)
                ahead, place = wins["top"][win] - score, wins["place"][win]
                least = _unsigned(ids) >> np.uint64(shift) if shift < 64 else np.zeros(len(ids), dtype=np.uint64)
                there = (ahead < place) | ((ahead == place) & (least <= wins["prefix"][win].view(np.uint64)))
                found, n = np.unique(np.stack([win[there], score[there], ids[there]]), axis=1, return_counts=True)
                same_for_all = [pa.array(np.full(len(n), batch.column(c)[k].as_py())) for c in ("dim", "block")]
                columns = [*same_for_all, *map(pa.array, (wins["anchor"][found[0]], wins["win"][found[0]], found[1], found[2], n))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=[*_ON, "score", "vec_id", "n"])

    return pairs.mapInArrow(run, "dim int, block long, anchor int, win int, score long, vec_id long, n long")


def _pairs(chunks: DataFrame, blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """Every chunk beside every block of its length, the block with its windows; only blocks move."""
    names = [f.split()[0] for f in _WINDOW.split(", ")]
    wins = windows.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("wins"))
    return chunks.join(F.broadcast(blocks.join(wins, ["dim", "block"])), "dim")


def _select(chunks: DataFrame, blocks: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """(dim, block, anchor, win, rank, vec_id, score): the first ``k`` rows of every window (dim, block, anchor, win, top, low)."""
    span = windows.agg(F.max(F.col("top") - F.col("low"))).first()[0]
    if span is None:
        return windows.select(*_ON, F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    state = windows.withColumns({"want": F.lit(k).cast("long"), "prefix": F.lit(0).cast("long"), "place": F.lit(0).cast("long")})
    few = None  # windows of fewer than k rows: all of them are gathered
    by_id, shift = False, DIGIT * (-(-max(span.bit_length(), 1) // DIGIT))
    while True:
        shift -= DIGIT
        counted = _histogram(_pairs(chunks, blocks, state), same, shift, by_id)
        running = F.sum("n").over(Window.partitionBy(*_ON).orderBy("bucket"))
        # The bucket of the wanted place, or the last one where there are fewer rows.
        step = counted.join(state.select(*_ON, "want"), _ON).withColumn("upto", running)
        reached = F.col("upto") >= F.col("want")
        held = step.groupBy(*_ON).agg(
            F.min(F.when(reached, F.struct("bucket", "n", "upto"))).alias("hit"), F.max("upto").alias("rows")
        )
        joined = cut(state.join(held, _ON))
        done = joined.filter("hit IS NULL").select(state.columns).withColumns({"place": F.lit((1 << 63) - 1), "prefix": F.lit(0).cast("long")})
        few = done if few is None else few.unionByName(done)
        state = joined.filter("hit IS NOT NULL").select(
            *_ON, "top", "low", (F.col("want") - F.col("hit.upto") + F.col("hit.n")).alias("want"),
            F.expr(f"shiftleft(prefix, {DIGIT}) | hit.bucket").alias("prefix"), "place", F.col("hit.n").alias("ties"),
        )
        most = None
        if not shift:
            if by_id:
                break
            most = state.agg(F.max("ties")).first()[0] or 0
            state = state.withColumns({"place": F.col("prefix"), "prefix": F.lit(0).cast("long")})
            by_id, shift = True, 64
        elif by_id:
            most = state.agg(F.max("ties")).first()[0] or 0
        state = state.drop("ties")
        if most is not None and most <= TIES:
            break
    found = _gathered(_pairs(chunks, blocks, state.select(few.columns).unionByName(few)), same, shift)
    found = found.groupBy(*_ON, "score", "vec_id").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_ON).orderBy(F.desc("score"), "vec_id"))
    ranks = F.sequence(F.col("upto") - F.col("n") + 1, F.least("upto", F.lit(k).cast("long")))
    found = found.withColumn("upto", upto).filter(F.col("upto") - F.col("n") < k)
    return found.select(*_ON, F.explode(ranks).alias("rank"), "vec_id", "score").withColumn("rank", F.col("rank").cast("int"))


def _share(score: str, percent: int, up: bool) -> Column:
    """``percent`` of a score, exactly, to the next whole number above or below."""
    sign = -1 if up else 1
    x = f"({sign * percent} * {score})"
    return F.expr(f"{sign} * (({x} - pmod({x}, 100)) div 100)")


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """Hard negatives of the anchors (rows whose vec_id is divisible by ``every``) among all rows (vec_id, embedding, label).

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its
    first ``positives`` rows of equal label, the first ``negatives`` rows of other labels whose score is between ``low``
    and ``high`` percent of the positive's.
    """
    chunks = cut(_chunks(rows, scale))
    blocks = cut(_blocks(cut(_anchor_rows(chunks, every))))
    limit = int(chunks.agg(F.max("norm")).first()[0] or 0) + 1  # no score is larger, by both norms
    turns = -(-(blocks.agg(F.max("block")).first()[0] or 0) // BLOCKS) + 1
    out = []
    for turn in range(turns):
        some = blocks.filter(F.floor(F.col("block") / BLOCKS) == turn)
        anchors = some.select("dim", "block", F.posexplode("members").alias("anchor", "member"))
        own = anchors.select("dim", "block", "anchor", F.lit(0).alias("win"), F.lit(limit).cast("long").alias("top"), F.lit(-limit).cast("long").alias("low"))
        first = cut(_select(chunks, some, own, positives, same=True))
        windows = first.select("dim", "block", "anchor", F.col("rank").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        windows = windows.withColumns({"low": _share("positive_score", low, True), "top": _share("positive_score", high, False)}).filter("low <= top")
        found = cut(_select(chunks, some, windows.select(*_ON, "top", "low"), negatives, same=False))
        named = anchors.select("dim", "block", "anchor", F.col("member.anchor_id").alias("anchor_id"))
        out.append(
            found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
            .join(windows, _ON)
            .join(named, ["dim", "block", "anchor"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        )
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def relabelled(rows: DataFrame) -> DataFrame:
    """The rows of ``embeddings`` with the label that the mining query takes: every seventh id's is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", label.alias("label"))


SQL = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.l = r.l AS same,
    CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r AS a, r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
