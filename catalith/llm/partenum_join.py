"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct ``WIDTH``-word shingles (lower-cased A-Z); with fewer
words, the whole sequence; with none, empty and linked with nothing.  Two documents
link when ``100 * intersection >= 75 * union``; component_id is the least doc_id that
links reach.

1. *Classes.*  Documents with equal sets are one class (a 128-bit digest of the set).
   Everything below is per class: no pair of copies is ever made.
2. *Signatures.*  Sizes fall into bands whose edges grow by 4/3, so two sets that link
   are in the same band or in adjacent ones.  A set signs its own band and, as the
   smaller partner, the next.  A band splits the feature domain into n parts by hash; a
   signature is the content of one non-empty part.  Sets of sizes x <= y that link differ
   in at most k = (x + y) / 7 features, which touch at most k parts, and n is chosen so
   that the larger set has well over k non-empty parts: at least one of them is equal
   in both.
3. *Prefixes.*  All sets rank the signatures of a band alike, by the number of classes that
   hold them.  Two sets that link differ in at most k parts, so the rarest signature they
   share is among the k + 1 rarest of each: a class stays in those buckets only, and a
   class with over k signatures of its own in none.
4. *Candidates.*  Buckets of up to ``BUCKET`` classes give their pairs.  Classes that larger
   buckets tie together (common passages, large groups of near copies) are one *crowd*;
   a crowd is dealt to blocks, and every two blocks are compared in full, by products of
   their incidence matrices, of which only degrees and a spanning forest come back.
5. *Check.*  Every pair of small buckets is checked on the sets themselves, so ``n_links`` is
   the number of other classes (distinct sets) that a document's set links with.

Edge cases: null texts and texts without words have size 0 and are components of their
own; repeated rows are members of one class; texts of any length are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .textkit import Words, cut, map_slices, mix64, signed, split_words, text_buffer

WIDTH = 5
#: Classes in a bucket that is paired row by row; classes and features in a block of a crowd.
BUCKET, BLOCK, BLOCK_FEATURES = 16, 256, 1 << 19
#: Columns of an incidence matrix that are multiplied at once.
_COLUMNS = 4096
#: Features in a part, on average, for the largest sets of a band, by the band's upper edge.
_PARTS = ((64, 1 / 16), (256, 1.5), (None, 2.5))


def band_edges(largest: int) -> np.ndarray:
    """Upper edges of the size bands, up to one that holds ``largest``, and one more."""
    edges = [0, 1]
    while edges[-2] < largest:
        edges.append(edges[-1] * 4 // 3 + 1)
    return np.array(edges)


def parts_of(edge: int) -> int:
    share = next(s for limit, s in _PARTS if limit is None or edge <= limit)
    return max(1, int(np.ceil(edge / share)))


def shingle_sets(batch: pa.RecordBatch, width: int = WIDTH) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, row, shingle) of the distinct shingles of each row, by row and hash."""
    words = split_words(*text_buffer(batch.column("text")), lower=True)
    hashes = words.hashes()
    at, shingle = words.windows(hashes, width)
    row = words.row[at]
    for k in np.flatnonzero((words.counts > 0) & (words.counts < width)).tolist():
        whole = np.array([words.counts[k]], dtype=np.uint64)
        for h in hashes[words.first[k] : words.first[k + 1]]:
            whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + h)
        row, shingle = np.append(row, k), np.append(shingle, whole)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return words, row[new], shingle[new]


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Wrapping sums of the values of each row."""
    sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)]
    return np.diff(sums[np.searchsorted(row, np.arange(rows + 1))])


def set_digests(row: np.ndarray, shingle: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit digests) of each row's set; the second confirms the first."""
    size = np.bincount(row, minlength=rows).astype(np.int64)
    first = mix64(_per_row(mix64(shingle ^ np.uint64(0x5851F42D4C957F2D)), row, rows) + size.astype(np.uint64))
    return size, first, _per_row(mix64(shingle + np.uint64(0x14057B7EF767814F)), row, rows)


def _digest_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, row, shingle = shingle_sets(batch)
    size, s1, s2 = set_digests(row, shingle, batch.num_rows)
    columns = [batch.column("doc_id"), batch.column("row"), pa.array(size), signed(s1), signed(s2)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "size", "s1", "s2"])


def signatures(row: np.ndarray, shingle: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, band offset 0 or 1, signature) of every non-empty part in a set's own band and the next."""
    edges = band_edges(int(size.max(initial=1)))
    band = np.searchsorted(edges, size)
    parts = np.array([parts_of(e) for e in edges], dtype=np.uint64)
    out = []
    for up in (0, 1):
        b = band[row] + up
        part = mix64(shingle ^ (b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % parts[b]
        order = np.lexsort((part, row))
        r, p, s = row[order], part[order], mix64(shingle[order])
        begin = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])]) if len(r) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(s, begin) if len(begin) else s
        b = (band[r[begin]] + up).astype(np.uint64)
        out.append((r[begin], np.full(len(begin), up), mix64(total + mix64(p[begin] * np.uint64(1 << 20) + b))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spare_parts(row: np.ndarray, up: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each signature: how many of its set's in the same band are outside the k + 1 rarest."""
    edges = band_edges(int(size.max(initial=1)))
    largest = np.minimum(4 * size[row] // 3, edges[np.searchsorted(edges, size)[row] + up])
    parts = np.bincount(row * 2 + up, minlength=2 * len(size))[row * 2 + up]
    return np.maximum(parts - (size[row] + largest) // 7 - 1, 0)


def _signature_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Signature rows of the distinct sets of a slice; copies sign once."""
    _, row, shingle = shingle_sets(batch)
    size, s1, _ = set_digests(row, shingle, batch.num_rows)
    first = np.zeros(batch.num_rows, dtype=bool)
    first[np.unique(s1, return_index=True)[1]] = True
    pick = first[row]
    row, up, signature = signatures(row[pick], shingle[pick], size)
    spare = spare_parts(row, up, size)
    return pa.RecordBatch.from_arrays(
        [signed(signature), signed(s1[row]), pa.array((spare * 2 + up).astype(np.int32))], names=["sig", "s1", "code"]
    )


def _set_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, row, shingle = shingle_sets(batch)
    _, s1, _ = set_digests(row, shingle, batch.num_rows)
    bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
    sets = pa.ListArray.from_arrays(pa.array(bounds), signed(np.ascontiguousarray(shingle)))
    return pa.RecordBatch.from_arrays([signed(s1), sets], names=["s1", "shingles"])


def candidates(signed_sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes a < b in small buckets, links between the classes of each large bucket).

    ``signed_sets``: sig, s1 (class), code (twice the spare parts of the set in the band,
    plus 1 for a signature in the band above).  Two signatures from the band above need no
    bucket: their sets meet in their own band.
    """
    same = Window.partitionBy("sig")
    up = F.pmod("code", F.lit(2))
    bounds = [f("s1").over(same).alias(n) for n, f in (("lo", F.min), ("hi", F.max))]
    met = signed_sets.select("*", *bounds, F.min(up).over(same).alias("own"))
    met = met.filter("lo <> hi and own = 0").select("sig", "s1", "code").distinct()
    met = met.select("*", F.count(F.lit(1)).over(same).alias("held"))
    # Signatures that no other class holds are the rarest, so the spare ones are the most held.
    place = F.row_number().over(Window.partitionBy("s1", "code").orderBy(F.desc("held"), F.desc("sig")))
    rare = met.withColumn("place", place).filter(F.col("place") > F.shiftright("code", 1)).select("sig", "s1", up.alias("up"))
    bucket = [F.count(F.lit(1)).over(same).alias("held"), F.min("s1").over(same).alias("lo"), F.min("up").over(same).alias("own")]
    rare = cut(rare.select("*", *bucket).filter("held > 1 and own = 0"))
    tied = rare.filter(F.col("held") > BUCKET).filter("s1 <> lo").select(F.col("lo").alias("a"), F.col("s1").alias("b"))
    grouped = rare.filter(F.col("held") <= BUCKET).groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("s1", "up"))).alias("m"))
    ones = grouped.select("m", F.posexplode("m").alias("i", "x"))
    twos = ones.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y")).filter("x.up = 0 or y.up = 0")
    return twos.select(F.col("x.s1").alias("a"), F.col("y.s1").alias("b")).distinct(), tied


def linked_matrix(first: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """Which of the sets ``shingle[first[i]:first[i + 1]]`` link with which others."""
    size = np.diff(first)
    column, row = np.unique(shingle, return_inverse=True)[1], np.repeat(np.arange(len(size)), size)
    shared = np.bincount(column)[column] > 1
    column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(size), len(size)), dtype=np.float32)  # counts are exact below 2**24
    for at in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
        held = np.zeros((len(size), _COLUMNS), dtype=np.float32)
        held[row[lo:hi], column[lo:hi] - at] = 1
        both += held @ held.T
    count = both.astype(np.int64)
    link = 100 * count >= 75 * (size[:, None] + size[None, :] - count)
    np.fill_diagonal(link, False)
    return link


def _block_pair(table: pa.Table) -> pa.Table:
    """(s1, tie, degree) of the classes of two blocks: the least linked class reached inside, and links not seen elsewhere."""
    s1, block = (table.column(c).to_numpy() for c in ("s1", "block"))
    sets = table.column("shingles").combine_chunks()
    first = np.r_[0, np.cumsum(sets.value_lengths().to_numpy())]
    link = linked_matrix(first, sets.flatten().to_numpy())
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():
        link &= block[:, None] != block[None, :]
    label = np.arange(len(s1))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(s1)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pa.table({"s1": s1, "tie": s1[label], "degree": link.sum(1).astype(np.int64)})


def _crowd_links(crowds: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(s1, tie, degree) rows of every two blocks of each crowd (s1, crowd)."""
    sized = crowds.join(classes.select("s1", "size"), "s1")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_FEATURES)).cast("int")
    dealt = sized.join(sized.groupBy("crowd").agg(blocks.alias("blocks")), "crowd")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "s1", "block")
    return dealt.join(sets, "s1").groupBy("crowd", "i", "j").applyInArrow(_block_pair, "s1 long, tie long, degree long")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose sets link."""
    one = pairs.join(sets.select(F.col("s1").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("s1").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return two.filter(100 * both >= 75 * (F.size("x") + F.size("y") - both)).select("a", "b")


def _linked(rows: DataFrame) -> DataFrame:
    """Per row (doc_id, text, row): size, component (a label, null for empty sets), component_id and n_links of its class."""
    docs = rows.select("doc_id", "text")
    members = cut(map_slices(rows, _digest_rows, "doc_id long, row long, size long, s1 long, s2 long"))
    classes = cut(members.filter("size > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size")))
    pairs, tied = candidates(map_slices(docs, _signature_rows, "sig long, s1 long, code int"))
    crowds = cut(components(tied).select(F.col("node").alias("s1"), F.col("component").alias("crowd")))
    side = lambda c: classes.select(F.col("s1").alias(c), F.col("size").alias(f"size_{c}"))
    crowd = lambda c: crowds.select(F.col("s1").alias(c), F.col("crowd").alias(f"crowd_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter("4 * least(size_a, size_b) >= 3 * greatest(size_a, size_b)")
    # Pairs inside a crowd are compared there.
    pairs = pairs.join(crowd("a"), "a", "left").join(crowd("b"), "b", "left")
    pairs = cut(pairs.filter("crowd_a is null or crowd_b is null or crowd_a <> crowd_b").select("a", "b"))
    # Sets of the classes to compare, from the texts of one document each.
    wanted = pairs.select(F.col("a").alias("s1")).union(pairs.select(F.col("b").alias("s1"))).union(crowds.select("s1")).distinct().join(classes, "s1")
    texts = docs.join(wanted.select("rep"), docs["doc_id"].eqNullSafe(F.col("rep")), "left_semi")
    sets = map_slices(texts, _set_rows, "s1 long, shingles array<long>").join(wanted.select("s1"), "s1", "left_semi")
    sets = cut(sets.groupBy("s1").agg(F.first("shingles").alias("shingles")))
    checked, crowded = cut(_checked(pairs, sets)), cut(_crowd_links(crowds, classes, sets))
    links = checked.union(crowded.filter("s1 <> tie").select(F.col("tie").alias("a"), F.col("s1").alias("b")))
    final = components(links)
    labelled = classes.join(final.withColumnRenamed("node", "s1"), "s1", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", F.col("s1")))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    degree = checked.select(F.explode(F.array("a", "b")).alias("s1"), F.lit(1).cast("long").alias("degree")).union(crowded.select("s1", "degree"))
    degree = degree.groupBy("s1").agg(F.sum("degree").alias("n_links"))
    known = labelled.join(least, "component").join(degree, "s1", "left")
    known = cut(known.select("s1", "s2", "component", "component_id", "n_links"))
    return members.join(known, ["s1", "s2"], "left")


def link_documents(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): n_shingles, component_id and n_links of its class."""
    return _linked(docs.select("doc_id", "text", F.lit(0).cast("long").alias("row"))).select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text and others) without near copies: one row of each component, with the least doc_id.

    Rows are told apart by doc_id and a hash of all they hold; of rows equal in both one
    stays.  Rows without words link with nothing and stay.
    """
    names = docs.columns
    rows = docs.withColumn("_row", F.xxhash64(*names))
    linked = cut(_linked(rows.select("doc_id", "text", F.col("_row").alias("row"))))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = linked.filter("component is not null").groupBy("component").agg(F.min_by(F.struct("doc_id", "row"), place).alias("r"))
    stay = first.select("r.*").union(linked.filter("component is null").select("doc_id", "row").distinct())
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("row").alias("_kept"))
    kept = rows.join(stay, F.col("_row").eqNullSafe(F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    again = linked.groupBy("doc_id", "row").count().filter("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_row"])
    return kept.select(names)


#: The same result in SQL, over a table ``documents``.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), class AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id
), degree AS (
  SELECT a, count(DISTINCT cb.k) AS n FROM link JOIN class ca ON ca.doc_id = a JOIN class cb ON cb.doc_id = b WHERE ca.k <> cb.k GROUP BY a
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, coalesce(any_value(degree.n), 0)::BIGINT AS n_links
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN degree ON degree.a = d.doc_id GROUP BY d.doc_id
"""
