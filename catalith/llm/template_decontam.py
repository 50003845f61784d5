"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words lose the punctuation around them and their case; numbers, numbers glued to a
unit, units behind a number, and names (capitalised words inside a sentence) become
typed placeholders.  Windows of ``WIDTH`` canonical words of the documents are
hash-joined with those of the benchmark, so a question with other numbers or names
still matches.  A match counts only if its slots are consistent: along one alignment of
document and item, equal values in the item stand against equal values in the document.
Where they do not, the alignment still counts for its copied runs: windows whose values
are all the same, if a run of them has a window without slots or ``2 * WIDTH`` words.

Texts are canonicalised by a few passes of whole-text replacement and cut into words
once; windows are hashed behind an explode of their positions, inside whole-stage code
generation, and only those that meet the benchmark go on.

Returns one row per document and item that match: doc_id, item_id, n_windows (distinct
windows of the item found), n_slots (distinct slot values compared), exact (no value
differs), first_word (of the match, from 0, among words with a letter or digit).

Edge cases: null or empty texts match nothing; windows with fewer than ``LITERAL`` plain
words match by their bare words, not by placeholders; an item shorter than a window
matches whole, anywhere in a document, and one of fewer than ``LITERAL`` words a document
that is nothing else; rows that repeat a doc_id, or have none, are told apart by their
texts; an empty benchmark gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import cut

WIDTH, LITERAL = 8, 5
#: Windows of the benchmark up to which they are broadcast (about 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 500_000
#: Fixed list of units.
UNITS = (
    "kg g mg lb oz km m cm mm mi ft in l ml h min s ms kb mb gb tb hz w v a c "
    "hours minutes seconds days weeks months years miles meters metres euros dollars "
    "horas minutos segundos días semanas meses años metros heures minutes secondes jours semaines mois ans mètres "
    "stunden minuten sekunden tage wochen monate jahre meter"
).split()
_NUMBER = r"[$€£]?[0-9](?:[0-9.,]*[0-9])?%?"
_QUANTITY = r"[0-9](?:[0-9.,]*[0-9])?(?:kg|g|mg|lb|oz|km|m|cm|mm|mi|ft|l|ml|h|min|s|ms|kb|mb|gb|tb|hz|w|v)"
_NAME = r"\p{Lu}\p{Ll}+"
#: White space and what precedes a word; what follows one, with its sentence mark; a word's end.
_BEFORE = r"[\x20\x09-\x0D]++(?:[^\p{L}\p{N}$€£]|[$€£](?![0-9]))*+"
_EDGE = r"[^\p{L}\p{N}%\x20]"
_BEHIND = rf"(?<!{_EDGE})(?:{_EDGE}*?([.!?:]){_EDGE}*+|{_EDGE}++)(?= )"
_END = "[.!?:]? "


def _canonical(table: DataFrame, key: list[str]) -> DataFrame:
    """The key, bare and canonical words of each text, and where its first placeholder is (0: none)."""
    units = "|".join(UNITS)
    plain = F.regexp_replace(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")), _BEFORE, " ")
    with_units = F.regexp_replace("plain", f" {_NUMBER} (?iu:{units})(?=[.!?:]? )", " <num> <unit>")
    with_numbers = F.regexp_replace(with_units, f" {_NUMBER}(?=[.!?:]? )", " <num>")
    typed = F.regexp_replace(with_numbers, f" (?i:{_QUANTITY})(?=[.!?:]? )", " <qty>")
    named = F.regexp_replace("typed", r" \p{Lu}(?<=[^.!?: ] .)\p{Ll}+(?=[.!?:]? )", " <name>")
    words = lambda c: F.split(F.lower(c), _END)
    step = table.select(*key, F.regexp_replace(plain, _BEHIND, "$1").alias("plain"))
    step = step.select(*key, "plain", F.when(F.col("plain").rlike("[0-9]"), typed).otherwise(F.col("plain")).alias("typed"))
    step = step.select(*key, words("plain").alias("bare"), named.alias("typed"))
    step = step.select(*key, "bare", "typed", F.instr("typed", " <").alias("slotted"))
    step = step.select(*key, "bare", "slotted", F.when(F.col("slotted") > 0, words("typed")).otherwise(F.col("bare")).alias("canon"))
    inner = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0))).alias(c)
    return step.select(*key, inner("bare"), inner("canon"), "slotted")


def _places(last: Column) -> Column:
    """Positions from 0 to ``last``, none if it is negative.

    Code generation computes what an explode refers to once per row, and all else once per
    exploded row; so the columns that are carried along are named, by conditions that hold.
    """
    carried = (F.size("bare") >= 0) & (F.size("canon") >= 0) & (F.col("slotted") >= 0)
    return F.when(carried & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hash(words: str, n: int, *first: Column) -> Column:
    return F.xxhash64(*first, *(F.get(words, F.col("at") + k) for k in range(n)))


def _windows(table: DataFrame, key: list[str]) -> DataFrame:
    """(key, h, at, bare, canon) of every window; the words are those of the whole text."""
    words = _canonical(table, key)
    placed = words.select("*", F.explode(_places(F.size("canon") - WIDTH)).alias("at"))
    is_slot = lambda k: F.when(F.startswith(F.get("canon", F.col("at") + k), F.lit("<")), 1).otherwise(0)
    dense = (F.col("slotted") > 0) & (sum((is_slot(k) for k in range(1, WIDTH)), is_slot(0)) > WIDTH - LITERAL)
    # Windows of mostly placeholders are hashed by their bare words.
    h = F.when(dense, _hash("bare", WIDTH, F.lit("bare"))).otherwise(_hash("canon", WIDTH))
    return placed.select(*key, h.alias("h"), "at", "bare", "canon")


def _window_words() -> list[Column]:
    return [F.slice(c, F.col("at") + 1, WIDTH).alias(c) for c in ("bare", "canon")]


def _item_windows(benchmark: DataFrame) -> DataFrame:
    items = _windows(benchmark, ["item_id"]).select("item_id", "h", F.col("at").alias("item_at"), *_window_words())
    items = cut(items.withColumnsRenamed({"bare": "item_bare", "canon": "item_canon"}))
    return items.withColumn("item_dense", F.size(F.filter("item_canon", lambda w: w.startswith("<"))) > WIDTH - LITERAL)


def _met(docs: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """Windows of documents beside equal windows of items, with the words of both."""
    found = _windows(docs, key)
    equal = lambda bare, canon: F.when(F.col("item_dense"), bare == F.col("item_bare")).otherwise(canon == F.col("item_canon"))
    bare, canon = _window_words()
    if items.count() <= BROADCAST_WINDOWS:
        met = found.join(F.broadcast(items), "h").filter(equal(bare, canon))
        # The explode of one struct keeps the texts' words out of what follows.
        one = F.explode(F.array(F.struct(bare, canon))).alias("w")
        return met.select(*key, "item_id", "at", "item_at", "item_bare", "item_canon", one).select("*", "w.*").drop("w")
    met = found.select(*key, "h", "at", bare, canon).join(items, "h")
    return met.filter(equal(F.col("bare"), F.col("canon")))


def _short_items(docs: DataFrame, benchmark: DataFrame, key: list[str]) -> DataFrame | None:
    """Rows of the items that are shorter than a window; None if there are none."""
    items = cut(_canonical(benchmark, ["item_id"])).filter(F.size("bare").between(1, WIDTH - 1))
    items = cut(items.select("item_id", F.size("bare").alias("n"), F.concat_ws(" ", "bare").alias("run"), F.lit(0).alias("at"), "bare"))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # seven at most
    if not lengths:
        return None
    size = F.size("bare")
    fits = lambda n: F.col("at") + n <= size if n >= LITERAL else (F.col("at") == 0) & (size == n)
    run = lambda n: F.when(fits(n), F.struct(F.lit(n).alias("n"), _hash("bare", n).alias("h")))
    placed = _canonical(docs, key).select(*key, "bare", F.explode(_places(size - 1)).alias("at"))
    runs = placed.select(*key, "bare", "at", F.explode(F.array(*map(run, lengths))).alias("w")).filter("w is not null")
    words = F.concat_ws(" ", F.slice("bare", F.col("at") + 1, F.col("w.n")))
    item_hash = F.coalesce(*(F.when(F.col("n") == n, _hash("bare", n)) for n in lengths))
    items = items.select("item_id", F.col("n").alias("item_n"), "run", item_hash.alias("h"))
    runs = runs.select(*key, "at", F.col("w.n").alias("n"), F.col("w.h").alias("h"), words.alias("words"))
    met = runs.join(items, "h").filter("n = item_n and words = run").groupBy(*key, "item_id").agg(F.min("at").cast("long").alias("first_word"))
    one = lambda n: F.lit(n).cast("long")
    return met.select(*key, "item_id", one(1).alias("n_windows"), one(0).alias("n_slots"), F.lit(True).alias("exact"), "first_word")


def _copied(same: Column) -> Column:
    """Of windows without a changed value, by item_at, those in runs that are evidence by themselves."""
    start = F.array().cast("array<struct<lo:int,hi:int,plain:boolean>>")

    def merge(runs: Column, w: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        plain = F.size(w["pairs"]) == 0
        run = lambda lo, p: F.array(F.struct(lo.alias("lo"), w["item_at"].alias("hi"), p.alias("plain")))
        touches = F.coalesce(w["item_at"] - last["hi"] <= WIDTH, F.lit(False))
        return F.when(touches, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), run(last["lo"], last["plain"] | plain))).otherwise(
            F.concat(runs, run(w["item_at"], plain))
        )

    runs = F.filter(F.aggregate(F.array_sort(same), start, merge), lambda r: r["plain"] | (r["hi"] - r["lo"] >= WIDTH))
    return F.filter(same, lambda w: F.exists(runs, lambda r: (w["item_at"] >= r["lo"]) & (w["item_at"] <= r["hi"])))


def _leaks(docs: DataFrame, benchmark: DataFrame, key: list[str]) -> DataFrame:
    met = _met(docs, _item_windows(benchmark), key)
    slots = F.filter(F.arrays_zip(F.col("item_canon").alias("c"), F.col("item_bare").alias("item"), F.col("bare").alias("doc")), lambda z: z["c"].startswith("<"))
    pairs = F.transform(slots, lambda z: F.struct(z["item"].alias("item"), z["doc"].alias("doc")))
    met = met.select(*key, "item_id", "at", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("pairs"))
    same = F.forall("pairs", lambda p: p["item"] == p["doc"])
    aligned = met.groupBy(*key, "item_id", "shift").agg(
        F.collect_set("item_at").alias("places"),
        F.min("at").alias("first_word"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.collect_set(F.when(same, F.struct("item_at", "pairs"))).alias("same"),
    )
    values = F.array_distinct(F.transform("pairs", lambda p: p["item"]))
    consistent = F.size(values) == F.size("pairs")  # each item value has one document value
    aligned = aligned.select("*", consistent.alias("ok"), F.when(~consistent, _copied(F.col("same"))).alias("copied"))
    aligned = aligned.filter(F.col("ok") | (F.size("copied") > 0))
    copied_places = F.transform("copied", lambda w: w["item_at"])
    aligned = aligned.select(
        *key,
        "item_id",
        F.when(F.col("ok"), F.col("places")).otherwise(copied_places).alias("places"),
        F.when(F.col("ok"), F.col("first_word")).otherwise(F.array_min(copied_places) + F.col("shift")).alias("first_word"),
        F.when(F.col("ok"), F.col("pairs")).otherwise(F.array_distinct(F.flatten(F.transform("copied", lambda w: w["pairs"])))).alias("pairs"),
    )
    out = aligned.groupBy(*key, "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"),
        F.max(F.size("pairs")).cast("long").alias("n_slots"),
        F.max(F.forall("pairs", lambda p: p["item"] == p["doc"])).alias("exact"),
        F.min("first_word").cast("long").alias("first_word"),
    )
    short = _short_items(docs, benchmark, key)
    return out if short is None else out.unionByName(short)


_ROW = ["doc_id", "_text"]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a hash of the text that tells rows of one doc_id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that hold windows of benchmark items (item_id, text)."""
    return _leaks(_rows(docs), benchmark.select("item_id", "text"), _ROW).drop("_text")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold benchmark windows."""
    found = _leaks(_rows(docs), benchmark.select("item_id", "text"), _ROW).select(F.col("doc_id").alias("_id"), "_text").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_text"]), "left_anti")


def _sql_words(table: str, key: str) -> str:
    """One row per text: bare and canonical words."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return rf"""
    SELECT {key}, list_transform(w, lambda x: lower(x.b)) AS bare, list_transform(w, lambda x, i:
        CASE WHEN i > 1 AND lower(x.b) IN ({units}) AND NOT w[i - 1].m AND regexp_matches(w[i - 1].b, '^{_NUMBER}$') THEN '<unit>'
             WHEN regexp_matches(x.b, '^{_NUMBER}$') THEN '<num>'
             WHEN regexp_matches(x.b, '^(?i:{_QUANTITY})$') THEN '<qty>'
             WHEN i > 1 AND NOT w[i - 1].m AND regexp_matches(x.b, '^{_NAME}$') THEN '<name>'
             ELSE lower(x.b) END) AS canon
    FROM (SELECT {key}, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda r:
            {{'b': regexp_replace(regexp_extract(r, '(?:[$€£][0-9]|[\p{{L}}\p{{N}}]).*$'), '[^\p{{L}}\p{{N}}%]+$', ''), 'm': regexp_matches(r, '[.!?:][^\p{{L}}\p{{N}}%]*$')}}), lambda x: x.b <> '') AS w
          FROM {table})"""


def _sql_windows(source: str, key: str) -> str:
    return f"""
  SELECT {key}, pos, CASE WHEN len(list_filter(c, lambda x: x[1] = '<')) > {WIDTH - LITERAL} THEN list_concat(['bare'], b) ELSE c END AS g, c, b
  FROM (SELECT {key}, i - 1 AS pos, list_slice(canon, i, i + {WIDTH - 1}) AS c, list_slice(bare, i, i + {WIDTH - 1}) AS b
        FROM (SELECT {key}, bare, canon, unnest(generate_series(1, len(canon) - {WIDTH - 1})) AS i FROM {source}))"""


#: The same result in SQL, over the tables ``documents`` and ``benchmark``.
SQL = f"""
WITH RECURSIVE dw AS ({_sql_words("documents", "doc_id")}
), bw AS ({_sql_words("benchmark", "item_id")}
), d AS ({_sql_windows("dw", "doc_id")}
), b AS ({_sql_windows("bw", "item_id")}
), met AS (
  SELECT doc_id, item_id, d.pos, b.pos AS item_pos, d.pos - b.pos AS shift,
         list_transform(list_filter(list_zip(b.c, b.b, d.b), lambda z: z[1][1] = '<'), lambda z: row(z[2], z[3])) AS pairs
  FROM d JOIN b USING (g)
), aligned AS (
  SELECT doc_id, item_id, shift, list_distinct(flatten(list(pairs))) AS pairs FROM met GROUP BY ALL
), judged AS (
  SELECT doc_id, item_id, shift, len(list_distinct(list_transform(pairs, lambda p: p[1]))) = len(pairs) AS ok FROM aligned
), copied AS (
  SELECT DISTINCT doc_id, item_id, shift, item_pos, len(pairs) = 0 AS plain FROM met JOIN judged USING (doc_id, item_id, shift) WHERE NOT ok AND len(list_filter(pairs, lambda p: p[1] <> p[2])) = 0
), stepped AS (
  SELECT *, CASE WHEN item_pos - lag(item_pos) OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_pos) <= {WIDTH} THEN 0 ELSE 1 END AS new FROM copied
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_pos) AS run FROM stepped
), evidence AS (
  SELECT doc_id, item_id, shift, item_pos FROM runs
  QUALIFY bool_or(plain) OVER (PARTITION BY doc_id, item_id, shift, run) OR max(item_pos) OVER (PARTITION BY doc_id, item_id, shift, run) - min(item_pos) OVER (PARTITION BY doc_id, item_id, shift, run) >= {WIDTH}
), counted AS (
  SELECT met.* FROM met JOIN judged USING (doc_id, item_id, shift) WHERE ok
  UNION ALL SELECT met.* FROM met JOIN evidence USING (doc_id, item_id, shift, item_pos) WHERE len(list_filter(pairs, lambda p: p[1] <> p[2])) = 0
), per_shift AS (
  SELECT doc_id, item_id, shift, list_distinct(flatten(list(pairs))) AS pairs, list(DISTINCT item_pos) AS places, min(pos) AS first_word FROM counted GROUP BY ALL
), short AS (
  SELECT item_id, len(bare) AS n, bare FROM bw WHERE len(bare) BETWEEN 1 AND {WIDTH - 1}
), short_met AS (
  SELECT doc_id, item_id, min(i - 1) AS first_word
  FROM (SELECT doc_id, bare, unnest(generate_series(1, len(bare))) AS i FROM dw WHERE EXISTS (SELECT 1 FROM short)) w
  JOIN short ON list_slice(w.bare, i, i + n - 1) = short.bare AND (n >= {LITERAL} OR n = len(w.bare)) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, len(list_distinct(flatten(list(places))))::BIGINT AS n_windows, max(len(pairs))::BIGINT AS n_slots,
       bool_or(len(list_filter(pairs, lambda p: p[1] <> p[2])) = 0) AS exact, min(first_word)::BIGINT AS first_word
FROM per_shift GROUP BY doc_id, item_id
UNION ALL SELECT doc_id, item_id, 1::BIGINT, 0::BIGINT, TRUE, first_word::BIGINT FROM short_met
"""
