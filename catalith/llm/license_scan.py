"""License scan by ordered signature rules, in DataFrame functions only.

Texts become lower-case words.  The words that are some rule's keywords say which rules
are tried at all, so most texts meet none.  A rule's regular expression runs over the
words, and its matches give intervals of words; the first and last word of each match are
marked in one replacement, so positions cost time in proportion to the text.

Detections overlap: a name stands inside a notice, a version inside "or any later
version".  They are ordered by start, then the longer, then the stronger level of
evidence, then the order of the rules, and a detection goes if it lies inside one before
it whose level is at least as strong.  One pass over the ordered intervals decides that,
with the furthest end so far of each level.  ``labels`` are those of the detections that
stay and of the base phrases; ``score`` is the confidence of the strongest.

There is no shuffle and no Python: a row's result depends on that row alone, so repeated
rows, null ids and hot sources need no care.

Edge cases: a null or empty text, or one without letters and digits, has no words and no
labels, and null first and last words; base phrases never overlap themselves, so every
place counts; texts are scanned whole; rules of one level with the same interval give the
label of the earlier rule; an empty table gives an empty result; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import LEVELS, PHRASE, rules

#: Base phrases and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"  # no word holds these


def expanded(pattern: str) -> str:
    """The pattern over words that are each set between two spaces of their own, so that neighbouring matches share none."""
    return f" ({pattern.replace(' ?', '(?:  )?').replace(' ', '  ').replace('(?:    )?', '(?:  )?')}) "


def _table() -> list[dict]:
    return [
        {"level": level + 1, "place": place, "label": label, "keys": list(keys), "pattern": expanded(pattern)}
        for place, (level, label, keys, pattern) in enumerate(rules())
    ]


def _literal() -> Column:
    """The rules as one constant: folded once, not rebuilt per row."""
    kind = "array<struct<level int, place int, label string, keys array<string>, pattern string>>"
    return F.from_json(F.lit(json.dumps(_table())), kind)


def _places(spaced: str, pattern: Column) -> tuple[Column, Column]:
    """(first words, last words) of a pattern's matches, from 0."""
    marked = F.split(F.trim(F.regexp_replace(spaced, pattern, F.lit(f" {_OPEN}$1{_CLOSE} "))), "  ")
    first = F.array_compact(F.transform(marked, lambda w, i: F.when(w.startswith(_OPEN), i)))
    last = F.array_compact(F.transform(marked, lambda w, i: F.when(w.endswith(_CLOSE), i)))
    return first, last


def _found(rule: Column) -> Column:
    """The rule's matches as (start, -end, level, place, label), which sort in the order that suppression needs."""
    first, last = _places("spaced", rule["pattern"])
    pair = lambda a, b: F.struct(a.alias("start"), (-b).alias("end"), rule["level"].alias("level"), rule["place"].alias("place"), rule["label"].alias("label"))
    return F.zip_with(first, last, pair)


def _kept(found: Column) -> Column:
    """(labels, level) of the detections that no stronger one before them contains; level 0: none."""
    levels = len(LEVELS)
    start = F.struct(F.array_repeat(F.lit(-1), levels).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("level"))

    def step(acc: Column, d: Column) -> Column:
        inside = F.array_max(F.slice(acc["ends"], 1, d["level"])) >= -d["end"]
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == d["level"], F.greatest(e, -d["end"])).otherwise(e))
        labels = F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"])))
        level = F.when(inside, acc["level"]).when(acc["level"] == 0, d["level"]).otherwise(F.least(acc["level"], d["level"]))
        return F.struct(ends.alias("ends"), labels.alias("labels"), level.alias("level"))

    return F.aggregate(found, start, step)


def _base(spaced: str) -> list[Column]:
    return [F.when(F.contains(spaced, F.lit(f" {p.replace(' ', '  ')} ")), _places(spaced, F.lit(f" ({p.replace(' ', '  ')}) "))[0]) for p in PHRASES]


def scan(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): counts and places of the base phrases, base_labels, labels and score."""
    keywords = sorted({k for rule in _table() for k in rule["keys"]} | {w for p in PHRASES for w in p.split()})
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower())
    words = docs.select("doc_id", F.array_remove(F.split(lower, _BETWEEN), "").alias("words"))
    keyed = words.withColumn("keys", F.array_intersect("words", F.array(*map(F.lit, keywords))))
    spaced = F.when(F.size("keys") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    row = keyed.select("doc_id", F.size("words").cast("long").alias("n_words"), "keys", spaced.alias("spaced"))
    tried = F.filter(_literal(), lambda r: (F.size(F.array_except(r["keys"], F.col("keys"))) == 0) & F.regexp_like("spaced", r["pattern"]))
    row = row.select("doc_id", "n_words", "spaced", F.when(F.col("spaced").isNotNull(), tried).alias("tried"), *(p.alias(f"p{k}") for k, p in enumerate(_base("spaced"))))
    found = F.when(F.size("tried") > 0, _kept(F.array_sort(F.flatten(F.transform("tried", _found)))))
    none = F.array().cast("array<int>")
    places = F.concat(*(F.coalesce(f"p{k}", none) for k in range(len(PHRASES))))
    named = F.array_compact(F.array(*(F.when(F.col(f"p{k}").isNotNull(), F.lit(label)) for k, label in enumerate(PHRASES.values()))))
    row = row.select("doc_id", "n_words", places.alias("places"), named.alias("named"), found.alias("found"))
    at = lambda c: F.col(c).cast("long")
    weight = reduce(lambda c, kw: c.when(F.col("found.level") == kw[0] + 1, kw[1]), enumerate(LEVELS.values()), F.when(F.lit(False), 0.0))
    weight = weight.otherwise(F.when(F.size("named") > 0, PHRASE).otherwise(0.0))
    every = F.array_union("named", F.coalesce("found.labels", F.array().cast("array<string>")))
    return row.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("named"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        weight.alias("score"),
    )


def _sql() -> str:
    """The same by its plain definition: every pair of intervals is compared."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    table = ",\n  ".join(f"({r['level']}, {r['place']}, {text(r['label'])}, [{', '.join(map(text, r['keys']))}], {text(r['pattern'])})" for r in _table())
    base = ", ".join(f"({text(p)}, {text(label)})" for p, label in PHRASES.items())
    weights = " ".join(f"WHEN {k + 1} THEN {w}" for k, w in enumerate(LEVELS.values()))
    marks = "string_split(trim(regexp_replace(spaced, pattern, ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), ' '), '  ')"
    return f"""
WITH rules(level, place, label, keys, pattern) AS (VALUES {table}),
phrases(phrase, label) AS (VALUES {base}),
w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_BETWEEN}'), lambda x: x <> '') AS words FROM documents),
n AS MATERIALIZED (SELECT *, ' ' || array_to_string(words, '  ') || ' ' AS spaced FROM w),
b AS (SELECT rid, label, length(string_split(spaced, ' ' || replace(phrase, ' ', '  ') || ' ')) - 1 AS n, words, len(string_split(phrase, ' ')) AS width, phrase
  FROM n, phrases WHERE contains(spaced, ' ' || replace(phrase, ' ', '  ') || ' ')),
places AS (SELECT rid, label, unnest(list_filter(range(len(words) - width + 1), lambda i: array_to_string(words[i + 1 : i + width], ' ') = phrase)) AS i FROM b),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS named FROM places GROUP BY rid),
u AS (SELECT DISTINCT rid, unnest(words) AS word FROM n),
m AS MATERIALIZED (SELECT rid, level, place, label, {marks} AS marked FROM u JOIN rules ON word = keys[1] JOIN n USING (rid) WHERE list_has_all(words, keys) AND regexp_matches(spaced, pattern)),
d AS MATERIALIZED (SELECT rid, level, place, label, unnest(list_filter(list_transform(marked, lambda x, i: CASE WHEN x[1] = chr(1) THEN i END), lambda x: x IS NOT NULL)) AS s,
    unnest(list_filter(list_transform(marked, lambda x, i: CASE WHEN x[-1] = chr(2) THEN i END), lambda x: x IS NOT NULL)) AS e FROM m),
kept AS (SELECT rid, list(DISTINCT label) AS found, min(level) AS level FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS o
    WHERE o.rid = d.rid AND o.s <= d.s AND o.e >= d.e AND o.level <= d.level AND (o.s < d.s OR o.e > d.e OR o.level < d.level OR o.place < d.place)) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(named), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(named, found))), ','), '') AS labels,
  CAST(CASE level {weights} ELSE CASE WHEN n_base > 0 THEN {PHRASE} ELSE 0 END END AS DOUBLE) AS score
FROM n LEFT JOIN base USING (rid) LEFT JOIN kept USING (rid)"""


SQL = _sql()
