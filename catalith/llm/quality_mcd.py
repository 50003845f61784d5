"""Quality rules: base counts, and robust multivariate outliers by minimum covariance determinant.

Everything is DataFrame and SQL functions.  One pass over the texts gives the counts
of each document; four transformed statistics follow, on an integer grid of 1/64, so
that every sum below is exact and the verdicts do not depend on the order of rows.
Documents with equal statistics are counted together before anything else, so a group
is as large as its part of the grid, whatever its number of documents.

Per language and source (where there are fewer than ``MIN_GROUP`` usable documents, all
those of the language, or else all) the minimum covariance determinant is sought from
three deterministic starts: the documents nearest by coordinate medians and median
deviations, by plain distance from the medians, and by mean and covariance.  From each,
concentration steps (the share ``H`` of documents nearest by Mahalanobis distance gives
the next mean and covariance) run until no determinant falls; the least determinant of
the three stays, and mean and covariance are taken once more over the documents within
the 97.5 % ellipsoid.  ``GUARD``, a grid step squared on the diagonal, keeps matrices of
statistics that are constant in a group regular.

Statistics: log mean word length, and square roots of symbols per word, of the share of
repeated lines, and of the share of words in repeated windows.  A short text says little
of its author's rates: a document's distance is taken under the group's covariance plus
the squared change that chance would make in this document (half a mean word length over
the root of its words; one symbol, one line, one repeated window), where more than
``EVIDENCE`` words count as so many.  A document is rejected if its squared distance
exceeds ``CUTOFF``.

Edge cases: a null or empty text has no words and fails the base rules; a null lang or
source is a value of its own; repeated rows each count; an empty table gives an
empty result; input columns other than doc_id, text, lang and source are ignored; row_hash,
the last column, tells rows of one doc_id apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import attach, cut

SPACE, GRID = r"[\x20\x09-\x0D]+", 64
WINDOW = 5
MIN_GROUP = 50
#: Share of a group that the estimates keep, and the factor that makes them consistent for
#: normal data with 4 dimensions: H / P(chi2(6) <= quantile of chi2(4) at H); the same at 0.975.
H, CONSISTENCY = 0.75, 1.485
WITHIN, WITHIN_CONSISTENCY = 11.143, 1.0645
GUARD = 1 / GRID**2
#: The greatest squared distance of a kept document (chi2 with 4 degrees of freedom at 1 - 1e-5).
CUTOFF = 28.5
EVIDENCE, EVIDENCE_LINES = 200, 25
#: Concentration steps, if determinants still fall; starts of a group.
MOST_STEPS, STARTS = 30, 3
_P = 4
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_Z = [f"z{i}" for i in range(_P)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """64-bit hashes of all runs of ``width`` words, in order; none if there are fewer."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(words[i + k] for k in range(width))))
    return F.when(n >= width, windows).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more, the first occurrence included."""

    def covered(pairs: Column) -> Column:
        same = lambda a, k: F.when((k >= 0) & (k < F.size(pairs)), a.h == pairs[k].h).otherwise(False)
        hit = F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))
        at = F.array_sort(F.transform(hit, lambda p: p.i))
        total = lambda at: F.aggregate(
            F.sequence(F.lit(0), F.size(at) - 1),
            F.lit(0),
            lambda n, k: n + F.when(k + 1 < F.size(at), F.least(F.lit(width), at[k + 1] - at[k])).otherwise(width),
        )
        return let(at, total)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, let(pairs, covered)).otherwise(0)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules, one pass over whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select("doc_id", "lang", "source", F.xxhash64("text", "lang", "source").alias("row_hash"), text.alias("text"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
    second = first.select("*", window_hashes(F.col("words")).alias("hashes"))
    words = F.col("words")
    return second.select(
        "doc_id",
        "lang",
        "source",
        "row_hash",
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _statistics(counts: DataFrame) -> DataFrame:
    """Adds z0..z3, the transformed statistics on the integer grid, and the keys of a document's levels."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    z = [
        F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    levels = {"s": F.concat(F.lit("s"), part("lang"), F.lit("\x1f"), part("source")), "l": F.concat(F.lit("l"), part("lang"))}
    return counts.withColumns({f"z{i}": F.floor(GRID * x + 0.5).cast("long") for i, x in enumerate(z)} | levels)


def _noise() -> list[Column]:
    """The change of each statistic that chance would make in a document."""
    words = F.least(F.greatest("n_words", F.lit(1)), F.lit(EVIDENCE))
    lines = F.least(F.greatest("n_lines", F.lit(1)), F.lit(EVIDENCE_LINES))
    return [0.5 / F.sqrt(words), 1 / F.sqrt(words), 1 / F.sqrt(lines), F.sqrt(2 * WINDOW / words)]


def _factor(matrix: Callable[[int, int], Column], out: DataFrame) -> DataFrame:
    """Adds l<i>_<j>, the Cholesky factor of a matrix of columns; each entry is computed once, as those after it name it often."""

    def entries(left: list, known: dict) -> Column:
        if not left:
            return F.struct(*(known[i, j].alias(f"l{i}_{j}") for i, j in _PAIRS))
        i, j = left[0]
        rest = matrix(i, j) - sum((known[i, k] * known[j, k] for k in range(j)), F.lit(0.0))
        value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / known[j, j]
        return let(value, lambda v: entries(left[1:], known | {(i, j): v}))

    return out.withColumn("_l", entries(_PAIRS, {})).select(*out.columns, "_l.*")


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, from z, m and the factor's columns, which go."""

    def total(i: int, solved: list[Column]) -> Column:
        if i == _P:
            return sum((y * y for y in solved), F.lit(0.0))
        rest = F.col(f"z{i}") / GRID - F.col(f"m{i}") - sum((F.col(f"l{i}_{k}") * solved[k] for k in range(i)), F.lit(0.0))
        return let(rest / F.col(f"l{i}_{i}"), lambda y: total(i + 1, [*solved, y]))

    keep = [c for c in rows.columns if c[0] not in "mcl" or not c[1:2].isdigit()]
    return rows.withColumn("d2", total(0, [])).select(*keep, "d2")


def _regular(i: int, j: int) -> Column:
    return F.col(f"c{i}_{j}") + (GUARD if i == j else 0.0)


def _starts(vectors: DataFrame) -> DataFrame:
    """Three estimates (g, start, m*, c*) of each group."""
    count = F.col("n")
    medians = vectors.groupBy("g").agg(*(F.percentile(z, F.lit(0.5), count).alias(f"q{i}") for i, z in enumerate(_Z)))
    around = attach(vectors, cut(medians), ["g"]).groupBy("g").agg(
        *(F.first(f"q{i}").alias(f"q{i}") for i in range(_P)),
        *(F.percentile(F.abs(F.col(z) - F.col(f"q{i}")), F.lit(0.5), count).alias(f"s{i}") for i, z in enumerate(_Z)),
    )
    center = [(F.col(f"q{i}") / GRID).alias(f"m{i}") for i in range(_P)]
    diagonal = lambda v: [(v(i) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _PAIRS]
    spread = lambda i: F.pow(1.4826 * F.col(f"s{i}") / GRID, F.lit(2))
    one = around.select("g", F.lit(0).alias("start"), *center, *diagonal(spread))
    two = around.select("g", F.lit(1).alias("start"), *center, *diagonal(lambda i: F.lit(1.0)))
    three = _moments(vectors.withColumn("start", F.lit(2))).drop("logdet")
    return one.unionByName(two).unionByName(three)


def _moments(near: DataFrame) -> DataFrame:
    """Mean, covariance and log determinant of each (g, start)."""
    n = F.col("n")
    sums = near.groupBy("g", "start").agg(
        F.sum(n).alias("t"),
        *(F.sum(n * F.col(z)).alias(f"t{i}") for i, z in enumerate(_Z)),
        *(F.sum(n * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"t{i}_{j}") for i, j in _PAIRS),
    )
    mean = lambda i: F.col(f"t{i}") / F.col("t") / GRID
    out = sums.select(
        "g",
        "start",
        *(mean(i).alias(f"m{i}") for i in range(_P)),
        *((F.col(f"t{i}_{j}") / F.col("t") / GRID**2 - mean(i) * mean(j)).alias(f"c{i}_{j}") for i, j in _PAIRS),
    )
    logdet = sum((2 * F.log(f"l{i}_{i}") for i in range(_P)), F.lit(0.0))
    return _factor(_regular, out).select(*out.columns, logdet.alias("logdet"))


def _measured(vectors: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """(g, start, z*, n, d2) of every vector under every estimate of its group."""
    return _distance(attach(vectors, _factor(_regular, estimates), ["g"], "inner", size=STARTS * groups))


def _concentrated(measured: DataFrame, groups: int) -> DataFrame:
    """Moments of the share H of each group with the least distances (ties included)."""
    place = measured.withColumn("place", F.floor(F.col("d2") * (1 << 20)))
    limits = place.groupBy("g", "start").agg(F.percentile("place", F.lit(H), F.col("n")).alias("limit"))
    return _moments(attach(place, limits, ["g", "start"], "inner", size=STARTS * groups).filter("place <= limit"))


def estimate(vectors: DataFrame) -> DataFrame:
    """Robust mean and covariance (m*, c*) per group of weighted vectors (g, z*, n)."""
    estimates, least = cut(_starts(vectors)), None
    groups = -(-estimates.count() // STARTS)
    for _ in range(MOST_STEPS):
        estimates = cut(_concentrated(_measured(vectors, estimates.drop("logdet"), groups), groups))
        total = estimates.agg(F.sum("logdet")).first()[0]
        if total is None or (least is not None and total > least - 1e-9):
            break
        least = total
    columns = ["start", *(f"m{i}" for i in range(_P)), *(f"c{i}_{j}" for i, j in _PAIRS)]
    best = estimates.groupBy("g").agg(F.min_by(F.struct(*columns), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    best = cut(_scaled(best, CONSISTENCY))
    within = _measured(vectors, best, groups).filter(F.col("d2") <= WITHIN)
    return _scaled(_moments(within), WITHIN_CONSISTENCY).drop("start")


def _scaled(estimates: DataFrame, factor: float) -> DataFrame:
    moments = [F.col(f"m{i}") for i in range(_P)] + [(F.col(f"c{i}_{j}") * factor).alias(f"c{i}_{j}") for i, j in _PAIRS]
    return estimates.select("g", "start", *moments)


def assess(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document.

    The counts are written once to the shared folder; every later step reads those few
    numbers per document, or counts of equal ones.
    """
    stats = cut(_statistics(base_counts(docs)))
    vectors = cut(stats.filter(~F.col("base_failed")).groupBy("s", "l", *_Z).agg(F.count(F.lit(1)).alias("n")))
    level = lambda c: vectors.groupBy(F.col(c).alias("g")).agg(F.sum("n").alias("size")).filter(F.col("size") >= MIN_GROUP).select("g")
    sources, languages = cut(level("s")), cut(level("l"))
    every = vectors.select(F.explode(F.array("s", "l", F.lit("*"))).alias("g"), *_Z, "n")
    judged = cut(sources.union(languages).union(vectors.select(F.lit("*").alias("g")).distinct()))
    grouped = cut(attach(every, judged, ["g"], "left_semi").groupBy("g", *_Z).agg(F.sum("n").alias("n")))
    estimates = cut(estimate(grouped))
    named = lambda t, c: t.select(F.col("g").alias(c), F.col("g").alias(f"ok_{c}"))
    stats = attach(attach(stats, named(sources, "s"), ["s"]), named(languages, "l"), ["l"])
    stats = stats.withColumn("g", F.coalesce("ok_s", "ok_l", F.lit("*")))
    out = attach(stats, estimates, ["g"]).withColumns({f"u{i}": u for i, u in enumerate(_noise())})
    out = _distance(_factor(lambda i, j: _regular(i, j) + (F.col(f"u{i}") * F.col(f"u{i}") if i == j else 0.0), out))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)).alias("kept"),
        F.col("d2").alias("distance2"),
        "row_hash",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept; rows are told apart by doc_id and by a hash of what their verdict rests on."""
    kept = assess(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_row")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"], docs["lang"], docs["source"]) == F.col("_row"))
    return docs.join(kept, same, "left_semi")


#: The base columns in SQL, over a table ``documents``.
BASE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
       coalesce(cov.n, 0) AS n_repeat_words
FROM t LEFT JOIN cov USING (doc_id)
"""
