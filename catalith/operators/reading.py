"""Scans, filters, text search and paging over products and their offers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def clamp_limit(limit: int | None) -> int:
    return min(C.READ_LIMIT_MAX, max(1, int(limit if limit is not None else C.READ_LIMIT)))


def by_category_and_price(products: DataFrame, category=None, lowest=None, highest=None, price: str = "lowest") -> DataFrame:
    """Equality and range filters; all of them reach the scan."""
    for value, condition in ((category, F.col("category") == category), (lowest, F.col(price) >= lowest), (highest, F.col(price) <= highest)):
        if value is not None:
            products = products.filter(condition)
    return products


def search_phrase(term: str) -> str:
    """The term without the characters of the filter syntax."""
    import re

    return re.sub(r"\s+", " ", re.sub(r"[%,()']", " ", term)).strip()


def phrase_filter(table: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows where a column contains the phrase, whatever the case."""
    phrase = search_phrase(term)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{phrase}%"), F.lit(False))
    return table.filter(hit) if phrase else table


def any_word_filter(table: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns, normalised and joined, contain any word of the query."""
    words = T.query_words(query)
    joined = F.concat_ws(" ", *(T.identity_text(F.coalesce(F.col(c), F.lit(""))) for c in columns))
    return table.filter(T.any_of(words, joined)) if words else table


def covers_query(name: Column, query: str) -> Column:
    """One or two words must all occur, of more at least 70 percent."""
    words = T.query_words(query)
    needed = len(words) if len(words) <= 2 else -(-7 * len(words) // 10)
    return T.matched_words(name, words) >= needed


def single_variants(query: str) -> list[str]:
    return [w for w in T.plain_identity(query).split(" ") if w in C.SINGLE_VARIANTS]


def strict_variants(query: str) -> list[str]:
    return [w for w in T.plain_identity(query).split(" ") if w in C.STRICT_VARIANTS]


def has_single_variants(name: Column, query: str) -> Column:
    """Every single-letter variant of the query stands behind one of its model words."""
    import re

    models = [w for w in T.query_words(query) if re.search("[a-z]", w) and re.search(r"\d", w) or re.fullmatch(r"\d{3,5}", w)]
    text, out = T.identity_text(name), F.lit(True)
    for v in single_variants(query) if models else ():
        hit = F.lit(False)
        for m in models:
            hit = hit | text.contains(m + v) | text.rlike(rf"\b{re.escape(m)}\s+{v}\b")
        out = out & hit
    return out


def has_strict_variants(name: Column, query: str) -> Column:
    out = F.lit(True)
    for v in strict_variants(query):
        out = out & T.identity_text(name).rlike(rf"\b{v}\b")
    return out


def matches_intent(name: Column, query: str) -> Column:
    return covers_query(name, query) & has_single_variants(name, query) & has_strict_variants(name, query)


def is_standalone(name: Column, category: Column) -> Column:
    """False for bundles and whole machines in the component categories."""
    return ~(category.isin(*C.COMPONENT_CATEGORIES) & T.any_of(C.COMPONENT_BUNDLE_TERMS, T.group_name(name)))


def is_in_stock(prices: Column) -> Column:
    return F.exists(prices, lambda p: p.stock.isin("in-stock", "low-stock"))


def is_stale(updated: Column, as_of: Column, minutes: int = C.STALE_MINUTES) -> Column:
    """Older than the limit; a missing time is stale."""
    return F.coalesce(F.unix_micros(as_of) - F.unix_micros(updated) > minutes * 60_000_000, F.lit(True))


def weak_description(description: Column, name: Column) -> Column:
    """Empty, shorter than 24 letters, or the name again."""
    bare = lambda c: T.collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]", ""))
    return (F.length(T.collapse(F.coalesce(description, F.lit("")))) < 24) | (bare(description) == bare(name))


def matches_terms(name: Column, terms: Sequence[str]) -> Column:
    """Whether all words of any term occur in the name."""
    text, out = T.identity_text(name), F.lit(False)
    for term in terms:
        hit = F.lit(True)
        for w in T.plain_identity(term).replace("+", " ").split():
            hit = hit & text.contains(w)
        out = out | hit
    return out


def host_allowed(url: Column, hosts: Sequence[str]) -> Column:
    host, out = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)), F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def page(table: DataFrame, order: Sequence[Column], number: int, size: int = C.PAGE_SIZE) -> DataFrame:
    """One page of an ordered table; a page past the end is the last one.

    The rows up to the page are a distributed top-k; only a count reaches the driver.
    """
    total = table.count()
    number = min(max(1, number), max(1, -(-total // size)))
    return table.orderBy(*order).limit(number * size).offset((number - 1) * size)


def page_facts(total: int, size: int, number: int) -> dict:
    pages = max(1, -(-total // size))
    return {"limit": size, "offset": (min(max(1, number), pages) - 1) * size, "total": total, "pages": pages}


def first_by(table: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (a window limit per group, pushed before the shuffle)."""
    ranked = table.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")
