"""The catalogue search as one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import price as P
from ..functions import text as T
from ..operators import offers as O
from ..operators import reading as R
from ..operators import resolve


@dataclass(frozen=True)
class SearchParams:
    query: str = ""
    category: str | None = None
    stores: tuple[str, ...] = ()
    lowest: int | None = None
    highest: int | None = None
    sort: str = "relevance"
    limit: int = C.READ_LIMIT


def coerce(values: dict) -> SearchParams:
    """Parameters from texts: numbers that are not negative, known sorts and categories, swapped bounds put right."""

    def number(name: str) -> int | None:
        try:
            value = float(values.get(name, ""))
        except (TypeError, ValueError):
            return None
        return int(value) if value >= 0 else None

    low, high = number("minPrice"), number("maxPrice")
    if low is not None and high is not None and low > high:
        low, high = high, low
    stores = tuple(sorted({s.strip().lower() for s in str(values.get("stores") or "").split(",") if s.strip()}))
    category = values.get("category")
    sort = values.get("sort")
    limit = number("limit")
    return SearchParams(
        query=" ".join(str(values.get("q") or "").split())[:120],
        category=category if category in C.CATEGORIES else None,
        stores=stores,
        lowest=low,
        highest=high,
        sort=sort if sort in ("price-asc", "price-desc", "name", "newest") else "relevance",
        limit=R.clamp_limit(limit),
    )


def cache_key(params: SearchParams) -> str:
    return "|".join(map(str, (params.query.lower(), params.category or "", ",".join(params.stores), params.lowest, params.highest, params.sort, params.limit)))


def catalogue_search(products: DataFrame, offers: DataFrame, params: SearchParams) -> DataFrame:
    """Keyed products and their offers → text filter → exact groups → component, store and price filters → sort.

    Price filters come after grouping, as they are on regrouped prices; stores are chosen among a group's comparable
    offers, which are then compared anew.
    """
    if params.category:
        products = products.filter(F.col("hw_category") == params.category)
    if params.query:
        products = R.any_word_filter(products, params.query, ["name", "normalized_title", "family_key", "variant_key", "canonical_key"])
    found, kept = resolve.group_exact(products, offers, newer_wins=True)
    found = found.filter(R.is_standalone(F.col("name"), F.col("hw_category")) & (F.col("lowest") > 0))
    if params.stores:
        own = kept.filter(F.lower("store_id").isin(*params.stores)).withColumnRenamed("canonical_key", "product_id")
        own = O.mark_outliers(own).filter("NOT discarded").withColumnRenamed("product_id", "canonical_key")
        found = resolve.with_stats(found.drop("n_offers", "lowest", "highest", "average"), own, ["canonical_key"]).filter("n_offers > 0")
    found = R.by_category_and_price(found, None, params.lowest, params.highest)
    orders = {
        "price-asc": [F.col("lowest"), F.col("seq")],
        "price-desc": [F.col("lowest").desc(), F.col("seq")],
        "name": [F.collate("name", "es"), F.col("seq")],
        "newest": [F.col("updated").desc(), F.col("seq")],
    }
    score = P.relevance(F.col("name"), F.col("hw_category"), F.col("lowest"), params.query, params.category)
    order = orders.get(params.sort, [score.desc(), F.col("lowest"), F.col("seq")])
    return found.orderBy(*order).limit(params.limit)


def read_newest(products: DataFrame, params: SearchParams, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """What the database hands to the transforms: the phrase in one column, a category, the newest rows up to the limit.

    Older rows never reach the transforms, which is part of what a search returns; so the limit stands before grouping.
    """
    found = R.by_category_and_price(R.phrase_filter(products, params.query, list(columns)), params.category)
    return found.orderBy(F.desc("updated"), "product_id").limit(params.limit)


def catalogue_read(products: DataFrame, offers: DataFrame, params: SearchParams) -> DataFrame:
    """Both stages of a read: the newest rows with the whole phrase, then any word of it, groups, filters and sort."""
    return catalogue_search(read_newest(products, params), offers, params)


def catalogue_page(products: DataFrame, offers: DataFrame, number: int, size: int) -> DataFrame:
    """A page of the catalogue: rows are counted and cut before they are grouped, so a page can be short and totals high."""
    total = products.count()
    pages = -(-total // size)
    rows = products.orderBy(F.desc("updated"), "product_id").limit(number * size).offset((number - 1) * size)
    grouped, _ = resolve.group_exact(rows, offers, newer_wins=True)
    shown = grouped.filter("lowest > 0").select("product_id", "name", "lowest", "n_offers")
    return shown.withColumns({"total": F.lit(total).cast("long"), "total_pages": F.lit(pages).cast("long"), "page": F.lit(max(1, min(number, max(pages, 1)))).cast("long")})


def stable_search(products: DataFrame, offers: DataFrame, fixtures: DataFrame, params: SearchParams) -> DataFrame:
    """Search when the shops do not answer: stored products with the phrase or all its words, else the fixtures that match.

    ``fixtures``: product_id, name, hw_category, lowest.  The category is inferred from the query where none is given.
    """
    text, words = T.plain_identity(params.query), T.plain_identity(params.query).split()
    category = F.coalesce(F.lit(params.category), T.infer_category(F.lit(params.query)))
    own = products.filter(F.col("hw_category") == category).orderBy(F.desc("updated"), "product_id").limit(C.FALLBACK_LIMIT)
    grouped, _ = resolve.group_exact(own, offers, newer_wins=True)
    name = T.identity_text(F.col("name"))
    hit = name.contains(text) if text else F.lit(False)
    every = F.lit(True)
    for w in words:
        every = every & name.contains(w)
    within = lambda df: R.by_category_and_price(df, None, params.lowest, params.highest)
    found = within(grouped.filter(R.is_standalone(F.col("name"), F.col("hw_category")) & (F.col("lowest") > 0))).filter(hit | every).select("product_id", "name", "lowest")
    spare = within(fixtures.filter(F.col("hw_category") == category)).filter(every).select("product_id", "name", F.col("lowest").cast("long").alias("lowest"))
    none = found.agg((F.count(F.lit(1)) == 0).alias("none"))
    rows = found.withColumn("fallback", F.lit(False)).unionByName(spare.join(F.broadcast(none), F.col("none")).drop("none").withColumn("fallback", F.lit(True)))
    order = {"price-asc": [F.col("lowest")], "price-desc": [F.col("lowest").desc()], "name": [F.collate("name", "es")]}.get(params.sort, [])
    return rows.orderBy(*order, "product_id")
