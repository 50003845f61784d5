"""Curated sections: featured products, fallback, budget guides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def featured(products: DataFrame, limit: int = C.FEATURED_LIMIT) -> DataFrame:
    """The cheapest available product of each category, then the freshest of the rest.

    ``products``: product_id, hw_category, lowest, updated, available.
    """
    usable = products.filter("available")
    order = Window.partitionBy("hw_category").orderBy("lowest", F.col("updated").desc(), "product_id")
    placed = usable.withColumn("_later", (F.row_number().over(order) > 1).cast("int"))
    return placed.orderBy("_later", F.col("updated").desc(), "product_id").limit(limit).drop("_later")


def fallback(products: DataFrame, limit: int = C.FEATURED_LIMIT) -> DataFrame:
    """Available products, or all where none is; freshest, then most stores, then cheapest."""
    any_left = products.agg(F.coalesce(F.bool_or("available"), F.lit(False)).alias("_any"))
    usable = products.join(F.broadcast(any_left)).filter(F.col("available") | ~F.col("_any")).drop("_any")
    return usable.orderBy(F.col("updated").desc(), F.col("stores").desc(), "lowest", "product_id").limit(limit)


def guide_prices(products: DataFrame, guide: DataFrame) -> DataFrame:
    """Per slot of a budget guide the first product whose title has the term; its price or the estimate.

    The guide is a fixed list of a few slots, so it is the broadcast side.
    """
    named = products.select("product_id", "retail", F.lower("title").alias("_t"))
    hits = named.join(F.broadcast(guide.select("slot", "term")), F.col("_t").contains(F.col("term"))).groupBy("slot")
    best = hits.agg(F.min_by("retail", "product_id").alias("retail"), F.min("product_id").alias("product_id"))
    return guide.join(best, "slot", "left").withColumn("price", F.coalesce(F.nullif("retail", F.lit(0)), "estimate"))
