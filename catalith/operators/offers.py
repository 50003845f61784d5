"""Offers per product: nesting, best prices, outliers, statistics, joins with stores and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import price as P


def cheapest_per_store(offers: DataFrame) -> DataFrame:
    """Least price per product and store (aggregated before the shuffle)."""
    return offers.filter("price > 0").groupBy("product_id", "store_id").agg(F.min("price").alias("price"))


def mark_outliers(best: DataFrame) -> DataFrame:
    """Adds n, median, discarded: the outlier rule over each product's prices, a row per store.

    A group in which every price would go keeps them all.  One partitioning by product
    serves all of it.
    """
    group = Window.partitionBy("product_id")
    facts = {"n": F.count(F.lit(1)), "median": F.percentile("price", F.lit(0.5)), "least": F.min("price")}
    marked = best.withColumns({name: f.over(group) for name, f in facts.items()})
    marked = marked.withColumn("out", P.outlier(F.col("price"), F.col("n"), F.col("median"), F.col("least")))
    return marked.withColumn("discarded", F.col("out") & ~F.min("out").over(group)).drop("out", "least")


def comparable_stats(best: DataFrame) -> DataFrame:
    """Per product: comparable offers and their least, greatest and rounded mean price."""
    kept = mark_outliers(best).filter(~F.col("discarded"))
    return kept.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_comparable"),
        F.min("price").alias("lowest"),
        F.max("price").alias("highest"),
        P.half_up(F.sum("price") / F.count(F.lit(1))).alias("average"),
    )


def ordered_offer(seq: Column) -> Column:
    """An offer as the struct the folds take."""
    return F.struct(
        F.col("store_id").cast("string").alias("store_id"), F.col("price").cast("double").alias("price"), "stock", "updated", seq.cast("long").alias("seq")
    )


def nested(offers: DataFrame, order: list[Column]) -> DataFrame:
    """Per product its offers as an array with seq, the order in which they came."""
    seq = F.row_number().over(Window.partitionBy("product_id").orderBy(*order))
    return offers.withColumn("seq", seq).groupBy("product_id").agg(F.collect_list(ordered_offer(F.col("seq"))).alias("prices"))


def with_store_names(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """Offers with the store's name, or its id where the store is unknown."""
    named = offers.join(stores.select("store_id", "store_name"), "store_id", "left")
    return named.withColumn("store_name", F.coalesce("store_name", F.col("store_id").cast("string")))


def stored_state(new: DataFrame, old: DataFrame, keys: list[str], signature: str = "signature") -> DataFrame:
    """Rows of a snapshot with what was stored under the same key: new, changed or same."""
    before = old.select(*keys, F.col(signature).alias("_old"), F.lit(True).alias("_known"))
    joined = new.join(before, keys, "left")
    kind = F.when(F.col("_known").isNull(), "new").when(F.col("_old").eqNullSafe(F.col(signature)), "same").otherwise("changed")
    return joined.withColumn("change", kind).drop("_old", "_known")


def baseline(current: DataFrame, history: DataFrame) -> DataFrame:
    """For each current price the dearer history row it is measured against.

    Rows older than the current one by over ``GUARD_SECONDS`` come first, then the newest.
    ``current``: product_id, store_id, price, updated; ``history``: product_id, store_id, price, recorded.
    An equi-join on product and store with a range condition; the best row is kept by an
    aggregate, so no group is sorted.
    """
    past = history.select("product_id", "store_id", F.col("price").alias("base"), "recorded")
    pairs = current.join(past, ["product_id", "store_id"]).filter(F.col("base") > F.col("price"))
    older = (F.unix_micros("recorded") < F.unix_micros("updated") - C.GUARD_SECONDS * 1_000_000).cast("int")
    best = pairs.groupBy(*current.columns).agg(F.max(F.struct(older.alias("older"), "recorded", "base")).alias("b"))
    return best.select(*current.columns, "b.base", "b.recorded")


def drops(found: DataFrame) -> DataFrame:
    """Adds amount and percent, keeps drops that qualify, and the best one of each product."""
    found = found.withColumn("amount", F.col("base") - F.col("price")).withColumn("percent", F.col("amount") / F.col("base"))
    found = found.filter((F.col("amount") >= C.DROP_AMOUNT) | (F.col("percent") >= C.DROP_PERCENT))
    best = found.groupBy("product_id").agg(F.max_by(F.struct(*found.columns), F.struct("percent", "amount", -F.col("store_id"))).alias("b"))
    return best.select("b.*")


def full_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Prices of two products side by side by store; 0 where a product has none."""
    left = a.select("store_id", F.col("price").alias("price_a"))
    right = b.select("store_id", F.col("price").alias("price_b"))
    return left.join(right, "store_id", "full").na.fill(0, ["price_a", "price_b"])
