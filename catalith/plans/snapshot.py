"""Change capture: history rows, upserts, signatures, refresh priorities and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def history_rows(flagged: DataFrame) -> DataFrame:
    """Rows to append to the history: new and changed ones."""
    return flagged.filter("change <> 'same'")


def heartbeat_due(updated: Column, as_of: Column, hours: int = C.HEARTBEAT_HOURS) -> Column:
    """Whether an unchanged row is due for a refresh of its time; never written is due."""
    return F.coalesce(F.unix_micros(as_of) - F.unix_micros(updated) >= hours * 3_600_000_000, F.lit(True))


def write_plan(flagged: DataFrame, as_of: Column) -> DataFrame:
    """Adds upsert and append: changed or new rows both, unchanged ones an upsert when the heartbeat is due."""
    fresh = F.col("change") != "same"
    return flagged.withColumns({"upsert": fresh | heartbeat_due(F.col("last_updated"), as_of), "append": fresh})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: new rows, and old ones without a new row of their key."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def changed_at(new_signature: Column, old_signature: Column, old_time: Column, now: Column) -> Column:
    """The time of the last content change: the old one while the signature stays."""
    return F.when(new_signature.eqNullSafe(old_signature), old_time).otherwise(now)


def refresh_priority(products: DataFrame, offers: DataFrame, tracked: DataFrame) -> DataFrame:
    """tracked, cold (nothing in stock), hot (``HOT_PRICES`` offers or more) or normal."""
    facts = offers.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("stock").isin("in-stock", "low-stock")).alias("available"))
    joined = products.join(facts, "product_id", "left").join(tracked.withColumn("_t", F.lit(True)), "product_id", "left")
    kind = (
        F.when(F.col("_t"), "tracked").when(~F.coalesce("available", F.lit(False)), "cold").when(F.col("n") >= C.HOT_PRICES, "hot").otherwise("normal")
    )
    return joined.select("product_id", kind.alias("priority"))


def hot_targets(latest: DataFrame, as_of: DataFrame, minutes: int, limit: int) -> DataFrame:
    """Products not refreshed for so many minutes, oldest first."""
    old = latest.join(F.broadcast(as_of)).filter(F.col("updated") < F.col("as_of") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return old.orderBy("updated", "product_id").limit(limit).drop("as_of")
