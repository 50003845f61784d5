"""Multi-resolution retention of an append-only history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def classify(
    history: DataFrame, keys: list[str], as_of: DataFrame, raw_days: int = C.RAW_DAYS, hourly_days: int = C.HOURLY_DAYS, daily_days: int = C.DAILY_DAYS
) -> DataFrame:
    """Adds retention: raw, hourly, daily (kept), thinned or purged.

    ``history``: id, recorded and the keys; ``as_of``: one row.  The age decides first: raw
    and purged rows are never shuffled, and each of the two middle bands is ranked by its
    own unit, an hour or a day of a key at a time.
    """
    if not 0 < raw_days < hourly_days < daily_days:
        raise ValueError("retention windows must grow: raw, hourly, daily")
    newest = [F.col("recorded").desc(), F.col("id").desc()]
    cutoff = lambda days: F.col("as_of") - F.make_dt_interval(F.lit(days))
    since = lambda days: F.col("recorded") >= cutoff(days)
    band = F.when(since(raw_days), "raw").when(since(hourly_days), "hourly").when(since(daily_days), "daily").otherwise("purged")
    banded = history.join(F.broadcast(as_of)).withColumn("retention", band)

    def thinned(name: str, unit: str, newer: int) -> DataFrame:
        # Newer rows count in the one hour or day that the band's edge cuts.
        edge = since(newer) & (F.date_trunc(unit, "recorded") == F.date_trunc(unit, cutoff(newer)))
        first = F.row_number().over(Window.partitionBy(*keys, F.date_trunc(unit, "recorded")).orderBy(*newest)) == 1
        ranked = banded.filter((F.col("retention") == name) | edge).withColumn("_first", first).filter(F.col("retention") == name)
        return ranked.withColumn("retention", F.when(F.col("_first"), name).otherwise("thinned")).drop("_first")

    plain = banded.filter(F.col("retention").isin("raw", "purged"))
    return plain.unionByName(thinned("hourly", "hour", raw_days)).unionByName(thinned("daily", "day", hourly_days)).drop("as_of")


def keep(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("retention").isin("raw", "hourly", "daily"))
