"""Tables that are kept in place: upserts that rewrite only the buckets they touch.

A stored table is Parquet in a folder per bucket of its key's hash.  An upsert finds what is
new or changed, reads the buckets of those keys, and replaces just these in one commit
(dynamic partition overwrite), so its cost follows the change and a second run of the same
rows writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """A file per bucket; only the buckets that rows are in are replaced."""
    dealt = rows.repartition("bucket")
    dealt.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 32) -> None:
    """A stored table of rows whose keys are distinct."""
    _write(_bucketed(rows, keys, buckets), path, "errorifexists")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], buckets: int = 32, combine: dict[str, Callable[[Column, Column], Column]] | None = None) -> int:
    """New rows (one per key) into a stored table; the number of rows that were new or changed.

    ``combine`` gives a column of a known key from its new and its stored value; other columns take the new one.
    """
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != "bucket"]
    values = [c for c in columns if c not in keys]
    held = stored.select(*keys, "bucket", F.struct(*values).alias("_old"))
    joined = _bucketed(new.select(*columns), keys, buckets).join(held, [*keys, "bucket"], "left")
    known = F.col("_old").isNotNull()
    rule = combine or {}
    value = lambda c: F.when(known, rule[c](F.col(c), F.col(f"_old.{c}"))).otherwise(F.col(c)) if c in rule else F.col(c)
    joined = joined.select(*keys, "bucket", "_old", *(value(c).alias(c) for c in values))
    changed = joined.filter(~known | ~F.struct(*values).eqNullSafe(F.col("_old")))
    changed = materialise(changed.select(*columns, "bucket"))
    n = changed.count()
    if n:
        touched = stored.join(changed.select("bucket").distinct(), "bucket", "left_semi")
        kept = touched.join(changed.select(*keys, "bucket"), [*keys, "bucket"], "left_anti").select(*columns, "bucket")
        _write(materialise(kept.unionByName(changed)), path, "overwrite")
    return n
