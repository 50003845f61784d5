"""Neighbours in order within groups that may be large.

Rows are dealt by ranges of group and order, so a large group lies in several parts; within
a part the next row is a window's, and the last row of a part takes the first one of the
group's next part, which a table of parts hands over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def with_next(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the ``value`` of the next row of the same keys in order, null for the last one."""
    by = [*keys, *order]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    # Written once, so that a part's number cannot change when a task runs again.
    placed = materialise(ranged.withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    first = placed.groupBy(*keys, "_part").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_part"))
    handed = first.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), after.alias("_after"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = placed.withColumn("_near", F.lead(F.struct(F.col(value).alias("v"))).over(own))
    return near.join(handed, same).select(*rows.columns, F.coalesce("_near", "_after")["v"].alias(name))
