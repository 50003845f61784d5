"""Sitemap pages and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import xml_escape
from ..storage import materialise


def entry(location: Column) -> Column:
    return F.concat(F.lit("<url><loc>"), xml_escape(location), F.lit("</loc></url>"))


def paged(table: DataFrame, key: str, size: int = C.SITEMAP_PAGE) -> DataFrame:
    """Adds page, counted over the rows in order of ``key``.

    Rows are ranged by key and written with their range, so that both sides below see the
    same ranges, and numbered within; only one count per range goes through a single task,
    so the numbering is global without a global sort in one.
    """
    ranged = materialise(table.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    numbered = ranged.withColumn("_n", within)
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    page = F.floor((F.col("_before") + F.col("_n")) / size).cast("long")
    return numbered.join(counts, "_part").withColumn("page", page).drop("_part", "_n", "_before")
