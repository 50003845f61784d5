"""Connected components by alternating star rounds; the number of rounds grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least one, then each node and its smaller neighbours to theirs."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    ties = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
    return ties.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node of ``links`` (a, b) with a > b."""
    edges, seen = materialise(links.select("a", "b").distinct()), None
    while True:
        edges = materialise(_stars(edges))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
