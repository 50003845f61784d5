"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one (``spark.checkpoint.dir``); only where none is named, as in tests, in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, computed once."""
    spark, path = df.sparkSession, folder(df.sparkSession, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
