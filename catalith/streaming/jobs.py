"""Running a stream over what is there, with its state and results in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..storage import folder

#: Timers and several states per key need a state store with column families.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Runs a stream until its source has nothing left; its rows as a Parquet table."""
    spark = stream.sparkSession
    path = path or folder(spark, "stream")
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, STORE)
    try:
        job = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_SETTING)
        else:
            spark.conf.set(_SETTING, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
