"""Streams of step events and bounded runs over them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from pathweave.session import scratch_dir


def file_stream(spark: SparkSession, path: str, name: str, files_per_trigger: int | None = None, bytes_per_trigger: int = 2 << 30) -> DataFrame:
    """Stream over the parquet file(s) ``name`` of a directory; the schema is taken from the stored data. The size of a
    micro-batch is limited, which also limits what one key can bring into one task at a time."""
    static = spark.read.parquet(os.path.join(path, name))
    reader = spark.readStream.schema(static.schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Process everything that is there, then stop; the result is a table in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch_dir(spark, purpose), scratch_dir(spark, f"{purpose}-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
        q.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, batch_id: int) -> None:
        # complete results replace each other; the last one is the answer
        batch.write.mode("overwrite").parquet(out)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).outputMode(mode)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
