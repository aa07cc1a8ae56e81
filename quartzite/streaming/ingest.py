"""Incremental ingest: files that arrive are taken once, by a checkpoint, into the same tables as a batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Take what is new under source, transform it and append it to out as Parquet. A batch that is run again
    after a failure overwrites its own folder, so rows come once."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
