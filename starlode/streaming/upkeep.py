"""Keeps a bitmap index up to date with a stream of appended rows.

The reference has no streams; what it has is appending rows to an index, and a stream of files is Spark's way to append.
Each micro-batch writes the bitmaps of its rows under its own number; a batch that runs again after a failure replaces its
own folder, and readers unite the bitmaps of a bucket, so that no row is lost or counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starlode.operators.bitmap import Layout, build


def keep(rows: DataFrame, layout: Layout, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the upkeep for a stream of rows with their row numbers; it ends when all present input is done."""

    def add(batch: DataFrame, number: int) -> None:
        build(batch, layout).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The index over all batches so far."""
    parts = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return parts.groupBy("name", "lo", "hi", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
