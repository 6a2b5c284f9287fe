"""Dense row numbers from 1, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlode.storage import written

_LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df with numbers 1 to n in a new column: places within partitions, and offsets of partitions.

    The rows with their places are written once, so that the numbers do not change when a plan runs again; the offsets
    are one row per partition of the written table's tasks.
    """
    mono = F.monotonically_increasing_id()
    placed = written(df.select("*", F.shiftright(mono, 33).alias("_part"), mono.bitwiseAND(F.lit(_LOCAL)).alias("_place")), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before")
    offsets = sizes.select("_part", before)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
