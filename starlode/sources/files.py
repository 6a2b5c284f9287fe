"""Files of the star schema: delimited text tables, binary column files, position lists, and writers for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlode.sources.rows import numbered
from starlode.storage import ship

#: Column names and widths of the benchmark's text tables. Numbers: i; text: s.
TEXT_TABLES = {
    "supplier": "s_suppkey i, s_name s, s_address s, s_city s, s_nation s, s_region s, s_phone s",
    "customer": "c_custkey i, c_name s, c_address s, c_city s, c_nation s, c_region s, c_phone s, c_mktsegment s",
    "part": "p_partkey i, p_name s, p_mfgr s, p_category s, p_brand1 s, p_color s, p_type s, p_size i, p_container s",
    "ddate": "d_datekey i, d_date s, d_dayofweek s, d_month s, d_year i, d_yearmonthnum i, d_yearmonth s, d_daynuminweek i, "
    "d_daynuminmonth i, d_daynuminyear i, d_monthnuminyear i, d_weeknuminyear i, d_sellingseason s, d_lastdayinweekfl s, "
    "d_lastdayinmonthfl s, d_holidayfl s, d_weekdayfl s",
    "lineorder": "lo_orderkey i, lo_linenumber i, lo_custkey i, lo_partkey i, lo_suppkey i, lo_orderdate i, lo_orderpriority s, "
    "lo_shippriority s, lo_quantity i, lo_extendedprice i, lo_ordtotalprice i, lo_discount i, lo_revenue i, lo_supplycost i, "
    "lo_tax i, lo_commitdate i, lo_shipmode s",
}


def text_schema(table: str) -> T.StructType:
    fields = [f.split() for f in TEXT_TABLES[table].split(", ")]
    return T.StructType([T.StructField(n, T.LongType() if k == "i" else T.StringType()) for n, k in fields])


def read_text(spark: SparkSession, path: str, table: str, sep: str = "|") -> DataFrame:
    """A delimited table; a delimiter at line ends is allowed."""
    return spark.read.schema(text_schema(table)).csv(path, sep=sep)


def write_text(rows: DataFrame, path: str, sep: str = "|") -> None:
    rows.write.mode("overwrite").csv(path, sep=sep)


def extract(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """A text column as whole numbers: ``date`` (drops dashes), ``money`` (hundredths, cut off), ``int``, or ``code``
    (the rank of the value in order; the distinct values are numbered, not the rows)."""
    c = F.col(column)
    if kind == "date":
        return rows.withColumn(column, F.replace(c, F.lit("-"), F.lit("")).cast("int"))
    if kind == "money":
        return rows.withColumn(column, (c.cast("decimal(18,4)") * 100).cast("bigint"))
    if kind == "int":
        return rows.withColumn(column, c.cast("bigint"))
    if kind == "code":
        return encode(rows, dictionary(rows, column), column)
    raise ValueError(kind)


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values in order, numbered from 0: sorted by ranges, then numbered within and across them."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")
    return numbered(values, "code").withColumn("code", F.col("code") - 1)


def sorted_columns(rows: DataFrame, key: str, positions: str = "position") -> DataFrame:
    """All columns in the order of one of them, with places from 0: the argsort, and the columns sorted by it."""
    return numbered(rows.orderBy(key), positions).withColumn(positions, F.col(positions) - 1)


def encode(rows: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return rows.join(named, F.col(column) == F.col("_value"), "left").withColumn(column, F.col("_code")).drop("_value", "_code")


def decode(rows: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return rows.join(named, F.col(column) == F.col("_code"), "left").withColumn(column, F.col("_value")).drop("_value", "_code")


def column_bytes(values: np.ndarray, width: int) -> bytes:
    """A column file: the width in bytes as four little-endian bytes, then the values."""
    return int(width).to_bytes(4, "little") + values.astype(f"<u{width}").tobytes()


def read_columns(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(path, pos, value) of binary column files: with their width in front, or of the width given and without a head.

    A file is one task's work, as the format has no blocks; a length that is not whole values raises.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                size, body = (width, data) if width else (int.from_bytes(data[:4], "little"), data[4:])
                if size not in (1, 2, 4, 8) or len(body) % size:
                    raise ValueError(f"{name}: {len(body)} bytes of values of {size} bytes")
                values = np.frombuffer(body, f"<u{size}").astype(np.int64)
                for a in range(0, len(values), 1 << 16):
                    part = values[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(part)], names=["path", "pos", "value"])

    ship(spark)
    return files.mapInArrow(run, "path string, pos long, value long")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(bitmap, row_id) of text files of comma-separated row numbers from 0; a file is a bitmap."""
    lines = spark.read.text(path).select(F.input_file_name().alias("bitmap"), F.explode(F.split("value", ",")).alias("at"))
    return lines.where(F.trim("at") != "").select("bitmap", (F.trim("at").cast("bigint") + 1).alias("row_id"))
