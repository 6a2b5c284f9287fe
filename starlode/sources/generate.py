"""Deterministic generators: star-schema tables, skewed and uniform columns, keys, inverted lists.

Values are functions of a row's number and a seed, so that any partitioning gives the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.storage import ship

ROWS = {"customer": 30_000, "supplier": 2_000, "part": 200_000, "lineorder": 6_000_000}
DAYS = 2557


def draw(name: str, n: int, seed: int, key: str = "id") -> Column:
    """A number in 0 to n-1 that depends on the key, the name and the seed."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(name), F.lit(seed)), F.lit(n))


def rows_of(table: str, sf: float) -> int:
    if table == "part":
        return ROWS[table] * (1 + max(0, int(np.floor(np.log2(sf)))) if sf >= 1 else 1)
    return max(1, int(ROWS[table] * sf))


def customers(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    city, digits = draw("city", 250, seed), draw("phone", 10**10, seed)
    phone = F.concat_ws("-", (F.call_function("div", city, F.lit(10)) + 10).cast("string"), F.lpad(digits.cast("string"), 10, "0"))
    return spark.range(n).select(F.col("id").alias("c_custkey"), city.alias("c_city"), draw("segment", 5, seed).alias("c_mktsegment"), phone.alias("c_phone"))


def suppliers(spark: SparkSession, n: int, seed: int = 2) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("s_suppkey"), draw("city", 250, seed).alias("s_city"))


def parts(spark: SparkSession, n: int, seed: int = 3) -> DataFrame:
    domains = {"p_name": 94 * 94, "p_brand": 1000, "p_color": 94, "p_type": 215, "p_size": 50, "p_container": 40}
    return spark.range(n).select(F.col("id").alias("p_partkey"), *[draw(c, k, seed).alias(c) for c, k in domains.items()])


def lineorders(spark: SparkSession, orders: int, customers_: int, parts_: int, suppliers_: int, seed: int = 4) -> DataFrame:
    """0 to 7 lines an order, which share customer, date and priority; an order's total is over its lines."""
    head = spark.range(orders).select(
        F.col("id").alias("lo_orderkey"), draw("cust", customers_, seed).alias("lo_custkey"), draw("date", DAYS, seed).alias("lo_orderdate"),
        draw("prio", 5, seed).alias("lo_orderpriority"), draw("lines", 8, seed).alias("lines"),
    ).where("lines > 0")
    lines = head.withColumn("lo_linenumber", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("lines")))).drop("lines")
    lines = lines.withColumn("id", F.col("lo_orderkey") * 8 + F.col("lo_linenumber"))
    domains = {"lo_extendedprice": (55450, 0), "lo_discount": (11, 0), "lo_tax": (9, 0), "lo_supplycost": (131072, 0), "lo_quantity": (50, 1), "lo_partkey": (parts_, 0), "lo_suppkey": (suppliers_, 0)}
    drawn = lines.select("*", *[(draw(c, k, seed) + low).alias(c) for c, (k, low) in domains.items()]).drop("id")
    revenue = F.call_function("div", F.col("lo_extendedprice") * (100 - F.col("lo_discount")), F.lit(100))
    full = drawn.withColumn("lo_revenue", revenue).withColumn("lo_commitdate", F.col("lo_orderdate"))
    totals = full.groupBy("lo_orderkey").agg(F.sum("lo_extendedprice").alias("lo_ordtotalprice"))
    return full.join(totals, "lo_orderkey")


def _chunks(spark: SparkSession, n: int, fn, chunk: int = 1 << 20) -> DataFrame:
    """(id, value): fn(chunk number, size) gives each chunk's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                size = min(chunk, n - k * chunk)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * chunk, k * chunk + size)), pa.array(np.asarray(fn(k, size), np.int64))], names=["id", "value"])

    ship(spark)
    return spark.range(-(-n // chunk)).mapInArrow(run, "id long, value long")


def zipf(spark: SparkSession, n: int, s: float, top: int, seed: int = 5) -> DataFrame:
    """Zipf values minus one, modulo top."""
    return _chunks(spark, n, lambda k, size: (np.random.default_rng([seed, k]).zipf(s, size) - 1) % top)


def uniform(spark: SparkSession, n: int, top: int, seed: int = 6) -> DataFrame:
    return spark.range(n).select("id", draw("uniform", top, seed).alias("value"))


def normal(spark: SparkSession, n: int, mean: float, deviation: float, seed: int = 7) -> DataFrame:
    return _chunks(spark, n, lambda k, size: np.rint(np.random.default_rng([seed, k]).normal(mean, deviation, size)))


def cycled(spark: SparkSession, n: int, top: int) -> DataFrame:
    """i modulo top + 1; the order of rows has no meaning, so none is made up."""
    return spark.range(n).select("id", (F.col("id") % (top + 1)).alias("value"))


def permutation(key: Column, n: int, seed: int) -> Column:
    """A permutation of 0 to n-1: an affine map modulo n whose factor has no divisor in common with n."""
    factor = next(f for f in range(int(0.618 * n) | 1, 2 * n + 3) if np.gcd(f, n) == 1)
    return F.pmod(key * factor + seed, F.lit(n))


def primary(spark: SparkSession, n: int, seed: int = 8) -> DataFrame:
    """Keys 1 to n, each once, in no particular order, with a value."""
    return spark.range(n).select((permutation(F.col("id"), n, seed) + 1).alias("key"), draw("value", 1 << 31, seed).alias("value"))


def foreign(spark: SparkSession, n: int, keys: int, seed: int = 9) -> DataFrame:
    """n keys of 1 to keys, each equally often (up to one)."""
    return spark.range(n).select((permutation(F.col("id") % keys, keys, seed) + 1).alias("key"), draw("value", 1 << 31, seed).alias("value"))


def inverted_lists(spark: SparkSession, n_rows: int, lists: int = 32, s: float = 1.2, seed: int = 10) -> DataFrame:
    """(bitmap, row_id): rows of a Zipf column over so many lists; each row is in one list."""
    return zipf(spark, n_rows, s, lists, seed).select(F.col("value").cast("int").alias("bitmap"), (F.col("id") + 1).alias("row_id"))


def random_words(n: int, density: float, longest_fill: int, tail: int, seed: int = 11) -> list[int]:
    """31-bit words for tests: runs of zeros or ones up to a length, between stretches of up to ``tail`` random words."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        out += [(1 << 31) - 1 if rng.random() < density else 0] * int(rng.integers(1, longest_fill + 1))
        out += [int(np.packbits(rng.random(32) < density, bitorder="little").view("<u4")[0]) & ((1 << 31) - 1) for _ in range(int(rng.integers(0, tail + 1)))]
    return out[:n]
