"""The star view over the driver tables: a fact row per line item, with codes and whole numbers, and labels of codes.

Predicates are over codes, which are computed from columns; what they imply for the columns themselves is added to each
table's scan (``implied``), so that it reaches the source as pushed filters and row groups can be skipped.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.functions import codes
from starlode.functions.predicates import And, Or, Predicate, Range

#: Columns and types of the tables; declared, so that reading needs no look at a file first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
NATIONS, REGIONS = 25, 5


def table(spark: SparkSession, sf_dir: str, name: str, where: Predicate | None = None) -> DataFrame:
    """A table; with a predicate, without rows that cannot meet it (others may stay)."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    kept = implied(where, name) if where is not None else None
    return rows if kept is None else rows.where(kept)


def _between(name: str, factor: int) -> Callable[[int, int], Column]:
    """For codes that are round(column * factor): a little more than the values between."""

    def condition(lo: int, hi: int) -> Column:
        return (F.col(name) >= (lo - 0.51) / factor) & (F.col(name) <= (hi - 0.49) / factor)

    return condition


def _cities(name: str) -> Callable[[int, int], Column]:
    """For city codes: the nations that have cities in a range."""

    def condition(lo: int, hi: int) -> Column:
        first = {n: (n % REGIONS) * 50 + n // REGIONS * 10 for n in range(NATIONS)}
        return F.col(name).isin([n for n, c in first.items() if c < hi and c + 10 > lo])

    return condition


def _brands(lo: int, hi: int) -> Column:
    return F.col("p_brand").isin([f"Brand#{c + 1}" for c in range(NATIONS) if c * 40 < hi and c * 40 + 40 > lo])


def _whole_from(lo: int, hi: int) -> Column:
    """For quantities, which are cut to whole numbers; below 1 a cut number may be a fraction above."""
    low = F.col("l_quantity") > lo - 1 if lo < 1 else F.col("l_quantity") >= lo
    return low & (F.col("l_quantity") < max(hi, 1))


def _days(lo: int, hi: int) -> Column:
    at = [codes.FIRST_DAY + datetime.timedelta(d) for d in (lo, hi)]
    return F.expr(f"o_orderdate >= TIMESTAMP_NTZ'{at[0]} 00:00:00' AND o_orderdate < TIMESTAMP_NTZ'{at[1]} 00:00:00'")


#: For each table, the codes that come from one of its columns, and what a range of codes says about that column.
IMPLIED: dict[str, dict[str, Callable[[int, int], Column]]] = {
    "lineitem": {"quantity": _whole_from, "discount": _between("l_discount", 100), "price": _between("l_extendedprice", 100)},
    "orders": {"day": _days},
    "supplier": {"s_city": _cities("s_nationkey")},
    "customer": {"c_city": _cities("c_nationkey")},
    "part": {"brand": _brands},
}


def implied(where: Predicate, name: str) -> Column | None:
    """A condition on a table's columns that holds wherever the predicate does; None if there is no such."""
    if isinstance(where, Range):
        rule = IMPLIED.get(name, {}).get(where.name)
        return rule(where.lo, where.hi) if rule else None
    if isinstance(where, And):
        found = [c for c in (implied(p, name) for p in where.parts) if c is not None]
        return reduce(lambda a, b: a & b, found) if found else None
    if isinstance(where, Or):
        found = [implied(p, name) for p in where.parts]
        return reduce(lambda a, b: a | b, found) if found and all(c is not None for c in found) else None
    return None


def customers(spark: SparkSession, sf_dir: str, where: Predicate | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "customer", where)
    return rows.select(F.col("c_custkey").alias("c_key"), codes.city_code(F.col("c_nationkey"), F.col("c_custkey")).alias("c_city"))


def suppliers(spark: SparkSession, sf_dir: str, where: Predicate | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "supplier", where)
    return rows.select(F.col("s_suppkey").alias("s_key"), codes.city_code(F.col("s_nationkey"), F.col("s_suppkey")).alias("s_city"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, nation_name) by nation code: the tens of city codes. One row a nation."""
    return table(spark, sf_dir, "nation").select(codes.nation_of(codes.city_code(F.col("n_nationkey"), F.lit(0))).alias("nation"), F.col("n_name").alias("nation_name"))


def parts(spark: SparkSession, sf_dir: str, where: Predicate | None = None) -> DataFrame:
    brand = codes.brand_code(F.col("p_brand"), F.col("p_partkey"))
    return table(spark, sf_dir, "part", where).select(F.col("p_partkey").alias("p_key"), brand.alias("brand"), codes.whole(F.col("p_retailprice"), 60).alias("lo_supplycost"))


def orders(spark: SparkSession, sf_dir: str, where: Predicate | None = None) -> DataFrame:
    date = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders", where).select("o_orderkey", "o_custkey", date.alias("date"))
    return rows.select("*", codes.day_of(F.col("date")).alias("day"), F.year("date").alias("year"))


def facts(spark: SparkSession, sf_dir: str, where: Predicate | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """Facts of line items; with further columns where asked for."""
    rows = table(spark, sf_dir, "lineitem", where).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity"),
        codes.whole(F.col("l_discount"), 100).cast("int").alias("discount"), codes.whole(F.col("l_extendedprice"), 100).alias("price"), *more,
    )
    return rows.withColumn("revenue", codes.discounted(F.col("price"), F.col("discount")))


def star(spark: SparkSession, sf_dir: str, dims: tuple[str, ...] = ("date", "customer", "supplier", "part"), where: Predicate | None = None) -> DataFrame:
    """Facts with the codes of the dimensions asked for, of the rows that meet a predicate over codes.

    Dimensions are small against facts, and smaller still once filtered; whether one is broadcast is left to the
    optimiser, which knows its size. Customers and dates come over the orders.
    """
    rows = facts(spark, sf_dir, where)
    if "part" in dims:
        rows = rows.join(parts(spark, sf_dir, where), F.col("l_partkey") == F.col("p_key"))
    if "supplier" in dims:
        rows = rows.join(suppliers(spark, sf_dir, where), F.col("l_suppkey") == F.col("s_key"))
    if "date" in dims or "customer" in dims:
        dated = orders(spark, sf_dir, where)
        if "customer" in dims:
            dated = dated.join(customers(spark, sf_dir, where), F.col("o_custkey") == F.col("c_key"))
        rows = rows.join(dated, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows if where is None else rows.where(where.column())


#: The same view for DuckDB.
STAR_SQL = """
WITH place AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
star AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l.quantity, l.discount, l.price,
    (l.price * (100 - l.discount)) // 100 AS revenue,
    CAST(round(p_retailprice * 60) AS BIGINT) AS lo_supplycost,
    (CAST(substr(p_brand, 7) AS INT) - 1) * 40 + CAST(p_partkey % 40 AS INT) AS brand,
    CAST((s_nationkey % 5) * 50 + (s_nationkey // 5) * 10 + s_suppkey % 10 AS INT) AS s_city, sp.n_name AS s_nation, sp.r_name AS s_region,
    CAST((c_nationkey % 5) * 50 + (c_nationkey // 5) * 10 + c_custkey % 10 AS INT) AS c_city, cp.n_name AS c_nation, cp.r_name AS c_region,
    rpad(substr(sp.n_name, 1, 9), 9, ' ') || CAST(s_suppkey % 10 AS VARCHAR) AS s_city_name,
    rpad(substr(cp.n_name, 1, 9), 9, ' ') || CAST(c_custkey % 10 AS VARCHAR) AS c_city_name,
    CAST(o_orderdate AS DATE) AS date, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS year,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day,
    'MFGR#' || CAST(brand // 200 + 1 AS VARCHAR) || CAST(brand // 40 % 5 + 1 AS VARCHAR) AS category_name,
    'MFGR#' || CAST(brand // 200 + 1 AS VARCHAR) || CAST(brand // 40 % 5 + 1 AS VARCHAR) || lpad(CAST(brand % 40 + 1 AS VARCHAR), 2, '0') AS brand_name
  FROM (SELECT *, CAST(l_quantity AS INT) AS quantity, CAST(round(l_discount * 100) AS INT) AS discount,
          CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey JOIN place sp ON s_nationkey = sp.n_nationkey JOIN place cp ON c_nationkey = cp.n_nationkey)
"""
