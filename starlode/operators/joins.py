"""Join forms of star queries: semi-join probe, N:1 lookup, sums over joins, chains of foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probe(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Fact rows whose key is among the dimension's: a filter, no column of the dimension."""
    return fact.join(dim.select(F.col(dim_key).alias(fact_key)), fact_key, "left_semi")


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, values: list[str]) -> DataFrame:
    """Fact rows with values of their dimension row; rows without one drop out."""
    return fact.join(dim.select(F.col(dim_key).alias("_key"), *values), F.col(fact_key) == F.col("_key")).drop("_key")


def chain(fact: DataFrame, hops: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Joins along a chain of foreign keys: each hop is (table, key so far, key of the table)."""
    return reduce(lambda rows, hop: rows.join(hop[0], F.col(hop[1]) == F.col(hop[2])), hops, fact)


def join_sum(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, product: Column) -> DataFrame:
    """One row: the sum of a product over the join, 0 if nothing joins."""
    joined = fact.join(dim, F.col(fact_key) == F.col(dim_key))
    return joined.agg(F.coalesce(F.sum(product), F.lit(0)).cast("bigint").alias("total"))
