"""Conjunctive comparison scans over numeric columns, and a sieve of equal-depth areas in front of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlode.functions.predicates import Compare, Predicate, Range, all_of, conjunction
from starlode.storage import shared_dir

#: Equal-depth areas of a column.
AREAS = 128


def scan(rows: DataFrame, conditions: dict[str, Compare]) -> DataFrame:
    """The rows that meet a comparison on each of the columns named (any number, any mix of operators)."""
    return rows.where(conjunction(conditions))


def ranges(conditions: dict[str, Compare]) -> Predicate:
    """Half-open ranges of whole numbers that hold all values which meet the conditions; open ends reach very far."""
    return all_of(*[Range(name, *c.span()) for name, c in conditions.items()])


def boundaries(rows: DataFrame, name: str, areas: int = AREAS, error: float = 0.0005) -> list[float]:
    """Values that part a column into areas of about equal numbers of rows; at most areas - 1, ascending."""
    return sorted(set(rows.approxQuantile(name, [i / areas for i in range(1, areas)], error)))


def area_of(name: str, bounds: list[float]) -> Column:
    """The area of a value: how many boundaries are at or below it."""
    array = F.array(*[F.lit(b) for b in bounds])
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(array, lambda b: b <= F.col(name)))


def sieved(rows: DataFrame, name: str, bounds: list[float]) -> DataFrame:
    """Rows with their area as a column; written partitioned by it, a scan skips areas that a comparison cannot meet."""
    return rows.withColumn("area", area_of(name, bounds))


def stored(rows: DataFrame, name: str, bounds: list[float]) -> DataFrame:
    """The sieved rows as a table with a folder for each area, so that a scan lists and reads only those it can meet."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/starlode-areas-{uuid.uuid4().hex}"
    table = sieved(rows, name, bounds)
    table.repartition("area", F.pmod(F.hash(*rows.columns), F.lit(4))).write.partitionBy("area").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def appended(table: DataFrame, rows: DataFrame, name: str, bounds: list[float]) -> DataFrame:
    """A sieved table with further rows; values beyond the old ones fall in the first or the last area."""
    return table.unionByName(sieved(rows, name, bounds))


def areas_met(condition: Compare, bounds: list[float]) -> tuple[int, int]:
    """First and last area (inclusive) that can hold a value that meets a comparison."""

    def area(value: float) -> int:
        return sum(b <= value for b in bounds)

    last = len(bounds)
    if condition.op == "bt":
        low, high = sorted((condition.value, condition.other))
        return area(low), area(high)
    return {"eq": (area(condition.value),) * 2, "lt": (0, area(condition.value)), "le": (0, area(condition.value)), "gt": (area(condition.value), last), "ge": (area(condition.value), last)}[condition.op]


def sieve_scan(table: DataFrame, name: str, condition: Compare, bounds: list[float]) -> DataFrame:
    """A comparison on a sieved table: a range of areas first (pruned at the source if partitioned), then the comparison."""
    first, last = areas_met(condition, bounds)
    return table.where((F.col("area") >= first) & (F.col("area") <= last)).where(condition.on(name))


def complement(condition: Compare) -> list[Compare]:
    """Comparisons, either of which holds exactly where the condition does not; for whole or fractional values alike."""
    turned = {"lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}
    if condition.op in turned:
        return [Compare(turned[condition.op], condition.value)]
    low, high = sorted((condition.value, condition.value if condition.other is None else condition.other))
    return [Compare("lt", low), Compare("gt", high)] if condition.op == "eq" else [Compare("le", low), Compare("ge", high)]


def nearest_boundary(value: float, bounds: list[float]) -> tuple[int, bool] | None:
    """The boundary next to a value, and whether rows below it are the smaller part of the table to look through: a scan for
    the larger part may look through the smaller one and take what that leaves."""
    if not bounds:
        return None
    at = min(range(len(bounds)), key=lambda i: (abs(bounds[i] - value), i))
    return at, at + 1 <= (len(bounds) + 1) / 2


def recoded(condition: Compare, codes: DataFrame) -> Compare:
    """A comparison of values as one of the codes that ``ranks`` gives them; it selects the same rows.

    codes has (value, code) of every value there is; the bounds are looked up, and the table stays where it is.
    """
    low, high = condition.span()
    inside = codes.where((F.col("value") >= low) & (F.col("value") < high)).agg(F.min("code").alias("a"), F.max("code").alias("b")).first()
    return Compare("bt", -2, -1) if inside["a"] is None else Compare("bt", inside["a"] - 1, inside["b"] + 1)


def equal_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two scans give the same rows, repeated ones included."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def ranks(rows: DataFrame, name: str, top: int = (1 << 32) - 1) -> DataFrame:
    """An order-preserving code of a column's values by their share of rows at or below: equal values, equal codes.

    (value, code): distinct values with frequencies; the running sum runs in two levels, within ranges of values and over
    the ranges, so that no task gets all of them. Rows get codes by joining on the value.
    """
    spark = rows.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = boundaries(rows, name, groups) if groups > 1 else []
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")).withColumn("part", area_of("value", bounds))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    totals = counts.groupBy("part").agg(F.sum("n").alias("all"))  # one row per range
    before = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    total = totals.agg(F.sum("all").alias("total"))
    placed = counts.withColumn("inside", inside).join(F.broadcast(before), "part").crossJoin(F.broadcast(total))
    return placed.select("value", F.floor((F.col("before") + F.col("inside")) * top / F.col("total")).alias("code"))


def histogram(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))

