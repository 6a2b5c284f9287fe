"""The thirteen star-schema benchmark queries, their twins with the reference's literals and keys, and wider variants.

A query is data: a predicate over codes (for the scan path and the index path alike), the dimensions it needs, group keys
and a measure. Rows are grouped by codes; labels are added to the groups. Sums are signed 64-bit numbers. Years are those of the driver tables, three
after the benchmark's.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.functions.codes import YEARS, brand_label, category_label, category_of, city_label, day, nation_of, year_starts
from starlode.functions.predicates import And, Or, Predicate, Range, all_of
from starlode.sources.star import STAR_SQL, nations, star


def key_columns() -> dict[str, tuple[Column, str, Column]]:
    """For each group key: the code to group by, the column it stands in, and its label."""
    found = {"year": (F.col("year"), "year", F.col("year")), "brand_name": (F.col("brand"), "brand", brand_label(F.col("brand")))}
    found["category_name"] = (category_of(F.col("brand")), "category", category_label(F.col("category") * 40))
    for p in "cs":
        city, label = F.col(f"{p}_city"), F.col(f"{p}_label")
        found[f"{p}_nation"] = (nation_of(city), f"{p}_nation", label)
        found[f"{p}_city_name"] = (city, f"{p}_city", city_label(label, city))
    return found


@dataclass(frozen=True)
class Query:
    where: Predicate
    measure: str
    keys: tuple[str, ...] = ()
    dims: tuple[str, ...] = ("date",)

    def measured(self) -> Column:
        value = {"volume": F.col("price") * F.col("discount"), "revenue": F.col("revenue"), "profit": F.col("revenue") - F.col("lo_supplycost")}[self.measure]
        return F.sum(value).cast("bigint").alias(self.measure)

    def grouped(self, rows: DataFrame, nations: DataFrame) -> DataFrame:
        """Sums of rows of codes by the group keys; nations (nation, nation_name) give names to the groups."""
        if not self.keys:
            return rows.agg(self.measured())
        of = key_columns()
        found = rows.groupBy(*[of[k][0].alias(of[k][1]) for k in self.keys]).agg(self.measured())
        for place in dict.fromkeys(k[0] for k in self.keys if k[1] == "_"):
            names = nations.select(F.col("nation").alias(f"{place}_at"), F.col("nation_name").alias(f"{place}_label"))
            code = next(of[k][1] for k in self.keys if k.startswith(f"{place}_"))
            at = nation_of(F.col(code)) if code.endswith("city") else F.col(code)
            found = found.join(F.broadcast(names), at == F.col(f"{place}_at"))  # a row a nation
        return found.select(*[of[k][2].alias(k) for k in self.keys], self.measure)


def years(first: int, last: int) -> Range:
    """Order dates of whole years, counted as in the benchmark (1992 to 1998)."""
    starts = year_starts()
    return Range("day", starts[first - 1992], starts[last - 1992 + 1])


def dates(first: tuple[int, int, int], after: tuple[int, int, int]) -> Range:
    return Range("day", day(datetime.date(*first)), day(datetime.date(*after)))


def region(place: str, code: int) -> Range:
    return Range(f"{place}_city", code * 50, code * 50 + 50)


def nation(place: str, code: int) -> Range:
    return Range(f"{place}_city", code * 10, code * 10 + 10)


def city_range(place: str, lo: int, hi: int) -> Range:
    return Range(f"{place}_city", lo, hi)


def cities(place: str, *codes: int) -> Predicate:
    return Or(tuple(Range(f"{place}_city", c, c + 1) for c in codes))


def brands(lo: int, hi: int) -> Range:
    return Range("brand", lo, hi)


#: Region codes (in label order) and the codes of the two nations and two cities that the queries name.
AMERICA, ASIA, EUROPE = 1, 2, 3
UNITED_STATES, UNITED_KINGDOM = 9, 15
KI1, KI5 = 151, 155

_Q1 = dict(measure="volume")
_Q2 = dict(measure="revenue", keys=("year", "brand_name"), dims=("date", "supplier", "part"))
_Q3 = dict(measure="revenue", dims=("date", "supplier", "customer"))
_CITY = ("c_city_name", "s_city_name", "year")
_Q4 = dict(measure="profit", dims=("date", "supplier", "customer", "part"))
_DECEMBER = dates((2000, 12, 1), (2001, 1, 1))
_AMERICAS = (region("c", AMERICA), region("s", AMERICA))

QUERIES: dict[str, Query] = {
    "ssb_q11": Query(all_of(years(1993, 1993), Range("discount", 1, 4), Range("quantity", 1, 25)), **_Q1),
    "ssb_q12": Query(all_of(dates((1997, 1, 1), (1997, 2, 1)), Range("discount", 4, 7), Range("quantity", 26, 36)), **_Q1),
    "ssb_q13": Query(all_of(dates((1997, 2, 4), (1997, 2, 11)), Range("discount", 5, 8), Range("quantity", 26, 36)), **_Q1),
    "ssb_q21": Query(all_of(brands(40, 80), region("s", AMERICA)), **_Q2),
    "ssb_q22": Query(all_of(brands(260, 268), region("s", ASIA)), **_Q2),
    "ssb_q23": Query(all_of(brands(278, 279), region("s", EUROPE)), **_Q2),
    "ssb_q31": Query(all_of(region("c", ASIA), region("s", ASIA), years(1992, 1997)), keys=("c_nation", "s_nation", "year"), **_Q3),
    "ssb_q32": Query(all_of(nation("c", UNITED_STATES), nation("s", UNITED_STATES), years(1992, 1997)), keys=_CITY, **_Q3),
    "ssb_q33": Query(all_of(cities("c", KI1, KI5), cities("s", KI1, KI5), years(1992, 1997)), keys=_CITY, **_Q3),
    "ssb_q34": Query(all_of(cities("c", KI1, KI5), cities("s", KI1, KI5), _DECEMBER), keys=_CITY, **_Q3),
    "ssb_q41": Query(all_of(*_AMERICAS, brands(0, 400)), keys=("year", "c_nation"), **_Q4),
    "ssb_q42": Query(all_of(*_AMERICAS, brands(0, 400), years(1997, 1998)), keys=("year", "s_nation", "category_name"), **_Q4),
    "ssb_q43": Query(all_of(region("c", AMERICA), nation("s", UNITED_STATES), brands(120, 160), years(1997, 1998)), keys=("year", "s_city_name", "brand_name"), **_Q4),
    # The reference's own literals and keys where they differ from the benchmark's text.
    "ssb_q23_ref": Query(all_of(brands(260, 261), region("s", EUROPE)), **_Q2),
    "ssb_q33_ref": Query(all_of(city_range("c", 151, 155), city_range("s", 151, 155), years(1992, 1997)), keys=_CITY, **_Q3),
    "ssb_q34_ref": Query(all_of(city_range("c", 151, 155), city_range("s", 151, 155), _DECEMBER), keys=_CITY, **_Q3),
    "ssb_q41_ref": Query(all_of(*_AMERICAS, brands(0, 400)), keys=("year", "s_nation", "category_name"), **_Q4),
    # The narrow ones over wider places, so that small tables have rows to compare.
    "ssb_q33_wide": Query(all_of(nation("c", UNITED_KINGDOM), nation("s", UNITED_KINGDOM), years(1992, 1997)), keys=_CITY, **_Q3),
    "ssb_q34_wide": Query(all_of(region("c", EUROPE), region("s", EUROPE), _DECEMBER), keys=_CITY, **_Q3),
    "ssb_q43_wide": Query(all_of(*_AMERICAS, brands(120, 160), years(1997, 1998)), keys=("year", "s_city_name", "brand_name"), **_Q4),
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The query as filters, joins and one aggregation."""
    query = QUERIES[name]
    return query.grouped(star(spark, sf_dir, query.dims, query.where), nations(spark, sf_dir))


#: The benchmark's order of the results, where it asks for one.
ORDERED: dict[str, tuple[str, ...]] = {n: ("year", "brand_name") for n in ("ssb_q21", "ssb_q22", "ssb_q23")}
ORDERED |= {n: ("year", "revenue DESC") for n in ("ssb_q31", "ssb_q32", "ssb_q33", "ssb_q34")}
ORDERED |= {n: QUERIES[n].keys for n in ("ssb_q41", "ssb_q42", "ssb_q43")}


def ordered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The query's groups in the benchmark's order."""
    return scan(spark, sf_dir, name).orderBy(*[F.col(o.split()[0]).desc() if o.endswith("DESC") else F.col(o) for o in ORDERED[name]])


def sql_of(where: Predicate) -> str:
    if isinstance(where, Range):
        return f"({where.name} >= {where.lo} AND {where.name} < {where.hi})"
    if isinstance(where, And):
        return "(" + " AND ".join(map(sql_of, where.parts)) + ")"
    if isinstance(where, Or):
        return "(" + " OR ".join(map(sql_of, where.parts)) + ")"
    return f"(NOT {sql_of(where.part)})"


def oracle(query: Query) -> str:
    value = {"volume": "price * discount", "revenue": "revenue", "profit": "revenue - lo_supplycost"}[query.measure]
    keys = "".join(f"{k}, " for k in query.keys)
    group = f" GROUP BY {', '.join(query.keys)}" if query.keys else ""
    return f"{STAR_SQL} SELECT {keys}CAST(sum({value}) AS BIGINT) AS {query.measure} FROM star WHERE {sql_of(query.where)}{group}"


def date_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1.1 with a date dimension joined on its day instead of a range of days; the same rows."""
    days = spark.range(year_starts()[YEARS]).select(F.col("id").cast("int").alias("d_day"), F.year(F.date_add(F.lit(datetime.date(1995, 1, 1)), F.col("id").cast("int"))).alias("d_year"))
    kept = all_of(Range("discount", 1, 4), Range("quantity", 1, 25))
    rows = star(spark, sf_dir, ("date",), kept).join(days.where("d_year = 1996"), F.col("day") == F.col("d_day"))
    return QUERIES["ssb_q11"].grouped(rows, nations(spark, sf_dir))
