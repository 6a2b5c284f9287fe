"""The registered queries of the star-schema engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.functions import codes
from starlode.functions.predicates import Compare, Not, Range, all_of, any_of
from starlode.operators import bitmap, joins, wah, words
from starlode.plans import index_path, scan, ssb, synth, wah_cases
from starlode.sources.rows import numbered
from starlode.sources.star import STAR_SQL, facts, orders, star, table
from starlode.storage import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn

    return add


for _name, _query in ssb.QUERIES.items():
    register(_name, ssb.oracle(_query))(partial(lambda spark, sf_dir, name: ssb.scan(spark, sf_dir, name), name=_name))
for _name, _order in ssb.ORDERED.items():
    register(f"{_name}_ordered", ssb.oracle(ssb.QUERIES[_name]) + f" ORDER BY {', '.join(_order)}")(partial(lambda spark, sf_dir, name: ssb.ordered(spark, sf_dir, name), name=_name))
register("ssb_q11_datejoin", ssb.oracle(ssb.QUERIES["ssb_q11"]))(ssb.date_joined)

#: The thirteen queries by every layout and recipe of the stored index.
for _name in [n for n in ssb.QUERIES if len(n) == 7]:
    for _kind in (*index_path.LAYOUTS, "perfect", "many_or", "candchk"):
        register(f"bitmap_{_kind}_{_name[4:]}", ssb.oracle(ssb.QUERIES[_name]))(partial(lambda spark, sf_dir, name, kind: index_path.run(spark, sf_dir, name, kind), name=_name, kind=_kind))

LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
WHOLE_SQL = "CAST(l_quantity AS INT) AS quantity, CAST(round(l_discount * 100) AS INT) AS discount, CAST(round(l_extendedprice * 100) AS BIGINT) AS price"


# Comparison scans.
_SCANS = {
    "scan_eq": ({"quantity": Compare("eq", 7)}, "quantity = 7"),
    "scan_lt": ({"quantity": Compare("lt", 7)}, "quantity < 7"),
    "scan_le": ({"quantity": Compare("le", 7)}, "quantity <= 7"),
    "scan_gt": ({"quantity": Compare("gt", 44)}, "quantity > 44"),
    "scan_ge": ({"quantity": Compare("ge", 44)}, "quantity >= 44"),
    "scan_bt": ({"price": Compare("bt", 2_000_000, 1_000_000)}, "price > 1000000 AND price < 2000000"),
    "scan_conj3": ({"quantity": Compare("lt", 25), "discount": Compare("bt", 2, 7), "price": Compare("ge", 1_500_000)}, "quantity < 25 AND discount > 2 AND discount < 7 AND price >= 1500000"),
    "scan_mixed_eq": ({"quantity": Compare("eq", 12), "discount": Compare("gt", 3), "price": Compare("lt", 1_800_000)}, "quantity = 12 AND discount > 3 AND price < 1800000"),
}
for _name, (_conditions, _sql) in _SCANS.items():
    register(_name, f"SELECT {LINES}, quantity, discount, price FROM (SELECT *, {WHOLE_SQL} FROM lineitem) WHERE {_sql}")(
        partial(lambda spark, sf_dir, conditions: scan.scan(facts(spark, sf_dir, scan.ranges(conditions)).drop("revenue"), conditions), conditions=_conditions)
    )


@register("scan_sieve", f"SELECT {LINES}, quantity, discount, price FROM (SELECT *, {WHOLE_SQL} FROM lineitem) WHERE price < 1200000")
def scan_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).drop("revenue")
    areas = spark.__dict__.setdefault("_starlode_areas", {})
    if sf_dir not in areas:  # made once in a session, like the index
        bounds = scan.boundaries(rows, "price", 16)
        areas[sf_dir] = scan.stored(rows, "price", bounds), bounds
    table_, bounds = areas[sf_dir]
    return scan.sieve_scan(table_, "price", Compare("lt", 1_200_000), bounds).drop("area")


@register("scan_recoded", f"SELECT {LINES}, quantity, discount, price FROM (SELECT *, {WHOLE_SQL} FROM lineitem) WHERE price > 1000000 AND price < 2000000")
def scan_recoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).drop("revenue")
    known = written(scan.ranks(rows, "price"), "codes")
    wanted = scan.recoded(Compare("bt", 1_000_000, 2_000_000), known)
    coded = rows.join(known.withColumnRenamed("value", "price"), "price")
    return coded.where(wanted.on("code")).select(*rows.columns)


@register("value_histogram", "SELECT CAST(l_quantity AS INT) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.histogram(facts(spark, sf_dir), "quantity")


@register(
    "order_preserving_codes",
    """SELECT value, CAST(sum(n) OVER (ORDER BY value) * 4294967295 // (sum(n) OVER ()) AS BIGINT) AS code
    FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS value, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def order_preserving_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.ranks(facts(spark, sf_dir), "price").withColumn("code", F.col("code").cast("bigint"))


# Synthetic query: line items stand for facts, parts for the dimension.
@register(
    "synth_or_and_count",
    """SELECT CAST(p_size % 256 AS INT) AS attr2, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE ((l_suppkey >= 10 AND l_suppkey < 40) OR (CAST(l_quantity AS INT) >= 5 AND CAST(l_quantity AS INT) < 9))
    AND p_partkey >= 100 AND p_partkey < 1500 GROUP BY 1""",
)
def synth_or_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fk"), F.col("l_suppkey").alias("a1"), F.col("l_quantity").cast("int").alias("a2"))
    dim = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("attr1"), (F.col("p_size") % 256).cast("int").alias("attr2"))
    return synth.count_query(fact, dim, (10, 40), (5, 9), (100, 1500))


# The grid of the synthetic study: every skew, column width and share, counted in one pass.
_GRID = synth.grid()
_POINT = "((a1_{2} >= {0} AND a1_{2} < {1}) OR (a2_{2} >= {0} AND a2_{2} < {1})) AND b1_{2} >= {0} AND b1_{2} < {1}"
_POINTS = {f"skew {s} bits {bits} share {share}": _POINT.format(a, a + synth.WIDTH, bits) for s, bits, share, a in _GRID}
_GRID_COLUMNS = ("l_partkey % 1083", "CAST(l_quantity AS INT) * 21", "p_partkey * 7 % 1083")
_GRID_ROWS = "SELECT " + ", ".join(f"CAST({c} AS {'SMALLINT' if bits == 16 else 'INT'}) AS {n}_{bits}" for bits in synth.COLUMN_BITS for n, c in zip(("a1", "a2", "b1"), _GRID_COLUMNS, strict=True))


@register(
    "synth_grid",
    "SELECT point, n FROM (SELECT " + ", ".join(f'count(*) FILTER ({c}) AS "{p}"' for p, c in _POINTS.items()) + f" FROM ({_GRID_ROWS} FROM lineitem JOIN part ON l_partkey = p_partkey)) UNPIVOT (n FOR point IN (COLUMNS(*)))",
)
def synth_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, dim = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), table(spark, sf_dir, "part").select("p_partkey")
    rows = fact.join(dim, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*_GRID_ROWS.removeprefix("SELECT ").split(", "))
    sums = rows.agg(*[F.count_if(F.expr(c)).alias(p) for p, c in _POINTS.items()])
    return sums.unpivot([], [f"`{p}`" for p in _POINTS], "point", "n")


# Joins.
@register("semi_join_probe", f"SELECT {LINES} FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def semi_join_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*LINES.split(", "))
    return joins.probe(rows, table(spark, sf_dir, "supplier").where("s_nationkey < 5"), "l_suppkey", "s_suppkey").select(*LINES.split(", "))


@register("lookup_join", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.lookup(rows, table(spark, sf_dir, "part").where("p_size < 10"), "l_partkey", "p_partkey", ["p_brand", "p_size"])


@register("hash_join_sum", "SELECT CAST(sum(CAST(l_quantity AS BIGINT) * p_size) AS BIGINT) AS total FROM lineitem JOIN part ON l_partkey = p_partkey")
def hash_join_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("v"))
    return joins.join_sum(fact, table(spark, sf_dir, "part").select("p_partkey", "p_size"), "l_partkey", "p_partkey", F.col("v") * F.col("p_size"))


@register(
    "snowflake_two_hop",
    "SELECT c_mktsegment, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def snowflake_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = [(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey"), (table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey")]
    return joins.chain(table(spark, sf_dir, "lineitem").select("l_orderkey"), hops).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


# Projections and codes.
@register("project_linear", "SELECT l_orderkey, l_linenumber, round(2.0::DOUBLE * l_discount + 3.0::DOUBLE * l_tax, 6) AS y FROM lineitem")
def project_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(codes.linear(F.col("l_discount"), F.col("l_tax")), 6).alias("y"))


@register("project_sigmoid", "SELECT l_orderkey, l_linenumber, round(1.0::DOUBLE / (1 + exp(-(2.0::DOUBLE * l_discount + 3.0::DOUBLE * l_tax))), 6) AS y FROM lineitem")
def project_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(codes.sigmoid(F.col("l_discount"), F.col("l_tax")), 6).alias("y"))


@register(
    "rollup_city_nation_region",
    f"{STAR_SQL} SELECT s_city AS city, s_city // 10 AS nation, s_city // 50 AS region, CAST(sum(revenue) AS BIGINT) AS revenue FROM star GROUP BY 1, 2, 3",
)
def rollup_city_nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star(spark, sf_dir, ("supplier",)).groupBy(F.col("s_city").alias("city")).agg(F.sum("revenue").cast("bigint").alias("revenue"))
    return rows.select("city", codes.nation_of(F.col("city")).alias("nation"), codes.region_of(F.col("city")).alias("region"), "revenue")


@register(
    "rollup_brand_category_manufacturer",
    f"{STAR_SQL} SELECT brand, brand // 40 AS category, brand // 200 AS manufacturer, category_name, brand_name, count(*) AS n FROM star GROUP BY ALL",
)
def rollup_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star(spark, sf_dir, ("part",)).groupBy("brand").agg(F.count("*").alias("n"))
    brand = F.col("brand")
    return rows.select(
        "brand", codes.category_of(brand).alias("category"), codes.manufacturer_of(brand).alias("manufacturer"),
        codes.category_label(brand).alias("category_name"), codes.brand_label(brand).alias("brand_name"), "n",
    )


@register(
    "compact_dates",
    "SELECT o_orderkey, CAST(strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS INT) AS yyyymmdd, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS year FROM orders",
)
def compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", codes.compact_date(F.col("date")).alias("yyyymmdd"), codes.year_of_day(F.col("day")).alias("year"))


# Bitmap index by itself.
MISALIGNED = all_of(Not(Range("discount", 3, 7)), any_of(Range("quantity", 4, 23), Range("price", 1_000_000, 2_500_000)))
MISALIGNED_LAYOUT = {"discount": bitmap.Bins((0, 2, 5, 8, 11)), "quantity": bitmap.Bins((1, 11, 21, 31, 41, 51)), "price": bitmap.Bins(tuple(range(0, 20_000_001, 1_500_000)) + (1 << 40,))}


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, words.Index]:
    rows = words.placed(numbered(facts(spark, sf_dir)))
    return rows, words.build(rows, MISALIGNED_LAYOUT, words.buckets_for(rows.count()))


@register(
    "bitmap_not",
    f"SELECT {LINES}, price FROM (SELECT *, {WHOLE_SQL} FROM lineitem) WHERE NOT (discount >= 3 AND discount < 7) AND ((quantity >= 4 AND quantity < 23) OR (price >= 1000000 AND price < 2500000))",
)
def bitmap_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index = _indexed(spark, sf_dir)
    return words.select(rows, index, MISALIGNED, MISALIGNED_LAYOUT).select(*LINES.split(", "), "price")


@register("bitmap_count", "SELECT count(*) AS possible, 0::BIGINT AS uncertain FROM lineitem WHERE round(l_discount * 100) >= 2 AND round(l_discount * 100) < 8 AND CAST(l_quantity AS INT) >= 11 AND CAST(l_quantity AS INT) < 31")
def bitmap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark, sf_dir)
    return words.cardinality(index, all_of(Range("discount", 2, 8), Range("quantity", 11, 31)), MISALIGNED_LAYOUT)


@register(
    "bitmap_sizes",
    "SELECT 'discount' AS name, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, count(*) AS rows FROM lineitem JOIN (VALUES (0, 2), (2, 5), (5, 8), (8, 11)) b(lo, hi) ON round(l_discount * 100) >= lo AND round(l_discount * 100) < hi GROUP BY 2, 3",
)
def bitmap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(facts(spark, sf_dir).select("discount"))
    built = bitmap.build(rows, {"discount": MISALIGNED_LAYOUT["discount"]})
    return bitmap.sizes(built).select("name", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), F.col("rows").cast("bigint").alias("rows"))


# Run-length bitmaps.
_ONE, _TWO = "discount = 0", "quantity < 25"
_SQL = {_ONE: "round(l_discount * 100) = 0", _TWO: "CAST(l_quantity AS INT) < 25"}



def _ordered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Numbered rows, the words of both predicates, and the number of rows."""
    rows = numbered(facts(spark, sf_dir).select("l_orderkey", "l_linenumber", "quantity", "discount"))
    one, two = (wah.flat(rows.where(where), F.lit(name)) for name, where in (("one", _ONE), ("two", _TWO)))
    return rows, one, two, rows.count()


@register("wah_roundtrip", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_SQL[_ONE]}")
def wah_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, one, _, n = _ordered(spark, sf_dir)
    return wah_cases.rows_of(wah.decoded(wah.encoded(wah.runs(one, n))), rows)


for _op, _sql in {"and": f"{_SQL[_ONE]} AND {_SQL[_TWO]}", "or": f"{_SQL[_ONE]} OR {_SQL[_TWO]}", "xor": f"({_SQL[_ONE]}) <> ({_SQL[_TWO]})"}.items():

    def _combine(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
        rows, one, two, n = _ordered(spark, sf_dir)
        return wah_cases.rows_of(wah.decoded(wah.encoded(wah.combined_runs(wah.runs(one, n), wah.runs(two, n), op))), rows)

    def _mix(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
        rows, one, two, n = _ordered(spark, sf_dir)
        return wah_cases.rows_of(wah.combined_mixed(wah.runs(one, n), two, op), rows)

    register(f"wah_{_op}", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_sql}")(partial(_combine, op=_op))
    register(f"wah_mixed_{_op}", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_sql}")(partial(_mix, op=_op))


@register("wah_andnot", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_SQL[_ONE]} AND NOT ({_SQL[_TWO]})")
def wah_andnot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, one, two, _ = _ordered(spark, sf_dir)
    return wah_cases.rows_of(wah.combined(one, two, "andnot"), rows)


for _name in wah_cases.CASES:
    register(f"wah_{_name}", wah_cases.case_sql(_name))(partial(wah_cases.case, name=_name))
for _skew in wah_cases.SKEWS:
    for _letter, _united in (("d", True), ("c", False)):
        register(f"wah_z{round(_skew * 10)}{_letter}", wah_cases.skewed_sql(_skew, _united))(partial(wah_cases.skewed, skew=_skew, united=_united))
