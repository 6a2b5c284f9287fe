import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlode.functions import codes
from starlode.functions.predicates import Compare, Range, commands, conjunction
from starlode.operators import joins
from starlode.plans import scan, synth
from starlode.plans.ssb import QUERIES
from starlode.sources import files, generate

TOP = (1 << 32) - 1


@pytest.mark.parametrize("op, want", [("eq", {10}), ("lt", {0, 9}), ("le", {0, 9, 10}), ("gt", {11, TOP}), ("ge", {10, 11, TOP})])
def test_comparisons_at_their_edges(spark, op, want):
    rows = spark.createDataFrame([(v,) for v in (0, 9, 10, 11, TOP)], "x long")
    assert {r["x"] for r in scan.scan(rows, {"x": Compare(op, 10)}).collect()} == want


def test_between_is_exclusive_and_takes_either_order(spark):
    rows = spark.range(10).withColumnRenamed("id", "x")
    for pair in ((3, 7), (7, 3)):
        assert {r["x"] for r in rows.where(conjunction({"x": Compare("bt", *pair)})).collect()} == {4, 5, 6}


def test_scan_commands():
    got = list(commands(["lt 10", "", "q3", "bt 3,7", "eq 5", "exit", "gt 1"]))
    assert got == [Compare("lt", 10.0), Compare("bt", 3.0, 7.0), Compare("eq", 5.0)]


def test_sieve_gives_the_scan(spark):
    rows = generate.uniform(spark, 5000, 1000)
    bounds = scan.boundaries(rows, "value", 16)
    table = scan.sieved(rows, "value", bounds)
    for c in (Compare("lt", 100), Compare("ge", 900), Compare("eq", 321), Compare("bt", 10, 50), Compare("gt", 2000)):
        assert scan.equal_rows(scan.sieve_scan(table, "value", c, bounds).drop("area"), rows.where(c.on("value")))


def test_ranks_keep_order_and_ties(spark):
    rows = spark.createDataFrame([(v,) for v in (5, 5, 1, 9, 1, 1, 7, None)], "x int")
    got = {r["value"]: r["code"] for r in scan.ranks(rows, "x", top=70).collect()}
    assert got == {1: 30, 5: 50, 7: 60, 9: 70}


def test_year_bounds():
    assert codes.year_starts() == [0, 365, 731, 1096, 1461, 1826, 2192, 2557]
    assert codes.day(datetime.date(1997, 2, 1)) == 762


def test_profit_is_signed_and_groups_are_exact(spark):
    rows = spark.createDataFrame([(1996, 57, 10, 40), (1996, 68, 10, 5), (1996, 51, 1, 1)], "year int, c_city int, revenue long, lo_supplycost long")
    names = spark.createDataFrame([(5, "A"), (6, "B"), (7, "C")], "nation int, nation_name string")
    got = {tuple(r) for r in QUERIES["ssb_q41"].grouped(rows, names).collect()}
    assert got == {(1996, "A", -30), (1996, "B", 5)}


def test_dangling_keys_and_key_zero(spark):
    fact = spark.createDataFrame([(0, 1), (1, 2), (5, 3), (None, 4)], "fk long, v long")
    dim = spark.createDataFrame([(0, 10), (1, 20)], "key long, w long")
    assert {r["v"] for r in joins.probe(fact, dim, "fk", "key").collect()} == {1, 2}
    assert joins.join_sum(fact, dim, "fk", "key", F.col("v") * F.col("w")).first()["total"] == 50
    assert joins.join_sum(fact.limit(0), dim, "fk", "key", F.col("v") * F.col("w")).first()["total"] == 0


def test_synthetic_count(spark):
    rng = np.random.default_rng(2)
    fact = [tuple(map(int, r)) for r in rng.integers(0, 50, (400, 3))]
    dim = [(k, k, k % 7) for k in range(45)]
    got = synth.count_query(spark.createDataFrame(fact, "fk long, a1 long, a2 long"), spark.createDataFrame(dim, "key long, attr1 long, attr2 long"), (5, 20), (30, 33), (10, 40))
    want: dict[int, int] = {}
    for fk, a1, a2 in fact:
        if fk < 45 and (5 <= a1 < 20 or 30 <= a2 < 33) and 10 <= fk < 40:
            want[fk % 7] = want.get(fk % 7, 0) + 1
    assert {r["attr2"]: r["n"] for r in got.collect()} == want


@pytest.mark.parametrize("s", [1.04, 1.12, 1.2])
def test_window_shares(s):
    assert abs(synth.zeta(2.0) - np.pi**2 / 6) < 1e-9
    assert synth.window_share(s, 0, 60) > synth.window_share(s, 100, 60)
    start = synth.window_for(s, 0.001)
    near = [abs(synth.selectivity(s, k, 60) - 0.001) for k in (max(0, start - 1), start, min(1023, start + 1))]
    assert near[1] <= min(near) + 1e-12


def test_window_stops_at_the_first(spark):
    assert synth.window_for(1.04, 0.8) == 0


def test_generators_do_not_depend_on_partitions(spark):
    make = lambda: generate.lineorders(spark, 300, 100, 200, 20)
    one = sorted(map(tuple, make().collect()))
    assert one == sorted(map(tuple, make().repartition(7).collect()))
    rows = make()
    assert rows.groupBy("lo_orderkey").agg(F.count_distinct("lo_custkey", "lo_orderdate").alias("n")).where("n > 1").isEmpty()
    assert rows.where("lo_revenue != floor(lo_extendedprice * (100 - lo_discount) / 100) or lo_quantity not between 1 and 50").isEmpty()
    assert {r["key"] for r in generate.primary(spark, 100).collect()} == set(range(1, 101))
    assert {r["count"] for r in generate.foreign(spark, 500, 100).groupBy("key").count().collect()} == {5}
    assert generate.zipf(spark, 5000, 1.2, 1000).where("value >= 1000 or value < 0").isEmpty()
    assert generate.inverted_lists(spark, 1000).count() == 1000
    assert abs(generate.normal(spark, 4000, 1000, 10).agg(F.avg("value")).first()[0] - 1000) < 2
    assert generate.cycled(spark, 10, 3).where("value > 3").isEmpty()
    assert generate.customers(spark, 50).where("c_city >= 250").isEmpty() and generate.parts(spark, 50).count() == 50 and generate.suppliers(spark, 9).count() == 9


def test_text_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "n", "a", "c", "x", "r", "p"), (2, "m", None, "c", "x", "r", "p")], files.text_schema("supplier"))
    files.write_text(rows, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_text(spark, str(tmp_path / "s"), "supplier").collect()))[0] == (1, "n", "a", "c", "x", "r", "p")


def test_extraction(spark):
    rows = spark.createDataFrame([("1997-02-04", "12.349", "b"), ("1995-01-01", "0.5", "a")], "d string, m string, c string")
    got = files.extract(files.extract(files.extract(rows, "d", "date"), "m", "money"), "c", "code")
    assert sorted(map(tuple, got.collect())) == [(19950101, 50, 0), (19970204, 1234, 1)]
    codes_ = files.dictionary(rows, "c")
    assert {r["c"] for r in files.decode(files.encode(rows, codes_, "c"), codes_, "c").collect()} == {"a", "b"}


def test_column_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(files.column_bytes(np.arange(300), 2))
    got = files.read_columns(spark, str(tmp_path / "a"))
    assert got.where("pos != value").isEmpty() and got.count() == 300
    (tmp_path / "b").write_bytes(b"\4\0\0\0abc")
    with pytest.raises(Exception, match="bytes of values"):
        files.read_columns(spark, str(tmp_path / "b")).collect()
    (tmp_path / "p").write_text("0,5,\n7\n")
    assert {r["row_id"] for r in files.read_positions(spark, str(tmp_path / "p")).collect()} == {1, 6, 8}


def test_projections(spark):
    rows = spark.createDataFrame([(0.5, 0.25)], "a double, b double")
    assert rows.select(codes.linear(F.col("a"), F.col("b"))).first()[0] == 1.75
    assert abs(rows.select(codes.sigmoid(F.col("a"), F.col("b"))).first()[0] - 1 / (1 + np.exp(-1.75))) < 1e-12
    assert Range("a", 0, 1).lo == 0
