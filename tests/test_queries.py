import re

import pytest
from comparing import same

from starlode import queries
from starlode.operators import bitmap, words
from starlode.plans import index_path, ssb
from starlode.sources.rows import numbered

KINDS = ["sparse", "medium", "dense", "perfect", "many_or", "candchk"]
THIRTEEN = [n for n in ssb.QUERIES if len(n) == 7]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, sf, duck, name):
    assert same(queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("name", ["ssb_q33_wide", "ssb_q34_wide", "ssb_q43_wide"])
def test_index_path_equals_scan_where_there_are_rows(spark, sf, kind, name):
    found, scanned = (f.collect() for f in (index_path.run(spark, sf, name, kind), ssb.scan(spark, sf, name)))
    assert sorted(map(tuple, found)) == sorted(map(tuple, scanned))


def pushed(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan))


#: Columns that each query's predicate says something about.
PUSHED = {
    "ssb_q1": ("l_quantity", "l_discount", "o_orderdate"), "ssb_q2": ("p_brand", "s_nationkey"), "ssb_q3": ("c_nationkey", "s_nationkey", "o_orderdate"),
    "ssb_q41": ("c_nationkey", "s_nationkey", "p_brand"), "ssb_q42": ("c_nationkey", "s_nationkey", "p_brand", "o_orderdate"), "ssb_q43": ("c_nationkey", "s_nationkey", "p_brand", "o_orderdate"),
}


@pytest.mark.parametrize("name", THIRTEEN)
def test_values_reach_the_scans(spark, sf, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    got = pushed(ssb.scan(spark, sf, name))
    for column in PUSHED.get(name) or PUSHED[name[:6]]:
        assert re.search(rf"(GreaterThan|LessThan|EqualTo|In|Or)\w*\([^\]]*{column}", got), (column, got)


def test_index_join_shuffles_no_facts(spark, sf):
    frame = index_path.run(spark, sf, "ssb_q21", "dense")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index_path.run(spark, sf, "ssb_q21", "dense")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert frame.count() > 0 and "hashpartitioning(word" not in plan and "Python" not in plan and "Arrow" not in plan


def test_words_agree_with_bitmaps(spark, sf):
    rows = numbered(queries.facts(spark, sf))
    placed = words.placed(rows)
    index = words.build(placed, queries.MISALIGNED_LAYOUT, 8)
    other = bitmap.stored(rows, queries.MISALIGNED_LAYOUT)
    a = words.cardinality(index, queries.MISALIGNED, queries.MISALIGNED_LAYOUT).first()
    b = bitmap.cardinality(queries.MISALIGNED, other, queries.MISALIGNED_LAYOUT, rows.count()).first()
    assert tuple(a) == tuple(b) and a["uncertain"] > 0
    got = words.select(placed, index, queries.MISALIGNED, queries.MISALIGNED_LAYOUT).select("row_id")
    assert got.exceptAll(rows.where(queries.MISALIGNED.column()).select("row_id")).isEmpty() and got.count() == rows.where(queries.MISALIGNED.column()).count()
