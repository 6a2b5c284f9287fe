from collections import Counter

from starlode.llm import sharding


def test_parts_of_a_large_group_meet(documents, monkeypatch):
    monkeypatch.setattr(sharding, "SMALL_UNIT", 4)  # as in a large table: the group has many parts
    rows = [(i, "copy" if i < 96 else f"alone {i}") for i in range(3200)]  # 3 %, under half a shard's share
    got = sharding.assign(documents(rows)).collect()
    where = Counter(r["shard"] for r in got if r["doc_id"] < 96)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == len(rows)
    assert max(where.values()) >= 80, where


def test_groups_that_fit_in_a_shard_are_not_cut(documents):
    rows = [(i, f"copy {i % 5}" if i < 2000 else f"alone {i}") for i in range(10_000)]  # a shard holds 625
    got = sharding.assign(documents(rows)).collect()
    places = {g: {r["shard"] for r in got if r["doc_id"] < 2000 and r["doc_id"] % 5 == g} for g in range(5)}
    assert all(len(p) == 1 for p in places.values()), places


def test_identical_rows_are_told_apart(documents, spark):
    rows = spark.range(4000).selectExpr("7L AS doc_id", "'one row' AS text").repartition(5)
    told = sharding.told_apart(sharding.base_rows(rows).withColumn("serial", sharding.F.monotonically_increasing_id()))
    assert told.select("own").distinct().count() == 4000
    assert Counter(r["n"] for r in told.groupBy(sharding.F.pmod("own", sharding.F.lit(16)).alias("p")).agg(sharding.F.count("*").alias("n")).collect()).total() == 16
    again = sharding.told_apart(sharding.base_rows(rows.coalesce(2)).withColumn("serial", sharding.F.monotonically_increasing_id()))
    assert told.select("own").exceptAll(again.select("own")).isEmpty()
    got = sharding.assign(rows.unionAll(spark.createDataFrame([(i, f"t {i}") for i in range(100)] + [(None, None)] * 60, "doc_id long, text string"))).collect()
    assert len(got) == 4160 and max(Counter(r["shard"] for r in got).values()) == 260
    assert len({(r["shard"], r["slot"]) for r in got}) == 4160


def test_row_buckets_follow_the_table():
    assert [sharding.row_buckets(n, 16) for n in (0, 10**6, 10**9, 10**11, 10**13)] == [16, 16, 64, 4096, 4096]
