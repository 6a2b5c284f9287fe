import numpy as np
import pytest
from pyspark.sql import functions as F

from starlode import queries, storage
from starlode.functions.predicates import Compare
from starlode.operators import wah
from starlode.plans import scan, synth
from starlode.sources import bitmap_files, files, generate


def set_rows(words):
    return {(r["bitmap"], r["row_id"]) for r in wah.positions(words).collect()}


def test_files_of_run_length_words(spark, tmp_path):
    n = 31 * 400
    rows = [("short", r) for r in (1, 5, 32, n)] + [("long", r) for r in range(63, 31 * 60)]
    runs = wah.runs(wah.flat(spark.createDataFrame(rows, "bitmap string, row_id long")), n)
    assert {r["bitmap"]: r["one_fills"] for r in bitmap_files.has_one_fills(runs).collect()} == {"short": False, "long": True}
    made = bitmap_files.contents(runs, n)
    assert bitmap_files.save(made, tmp_path.as_uri(), "bitmap", "content").agg(F.count("*")).first()[0] == 2
    head = bitmap_files.HEAD.unpack_from((tmp_path / "long").read_bytes())
    assert head[0] == 1 and head[1] == bitmap_files.MAGIC and head[3] == 400
    back = wah.decoded(bitmap_files.read(spark, str(tmp_path)))
    assert {(b.rsplit("/", 1)[1], r) for b, r in set_rows(back)} == set(rows)
    (tmp_path / "bad").write_bytes(b"no bitmap at all, but long enough")
    with pytest.raises(Exception, match="no file of run-length words"):
        bitmap_files.read(spark, str(tmp_path / "bad")).collect()


def test_column_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 3 % 256, i * 70_000) for i in range(500)], "at long, small long, large long").repartition(5)
    bitmap_files.save(bitmap_files.column_files(rows, {"small": 1, "large": 4}, "at"), tmp_path.as_uri(), "name", "content").collect()
    got = {(r["path"].rsplit("/", 1)[1], r["pos"]): r["value"] for r in files.read_columns(spark, str(tmp_path)).collect()}
    assert got == {("small", i): i * 3 % 256 for i in range(500)} | {("large", i): i * 70_000 for i in range(500)}
    more = spark.createDataFrame([("small", bytearray(b"\x07\x08"))], "name string, content binary")
    bitmap_files.save(more, tmp_path.as_uri(), "name", "content", append=True).collect()
    assert [r["value"] for r in files.read_columns(spark, str(tmp_path / "small")).orderBy("pos").collect()][-2:] == [7, 8]


def test_columns_one_after_the_other(spark, tmp_path):
    values = np.arange(30, dtype="<u4").reshape(3, 10)
    (tmp_path / "x.dat").write_bytes(values.tobytes())
    got = sorted(map(tuple, bitmap_files.read_many(spark, str(tmp_path / "x.dat"), 3).collect()))
    assert got == [(i, i, 10 + i, 20 + i) for i in range(10)]


def test_dictionary_and_sorted_columns(spark):
    rows = spark.createDataFrame([(w, i) for i, w in enumerate("pear fig apple fig kiwi".split())], "w string, i int")
    assert {r["value"]: r["code"] for r in files.dictionary(rows, "w").collect()} == {"apple": 0, "fig": 1, "kiwi": 2, "pear": 3}
    got = [(r["w"], r["position"]) for r in files.sorted_columns(rows, "w").orderBy("position").collect()]
    assert [w for w, _ in got] == sorted("pear fig apple fig kiwi".split()) and [p for _, p in got] == list(range(5))


def test_stored_areas_are_pruned(spark):
    rows = generate.uniform(spark, 4000, 1000)
    bounds = scan.boundaries(rows, "value", 8)
    table = scan.stored(rows, "value", bounds)
    for c in (Compare("lt", 100), Compare("eq", 321), Compare("bt", 10, 50), Compare("gt", 2000)):
        met = scan.sieve_scan(table, "value", c, bounds)
        assert scan.equal_rows(met.drop("area"), rows.where(c.on("value")))
        assert "PartitionFilters: [isnotnull(area" in met._jdf.queryExecution().executedPlan().toString()
    both = scan.appended(table, spark.createDataFrame([(9999, -5), (9998, 5000)], "id long, value long"), "value", bounds)
    assert scan.sieve_scan(both, "value", Compare("gt", 2000), bounds).first()["id"] == 9998


@pytest.mark.parametrize("condition", [Compare("lt", 5), Compare("ge", 5), Compare("gt", 5), Compare("le", 5), Compare("eq", 5), Compare("bt", 2, 7)])
def test_complement_and_recoding(spark, condition):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 5, 5, 7, 8)], "x long")
    met = {r["x"] for r in rows.where(condition.on("x")).collect()}
    rest = {r["x"] for c in scan.complement(condition) for r in rows.where(c.on("x")).collect()}
    assert met | rest == {0, 1, 2, 3, 5, 7, 8} and not met & rest
    known = scan.ranks(rows, "x")
    wanted = scan.recoded(condition, known)
    coded = rows.join(known.withColumnRenamed("value", "x"), "x")
    assert {r["x"] for r in coded.where(wanted.on("code")).collect()} == met
    assert coded.where(scan.recoded(Compare("eq", 4), known).on("code")).isEmpty()


def test_nearest_boundary():
    assert scan.nearest_boundary(9, [10, 20, 30]) == (0, True) and scan.nearest_boundary(31, [10, 20, 30]) == (2, False)
    assert scan.nearest_boundary(1, []) is None


def test_grid_windows():
    for s, _, share, start in synth.grid():
        assert synth.window_share(s, start, 60) <= share and (start == 0 or synth.window_share(s, start - 1, 60) > share)
    assert len(synth.grid()) == 100


@pytest.mark.parametrize("op", ["and", "or", "xor"])
def test_runs_with_words(spark, op):
    rng, n = np.random.default_rng(3), 31 * 300
    sides = [set(range(a, a + 2000)) | set(rng.integers(1, n, 60).tolist()) for a in (1, 900)]
    one, two = (wah.flat(spark.createDataFrame([("x", int(r)) for r in side], "bitmap string, row_id long")) for side in sides)
    got = {r for _, r in set_rows(wah.combined_mixed(wah.runs(one, n), two, op))}
    assert got == {"and": sides[0] & sides[1], "or": sides[0] | sides[1], "xor": sides[0] ^ sides[1]}[op]


def test_first_set_and_lengths(spark):
    words = wah.flat(spark.createDataFrame([("a", 40), ("a", 39), ("b", 31), ("c", 1), ("d", 62)], "bitmap string, row_id long"))
    assert {r["bitmap"]: r["row_id"] for r in wah.first_set(words).collect()} == {"a": 39, "b": 31, "c": 1, "d": 62}
    assert [wah.result_length(op, 3, 5) for op in ("and", "or", "xor")] == [3, 5, 5]


def test_written_tables_are_cleaned_up(spark):
    table = storage.written(spark.range(3), "gone")
    path = table.inputFiles()[0]
    assert storage.clean_up(spark) > 0 and not path.startswith("gone")
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST"):
        table.collect()
    queries  # the queries' stores are tables of their own and stay
