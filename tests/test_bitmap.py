import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starlode.functions.predicates import And, Not, Or, Range
from starlode.operators import bitmap
from starlode.sources.rows import numbered

LEAF = st.builds(lambda n, a, b: Range(n, min(a, b), max(a, b)), st.sampled_from("xy"), st.integers(0, 40), st.integers(0, 40))
TREE = st.recursive(LEAF, lambda t: st.one_of(st.builds(Not, t), st.builds(lambda p: And(tuple(p)), st.lists(t, min_size=1, max_size=3)), st.builds(lambda p: Or(tuple(p)), st.lists(t, min_size=1, max_size=3))), max_leaves=6)
LAYOUT = {"x": bitmap.Bins((0, 7, 19, 40)), "y": bitmap.Bins((0, 20, 40), (0, 5, 10, 15, 20))}


def truth(where, values):
    if isinstance(where, Range):
        return (values[where.name] >= where.lo) & (values[where.name] < where.hi)
    if isinstance(where, Not):
        return ~truth(where.part, values)
    parts = [truth(p, values) for p in where.parts]
    return np.logical_and.reduce(parts) if isinstance(where, And) else np.logical_or.reduce(parts)


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_sure_rows_are_right_and_no_row_is_lost(where):
    rng = np.random.default_rng(1)
    values = {"x": rng.integers(0, 40, 500), "y": rng.integers(0, 40, 500)}
    needed, leaves = bitmap.program(where, LAYOUT)
    pack = lambda m: np.packbits(np.pad(m, (0, 12)), bitorder="little")
    maps = [pack((values[n] >= lo) & (values[n] < hi)) for n, lo, hi in needed]
    possible, doubt = bitmap.evaluate(where, leaves, maps, pack(np.ones(500, bool)))
    p, u = (np.unpackbits(b, bitorder="little")[:500].astype(bool) for b in (possible, doubt))
    right = truth(where, values)
    assert not (right & ~p).any() and not (u & ~p).any()
    assert (right[p & ~u]).all()


def test_bins_are_chosen_as_in_the_sparse_layout():
    assert bitmap.Bins((0, 2, 5, 8, 11)).choose(1, 4) == ([], [(0, 2), (2, 5)])
    assert bitmap.Bins((1, 11, 21, 31, 41, 51)).choose(1, 25) == ([(1, 11), (11, 21)], [(21, 31)])


def test_fine_bins_only_where_coarse_ones_leave_a_remainder():
    bins = bitmap.Bins((0, 50, 100), (0, 10, 20, 30))
    assert bins.choose(0, 50) == ([(0, 50)], [])
    assert bins.choose(10, 30) == ([(10, 20), (20, 30)], [])


def test_ranges_beyond_the_bins_raise():
    with pytest.raises(ValueError):
        bitmap.Bins((0, 10)).choose(5, 11)


def test_bucket_edges_and_misaligned_not(spark):
    n = 70000
    rows = numbered(spark.range(n).selectExpr("id % 100 as v", "id"))
    layout = {"v": bitmap.Bins((0, 30, 60, 100))}
    index = bitmap.stored(rows, layout)
    for where in (Not(Range("v", 10, 50)), Range("v", 0, 30), And((Range("v", 0, 60), Not(Range("v", 30, 100))))):
        found = bitmap.select(rows, where, index, layout, n)
        assert found.count() == rows.where(where.column()).count()
    ids = rows.agg({"row_id": "min"}).first()[0], rows.agg({"row_id": "max"}).first()[0], rows.select("row_id").distinct().count()
    assert ids == (1, n, n)


def test_appended_rows_are_found(spark):
    layout = {"v": bitmap.Bins((0, 5, 10))}
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("id as row_id", "id % 10 as v")
    index = bitmap.appended(bitmap.build(make(1, 40001), layout), make(40001, 50001), layout)
    sizes = {(r["lo"], r["hi"]): r["rows"] for r in bitmap.sizes(index).collect()}
    assert sizes == {(0, 5): 25000, (5, 10): 25000}


def test_empty_table(spark):
    rows = numbered(spark.range(0).selectExpr("id % 100 as v"))
    layout = {"v": bitmap.Bins((0, 30))}
    assert bitmap.select(rows, Range("v", 0, 30), bitmap.build(rows, layout), layout, 0).count() == 0


def test_random_recipes_cover_their_ranges():
    random.seed(4)
    for _ in range(200):
        a = random.randrange(100)
        where = And((Range("x", a, a + random.randrange(1, 30)), Range("y", 5, 5 + random.randrange(1, 9))))
        for recipe in (bitmap.exact, bitmap.thirds, bitmap.widened):
            layout = recipe(where)
            for r in where.ranges():
                whole, part = layout[r.name].choose(r.lo, r.hi)
                covered = {v for lo, hi in whole + part for v in range(lo, hi)}
                assert set(range(r.lo, r.hi)) <= covered and all(r.lo <= lo and hi <= r.hi for lo, hi in whole)
