import numpy as np
import pyarrow as pa
import pytest

from starlode.llm import links, neardup


def pairs_of(spark, common, extra, count, size, seed):
    """Rows (n, sketch, c_n, c_sketch) of pairs of random sets that share some hashes and have further ones on one side."""
    rng = np.random.default_rng(seed)
    whole = rng.integers(0, 1 << 64, (count, common + extra), dtype=np.uint64)
    sides = []
    for sets in (whole[:, :common], whole):
        values = np.sort(sets, axis=1).reshape(-1)
        sides.append(links.parities(values, np.full(count, sets.shape[1]), size))
    marks = [f"s{i}" for i in range(size // 64)]
    rows = [(common, *x, common + extra, *y) for x, y in zip(sides[0].tolist(), sides[1].tolist(), strict=True)]
    names = ["n", *marks, "c_n", *[f"c_{m}" for m in marks]]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names)), marks


@pytest.mark.parametrize("union", [5, 10, 15, 400])
def test_sketch_turns_no_pair_at_the_threshold_down(spark, union):
    count = 20_000 if union < 100 else 1000
    pairs, marks = pairs_of(spark, union * 4 // 5, union - union * 4 // 5, count, neardup.SKETCH, union)
    assert pairs.where(links.near_enough(marks, "c_", 80)).count() == count


def test_sketch_spares_pairs_that_sizes_let_through(spark):
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 1 << 64, (2, 50), dtype=np.uint64), axis=1).reshape(-1)
    x, y = links.parities(values, np.array([50, 50]), neardup.SKETCH).tolist()
    marks = [f"s{i}" for i in range(len(x))]
    names = ["n", *marks, "c_n", *[f"c_{m}" for m in marks]]
    pair = spark.createDataFrame([(50, *x, 50, *y)], ", ".join(f"{c} long" for c in names))
    assert pair.where(links.near_enough(marks, "c_", 80)).count() == 0


def test_names_of_sets_do_not_depend_on_the_texts_around_them():
    texts = pa.array([f"one two three four five six seven eight nine {i % 7} ten eleven" for i in range(50)] + ["", None])
    values, counts = neardup.shingle_sets(texts, 4)
    k1, k2 = neardup.set_names(values, counts)
    for i in range(len(texts)):
        assert [x.tolist() for x in neardup.set_names(*neardup.shingle_sets(texts.slice(i, 1), 4))] == [[k1[i]], [k2[i]]]
    assert len(set(k1[:50].tolist())) == 7


def test_folded_sketches_are_sketches_of_fewer_cells(spark):
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(0, 1 << 64, (40, 100), dtype=np.uint64), axis=1).reshape(-1)
    marks = links.parities(values, np.full(40, 100), 2048).tolist()
    names = [f"s{i}" for i in range(32)]
    frame = spark.createDataFrame([(i, 100, *m) for i, m in enumerate(marks)], "item long, n long, " + ", ".join(f"{c} long" for c in names))
    for r in links.folded(frame, names).collect():
        bits = np.zeros(256, np.int64)
        cells = (values.reshape(40, 100)[r["item"]] >> np.uint64(53)).astype(np.int64)  # 2048 cells: word i is laid on word i mod 4
        np.add.at(bits, (cells // 64 % 4) * 64 + cells % 64, 1)
        assert sum(bin(r[f"s{i}"] & (1 << 64) - 1).count("1") for i in range(4)) == int((bits & 1).sum())
