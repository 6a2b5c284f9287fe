import pytest
from pyspark.sql import functions as F

from starlode.operators import wah
from starlode.sources.generate import random_words

N = 3000


@pytest.fixture(scope="module")
def pair(spark):
    rows = [(name, w, word) for name, seed in (("a", 1), ("b", 2)) for w, word in enumerate(random_words(N // 31, 0.5, 9, 3, seed)) if word]
    words = spark.createDataFrame(rows, "bitmap string, word_no long, word long")
    return words.where("bitmap = 'a'"), words.where("bitmap = 'b'"), {n: {31 * w + i + 1 for m, w, x in rows if m == n for i in range(31) if x >> (30 - i) & 1} for n in "ab"}


def found(words):
    return {r["row_id"] for r in wah.positions(words).collect()}


def test_roundtrip(pair):
    for words, name in zip(pair[:2], "ab", strict=True):
        for fills in (True, False):
            assert found(wah.decoded(wah.encoded(wah.runs(words, N), fills))) == pair[2][name]


@pytest.mark.parametrize("op", ["and", "or", "xor"])
def test_operators_on_words_and_on_runs(pair, op):
    a, b, truth = pair
    want = {"and": truth["a"] & truth["b"], "or": truth["a"] | truth["b"], "xor": truth["a"] ^ truth["b"]}[op]
    assert found(wah.combined(a, b, op)) == want
    runs = wah.combined_runs(wah.runs(a, N), wah.runs(b, N), op)
    assert found(wah.decoded(wah.encoded(runs))) == want
    lengths = runs.agg(F.sum("length")).first()[0]
    assert lengths == -(-N // 31)


@pytest.mark.parametrize("n", [1, 30, 31, 32, 61, 62, 63])
def test_tails(spark, n):
    for rows in ([], [1], [n], list(range(1, n + 1))):
        frame = spark.createDataFrame([("m", r) for r in rows], "bitmap string, row_id long")
        words = wah.flat(frame)
        assert found(wah.decoded(wah.encoded(wah.runs(words, n)))) == set(rows)


def test_longest_run_and_zeros_between(spark):
    words = wah.flat(spark.range(1, 31 * 9 + 1).selectExpr("'m' as bitmap", "id as row_id").unionAll(spark.createDataFrame([("m", 1000)], "bitmap string, row_id long")))
    assert wah.longest_ones(wah.runs(words, 2000)).first()["longest"] == 9
    assert wah.padded(words, 2000).count() == 65
