import numpy as np

from starlode.llm import langid


def direct(net, text):
    """Window by window with a plain convolution."""
    data = text.encode()
    kinds = np.concatenate([langid.KIND[np.frombuffer(data, np.uint8)], np.zeros(8, np.int64)])
    total = np.zeros(len(net.languages))
    for a in range(0, len(data), langid.WINDOW):
        n = min(langid.WINDOW, len(data) - a)
        best = np.full(len(net.bias), -np.inf)
        for t in range(a, a + n):
            z = net.bias.copy()
            for i, w in enumerate(net.filters):
                z[i * langid.FILTERS : (i + 1) * langid.FILTERS] += sum(w[k, kinds[t + k]] for k in range(len(w)))
            best = np.maximum(best, z)
        total += net.probabilities(best[None])[0] * n
    return total / len(data)


def test_tables_give_the_convolution():
    net = langid.train([b"the cat and the dog", b"le chat et le chien", b"der hund und die katze"] * 4, ["en", "fr", "de"] * 4, steps=5)
    texts = ["the end", "une très longue phrase " * 30, "x", "", "Größe"]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = langid.predict(net, np.frombuffer(data, np.uint8), at, net.tables())
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, direct(net, text) if text else 0, atol=1e-4)


def test_held_out_accuracy(small, spark):
    got = langid.language_ids(small).join(small.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_und_and_odd_rows(documents, small):
    net = langid.fit(small)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of"), (None, "the and of"), (4, "the and of"), (5, "²³")]
    got = langid.identify(documents(rows), net).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 5))
    assert by[4]["lang_pred"] in net.languages and 0 < by[4]["score"] <= 1


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "text", None), (2, None, "en")])
    assert {r["lang_pred"] for r in langid.language_ids(docs).collect()} == {"und"}
    assert langid.language_ids(documents([])).count() == 0


def usable(docs):
    return docs.where(~langid.held_out(3, 1) & langid.F.col("lang").isNotNull() & (langid.F.length("text") > 0)).count()


def test_sample_is_not_thinned_by_rows_that_cannot_be_used(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "if(id % 50 = 0, concat('text number ', id), '') AS text", "'en' AS lang")
    assert len(langid.sampled_windows(rows, sample=60)) == min(60, usable(rows)) > 40


def test_rows_that_share_an_id_and_repeated_rows(spark):
    rows = spark.range(3000).selectExpr("0L AS doc_id", "concat('text number ', id) AS text", "'en' AS lang")
    found = langid.sampled_windows(rows.unionAll(rows), sample=100)
    assert len(found) == len(set(found)) == 100
    same = spark.range(3000).selectExpr("0L AS doc_id", "'one and the same' AS text", "'en' AS lang")
    assert langid.sampled_windows(same, sample=100) == [("en", b"one and the same")]


def test_windows_of_whole_texts_are_drawn_within_bounds(spark):
    rows = spark.range(30).selectExpr("id AS doc_id", "concat(repeat('a', 256 * 40), repeat('b', 100)) AS text", "'en' AS lang")
    every = langid.sampled_windows(rows, windows=10_000)
    assert len(every) == 41 * usable(rows) and {w for _, w in every} == {b"a" * 256, b"b" * 100}
    assert len(langid.sampled_windows(rows, windows=50)) == 50


def test_ties_take_the_language_that_sorts_first(documents):
    net = langid.train([b"same text"] * 8, ["fr", "de"] * 4, steps=1)
    net.dense[:], net.out[:] = 0, 0
    assert langid.identify(documents([(1, "any text")]), net).first()["lang_pred"] == "de"
