import random

import numpy as np
import pyarrow as pa
import pytest

from starlode.llm import quality


def test_ratios_by_hand():
    slots, counts = np.array([1, 2, 1, 3]), np.array([2, 2])
    got = quality.log_count_ratios(slots, counts, np.array([1, 0]))
    total = 2 + quality.HASHED
    assert got[2] == pytest.approx(np.log(2 / total) - np.log(1 / total)) and got[1] == pytest.approx(0)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 200)
    rows = [np.unique(np.append(rng.integers(0, 50, 5), 100 + y)) for y in labels]
    slots, counts = np.concatenate(rows), np.array([len(r) for r in rows])
    ratios = quality.log_count_ratios(slots, counts, labels)
    weights, bias = quality.dual_coordinate_descent(slots, counts, labels, ratios)
    margin = quality.margins(weights, slots, counts, ratios) + bias
    assert ((margin > 0) == (labels == 1)).mean() == 1


def test_indicators_of_whole_texts_are_distinct_and_local():
    texts = ["Ab ab, AB!!", "", None, "x", "Ab ab, AB!!"]
    slots, counts = quality.indicators(pa.array(texts, pa.string()))
    alone, n = quality.indicators(pa.array(texts[:1]))
    assert counts.tolist() == [n[0], 0, 0, counts[3], n[0]] and (slots[: n[0]] == alone).all() and len(set(alone.tolist())) == n[0]


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classified(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_labels_and_other_columns_do_not_reach_scores(documents):
    fitted = quality.train(quality.sample_of(["good words here", "BAD!! BAD!!"] * 5, [1, 0] * 5))
    rows = [(1, "good words here"), (2, "BAD!! BAD!!"), (3, None), (4, ""), (None, "x"), (1, "good words here")]
    got = quality.score(documents(rows), fitted).collect()
    assert len(got) == 6 and got[0]["score"] == got[5]["score"] > 0.5 > got[1]["score"] and got[2]["score"] == got[3]["score"]


@pytest.mark.parametrize("labels, share", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_without_both_classes(documents, spark, labels, share):
    docs = documents([(i, "text") for i in range(1, 4)])
    known = spark.createDataFrame([(i + 1, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    fitted = quality.fit(docs, known)
    assert isinstance(fitted, float)
    assert quality.score(docs, share).first()["score"] == share and quality.score(documents([]), fitted).count() == 0


def test_long_text_counts_whole():
    random.seed(1)
    clean = " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3000))
    fitted = quality.train(quality.sample_of(["alpha beta gamma", "ALPHA!! BETA!!"] * 10, [1, 0] * 10))
    a, b = fitted.of(pa.array([clean, clean + " " + "SHOUT!! " * 3000]))
    assert a > b


def test_dual_coordinate_descent_finds_the_least_loss():
    # The dual of a small problem, solved by projected gradient steps on its full matrix, has the same optimum.
    rng = np.random.default_rng(4)
    labels = np.array([1, 0] * 12)
    rows = [np.unique(np.append(rng.integers(0, 30, 6), 40 + (y if rng.random() < 0.8 else 1 - y))) for y in labels]
    slots, counts = np.concatenate(rows), np.array([len(r) for r in rows])
    ratios = quality.log_count_ratios(slots, counts, labels) + 0.05
    dense = np.zeros((len(rows), quality.HASHED))
    for i, r in enumerate(rows):
        dense[i, r] = ratios[r] / np.sqrt((ratios[r] ** 2).sum())
    x = np.hstack([dense, np.ones((len(rows), 1))])
    sign = np.where(labels == 1, 1.0, -1.0)
    loss = lambda w: 0.5 * (w**2).sum() + np.maximum(0, 1 - sign * (x @ w)).sum()  # noqa: E731  both classes have equal numbers
    q, alpha = (x @ x.T) * np.outer(sign, sign), np.zeros(len(rows))
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, quality.COST)
    best = x.T @ (alpha * sign)
    weights, bias = quality.dual_coordinate_descent(slots, counts, labels, ratios, epochs=400)
    assert loss(np.append(weights, bias)) == pytest.approx(loss(best), rel=1e-4)
    assert np.abs(weights - best[:-1]).max() < 1e-2


def test_margins_for_the_logistic_function_are_of_unseen_texts():
    rng = np.random.default_rng(0)
    noise = quality.sample_of([" ".join(f"w{j}" for j in rng.integers(0, 10_000, 40)) for _ in range(60)], rng.integers(0, 2, 60).tolist())
    unseen = quality.unseen_margins(noise)
    ratios, weights, bias = quality.machine(noise)
    seen = quality.margins(weights, noise.slots, noise.counts, ratios) + bias
    right = lambda m: ((m > 0) == (noise.labels == 1)).mean()
    assert right(seen) == 1 and right(unseen) < 0.8
    assert quality.unseen_margins(quality.sample_of(["a", "b"], [1, 0])) is None


def test_training_reads_whole_texts_and_one_text_of_a_shared_id(spark, documents):
    filler = "plain words " * 4000  # what tells the classes apart stands behind 48,000 characters
    rows = [(i, filler + ("fine ending here" if i % 2 else "BAD!! ENDING!!")) for i in range(1, 60)] + [(3, filler + "fine ending here")] * 200
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] * 2, "doc_id long, quality int")
    fitted = quality.fit(documents(rows), known)
    good, bad = fitted.of(pa.array([filler + "fine ending here", filler + "BAD!! ENDING!!"]))
    assert good > 0.6 > 0.4 > bad
