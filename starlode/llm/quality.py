"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

n-grams are runs of 1 and 2 words, of 1 to 3 word shapes (case, marks and repetition of a word) and of 3 bytes, as
indicators in HASHED slots. The ratio of a slot is the logarithm of its smoothed share in class 1 over that in class 0; the
machine is fitted on ratio-scaled indicators, each text at unit length, by dual coordinate descent on the hinge loss. A
score is the logistic function of the margin, its slope and offset fitted on margins of texts by machines that were
trained without them (Platt, FOLDS folds).

Defined results: null and empty texts have no indicators and score by the bias alone; without labelled rows of both
classes every score is the share of class 1 (0.5 without any). Different labels of a document each count, with one of its
texts (that of the least hash, should rows share a doc_id). Repeated rows give repeated rows; equal texts score the same;
columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlode.llm import common, hashing
from starlode.llm.common import held_out

HASHED = 1 << 18
#: Bound of the training sample: so many labelled documents, those of the least hash of doc_id.
SAMPLE = 4000
COST = 1.0
FOLDS = 3
EPOCHS = 15
THRESHOLD = 0.3
MARK = np.zeros(256, bool)
MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def words_and_shapes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash and a shape number of every word, and the number of words of each text."""
    words, counts = hashing.words(data, at, lower=True)
    if not len(words):
        return words, words.astype(np.int64), counts
    white = hashing.WHITE[data]
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data), bool)
    before[1:], after[:-1] = white, white[1:]
    cut = at[(at > 0) & (at < len(data))]
    before[cut] = True
    after[cut - 1] = True
    start, last = np.flatnonzero(~white & before[:-1]), np.flatnonzero(~white & after)
    sums = lambda mask: np.append(0, np.cumsum(mask))
    inside = lambda mask: (lambda s: s[last + 1] - s[start])(sums(mask))
    upper, marks = inside((data >= 65) & (data <= 90)), inside(MARK[data])
    first = np.cumsum(counts) - counts
    again = np.zeros(len(words), np.int64)
    again[1:] = words[1:] == words[:-1]
    again[first[counts > 0]] = 0
    end = np.where(MARK[data[last]], data[last], 0).astype(np.int64)
    return words, (end * 4 + np.minimum(marks, 3)) * 8 + np.minimum(upper, 2) * 2 + again, counts


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct slots of each text, and their numbers."""
    data, at = common.text_buffer(texts)
    words, shape, counts = words_and_shapes(data, at)
    owner = np.repeat(np.arange(len(counts)), counts)
    keys, rows = [], []
    for tokens, longest, salt in ((shape.astype(hashing.U), 3, 0), (words, 2, 1 << 41)):
        value = np.zeros(len(tokens), hashing.U)
        for n in range(1, longest + 1):
            size = max(len(tokens) - n + 1, 0)
            value = value[:size] * hashing.U(0x1000193) + tokens[n - 1 :] + hashing.U(n + salt)
            same = owner[:size] == owner[n - 1 :]
            keys.append(hashing.mix(value)[same])
            rows.append(owner[:size][same])
    if len(data) > 2:
        x = data.astype(hashing.U)
        three = x[:-2] << hashing.U(16) | x[1:-1] << hashing.U(8) | x[2:]
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        same = row[:-2] == row[2:]
        keys.append(hashing.mix(three[same] + hashing.U(1 << 40)))
        rows.append(row[:-2][same])
    slot = (np.concatenate(keys) % hashing.U(HASHED)).astype(np.int64)
    both = np.unique(np.concatenate(rows) * HASHED + slot)
    return both % HASHED, np.bincount(both // HASHED, minlength=len(at) - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, slots: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
        margin = margins(self.weights, slots, counts, scale) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


@dataclass
class Fitted:
    ratios: np.ndarray
    model: Model

    def of(self, texts: pa.Array) -> np.ndarray:
        slots, counts = indicators(texts)
        return self.model.scores(slots, counts, self.ratios)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each row's values, by itself, so that it does not depend on the rows around it."""
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), (np.cumsum(counts) - counts)[full])
    return out


def lengths(slots: np.ndarray, counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(row_sums(ratios[slots] ** 2, counts), 1e-12))


def margins(weights: np.ndarray, slots: np.ndarray, counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    return row_sums((weights * ratios)[slots], counts) / lengths(slots, counts, ratios)


def log_count_ratios(slots: np.ndarray, counts: np.ndarray, labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    row = np.repeat(labels, counts)
    good, bad = (np.bincount(slots[row == y], minlength=HASHED) + smoothing for y in (1, 0))
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_coordinate_descent(slots: np.ndarray, counts: np.ndarray, labels: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise half the squared norm plus cost times the hinge losses (bias as a feature of 1)."""
    at, size = hashing.bounds_of(counts), lengths(slots, counts, ratios)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, len(labels) / max(2 * (labels == 1).sum(), 1), len(labels) / max(2 * (labels == 0).sum(), 1))
    values = (ratios[slots] / np.repeat(size, counts)).astype(np.float32)
    alpha, weights, bias = np.zeros(len(labels)), np.zeros(HASHED), 0.0
    norm = row_sums(values**2, counts) + 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)).tolist():
            own, x = slots[at[i] : at[i + 1]], values[at[i] : at[i + 1]]
            gradient = sign[i] * (weights[own] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost * share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[own] += step * x
                bias += step
                alpha[i] = new
    return weights, bias


def platt(margin: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic function by Newton steps on smoothed targets; the slope is positive."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Sample:
    """Distinct slots of labelled texts, one after the other, their numbers, and the labels."""

    slots: np.ndarray
    counts: np.ndarray
    labels: np.ndarray

    def rows(self, chosen: np.ndarray) -> Sample:
        return Sample(self.slots[np.repeat(chosen, self.counts)], self.counts[chosen], self.labels[chosen])

    def both(self) -> bool:
        return len(self.labels) > 0 and self.labels.min() != self.labels.max()


def sample_of(texts: list[str | None], labels: list[int]) -> Sample:
    slots, counts = indicators(pa.array(texts, pa.string()))
    return Sample(slots.astype(np.int32), counts, np.array(labels, np.int64))


def machine(sample: Sample) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios, weights and bias."""
    ratios = log_count_ratios(sample.slots, sample.counts, sample.labels)
    return ratios, *dual_coordinate_descent(sample.slots, sample.counts, sample.labels, ratios)


def unseen_margins(sample: Sample, folds: int = FOLDS) -> np.ndarray | None:
    """Margins of each text by a machine that was trained without its fold; None if a machine would lack a class."""
    fold, out = np.arange(len(sample.labels)) % folds, np.zeros(len(sample.labels))
    for k in range(folds):
        known, rest = sample.rows(fold != k), sample.rows(fold == k)
        if not known.both():
            return None
        ratios, weights, bias = machine(known)
        out[fold == k] = margins(weights, rest.slots, rest.counts, ratios) + bias
    return out


def train(sample: Sample) -> Fitted | float:
    """The fitted machine, or the share of class 1 if there are not both classes."""
    if not sample.both():
        return float(sample.labels.mean()) if len(sample.labels) else 0.5
    ratios, weights, bias = machine(sample)
    unseen = unseen_margins(sample)
    slope, offset = platt(margins(weights, sample.slots, sample.counts, ratios) + bias if unseen is None else unseen, sample.labels)
    return Fitted(ratios.astype(np.float32), Model(weights.astype(np.float32), bias, slope, offset))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted | float:
    """Trains on at most ``sample`` labelled documents that are not held out, with their whole texts: tasks find the
    indicators, of which a text has HASHED at most, and the driver gets these."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0)).select("doc_id", "quality").distinct()
    chosen = common.least_hashed(known, "quality", known, sample).orderBy("key", "doc_id", "quality").limit(sample).drop("key")
    # The chosen rows are bounded by ``sample``, so that they may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("h"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, counts = indicators(batch.column("text"))
        cut = np.split(slots.astype("<i4"), np.cumsum(counts)[:-1])
        return common.batch_of(doc_id=batch.column("doc_id"), quality=batch.column("quality").cast(pa.int32()), h=batch.column("h"), slots=pa.array([c.tobytes() for c in cut], pa.binary()))

    found = common.map_slices(rows, run, "doc_id long, quality int, h long, slots binary")
    one = found.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "slots"))["slots"].alias("slots"))
    got = sorted((r["doc_id"], r["quality"], bytes(r["slots"])) for r in one.collect())
    parts = [np.frombuffer(g[2], "<i4") for g in got]
    slots = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return train(Sample(slots, np.array([len(x) for x in parts], np.int64), np.array([g[1] for g in got], np.int64)))


SCORED = "doc_id long, score double, predicted int"


def score(docs: DataFrame, fitted: Fitted | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = fitted.of(batch.column("text")) if isinstance(fitted, Fitted) else np.full(batch.num_rows, fitted)
        got = got.astype(np.float64)
        return common.batch_of(doc_id=batch.column("doc_id"), score=pa.array(got), predicted=pa.array((got >= threshold).astype(np.int32)))

    return common.map_slices(docs.select("doc_id", "text"), run, SCORED)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
