"""Language ID: a convolutional network over bytes, trained in numpy and applied to fixed-length windows of whole texts.

Filters of WIDTHS bytes over one-hot bytes (A to Z count as a to z), a rectifier, the maximum over a window of WINDOW
bytes and a softmax layer give each window's language. A text's prediction is the language of the largest mean
probability, windows weighted by their bytes; the score is that mean. When applied, the filters are sums of two table
look-ups per byte, one row for each pair of bytes: the same numbers as the convolution, without building windows.

Training draws SAMPLE different rows (doc_id, text) that have a language and a letter, by a hash, and from all windows of
their whole texts WINDOWS ones, again by a hash: both bounds keep what the driver gets, whatever the table.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if nothing could be
learned (no row with a language). Ties take the language that sorts first. Repeated rows give repeated rows; columns
other than those named are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlode.llm import common, hashing
from starlode.llm.common import held_out

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
CLASSES = 256
#: Bounds of the training sample: rows, and windows of them.
SAMPLE = 4000
WINDOWS = 16_000
#: Training steps, whatever the sample's size.
STEPS = 750
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
BLOCK = 1 << 14


KIND = hashing.LOWER.astype(np.int64)


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, CLASSES, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def responses(self, kinds: np.ndarray) -> np.ndarray:
        """All filters at every place of windows, given by kinds with three more at the end."""
        size = kinds.shape[1] - 3
        return np.concatenate([sum(w[k][kinds[:, k : k + size]] for k in range(len(w))) for w in self.filters], axis=2) + self.bias

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Per pair of kinds: what the pair at a place adds to all filters there, and what the pair two bytes on adds."""
        near = np.zeros((CLASSES, CLASSES, len(self.bias)), np.float32)
        far = np.zeros_like(near)
        for i, w in enumerate(self.filters):
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            near[:, :, part] = w[0][:, None] + w[1][None]
            if len(w) > 2:
                far[:, :, part] = w[2][:, None] + (w[3][None] if len(w) > 3 else 0)
        return (near + self.bias).reshape(-1, len(self.bias)), far.reshape(-1, len(self.bias))

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense + self.out
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of all texts, three blanks behind each, and the new offsets."""
    counts = np.diff(at)
    kinds = np.zeros(len(data) + 3 * len(counts), np.int64)
    kinds[np.arange(len(data)) + 3 * np.repeat(np.arange(len(counts)), counts)] = KIND[data]
    return kinds, at[:-1] + 3 * np.arange(len(counts))


def predict(net: Network, data: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean probabilities of each text; zeros for an empty one."""
    near, far = tables
    counts = np.diff(at)
    kinds, first = padded(data, at)
    pair = np.append(kinds[:-1] * CLASSES + kinds[1:], [0, 0, 0])
    windows = -(-counts // WINDOW)
    owner = np.repeat(np.arange(len(counts)), windows)
    start = first[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows))
    length = np.minimum(WINDOW, first[owner] + counts[owner] - start)
    pooled = np.empty((len(owner), near.shape[1]), np.float32)
    each = BLOCK // WINDOW
    for a in range(0, len(owner), each):
        n = length[a : a + each]
        head = np.cumsum(n) - n
        place = np.arange(n.sum()) + np.repeat(start[a : a + each] - head, n)
        z = near[pair[place]]
        z += far[pair[place + 2]]
        pooled[a : a + each] = np.maximum.reduceat(z, head, axis=0)
    out = np.zeros((len(counts), len(net.languages)))
    if len(owner):
        np.add.at(out, owner, net.probabilities(pooled) * length[:, None])
    return out / np.maximum(counts, 1)[:, None]


def train(windows: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 3, rate: float = 0.01, batch: int = 64) -> Network | None:
    """Adam on the cross-entropy of windows of at most WINDOW bytes; None without any."""
    rows = [(t[:WINDOW], y) for t, y in zip(windows, labels, strict=True) if t and y is not None]
    if not rows:
        return None
    languages = sorted({y for _, y in rows})
    target = np.array([languages.index(y) for _, y in rows])
    kinds = np.zeros((len(rows), WINDOW + 3), np.uint8)
    for i, (t, _) in enumerate(rows):
        kinds[i, : len(t)] = KIND[np.frombuffer(t, np.uint8)]
    rng = np.random.default_rng(seed)
    width = FILTERS * len(WIDTHS)
    net = Network(
        languages, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(width, np.float32),
        rng.normal(0, 0.3, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    weights = [*net.filters, net.bias, net.dense, net.out]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    lengths = np.array([len(t) for t, _ in rows])
    while step < steps:
        order = rng.permutation(len(rows))
        for a in range(0, min(len(rows), (steps - step) * batch), batch):
            pick = order[a : a + batch]
            x, y, m = kinds[pick], target[pick], len(pick)
            z = net.responses(x)
            z[np.arange(WINDOW)[None, :] >= lengths[pick][:, None]] = -np.inf
            where = z.argmax(axis=1)
            pooled = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0]
            delta = net.probabilities(pooled)
            delta[np.arange(m), y] -= 1
            delta /= m
            hidden = np.maximum(pooled, 0)
            back = (delta @ net.dense.T) * (pooled > 0)
            grads = [np.zeros_like(w) for w in net.filters]
            for i, g in enumerate(grads):
                for f in range(FILTERS):
                    col = i * FILTERS + f
                    for k in range(len(g)):
                        np.add.at(g[k, :, f], x[np.arange(m), where[:, col] + k], back[:, col])
            step += 1
            for w, g, (m1, m2) in zip(weights, [*grads, back.sum(0), hidden.T @ delta, delta.sum(0)], moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return net


def least_keys(keys: DataFrame, most: int) -> Column | None:
    """A condition that the ``most`` least of distinct keys (column key) meet, by a hash of them; None if all may stay.

    Keys beyond twice the wanted share are left out first, so that what tasks send on is bounded.
    """
    n = keys.count()
    if n <= most:
        return None
    place = F.pmod(F.xxhash64("key", F.lit("place")), F.lit(1 << 40))
    share = int((1 << 40) * min(1.0, 2 * most / n))
    cut = keys.select(place.alias("place")).where(F.col("place") < share).orderBy("place").limit(most).agg(F.max("place")).first()[0]
    return place <= (share if cut is None else cut)


def sampled_windows(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> list[tuple[str, bytes]]:
    """(lang, window) of at most so many windows of at most so many different rows with a language and a letter."""
    usable = docs.where(~held_out(3, 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = usable.select("lang", "text", F.xxhash64("doc_id", "text", "lang").alias("key"))
    wanted = least_keys(rows.select("key").distinct(), sample)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [(k * 1_000_003 + i, y, t[a : a + WINDOW]) for k, y, t in zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "text")), strict=True) for t in [t.encode()] for i, a in enumerate(range(0, len(t), WINDOW))]
        key, lang, window = zip(*parts, strict=True)
        signed = [(k + (1 << 63)) % (1 << 64) - (1 << 63) for k in key]
        return common.batch_of(key=pa.array(signed, pa.int64()), lang=pa.array(lang, pa.string()), window=pa.array(window, pa.binary()))

    every = common.map_slices(rows if wanted is None else rows.where(wanted), cut, "key long, lang string, window binary")
    every = common.written(every.dropDuplicates(["key"]), "windows")
    wanted = least_keys(every.select("key"), windows)
    found = (every if wanted is None else every.where(wanted)).orderBy("key").limit(windows).collect()
    return [(r["lang"], bytes(r["window"])) for r in found]


def fit(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Network | None:
    """Trains on windows of documents that are not held out."""
    found = sampled_windows(docs, sample, windows)
    return train([w for _, w in found], [y for y, _ in found])


def has_letter(text: str) -> bool:
    found = LETTER.search(text)
    return bool(found) and (found[0].isalpha() or any(c.isalpha() for c in text))


PREDICTED = "doc_id long, lang_pred string, score double"


def identify(docs: DataFrame, net: Network | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every whole text, and the columns to carry along."""
    types = dict(docs.dtypes)
    tables: list[tuple[np.ndarray, np.ndarray]] = []  # made by each task for itself

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        good = [bool(t) and has_letter(t) for t in texts.to_pylist()]
        names, scores = [UNKNOWN] * len(good), [0.0] * len(good)
        if net:
            if not tables:
                tables.append(net.tables())
            probability = predict(net, *common.text_buffer(texts), tables[0])
            for i, k in enumerate(probability.argmax(axis=1).tolist()):
                if good[i]:
                    names[i], scores[i] = net.languages[k], min(1.0, round(float(probability[i, k]), 6))
        extra = {c: batch.column(c) for c in carry}
        return common.batch_of(doc_id=batch.column("doc_id"), lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()), **extra)

    schema = PREDICTED + "".join(f", `{c}` {types[c]}" for c in carry)
    return common.map_slices(docs.select(*dict.fromkeys(("doc_id", "text", *carry))), run, schema)


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from the same table."""
    return identify(docs, fit(docs)).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
