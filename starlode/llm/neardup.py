"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

The shingle hashes of a text are one permutation of its set: its range is split into bins, a bin's least hash is one
signature entry, and an empty bin borrows from a non-empty one that a universal hash of (bin, attempt) selects. Texts
with equal sets are one item, items that share a band are candidates, and links are confirmed on full sets.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; in
``near_duplicates`` so are rows without doc_id (their component is null and they are kept). A component's label is its
smallest doc_id; rows that share a doc_id but not the text are judged row by row, each by its own set. Repeated rows stay
repeated in ``near_duplicates``, and one of them stays in ``deduplicated``, which looks at rows without doc_id as well. An
empty table gives no rows; other columns are ignored, beyond the five of documents by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlode.llm import common, hashing, links
from starlode.llm.common import written

SHINGLE = 5
PERCENT = 80
#: A pair of likeness 0.8 shares none of 30 bands of 5 rows with a chance of 7 in a million.
BANDS, ROWS = 30, 5
#: Bits of the sketch that rules candidates out whose sets differ in too many shingles; a power of two.
SKETCH = 512
#: Attempts of densification by hashing; a bin still empty then (a set of very few shingles) takes the next full bin.
ATTEMPTS = 256


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, and their numbers; A-Z count as a-z."""
    found, counts = hashing.words(*common.text_buffer(texts), lower=True)
    return hashing.distinct(*hashing.word_shingles(found, counts, k))


def one_permutation(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Densified signatures (32-bit numbers) of sorted distinct hashes; rows of empty sets are of no use."""
    group = np.repeat(np.arange(len(counts)), counts)
    place = ((values >> hashing.U(32)) * hashing.U(bins) >> hashing.U(32)).astype(np.int64)
    slot = group * bins + place
    head = np.ones(len(slot), bool)
    head[1:] = slot[1:] != slot[:-1]  # sorted: the first of a bin is its least
    out = np.zeros(len(counts) * bins, np.uint32)
    full = np.zeros(len(counts) * bins, bool)
    out[slot[head]] = hashing.mix(values[head]).astype(np.uint32)
    full[slot[head]] = True
    own, source = out.copy().reshape(-1, bins), full.copy().reshape(-1, bins)
    todo = np.flatnonzero(~full & np.repeat(counts > 0, bins))
    for attempt in range(ATTEMPTS):
        if not len(todo):
            break
        row, col = todo // bins, todo % bins
        other = (hashing.mix((col * 1_000_003 + attempt + 1).astype(hashing.U)) % hashing.U(bins)).astype(np.int64)
        got = source[row, other]
        out[todo[got]] = own[row[got], other[got]]
        todo = todo[~got]
    for at in todo.tolist():
        row, col = divmod(at, bins)
        full_bins = np.flatnonzero(source[row])
        out[at] = own[row, full_bins[np.searchsorted(full_bins, col) % len(full_bins)]]
    return out.reshape(-1, bins)


def set_names(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the distinct shingle hashes of each text; together they name its set."""
    at = hashing.bounds_of(counts)
    names = []
    for i in (1, 2):
        sums = np.zeros(len(values) + 1, hashing.U)
        np.cumsum(hashing.mix(values + hashing.U(i)), out=sums[1:])
        names.append(hashing.signed(sums[at[1:]] - sums[at[:-1]]))
    return names[0], names[1]


def text_names() -> list[Column]:
    """Two numbers that together name a text, by which one text of a set is found again."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


SIGNED = "n_shingles long, k1 long, k2 long, bands array<long>"


def signed(docs: DataFrame, signature: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, t1 and t2 (names of the text), SIGNED and the columns to carry, of every whole text: k1 and k2 name its set;
    the band keys are null for an empty set. signature gives the sets of texts (values, counts) and their band keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts, keys = signature(batch.column("text"))
        k1, k2 = set_names(values, counts)
        lists = [k if c else None for k, c in zip(keys, counts.tolist(), strict=True)]
        own = {c: batch.column(c) for c in ("doc_id", "t1", "t2", *carry)}
        return common.batch_of(**own, n_shingles=pa.array(counts, pa.int64()), k1=pa.array(k1), k2=pa.array(k2), bands=pa.array(lists, pa.list_(pa.int64())))

    schema = "doc_id long, t1 long, t2 long, " + "".join(f"{c} long, " for c in carry) + SIGNED
    return common.map_slices(docs.select("doc_id", "text", *text_names(), *carry), run, schema)


def one_permutation_bands(texts: pa.Array, shingle: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, counts = shingle_sets(texts, shingle)
    return values, counts, hashing.signed(hashing.band_keys(one_permutation(values, counts, bands * rows), rows))


def class_payload(docs: DataFrame, classes: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(item, n, sketch, text) of the classes (item, t1, t2) that are items of members; each has one text."""
    wanted = written(classes.select("item", "t1", "t2").join(members.select("item").distinct(), "item", "left_semi"), "wanted")
    texts = docs.select(*text_names(), "text")
    bits = docs.sparkSession.sparkContext.broadcast(links.sketch(wanted.select("t1")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(links.hits(bits.value, batch.column("t1").to_numpy())))
        values, counts = shingle_sets(batch.column("text"), shingle)
        return common.batch_of(t1=batch.column("t1"), t2=batch.column("t2"), **links.attributes_of(values, counts, SKETCH), text=batch.column("text"))

    # Copies of a text are united in each task before they are shuffled.
    rows = common.map_slices(texts, run, links.payload_schema(SKETCH).replace("item long", "t1 long, t2 long")).dropDuplicates(["t1", "t2"])
    return written(rows.join(wanted, ["t1", "t2"]).drop("t1", "t2"), "texts")


def set_components(docs: DataFrame, table: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(k1, k2, part, doc_id) of the distinct sets of ``signed``, the empty one left out: the component of each set, and
    the smallest doc_id of a row whose set is in that component."""
    own = table.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("t1", "t2")).alias("t"), F.first("bands").alias("bands"))
    # Numbers are given as the table is written, once.
    classes = written(own.select(F.monotonically_increasing_id().alias("item"), "k1", "k2", "doc_id", "t.*", "bands"), "classes")
    members = links.shared_bands(classes.select("item", "bands"))
    labels = links.linked(members, class_payload(docs, classes, members, shingle), partial(shingle_sets, k=shingle), percent)
    placed = written(classes.select("item", "k1", "k2", "doc_id").join(labels.withColumnRenamed("node", "item"), "item", "left"), "placed")
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "component", "left").select("k1", "k2", F.coalesce("component", "item").alias("part"), F.least("least", "doc_id").alias("doc_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    table = written(signed(docs, partial(one_permutation_bands, shingle=shingle, bands=bands, rows=rows)), "signatures")
    named = set_components(docs, table.where("doc_id is not null"), shingle, percent).select("k1", "k2", F.col("doc_id").alias("component"))
    rows_ = table.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows_.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def row_names() -> list[Column]:
    """Two numbers that together name the content of a row of documents, nulls included."""
    every = [x for c in common.DOCUMENT_COLUMNS for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(i), *every).alias(f"h{i}") for i in (1, 2)]


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the row of the smallest doc_id (rows without one last; ties by a hash of the row),
    and of identical rows one. Rows with an empty set all stay."""
    docs = docs.select(*common.DOCUMENT_COLUMNS)
    named = docs.select("*", *row_names())
    table = written(signed(named, partial(one_permutation_bands, shingle=shingle, bands=BANDS, rows=ROWS), ("h1", "h2")), "signatures").where("n_shingles > 0")
    parts = set_components(docs, table, shingle, percent).select("k1", "k2", "part")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h1", "h2").alias("row")
    rows = written(table.select(row, "k1", "k2").join(parts, ["k1", "k2"]).select("part", "row"), "rows")
    several = written(rows.groupBy("part").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first != last").select("part", "first"), "several")
    drop = rows.join(several, "part").where("row != first").select("row.h1", "row.h2").distinct()
    kept = named.join(drop, ["h1", "h2"], "left_anti")
    again = written(table.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated")
    if not again.isEmpty():
        once = kept.join(again, ["h1", "h2"], "left_semi").select(*common.DOCUMENT_COLUMNS).distinct()
        return kept.join(again, ["h1", "h2"], "left_anti").select(*common.DOCUMENT_COLUMNS).unionAll(once)
    return kept.select(*common.DOCUMENT_COLUMNS)
