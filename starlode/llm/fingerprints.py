"""Document fingerprints: MinHash over five-word shingles, compared slot by slot, and near classes by bands.

A signature is the minima of PERMUTATIONS universal hash permutations over the shingle hashes of a text; the fingerprint
keeps 16 mixed bits of each as hex, so that equal shares of slots estimate the Jaccard likeness. ``near_classes`` joins
bands of full signatures in Spark and verifies likeness on full sets.

Defined results: a null text is an empty one, whose slots are all ones; a text of fewer than five words has its whole
sequence as one shingle. In ``against_edits`` rows follow one another by descending doc_id (rows without doc_id last,
equal ids by text), the last is followed by the first, a single row by itself; repeated rows give their own rows; an
empty table gives none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlode.llm import common, hashing, neardup
from starlode.llm.common import written

SHINGLE = 5
PERMUTATIONS = 64
SEED = 20
#: A pair of likeness 0.8 shares none of 32 bands of 4 rows with a chance of 5 in 100 million.
BANDS, ROWS = 32, 4
PERCENT = 80
#: Bytes of text that a task of ``against_edits`` gets, about; the number of buckets follows the table's size.
BUCKET_BYTES = 64 << 20


def signature(texts: pa.Array, n: int = PERMUTATIONS, shingle: int = SHINGLE) -> np.ndarray:
    found, counts = hashing.words(*common.text_buffer(texts), lower=True)
    values, counts = hashing.word_shingles(found, counts, shingle)
    return hashing.universal_minhash(hashing.top32(values), counts, n, SEED)


def fingerprint(minima: np.ndarray) -> np.ndarray:
    """16 bits of each minimum; all ones stay all ones."""
    return np.where(minima == 0xFFFFFFFF, 0xFFFF, hashing.mix32(minima) & np.uint32(0xFFFF)).astype(np.uint16)


def hexed(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints.astype(">u2")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return common.batch_of(doc_id=batch.column("doc_id"), fingerprint=pa.array(hexed(fingerprint(signature(batch.column("text")))), pa.string()))

    return common.map_slices(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def bands_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, counts = neardup.shingle_sets(texts, SHINGLE)
    minima = hashing.universal_minhash(hashing.top32(values), counts, BANDS * ROWS, SEED)
    return values, counts, hashing.signed(hashing.band_keys(minima, ROWS))


def near_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id and class_id (the smallest doc_id reachable over verified links) of every row with a doc_id."""
    own = docs.where("doc_id is not null").select("doc_id", "text")
    table = written(neardup.signed(own, bands_of), "fingerprints")
    named = neardup.set_components(own, table, SHINGLE, percent).select("k1", "k2", F.col("doc_id").alias("class_id"))
    same = table.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    return same.select("doc_id", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def edited(text: str, following: str) -> str:
    """The text whose last third (rounded down) is replaced by the first as many code points of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, again, doc_id, text), sorted by descending doc_id in each bucket; again marks a copy of the row that
    follows the bucket, which the next bucket begins with (the first one, after the last).

    Buckets are ranges of doc_id between quantiles, at most ``buckets`` and one for rows without doc_id, so that only
    bounds and the largest doc_id of each bucket pass the driver.
    """
    docs = docs.select("doc_id", "text")
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)), reverse=True) if buckets > 1 else []
    bounds = -np.array(cuts, np.float64)

    def bucket_of(ids: pa.Array) -> np.ndarray:
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, -ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), side="right")
        return np.where(missing, len(bounds) + 1, at).astype(np.int32)

    def only_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield common.batch_of(bucket=pa.array(bucket_of(batch.column("doc_id"))), doc_id=batch.column("doc_id"))

    common.prepare(docs.sparkSession)
    heads = docs.select("doc_id").mapInArrow(only_ids, "bucket int, doc_id long").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    heads = sorted(((r["bucket"], r["head"]) for r in heads), key=lambda x: x[0])  # one row a bucket
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    largest = dict(heads)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id")
        buckets_ = bucket_of(ids)
        take, bucket, again = list(range(batch.num_rows)), buckets_.tolist(), [False] * batch.num_rows
        first: dict[int, int] = {}  # per bucket, the row of its largest doc_id (of equal ones that of the least text)
        texts = batch.column("text")
        for i, (b, doc_id) in enumerate(zip(buckets_.tolist(), ids.to_pylist(), strict=True)):
            if largest[b] == doc_id and (b not in first or (texts[i].as_py() or "") < (texts[first[b]].as_py() or "")):
                first[b] = i
        for b, i in first.items():
            take.append(i)
            bucket.append(before[b])
            again.append(True)
        rows = pa.array(take, pa.int64())
        return common.batch_of(bucket=pa.array(bucket, pa.int32()), again=pa.array(again), doc_id=ids.take(rows), text=batch.column("text").take(rows))

    placed = common.map_slices(docs, run, "bucket int, again boolean, doc_id long, text string")
    return placed.repartition(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "again", F.desc("doc_id"), F.coalesce("text", F.lit("")))


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses; see EDITS."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def finish(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        other = fingerprint(signature(pa.array(changed, pa.string())))
        return common.batch_of(
            doc_id=pa.array(ids, pa.int64()), n_chars=pa.array([len(t) for t in texts], pa.int64()),
            edited_sha256=pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            fingerprint=pa.array(hexed(own), pa.string()), edited_fingerprint=pa.array(hexed(other), pa.string()),
            near_edited=pa.array((own == other).mean(axis=1)), near_next=pa.array((own == after).mean(axis=1)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, which waits for the one that follows it
        for batch in common.slices(batches):
            names = ("bucket", "again", "doc_id", "text")
            rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            prints = fingerprint(signature(batch.column("text")))
            if held is not None:
                rows.insert(0, held[0])
                prints = np.concatenate([held[1], prints])
            held = (rows[-1], prints[-1:])
            # A row is done with the row behind it; of the copies at a bucket's end only the first one counts.
            ready = [i for i in range(len(rows) - 1) if not rows[i][1]]
            if ready:
                nxt = [i + 1 for i in ready]
                yield finish([rows[i][2] for i in ready], [rows[i][3] or "" for i in ready], [rows[i][3] or "" for i in nxt], prints[ready], prints[nxt])

    common.prepare(docs.sparkSession)
    return in_order(docs, buckets).mapInArrow(run, EDITS)
