"""Fuzzy line dedup: MinHash over character shingles, banding, exact verification, union-find, one line per component.

A line is what stands between newlines; its normal form is in lower case with single spaces. Lines of equal normal form
are one item, named by 128 bits of a hash of it (of lines that share the first 64, one is compared with others). Of each component of lines with a likeness of PERCENT / 100 or more, only the
first occurrence in the order (doc_id, hash of the text, position) stays, across the whole table.

Defined results: blank lines always stay and are not counted; a null text stays null, an empty one empty; rows without
doc_id keep all their lines and are not looked at; identical repeated rows are treated alike (all keep or all lose a
line); an empty table gives no rows; columns beyond the five of documents are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlode.llm import common, hashing, links
from starlode.llm.common import written

SHINGLE = 8
PERCENT = 80
#: A pair of likeness 0.8 shares none of 10 bands of 3 rows with a chance of 8 in 10,000; of 0.9, 2 in a million.
BANDS, ROWS, SEED = 10, 3, 11
#: Bits of the sketches that rule candidates out whose sets differ in too many shingles, powers of two: every candidate has
#: the short one, and those that meet across components the long one too.
SHORT, SKETCH = 256, 2048
#: Lines that a task remembers so as not to sign them again.
SEEN = 200_000
#: Bytes of text whose lines are signed at once, some 100 bytes of memory for each.
LINE_BYTES = 1 << 19
NAME = struct.Struct("<qq")


def normal(line: str) -> str:
    # Lines of printable characters (the space is the only white space among these) with single spaces are quick to see.
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line.lower()
    return " ".join(line.lower().split())


def line_name(text: str) -> tuple[int, int]:
    """Two 64-bit numbers, which together name a line."""
    return NAME.unpack(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and n+1 offsets."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def line_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-character shingles of each line, and their numbers."""
    return hashing.distinct(*hashing.char_shingles(*codes_of(texts.to_pylist()), k, hashing.U, padded=True))


def lines(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h (hash of the whole text), pos, id, id2 and, where the task meets the line first, its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        seen: set[int] = set()
        for batch in common.slices(batches, size=LINE_BYTES):
            row, pos, names, fresh, fresh_at = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for p, line in enumerate((text or "").split("\n")):
                    if clean := normal(line):
                        row.append(i)
                        pos.append(p)
                        names.append(line_name(clean))
                        if names[-1][0] not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(names[-1][0])
                            fresh_at.append(len(names) - 1)
                            fresh.append(clean)
            if not names:
                continue
            values, counts = hashing.char_shingles(*codes_of(fresh), k, padded=True)
            keys = hashing.signed(hashing.band_keys(hashing.minhash(values, counts, bands * rows, SEED), rows))
            place = np.full(len(names), -1)
            place[fresh_at] = np.arange(len(fresh_at))
            flat = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, keys.reshape(-1))
            take, both = pa.array(row, pa.int64()), np.array(names, np.int64)
            yield common.batch_of(
                doc_id=batch.column("doc_id").take(take), h=batch.column("h").take(take), pos=pa.array(pos, pa.int32()),
                id=pa.array(both[:, 0]), id2=pa.array(both[:, 1]), bands=flat.take(pa.array(place, mask=place < 0)),
            )

    common.prepare(docs.sparkSession)
    named = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    return named.mapInArrow(run, "doc_id long, h long, pos int, id long, id2 long, bands array<long>")


def line_texts(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(item, id2, n, sketch, text) of the lines whose first name is among ids (item); one line for each of these."""
    bits = docs.sparkSession.sparkContext.broadcast(links.sketch(ids))
    kinds = "id2 long, " + links.payload_schema(SHORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        seen: set[int] = set()
        for batch in common.slices(batches, size=LINE_BYTES):
            found = [c for text in batch.column("text").to_pylist() for line in (text or "").split("\n") if (c := normal(line))]
            if not found:
                continue
            names = np.array([line_name(c) for c in found], np.int64)
            fresh: dict[int, int] = {}
            for i in np.flatnonzero(links.hits(bits.value, names[:, 0])).tolist():
                if (v := int(names[i, 0])) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(v)
                    fresh[v] = i
            at = list(fresh.values())
            texts = pa.array([found[i] for i in at], pa.string())
            yield common.batch_of(id2=pa.array(names[at, 1]), item=pa.array(names[at, 0]), **links.attributes_of(*line_sets(texts, k), SHORT), text=texts)

    common.prepare(docs.sparkSession)
    texts = docs.where("doc_id is not null").select("text").mapInArrow(run, kinds)
    return texts.join(ids, "item", "left_semi").dropDuplicates(["item"])


def repeated_lines(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, pos) of every line that goes."""
    table = written(lines(docs, k), "lines")
    members = links.shared_bands(table.select(F.col("id").alias("item"), "bands"))
    payload = written(line_texts(docs, members.select("item").distinct(), k), "texts")
    labels = links.linked(members, payload, partial(line_sets, k=k), percent, SKETCH)
    named = written(payload.select(F.col("item").alias("id"), "id2").join(labels.withColumnRenamed("node", "id"), "id"), "named")
    # Most lines occur once and are in no component; only the occurrences of the others are looked at again.
    rows = table.select("doc_id", "h", "pos", "id", "id2")
    often = rows.groupBy("id", "id2").agg(F.count("*").alias("times")).join(named, ["id", "id2"], "left").where("times > 1 or component is not null")
    # A component bears the first name of one of its lines; the second name tells it from a line by itself.
    often = written(often.select("id", "id2", F.coalesce("component", "id").alias("part"), F.when(F.col("component").isNull(), F.col("id2")).otherwise(0).alias("part2")), "often")
    place = F.struct("doc_id", "h", "pos")
    found = written(links.in_sketch(rows, "id", often.select("id")).join(often, ["id", "id2"]).select("part", "part2", place.alias("place")), "occurrences")
    firsts = written(found.groupBy("part", "part2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first != last").select("part", "part2", "first"), "firsts")
    return found.join(firsts, ["part", "part2"]).where("place != first").select("place.*")


CLEANED = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_kept int"


def deduplicated(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The five columns of documents without the lines that go (n_chars counted anew where some do), n_lines and n_kept."""
    docs = docs.select(*common.DOCUMENT_COLUMNS)
    gone = repeated_lines(docs, k, percent).groupBy("doc_id", "h").agg(F.collect_set("pos").alias("gone"))
    whole = docs.withColumn("h", F.xxhash64("text")).join(gone, ["doc_id", "h"], "left").select(*common.DOCUMENT_COLUMNS, "gone")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
        before, after = [], []
        for i, (text, drop) in enumerate(zip(texts, batch.column("gone").to_pylist(), strict=True)):
            parts = (text or "").split("\n")
            before.append(sum(1 for line in parts if line.strip()))
            after.append(before[-1] - len(drop or ()))
            if drop:
                drop = set(drop)
                texts[i] = "\n".join(line for p, line in enumerate(parts) if p not in drop)
                sizes[i] = len(texts[i])
        columns = {c: batch.column(c) for c in common.DOCUMENT_COLUMNS} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
        return common.batch_of(**columns, n_lines=pa.array(before, pa.int32()), n_kept=pa.array(after, pa.int32()))

    return common.map_slices(whole, run, CLEANED)


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, n_chars and the digest of each document's remaining text."""
    done = deduplicated(docs)
    return done.select("doc_id", "n_lines", "n_kept", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
