"""Links between items that share a band of their signatures: star-shaped candidates, exact verification, no lost pair.

Every bucket (equal band keys) has two centres, and each of its items meets both: pair counts are linear in the rows. Pairs
are verified on the full sets, and linked items become components. Only in buckets that then still hold items of several
components do the items that are no centres meet each other, and only across components: a hot bucket of like items costs
no quadratic number of pairs, and no pair is capped or dropped. So each pair that shares a band is verified, or ruled out
by an exact bound, or inside one component.

The bound: an item has a sketch, the parity of the number of its shingles in each of 64 * w cells (columns s0 to s{w-1}).
A cell whose parity differs holds a shingle that one of the sets lacks, so the differing bits bound the symmetric
difference from below; a pair is spared only where sizes or this bound rule the wanted likeness out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlode.llm import common, hashing
from starlode.llm.common import written
from starlode.llm.components import connected

#: Bits of a membership sketch: a fixed size, whatever the input. A false hit only lets a row through to an exact join.
SKETCH_BITS = 1 << 24
#: Cells of sketches that are counted at once, eight bytes each.
CELLS = 1 << 19

Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def sketch(keys: DataFrame) -> np.ndarray:
    """A bitmap of SKETCH_BITS bits of the (only) long column's values, built by partial aggregation."""
    slot = F.pmod(F.col(keys.columns[0]), F.lit(SKETCH_BITS)) + 1
    rows = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = np.zeros((SKETCH_BITS // 32768, 4096), np.uint8)
    for row in rows.collect():  # SKETCH_BITS / 8 bytes at most
        out[row["k"] - 1] = np.frombuffer(row["m"], np.uint8)
    return out.reshape(-1)


def hits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) % SKETCH_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def in_sketch(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among keys; a superset, to be followed by an exact join."""
    bits = df.sparkSession.sparkContext.broadcast(sketch(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            keep = hits(bits.value, values.fill_null(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep & values.is_valid().to_numpy(zero_copy_only=False)))

    common.prepare(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def shared_bands(items: DataFrame) -> DataFrame:
    """(bucket, item, c0, c1) for every bucket with two items or more, from items (item, bands), which may be repeated.

    The centres c0 and c1 are the items of the least and the largest number after mixing with the bucket's bits, so that
    an item is not the centre of all its buckets; both come from plain numbers, which tasks aggregate before the shuffle.
    """
    rows = items.where("bands is not null").select("item", F.explode("bands").alias("bucket"))
    mixed, bucket = F.col("item").bitwiseXOR(F.col("bucket")), F.col("bucket")
    found = rows.groupBy("bucket").agg(F.min(mixed).alias("lo"), F.max(mixed).alias("hi")).where("lo < hi")
    shared = written(found.select("bucket", F.col("lo").bitwiseXOR(bucket).alias("c0"), F.col("hi").bitwiseXOR(bucket).alias("c1")), "buckets")
    bits = items.sparkSession.sparkContext.broadcast(sketch(shared.select("bucket")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands")
            counts = np.diff(np.frombuffer(bands.buffers()[1], np.int32)[bands.offset : bands.offset + len(bands) + 1])
            flat = bands.flatten().to_numpy()
            keep = hits(bits.value, flat)
            row = np.repeat(np.arange(batch.num_rows), counts)[keep]
            yield common.batch_of(bucket=pa.array(flat[keep]), item=batch.column("item").take(pa.array(row)))

    common.prepare(items.sparkSession)
    likely = items.where("bands is not null").select("item", "bands").mapInArrow(run, "bucket long, item long")
    return written(likely.distinct().join(shared, "bucket"), "members")


def sketch_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c[0] == "s" and c[1:].isdigit()]


def parities(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The parity of the number of distinct hashes in each of ``size`` cells (their top bits), in 64-bit words."""
    cell = (values >> hashing.U(65 - size.bit_length())).astype(np.int64)
    at, step = hashing.bounds_of(counts), max(1, CELLS // size)
    out = np.empty((len(counts), size // 64), np.int64)
    for low in range(0, len(counts), step):
        some = counts[low : low + step]
        group = np.repeat(np.arange(len(some)), some)
        bits = np.bincount(group * size + cell[at[low] : at[low + len(some)]], minlength=len(some) * size) & 1
        out[low : low + step] = np.packbits(bits.astype(np.uint8).reshape(-1, size), axis=1).view(np.int64)
    return out


def attributes_of(values: np.ndarray, counts: np.ndarray, size: int) -> dict[str, pa.Array]:
    """Set size (n) and sketch columns of sorted distinct shingles."""
    marks = parities(values, counts, size)
    return {"n": pa.array(counts.astype(np.int64))} | {f"s{i}": pa.array(marks[:, i]) for i in range(size // 64)}


def payload_schema(size: int) -> str:
    return "item long, n long" + "".join(f", s{i} long" for i in range(size // 64)) + ", text string"


def sizes_fit(a: str, b: str, percent: int) -> Column:
    """Two sets of such sizes can have a likeness of percent / 100."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_enough(marks: list[str], prefix: str, percent: int) -> Column:
    """Whether two items may be as like as wanted: by their sizes, and by their sketches if there are any; exact, in that
    no pair as like as wanted is turned down.

    The columns of the second item have a prefix. Sets of n and m shingles and d in their symmetric difference have a
    likeness of (n + m - d) / (n + m + d), and at most d bits of their sketches differ.
    """
    fits = sizes_fit("n", f"{prefix}n", percent)
    return fits & few_differ([(F.col(c), F.col(f"{prefix}{c}")) for c in marks], prefix, percent) if marks else fits


def few_differ(words: list[tuple[Column, Column]], prefix: str, percent: int) -> Column:
    differing = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in words), F.lit(0))
    return differing * (100 + percent) <= (F.col("n") + F.col(f"{prefix}n")) * (100 - percent)


def widened(payload: DataFrame, sets: Sets, size: int) -> DataFrame:
    """(item, n, sketch, wide) with a sketch of ``size`` bits, made from the text, in the fields s0, s1 ... of wide: a struct
    is one column to a join, whose fields are read only of pairs that the shorter sketch lets through."""
    own = ["item", "n", *sketch_columns(payload)]
    fields = [f"s{i}" for i in range(size // 64)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = parities(*sets(batch.column("text")), size)
        wide = pa.StructArray.from_arrays([pa.array(marks[:, i]) for i in range(len(fields))], fields)
        return common.batch_of(**{c: batch.column(c) for c in own}, wide=wide)

    schema = ", ".join(f"{c} long" for c in own) + f", wide struct<{', '.join(f'{c}: long' for c in fields)}>"
    return common.map_slices(payload.select(*own, "text"), run, schema)


def folded(payload: DataFrame, marks: list[str], words: int = 4) -> DataFrame:
    """(item, n, sketch) with shorter sketches: words that are laid over one another are the parities of united cells."""
    rows = [marks[i::words] for i in range(min(words, len(marks)))]
    return payload.select("item", "n", *[reduce(lambda a, b: a.bitwiseXOR(b), map(F.col, r)).alias(f"s{i}") for i, r in enumerate(rows)])


def linked(members: DataFrame, payload: DataFrame, sets: Sets, percent: int, size: int = 0) -> DataFrame:
    """(node, component) of all items that have a verified link; a component is named by its least item.

    members is what ``shared_bands`` gives; payload has (item, n, sketch, text) of every item there. With a size, the items
    that meet across components have a sketch of so many bits besides, which is made for these alone.
    """
    marks = sketch_columns(payload)
    short = folded(payload, marks)
    other = short.select(*[F.col(c).alias(f"c_{c}") for c in short.columns])
    ends = F.explode(F.array("c0", "c1")).alias("c_item")
    star = members.select("item", ends).where("item != c_item").select(F.least("item", "c_item").alias("item"), F.greatest("item", "c_item").alias("c_item")).distinct()
    pairs = star.join(short, "item").join(other, "c_item").where(near_enough(sketch_columns(short), "c_", percent)).select(F.col("item").alias("a"), F.col("c_item").alias("b"))
    tested = written(verified(pairs, payload, sets, percent), "tested")
    labels = connected(tested.where("ok"))
    # Each pair with a centre is done; the other items of a bucket meet across components.
    rest = members.where("item != c0 and item != c1").select("bucket", "item")
    known = written(rest.join(labels.withColumnRenamed("node", "item"), "item", "left").select("bucket", "item", F.coalesce("component", "item").alias("part")), "known")
    mixed = known.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("bucket")
    across, attributes = known.join(mixed, "bucket"), payload.select("item", "n", *marks)
    near = near_enough(marks, "c_", percent)
    if size:
        across = written(across, "across")
        attributes = widened(payload.join(across.select("item").distinct(), "item", "left_semi"), sets, size)
        near &= few_differ([(F.col("wide")[f"s{i}"], F.col("c_wide")[f"s{i}"]) for i in range(size // 64)], "c_", percent)
    active = written(across.join(attributes, "item"), "active")
    second = active.select(*[F.col(c).alias(c if c == "bucket" else f"c_{c}") for c in active.columns])
    met = active.join(second, "bucket").where((F.col("item") < F.col("c_item")) & (F.col("part") != F.col("c_part")) & near)
    pairs = met.select(F.col("item").alias("a"), F.col("c_item").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    fresh = written(verified(pairs, payload, sets, percent).where("ok"), "tested")
    return labels if fresh.isEmpty() else merged(labels, fresh)


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after further edges (a, b): only components that edges join are looked at, and those they make."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    ends = edges.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    parts = ends.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    joined = connected(parts)
    moved = labels.join(joined.withColumnRenamed("component", "to").withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # A component's label is one of its nodes, so that nodes without a label so far are those of joined that labels lacks.
    new = joined.join(labels.select("node"), "node", "left_anti")
    return written(moved.unionAll(new), "labels")


def verified(pairs: DataFrame, payload: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(a, b, ok) by exact Jaccard likeness of whole shingle sets.

    payload has (item, text); sets gives the sorted distinct shingles of each text, and their numbers. A text that occurs
    in many pairs of a slice is shingled once.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.concat_arrays([batch.column("ta"), batch.column("tb")]).dictionary_encode()
        values, counts = sets(texts.dictionary)
        at, code, n = hashing.bounds_of(counts), texts.indices.to_numpy(), batch.num_rows
        ok = np.zeros(n, bool)
        for i in range(n):
            x, y = values[at[code[i]] : at[code[i] + 1]], values[at[code[i + n]] : at[code[i + n] + 1]]
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common_ = int(np.count_nonzero(both[1:] == both[:-1]))
            ok[i] = len(both) > 0 and common_ * 100 >= (len(both) - common_) * percent
        return common.batch_of(a=batch.column("a"), b=batch.column("b"), ok=pa.array(ok))

    right = pairs.join(payload.select(F.col("item").alias("b"), F.col("text").alias("tb")), "b")
    whole = right.join(payload.select(F.col("item").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return common.map_slices(whole, run, "a long, b long, ok boolean", column="tb")
