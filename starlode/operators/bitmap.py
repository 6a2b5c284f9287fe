"""A binned bitmap index over dense row numbers, and boolean programs over it with a check of uncertain rows.

The index is a table (name, lo, hi, bucket, bits): the rows of a bucket of 32768 row numbers whose value is in [lo, hi),
built for all bins of all columns in one pass with partial aggregation. A program is a predicate; each of its ranges takes
the bins inside it and, where its ends fall inside bins, those bins as uncertain. Possible and uncertain rows go through

  and: P = P1 & P2, U = (U1 | U2) & P      or: P = P1 | P2, U = P & ~(C1 | C2) with C = P & ~U
  not: P = ~C, U = U

so that a row is surely in (C), surely out (not P) or must be looked at (U). A bucket without a bitmap counts as zeros.
Bits are numbered from the least significant one of each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlode.functions.predicates import And, Not, Or, Predicate, Range
from starlode.storage import ship, written

BUCKET_BITS = 32768
BUCKET_BYTES = BUCKET_BITS // 8


@dataclass(frozen=True)
class Bins:
    """Bins between ascending edges; fine edges, where given, stand in when the coarse ones leave a remainder."""

    coarse: tuple[int, ...]
    fine: tuple[int, ...] = ()

    def pairs(self) -> list[tuple[int, int]]:
        """Every bin of either level."""
        found = {p for edges in (self.coarse, self.fine) for p in zip(edges, edges[1:], strict=False)}
        return sorted(found)

    def choose(self, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(whole bins, partial bins) that cover [lo, hi); an empty range has none. ValueError if they do not cover it."""
        whole, part = pick(self.coarse, lo, hi)
        if part and self.fine and self.fine[0] <= lo and hi <= self.fine[-1]:
            return pick(self.fine, lo, hi)
        return whole, part


def pick(edges: tuple[int, ...], lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    if lo >= hi:
        return [], []
    if lo < edges[0] or hi > edges[-1]:
        raise ValueError(f"[{lo}, {hi}) is not covered by bins from {edges[0]} to {edges[-1]}")
    met = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < hi and b > lo]
    return [(a, b) for a, b in met if lo <= a and b <= hi], [(a, b) for a, b in met if a < lo or b > hi]


Layout = dict[str, Bins]


def exact(where: Predicate) -> Layout:
    """One bin for each range of a predicate: nothing is uncertain."""
    return {name: _Own([(r.lo, r.hi) for r in found]) for name, found in by_name(where).items()}


def thirds(where: Predicate) -> Layout:
    """Three bins for each range, the last takes the remainder; a range of fewer than three values is one bin."""
    return {name: _Own([p for r in found for p in split(r)]) for name, found in by_name(where).items()}


def widened(where: Predicate) -> Layout:
    """Thirds; the first column's bins begin half a step early and the second's end half a step late."""
    out: Layout = {}
    for i, (name, found) in enumerate(by_name(where).items()):
        pairs = []
        for r in found:
            own = split(r)
            half = max(1, (r.hi - r.lo) // 3 // 2)
            if i == 0:
                own[0] = (own[0][0] - half, own[0][1])
            if i == 1:
                own[-1] = (own[-1][0], own[-1][1] + half)
            pairs += own
        out[name] = _Own(pairs)
    return out


def split(r: Range) -> list[tuple[int, int]]:
    step = (r.hi - r.lo) // 3
    return [(r.lo, r.lo + step), (r.lo + step, r.lo + 2 * step), (r.lo + 2 * step, r.hi)] if step else [(r.lo, r.hi)]


def by_name(where: Predicate) -> dict[str, list[Range]]:
    out: dict[str, list[Range]] = {}
    for r in where.ranges():
        if r not in out.setdefault(r.name, []):
            out[r.name].append(r)
    return out


class _Own(Bins):
    """Bins made for the ranges of one query; they may overlap and leave gaps between ranges."""

    def __init__(self, own: list[tuple[int, int]]):
        object.__setattr__(self, "own", tuple(dict.fromkeys(own)))

    def pairs(self) -> list[tuple[int, int]]:
        return list(self.own)

    def choose(self, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        if lo >= hi:
            return [], []
        met = [(a, b) for a, b in self.own if a < hi and b > lo]
        inside = [(a, b) for a, b in met if lo <= a and b <= hi]
        # Bins of other ranges may cut across this one: whole bins first, partial ones only for what they leave open.
        part, at = [], lo
        for a, b in sorted(inside):
            if a > at:
                part += _covering(met, at, a)
            at = max(at, b)
        return inside, list(dict.fromkeys(part + (_covering(met, at, hi) if at < hi else [])))


def _covering(met: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    found, at = [], lo
    while at < hi:
        best = max((p for p in met if p[0] <= at < p[1]), key=lambda p: p[1], default=None)
        if best is None:
            raise ValueError(f"[{lo}, {hi}) is not covered by bins")
        found.append(best)
        at = best[1]
    return found


def build(rows: DataFrame, layout: Layout, row_id: str = "row_id") -> DataFrame:
    """The index of rows for all bins of a layout, in one pass."""
    bins = [(name, lo, hi) for name, b in layout.items() for lo, hi in b.pairs()]
    hits = F.array(*[F.when((F.col(n) >= lo) & (F.col(n) < hi), F.lit(i)) for i, (n, lo, hi) in enumerate(bins)])
    spread = rows.select(F.bitmap_bucket_number(row_id).alias("bucket"), F.bitmap_bit_position(row_id).alias("at"), F.explode(F.array_compact(hits)).alias("bin"))
    maps = spread.groupBy("bin", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    field = lambda k: F.array(*[F.lit(b[k]) for b in bins])[F.col("bin")]
    return maps.select(field(0).alias("name"), field(1).alias("lo"), field(2).alias("hi"), "bucket", "bits")


def program(where: Predicate, layout: Layout) -> tuple[list[tuple[str, int, int]], dict[Range, tuple[list[int], list[int]]]]:
    """The bins that a predicate needs, and for each of its ranges the places of its whole and partial bins among them."""
    needed: list[tuple[str, int, int]] = []
    leaves: dict[Range, tuple[list[int], list[int]]] = {}
    for r in where.ranges():
        sides = []
        for side in layout[r.name].choose(r.lo, r.hi):
            for lo, hi in side:
                if (r.name, lo, hi) not in needed:
                    needed.append((r.name, lo, hi))
            sides.append([needed.index((r.name, lo, hi)) for lo, hi in side])
        leaves[r] = (sides[0], sides[1])
    return needed, leaves


def evaluate(where: Predicate, leaves: dict[Range, tuple[list[int], list[int]]], maps: list[np.ndarray], valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(possible, uncertain) bitmaps of a predicate from the bitmaps of its bins."""
    if isinstance(where, Range):
        whole, part = leaves[where]
        sure, maybe = np.zeros_like(valid), np.zeros_like(valid)
        for i in whole:
            sure |= maps[i]
        for i in part:
            maybe |= maps[i]
        return sure | maybe, maybe & ~sure
    if isinstance(where, Not):
        p, u = evaluate(where.part, leaves, maps, valid)
        return ~(p & ~u) & valid, u
    sides = [evaluate(x, leaves, maps, valid) for x in where.parts]
    if isinstance(where, And):
        possible, doubt = valid.copy(), np.zeros_like(valid)
        for p, u in sides:
            possible &= p
            doubt |= u
        return possible, doubt & possible
    possible, sure = np.zeros_like(valid), np.zeros_like(valid)
    for p, u in sides:
        possible |= p
        sure |= p & ~u
    assert isinstance(where, Or)
    return possible, possible & ~sure


def bucket_maps(where: Predicate, index: DataFrame, layout: Layout, n_rows: int) -> tuple[DataFrame, dict]:
    """One row per bucket with a bitmap column per needed bin (null for none); every bucket of the table has a row."""
    needed, leaves = program(where, layout)
    spark = index.sparkSession
    every = spark.range(1, -(-n_rows // BUCKET_BITS) + 1).withColumnRenamed("id", "bucket")
    if not needed:
        return every, leaves
    which = F.coalesce(*[F.when((F.col("name") == n) & (F.col("lo") == lo) & (F.col("hi") == hi), F.lit(i)) for i, (n, lo, hi) in enumerate(needed)])
    chosen = index.select("bucket", "bits", which.alias("bin")).where("bin is not null")
    wide = chosen.groupBy("bucket").agg(*[F.first(F.when(F.col("bin") == i, F.col("bits")), ignorenulls=True).alias(f"b{i}") for i in range(len(needed))])
    return every.join(wide, "bucket", "left"), leaves


def _rows_of(batch: pa.RecordBatch, where: Predicate, leaves: dict, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers and (possible, uncertain) bitmaps of a batch of bucket rows."""
    n = batch.num_rows
    bucket = batch.column("bucket").to_numpy().astype(np.int64)
    names = sorted((c for c in batch.schema.names if c != "bucket"), key=lambda c: int(c[1:]))
    blank = bytes(BUCKET_BYTES)
    maps = [np.frombuffer(b"".join(x if x is not None else blank for x in batch.column(c).to_pylist()), np.uint8).reshape(n, BUCKET_BYTES) for c in names]
    left = np.clip(n_rows - (bucket - 1) * BUCKET_BITS, 0, BUCKET_BITS)
    valid = np.packbits(np.arange(BUCKET_BITS)[None, :] < left[:, None], axis=1, bitorder="little")
    return bucket, *evaluate(where, leaves, maps, valid)


def matches(where: Predicate, index: DataFrame, layout: Layout, n_rows: int) -> DataFrame:
    """(row_id, uncertain) of all possible rows."""
    table, leaves = bucket_maps(where, index, layout, n_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):  # a bucket expands to 32768 rows at most
                bucket, possible, doubt = _rows_of(whole.slice(k, 1), where, leaves, n_rows)
                at = np.flatnonzero(np.unpackbits(possible[0], bitorder="little"))
                unsure = np.unpackbits(doubt[0], bitorder="little")[at].astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(at + (bucket[0] - 1) * BUCKET_BITS + 1), pa.array(unsure)], names=["row_id", "uncertain"])

    ship(table.sparkSession)
    return table.mapInArrow(run, "row_id long, uncertain boolean")


def cardinality(where: Predicate, index: DataFrame, layout: Layout, n_rows: int) -> DataFrame:
    """(possible, uncertain): numbers of rows, from the bitmaps alone."""
    table, leaves = bucket_maps(where, index, layout, n_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, possible, doubt = _rows_of(batch.slice(k, 1), where, leaves, n_rows)
                yield pa.RecordBatch.from_arrays([pa.array([int(np.bitwise_count(m).sum())], pa.int64()) for m in (possible, doubt)], names=["p", "u"])

    ship(table.sparkSession)
    parts = table.mapInArrow(run, "p long, u long")
    return parts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("possible"), F.coalesce(F.sum("u"), F.lit(0)).alias("uncertain"))


def select(rows: DataFrame, where: Predicate, index: DataFrame, layout: Layout, n_rows: int) -> DataFrame:
    """The rows that satisfy a predicate: those the index is sure of, and the uncertain ones that pass the predicate."""
    found = rows.join(matches(where, index, layout, n_rows), "row_id")
    return found.where(~F.col("uncertain") | where.column()).drop("uncertain")


def appended(index: DataFrame, rows: DataFrame, layout: Layout) -> DataFrame:
    """The index after further rows with row numbers beyond the present ones: bitmaps of shared buckets are united."""
    both = index.unionByName(build(rows, layout))
    return both.groupBy("name", "lo", "hi", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(index: DataFrame) -> DataFrame:
    """Rows, buckets and bytes of each bin."""
    bits: Column = F.bitmap_count("bits")
    return index.groupBy("name", "lo", "hi").agg(F.sum(bits).alias("rows"), F.count("*").alias("buckets"), F.sum(F.length("bits")).cast("bigint").alias("bytes"))


def stored(rows: DataFrame, layout: Layout) -> DataFrame:
    """The index as a written table, to be used by many queries."""
    return written(build(rows, layout), "bitmaps")


def _steps(lo: int, hi: int, step: int) -> tuple[int, ...]:
    return tuple(range(lo, hi + 1, step))


def layouts(year_edges: list[int]) -> dict[str, Layout]:
    """The three layouts for the star view: which columns have fine bins beside coarse ones.

    Fixed values: bin edges; days are counted from the view's first day, whose leap years fall as in the benchmark.
    """
    date = Bins(tuple(year_edges)), (731, 762, 790, 2161, 2192)
    discount = Bins((0, 2, 5, 8, 11)), _steps(0, 11, 1)
    quantity = Bins((1, 11, 21, 31, 41, 51)), _steps(1, 51, 5)
    brand = Bins(_steps(0, 1000, 200)), (40, 80, 120, 160, 240, 280)
    city = Bins(_steps(0, 250, 50)), (150, 160, 190, 200)
    columns = {"day": date, "discount": discount, "quantity": quantity, "brand": brand, "c_city": city, "s_city": city}
    fine = {"sparse": (), "medium": ("discount", "quantity", "brand", "c_city"), "dense": tuple(columns)}
    return {kind: {n: Bins(c.coarse, f) if n in fine[kind] else c for n, (c, f) in columns.items()} for kind in fine}
