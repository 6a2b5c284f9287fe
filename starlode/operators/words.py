"""A binned bitmap index as a table of 64-row words, combined and tested with plain arithmetic on the JVM.

Row numbers begin at 0; word w holds rows 64w to 64w + 63, the first of them in the least significant bit. The index has a
row for each word and a column for each bin (b0, b1, ...), so that a boolean program over bins is an expression over
columns: it needs no join, no Python and no positions. Facts join the words that are left on the word's number and test
their bit. Both tables are written in the same number of buckets of the word's number, so that this join shuffles nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlode.functions.predicates import And, Not, Predicate, Range
from starlode.operators.bitmap import Layout, program
from starlode.storage import shared_dir

BITS = 64
#: Rows of facts in a bucket, about; the number of buckets follows the table's size.
BUCKET_ROWS = 4_000_000

Bin = tuple[str, int, int]


@dataclass(frozen=True)
class Index:
    """Words (word, valid, b0, ...) of bins; valid has a bit for each row that there is."""

    words: DataFrame
    bins: dict[Bin, str]


def buckets_for(n_rows: int) -> int:
    return max(8, -(-n_rows // BUCKET_ROWS))


def bucketed(rows: DataFrame, label: str, buckets: int) -> DataFrame:
    """rows as a table in the shared folder, in buckets of the column word."""
    name = f"starlode_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/{name}"
    placed = rows.repartition(buckets, "word")  # a file a bucket
    placed.write.format("parquet").option("path", path).bucketBy(buckets, "word").sortBy("word").saveAsTable(name)
    return rows.sparkSession.table(name)


def placed(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """rows with word and place (0 to 63) of their number, which counts from 1."""
    at = F.col(row_id) - 1
    return rows.withColumn("word", F.shiftright(at, 6)).withColumn("place", at.bitwiseAND(F.lit(BITS - 1)).cast("int"))


def build(rows: DataFrame, layout: Layout, buckets: int) -> Index:
    """The index of placed rows for all bins of a layout, in one pass with partial aggregation."""
    bins = {(name, lo, hi): f"b{i}" for i, (name, lo, hi) in enumerate((n, *p) for n, b in layout.items() for p in b.pairs())}
    bit = F.expr("shiftleft(1L, place)")
    hits = [F.coalesce(F.bit_or(F.when((F.col(n) >= lo) & (F.col(n) < hi), bit)), F.lit(0)).alias(c) for (n, lo, hi), c in bins.items()]
    words = rows.groupBy("word").agg(F.bit_or(bit).alias("valid"), *hits)
    return Index(bucketed(words, "words", buckets), bins)


def evaluate(where: Predicate, leaves: dict[Range, tuple[list[Column], list[Column]]]) -> tuple[Column, Column]:
    """(possible, uncertain) words of a predicate, by the rules of operators/bitmap.py, as expressions over bins."""
    either = lambda columns: reduce(lambda a, b: a.bitwiseOR(b), columns, F.lit(0).cast("bigint"))
    if isinstance(where, Range):
        sure, maybe = (either(side) for side in leaves[where])
        return sure.bitwiseOR(maybe), maybe.bitwiseAND(F.bitwise_not(sure))
    if isinstance(where, Not):
        p, u = evaluate(where.part, leaves)
        return F.col("valid").bitwiseAND(F.bitwise_not(p.bitwiseAND(F.bitwise_not(u)))), u
    sides = [evaluate(x, leaves) for x in where.parts]
    if isinstance(where, And):
        possible = reduce(lambda a, b: a.bitwiseAND(b), (p for p, _ in sides), F.col("valid"))
        return possible, either([u for _, u in sides]).bitwiseAND(possible)
    possible, sure = either([p for p, _ in sides]), either([p.bitwiseAND(F.bitwise_not(u)) for p, u in sides])
    return possible, possible.bitwiseAND(F.bitwise_not(sure))


def found(index: Index, where: Predicate, layout: Layout) -> DataFrame:
    """(word, possible, uncertain) of the words that may hold a row; only the columns of the needed bins are read."""
    needed, places = program(where, layout)
    column = [F.col(index.bins[b]) for b in needed]
    leaves = {r: ([column[i] for i in whole], [column[i] for i in part]) for r, (whole, part) in places.items()}
    possible, uncertain = evaluate(where, leaves)
    return index.words.select("word", possible.alias("possible"), uncertain.alias("uncertain")).where("possible != 0")


def select(rows: DataFrame, index: Index, where: Predicate, layout: Layout) -> DataFrame:
    """The placed rows that meet a predicate: those that the index is sure of, and uncertain ones that pass the predicate."""
    bit = F.expr("shiftleft(1L, place)")
    has = lambda name: F.col(name).bitwiseAND(bit) != 0
    met = rows.join(found(index, where, layout), "word").where(has("possible") & (~has("uncertain") | where.column()))
    return met.drop("possible", "uncertain")


def cardinality(index: Index, where: Predicate, layout: Layout) -> DataFrame:
    """(possible, uncertain): numbers of rows, from the words alone."""
    total = lambda name: F.coalesce(F.sum(F.bit_count(name)), F.lit(0)).cast("bigint").alias(name)
    return found(index, where, layout).agg(total("possible"), total("uncertain"))
