"""Connected components by distributed union-find.

Each partition first contracts its own edges to a forest (local union-find). While more than SMALL edges are left, every
node points at the smallest id it knows and pointers are halved, round by round, in joins; a forest of at most SMALL edges,
a checked and fixed number, is finished by one task. Both ways give the same labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlode.llm.common import batch_of, prepare, written

#: Edges that one task finishes, about 100 bytes of memory each.
SMALL = 500_000
#: Edges that a task contracts at a time.
CHUNK = 200_000


def forest(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest node reachable from each node."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = up.setdefault(x, x)
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def contracted(edges: DataFrame, chunk: int | None) -> DataFrame:
    """(a, b): each node a of a chunk of a partition's edges, with the smallest node b that the chunk connects it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def done() -> pa.RecordBatch:
            found = forest(iter(held))
            held.clear()
            return batch_of(a=pa.array(list(found), pa.int64()), b=pa.array(list(found.values()), pa.int64()))

        for batch in batches:
            held.extend(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
            if chunk and len(held) >= chunk:
                yield done()
        yield done()

    prepare(edges.sparkSession)
    return edges.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Each round takes the smallest label among the neighbours, then follows that label once (path halving), so that long
    chains take about as many rounds as the logarithm of their length. Repeated edges, loops and no edges at all are
    fine; edges with a null end are ignored. State is a table in the shared folder after each round.
    """
    pairs = edges.where("a is not null and b is not null and a != b").select("a", "b")
    pairs = written(contracted(pairs, CHUNK).where("a != b"), "forest")
    if pairs.count() <= SMALL:
        labels = written(contracted(pairs.coalesce(1), None), "labels")
        return labels.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return spread(pairs)


def spread(pairs: DataFrame) -> DataFrame:
    """Labels by joins, for any number of edges (a, b) without loops or nulls."""
    both = written(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        # A label is a node; where it points in the table before this round is as small or smaller.
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        step = written(step.join(up, "label").select("node", "was", F.least("label", "higher").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("label != was").isEmpty():
            return labels.withColumnRenamed("label", "component")
