"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. Each starts in the shard of a hash; in each round a unit of linked documents wants to
meet in the shard where most of its documents are, among those with room, and shards admit units (in the order of a hash)
up to a quota: the room that is left plus half of what is about to leave. Documents of a unit and shard are alike, so the
state is one row per unit and shard with a count. A group with many documents is split into units (see PARTS), which no
shard's quota is too small for and which keep the rows of every join key bounded; they want to meet in the same shard, or
in as few as have room for them, by the counts of the whole group. What exceeds a shard's share in the
end, documents without links first, moves to shards below theirs: counts are at most one apart (law ``rows``).

Defined results: a null text is an empty one; rows without doc_id are rows as any other; repeated rows get slots of their
own; an empty table gives no rows; columns other than doc_id and text are ignored. The result does not depend on the
order or partitioning of the input (of identical rows it does not matter which gets which slot).
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlode.llm.common import written

SHARDS = 16
ROUNDS = 6
#: Units of at most one part in this many of all rows, or of so many rows where that is more (in small tables at most a
#: quarter of a shard's share); so at most PARTS groups, or 4 a shard, are larger and are split.
PARTS, SMALL_UNIT = 1024, 1000
#: Buckets of the admission order.
BUCKETS = 256
WINDOW_ROWS = 100_000
GROUP = ["g1", "g2"]
UNIT = [*GROUP, "part"]


def base_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, two hashes of the text (the group) and a hash of the row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"))
    return rows.withColumn("own", F.xxhash64("doc_id", "g1"))


def told_apart(rows: DataFrame) -> DataFrame:
    """rows with another hash (own) for each of identical rows, so that these spread like others.

    They are numbered from 1, place by place within the partitions they were written from and by sums of partitions, so
    that no task gets all of them; the numbers do not depend on the partitioning.
    """
    key = ["own", "g2"]
    again = written(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    if again.isEmpty():
        return rows.drop("serial")
    origin = F.shiftright("serial", 33).alias("origin")
    copies = written(rows.join(again, key, "left_semi").select("*", origin), "copies")
    sizes = copies.groupBy(*key, "origin").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(Window.partitionBy(*key).orderBy("origin")) - F.col("n")).alias("before")  # a row for each partition
    number = F.col("before") + F.row_number().over(Window.partitionBy(*key, "origin").orderBy("serial"))
    numbered = copies.join(sizes.select(*key, "origin", before), [*key, "origin"]).withColumn("own", F.xxhash64("own", number))
    return rows.join(again, key, "left_anti").drop("serial").unionByName(numbered.drop("serial", "origin", "before"))


def propagate(cells: DataFrame, shares: list[int], rounds: int = ROUNDS) -> DataFrame:
    """The cells (unit, shard, n) after the last round; cells has all documents of linked units."""
    shards = len(shares)
    for number in range(rounds):
        whole = cells.groupBy(*UNIT).agg(F.sum("n").alias("all"), F.count("*").alias("places"))
        if whole.where("places > 1").isEmpty():
            break
        loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # at most one row a shard
        leaving = cells.join(whole.where("places > 1"), UNIT, "left_semi").groupBy("shard").agg(F.sum("n").alias("n")).collect()
        out = {r["shard"]: r["n"] for r in leaving}
        quota = [max(0, shares[j] - loads.get(j, 0)) + out.get(j, 0) // 2 for j in range(shards)]
        free = [j for j in range(shards) if quota[j] > 0]
        if not free:
            break
        room = F.array(*[F.lit(q) for q in quota])
        # The shards of a group by its documents there, those with room only, and the sums of their rooms up to each.
        tie = F.pmod(F.xxhash64(*GROUP, "shard", F.lit(number)), F.lit(1 << 20))
        spread = cells.groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where(room[F.col("shard")] > 0)
        order = Window.partitionBy(*GROUP).orderBy(F.desc("n"), F.desc(tie), F.desc("shard"))  # at most one row a shard
        spread = spread.withColumn("end", F.sum(room[F.col("shard")]).over(order))
        liked = spread.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("liked"))
        spare = F.array(*[F.lit(j) for j in free])[F.pmod(F.xxhash64(*UNIT, F.lit(number)), F.lit(len(free))).cast("int")]
        own = F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("own")  # at most one entry a shard
        wish = cells.groupBy(*UNIT).agg(F.sum("n").alias("all"), F.count("*").alias("places"), own).where("places > 1")
        # The parts of a group fill these shards one after the other, so that they meet in as few as the group needs.
        filled = F.sum("all").over(Window.partitionBy(*GROUP).orderBy("part"))  # a group has PARTS parts at most
        wish = wish.withColumn("filled", filled).join(liked, GROUP, "left")
        first = F.try_element_at(F.filter("liked", lambda x: x["end"] >= F.col("filled")), F.lit(1))
        wish = wish.withColumn("to", F.coalesce(first["shard"], spare))
        wish = wish.select(*UNIT, "all", "to", F.coalesce(F.try_element_at("own", F.col("to")), F.lit(0)).alias("there"))
        wish = written(wish.withColumn("bucket", F.pmod(F.xxhash64(*UNIT, F.lit("admit")), F.lit(BUCKETS))), "wishes")
        inflow = wish.groupBy("to", "bucket").agg(F.sum(F.col("all") - F.col("there")).alias("n"))  # shards * BUCKETS rows at most
        upto = F.sum("n").over(Window.partitionBy("to").orderBy("bucket"))
        admitted = inflow.withColumn("upto", upto).where(F.col("upto") <= room[F.col("to")]).select("to", "bucket")
        moved = wish.join(F.broadcast(admitted), ["to", "bucket"]).select(*UNIT, F.col("to").alias("shard"), F.col("all").alias("n"))
        cells = written(cells.join(moved, UNIT, "left_anti").unionAll(moved.select(*cells.columns)), "cells")
    return cells


def row_buckets(total: int, shards: int) -> int:
    """Buckets of rows in each shard and unit bucket: so many that a window gets about WINDOW_ROWS rows, at most 4096."""
    return min(4096, max(16, 1 << (total // (shards * 16 * WINDOW_ROWS)).bit_length()))


def evened(rows: DataFrame, shares: list[int]) -> DataFrame:
    """shard and slot of rows that have a wanted shard (lp) and say whether they are single."""
    shards = len(shares)
    fine = ["lp", "single", "unit_bucket", "row_bucket"]
    buckets = row_buckets(sum(shares), shards)
    rows = rows.withColumn("unit_bucket", F.pmod(F.xxhash64(*UNIT), F.lit(16))).withColumn("row_bucket", F.pmod(F.shiftright("own", 8), F.lit(buckets)))
    counts = rows.groupBy(*fine).agg(F.count("*").alias("n"))  # shards * 2 * 16 * buckets rows at most
    before = F.sum("n").over(Window.partitionBy("lp").orderBy(*fine[1:])) - F.col("n")
    counts = written(counts.withColumn("before", before), "counts")
    totals = {r["lp"]: r["n"] for r in counts.groupBy("lp").agg(F.sum("n").alias("n")).collect()}
    have = [totals.get(j, 0) for j in range(shards)]
    over = [0, *accumulate(max(0, have[j] - shares[j]) for j in range(shards))]
    lack = [0, *accumulate(max(0, shares[j] - have[j]) for j in range(shards))]
    pick = lambda values, at: F.array(*[F.lit(v).cast("long") for v in values])[at]
    lp = F.col("lp")
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*fine).orderBy("g1", "g2", "part", "doc_id", "own")) - 1
    ranked = rows.join(F.broadcast(counts.drop("n")), fine).withColumn("rank", rank)
    stays = F.col("rank") < pick(shares, lp)
    excess = pick(over[:-1], lp) + F.col("rank") - pick(shares, lp)
    ends: Column = F.array(*[F.lit(v).cast("long") for v in lack[1:]])
    goes = F.size(F.filter(ends, lambda end: end <= F.col("excess")))
    ranked = ranked.withColumn("excess", F.when(~stays, excess)).withColumn("goes", F.when(~stays, goes))
    shard = F.when(stays, lp).otherwise(F.col("goes")).cast("int")
    slot = F.when(stays, F.col("rank")).otherwise(pick(have, F.col("goes")) + F.col("excess") - pick(lack[:-1], F.col("goes")))
    return ranked.withColumn("shard", shard).withColumn("slot", slot.cast("long"))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and linked (whether others have the same text)."""
    rows = written(base_rows(docs).withColumn("serial", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    rows = told_apart(rows).withColumn("home", F.pmod("own", F.lit(shards)).cast("int"))
    shares = [total // shards + (j < total % shards) for j in range(shards)]
    limit = max(1, total // PARTS, min(SMALL_UNIT, total // (4 * shards)))
    groups = written(rows.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    large = groups.where(F.col("n") > limit).select("g1", "g2", F.ceil(F.col("n") / limit).alias("parts"))  # a bounded number of rows, see PARTS
    part = F.coalesce(F.pmod(F.shiftright("own", 20), F.col("parts")), F.lit(0))
    rows = rows.join(F.broadcast(large), ["g1", "g2"], "left").withColumn("part", part).drop("parts")
    cells = rows.groupBy(*UNIT, F.col("home").alias("shard")).agg(F.count("*").alias("n"))
    # Only groups of two rows or more are linked; the groups are unique, so that this join keeps counts bounded per key.
    cells = written(cells.join(groups.select("g1", "g2"), ["g1", "g2"], "left_semi"), "cells")
    done = propagate(cells, shares, rounds)
    # One row a unit: where all its documents are, or null where they stay where they started.
    place = done.groupBy(*UNIT).agg(F.when(F.count("*") == 1, F.max("shard")).alias("met"), F.lit(False).alias("single"))
    rows = rows.join(place, UNIT, "left").withColumn("lp", F.coalesce("met", "home")).withColumn("single", F.coalesce("single", F.lit(True)))
    even = evened(rows, shares)
    return even.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), (~F.col("single")).alias("linked"))
