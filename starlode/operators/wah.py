"""Word-aligned run-length bitmaps: 31-bit words, literals and fills, as Spark tables.

A bitmap is named (``bitmap``); word w holds rows 31w+1 to 31w+31, the first of them in the most significant of 31 bits.
Three forms: words (bitmap, word_no, word) of the words that are not zero; runs (bitmap, chunk, start, length, word) of
maximal stretches of equal words; codes (bitmap, chunk, codes) with one array of encoded words a chunk, where a literal is
the word itself and a fill is 2**31 + fill bit * 2**30 + length. Chunks of CHUNK words bound windows and arrays; a run
does not go on over a chunk's end. Every form covers ceil(rows / 31) words; the last is padded with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 31
FULL = (1 << BITS) - 1
FILL, ONE, LENGTH = 1 << 31, 1 << 30, (1 << 30) - 1
CHUNK = 1 << 16


def div(a: Column, by: int) -> Column:
    return F.call_function("div", a, F.lit(by))


def flat(rows: DataFrame, bitmap: str | Column = "bitmap", row_id: str = "row_id") -> DataFrame:
    """Words of the rows given; a row that comes twice counts once."""
    at = F.col(row_id) - 1
    name = F.col(bitmap) if isinstance(bitmap, str) else bitmap
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(BITS - 1) - at % BITS).cast("int"))
    return rows.select(name.alias("bitmap"), div(at, BITS).alias("word_no"), bit.alias("bit")).groupBy("bitmap", "word_no").agg(F.bit_or("bit").alias("word"))


def padded(words: DataFrame, n_rows: int) -> DataFrame:
    """Words with the zeros between them, for every bitmap that has a word."""
    names = words.select("bitmap").distinct()
    every = words.sparkSession.range(-(-n_rows // BITS)).withColumnRenamed("id", "word_no")
    return names.join(every).join(words, ["bitmap", "word_no"], "left").select("bitmap", "word_no", F.coalesce("word", F.lit(0)).alias("word"))


def runs(words: DataFrame, n_rows: int) -> DataFrame:
    """Maximal runs of equal words within chunks, zeros included: the gaps between words are runs by arithmetic."""
    total = -(-n_rows // BITS)
    chunk = div(F.col("word_no"), CHUNK).alias("chunk")
    kept = words.where("word != 0").select("bitmap", chunk, F.col("word_no").alias("at"), "word")
    order = Window.partitionBy("bitmap", "chunk").orderBy("at")
    new = F.when((F.col("word") == F.lag("word").over(order)) & (F.col("at") == F.lag("at").over(order) + 1), 0).otherwise(1)
    islands = kept.withColumn("new", new).withColumn("island", F.sum("new").over(order)).groupBy("bitmap", "chunk", "island")
    ones = islands.agg(F.min("at").alias("start"), F.count("*").alias("length"), F.first("word").alias("word")).drop("island")
    # A zero run stands before each island, behind the last one, and in chunks without any.
    end = F.least((F.col("chunk") + 1) * CHUNK, F.lit(total))
    order = Window.partitionBy("bitmap", "chunk").orderBy("start")
    before = F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.col("chunk") * CHUNK)
    gaps = ones.select("bitmap", "chunk", before.alias("start"), (F.col("start") - before).alias("length"))
    tail = ones.groupBy("bitmap", "chunk").agg(F.max(F.col("start") + F.col("length")).alias("start")).select("bitmap", "chunk", "start", (end - F.col("start")).alias("length"))
    chunks = words.sparkSession.range(-(-total // CHUNK)).withColumnRenamed("id", "chunk")
    empty = words.select("bitmap").distinct().join(chunks).join(ones.select("bitmap", "chunk").distinct(), ["bitmap", "chunk"], "left_anti")
    blank = empty.select("bitmap", "chunk", (F.col("chunk") * CHUNK).alias("start"), (end - F.col("chunk") * CHUNK).alias("length"))
    zeros = gaps.unionAll(tail).unionAll(blank).where("length > 0").withColumn("word", F.lit(0).cast("bigint"))
    return ones.unionByName(zeros)


def encoded(run_table: DataFrame, one_fills: bool = True) -> DataFrame:
    """Codes of runs; without one_fills, runs of ones stay literals."""
    fill = F.lit(FILL) + F.col("length")
    many = F.expr("array_repeat(word, cast(length as int))")
    code = F.when(F.col("word") == 0, F.array(fill))
    if one_fills:
        code = code.when(F.col("word") == FULL, F.array(fill + ONE))
    pieces = run_table.select("bitmap", "chunk", F.struct("start", code.otherwise(many).alias("codes")).alias("piece"))
    ordered = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["codes"])
    return pieces.groupBy("bitmap", "chunk").agg(F.flatten(ordered).alias("codes"))


def decoded(code_table: DataFrame) -> DataFrame:
    """Words (without zeros) of codes."""
    each = code_table.select("bitmap", "chunk", F.posexplode("codes").alias("pos", "code"))
    is_fill = F.col("code") >= FILL
    length = F.when(is_fill, F.col("code").bitwiseAND(F.lit(LENGTH))).otherwise(1)
    word = F.when(~is_fill, F.col("code")).when(F.col("code").bitwiseAND(F.lit(ONE)) != 0, F.lit(FULL)).otherwise(0)
    order = Window.partitionBy("bitmap", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.select("bitmap", "chunk", length.alias("length"), word.cast("bigint").alias("word"), (F.col("chunk") * CHUNK + F.coalesce(F.sum(length).over(order), F.lit(0))).alias("start"))
    spread = placed.where("word != 0").select("bitmap", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word_no"), "word")
    return spread


def positions(words: DataFrame) -> DataFrame:
    """(bitmap, row_id) of the set bits."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftright", F.col("word"), F.lit(BITS - 1) - i).bitwiseAND(F.lit(1)) == 1)
    return words.select("bitmap", "word_no", F.explode(bits).alias("i")).select("bitmap", (F.col("word_no") * BITS + F.col("i") + 1).alias("row_id"))


def combined(left: DataFrame, right: DataFrame, op: str, name: str = "result") -> DataFrame:
    """Words of and, or, xor or andnot of two bitmaps' words; an absent word is zero."""
    how = "inner" if op == "and" else "left" if op == "andnot" else "full"
    both = left.select("word_no", F.col("word").alias("x")).join(right.select("word_no", F.col("word").alias("y")), "word_no", how)
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    word = {"and": x.bitwiseAND(y), "or": x.bitwiseOR(y), "xor": x.bitwiseXOR(y), "andnot": x.bitwiseAND(y.bitwiseXOR(F.lit(FULL)))}[op]
    return both.select(F.lit(name).alias("bitmap"), "word_no", word.alias("word")).where("word != 0")


def combined_runs(left: DataFrame, right: DataFrame, op: str, name: str = "result") -> DataFrame:
    """Runs of and, or or xor of two run tables of the same length, without spreading fills into words.

    Runs of both sides are cut at all starts of either side in their chunk; equal neighbours are united again.
    """
    starts = left.select("chunk", "start").unionAll(right.select("chunk", "start")).distinct()
    ends = left.groupBy("chunk").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    order = Window.partitionBy("chunk").orderBy("start")
    pieces = starts.join(ends, "chunk").select("chunk", "start", F.coalesce(F.lead("start").over(order), F.col("end")).alias("next"))

    def value(side: DataFrame, column: str) -> DataFrame:
        # The run that holds a piece is the last one that begins at or before it.
        marked = pieces.join(side.select("chunk", "start", "word"), ["chunk", "start"], "left")
        last = F.last("word", ignorenulls=True).over(order)
        return marked.select("chunk", "start", "next", last.alias(column))

    both = value(left, "x").join(value(right, "y"), ["chunk", "start", "next"])
    word = {"and": F.col("x").bitwiseAND(F.col("y")), "or": F.col("x").bitwiseOR(F.col("y")), "xor": F.col("x").bitwiseXOR(F.col("y"))}[op]
    cut = both.select("chunk", "start", (F.col("next") - F.col("start")).alias("length"), word.alias("word"))
    return compacted(cut.withColumn("bitmap", F.lit(name)))


def combined_mixed(run_table: DataFrame, words: DataFrame, op: str, name: str = "result") -> DataFrame:
    """Words of and, or or xor of a run table and another bitmap's words, without spreading fills for and.

    The run that holds a word is the last one that begins at or before it; for or and xor all words of the runs that are
    not zero count as well.
    """
    if op != "and":
        spread = run_table.where("word != 0").select(F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word_no"), "word")
        return combined(spread, words, op, name)
    heads = run_table.select("chunk", F.col("start").alias("at"), F.col("word").alias("x"), F.lit(None).cast("bigint").alias("y"))
    own = words.select(div(F.col("word_no"), CHUNK).alias("chunk"), F.col("word_no").alias("at"), F.lit(None).cast("bigint").alias("x"), F.col("word").alias("y"))
    # Of equal places the run's head comes first, so that the word there sees it.
    order = Window.partitionBy("chunk").orderBy("at", F.col("y").isNotNull())
    both = heads.unionAll(own).withColumn("x", F.last("x", ignorenulls=True).over(order)).where("y is not null")
    return both.select(F.lit(name).alias("bitmap"), F.col("at").alias("word_no"), F.col("x").bitwiseAND(F.col("y")).alias("word")).where("word != 0")


def result_length(op: str, left: int, right: int) -> int:
    """Words of the result of two bitmaps of different lengths: the shorter for and, the longer for or and xor."""
    return min(left, right) if op == "and" else max(left, right)


def first_set(words: DataFrame) -> DataFrame:
    """(bitmap, row_id) of the first set bit of each bitmap that has one."""
    lead = F.lit(BITS - 1) - F.floor(F.log2("word")).cast("int")
    head = words.where("word != 0").groupBy("bitmap").agg(F.min(F.struct("word_no", "word")).alias("w")).select("bitmap", "w.*")
    return head.select("bitmap", (F.col("word_no") * BITS + lead + 1).alias("row_id"))


def compacted(run_table: DataFrame) -> DataFrame:
    """Runs with equal neighbours united."""
    order = Window.partitionBy("bitmap", "chunk").orderBy("start")
    new = F.when(F.col("word") == F.lag("word").over(order), 0).otherwise(1)
    islands = run_table.withColumn("new", new).withColumn("island", F.sum("new").over(order)).groupBy("bitmap", "chunk", "island")
    return islands.agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.first("word").alias("word")).select("bitmap", "chunk", "start", "length", "word")


def longest_ones(run_table: DataFrame) -> DataFrame:
    """The longest run of full words of each bitmap; 0 for none."""
    return run_table.groupBy("bitmap").agg(F.coalesce(F.max(F.when(F.col("word") == FULL, F.col("length"))), F.lit(0)).alias("longest"))


def count(words: DataFrame) -> DataFrame:
    return words.groupBy("bitmap").agg(F.sum(F.bit_count("word")).cast("bigint").alias("rows"))
