"""Cases for run-length bitmaps: lists of rows by simple predicates, united within groups and intersected across groups.

Each list is made from the star's facts, encoded into run-length words and decoded again, and the lists are combined on
words; the bits that are left give the rows. Dates are those of the driver tables, three years after the published ones;
columns that these tables lack have stand-ins (noted below). The skewed lists are lists of orders, by their keys.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.functions import codes
from starlode.operators import wah
from starlode.sources.rows import numbered
from starlode.sources.star import customers, facts, orders, parts, suppliers, table
from starlode.storage import written

#: For each case its lists, united within a group; groups are intersected. Conditions are SQL that both
#: engines read. In T12 the order's priority stands for the shipping mode and the shipping date for that of receipt, in T17
#: the size stands for the container.
CASES: dict[str, tuple[tuple[str, ...], ...]] = {
    "s12": (("discount >= 4 AND discount < 7",), ("quantity >= 26 AND quantity < 36",), ("day >= 731 AND day < 762",)),
    "s13": (("discount >= 5 AND discount < 8",), ("quantity >= 26 AND quantity < 36",), ("day >= 765 AND day < 772",)),
    "s23": (("brand >= 278 AND brand < 279",), ("s_city >= 150 AND s_city < 200",)),
    "s34": (("c_city >= 151 AND c_city < 152", "c_city >= 155 AND c_city < 156"), ("s_city >= 151 AND s_city < 152", "s_city >= 155 AND s_city < 156"), ("day >= 2161 AND day < 2192",)),
    "s41": (("brand >= 0 AND brand < 200", "brand >= 200 AND brand < 400"), ("s_city >= 50 AND s_city < 100",), ("c_city >= 50 AND c_city < 100",)),
    "t3": (("day >= 1186", "day >= 1169 AND day < 1186"), ("ship < 1155", "ship >= 1155 AND ship < 1169"), ("segment = 'BUILDING'",)),
    "t6": (("quantity >= 24 AND quantity < 25",), ("discount >= 5 AND discount < 7",), ("ship >= 365 AND ship < 1096",)),
    "t12": (("priority = '1-URGENT'", "priority = '2-HIGH'"), ("ship >= 731 AND ship < 738",)),
    "t17": (("size >= 39 AND size < 40",), ("category = 13",), ("quantity >= 0 AND quantity < 6",)),
}
SKEWS = (1.2, 1.4, 1.6, 1.8, 2.0)
LISTS, SHOWN = 32, 6
#: Parameters of the residues that deal rows to the lists of the skewed cases.
PRIME, FACTORS = 1_000_003, (7919, 104_729)

VIEW_SQL = """
WITH view AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS quantity, CAST(round(l_discount * 100) AS INT) AS discount,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS ship,
    (CAST(substr(p_brand, 7) AS INT) - 1) * 40 + CAST(p_partkey % 40 AS INT) AS brand, CAST(substr(p_brand, 7) AS INT) - 1 AS category, p_size AS size,
    CAST((s_nationkey % 5) * 50 + (s_nationkey // 5) * 10 + s_suppkey % 10 AS INT) AS s_city, CAST((c_nationkey % 5) * 50 + (c_nationkey // 5) * 10 + c_custkey % 10 AS INT) AS c_city,
    c_mktsegment AS segment, o_orderpriority AS priority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
"""


def view(spark: SparkSession, sf_dir: str, conditions: str) -> DataFrame:
    """(row_id, ...) of the facts with the dimensions that the conditions speak about."""
    rows = facts(spark, sf_dir, more=(codes.day_of(F.col("l_shipdate").cast("date")).alias("ship"),))
    if any(w in conditions for w in ("brand", "category", "size")):
        own = parts(spark, sf_dir).select("p_key", "brand", codes.category_of(F.col("brand")).alias("category"))
        rows = rows.join(own, F.col("l_partkey") == F.col("p_key")).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p_again"), F.col("p_size").alias("size")), F.col("p_key") == F.col("p_again"))
    if "s_city" in conditions:
        rows = rows.join(suppliers(spark, sf_dir), F.col("l_suppkey") == F.col("s_key"))
    if any(w in conditions for w in ("day", "priority", "c_city", "segment")):
        dated = orders(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o_again"), F.col("o_orderpriority").alias("priority")), F.col("o_orderkey") == F.col("o_again"))
        if "c_city" in conditions or "segment" in conditions:
            who = customers(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c_again"), F.col("c_mktsegment").alias("segment")), F.col("c_key") == F.col("c_again"))
            dated = dated.join(who, F.col("o_custkey") == F.col("c_key"))
        rows = rows.join(dated, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows


def listed(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    """Words of all lists (bitmap 0, 1, ...) in one pass."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]))
    return wah.flat(rows.select("row_id", F.explode(named).alias("bitmap")))


def stored(words: DataFrame, n_rows: int) -> DataFrame:
    """The words after a turn as codes, fills of ones where the lists have long ones."""
    runs = wah.runs(words, n_rows)
    return wah.decoded(wah.encoded(runs))


def rows_of(words: DataFrame, rows: DataFrame) -> DataFrame:
    """(l_orderkey, l_linenumber) of the numbered rows whose bits are set."""
    return rows.join(wah.positions(words).select("row_id"), "row_id", "left_semi").select("l_orderkey", "l_linenumber")


def case(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(l_orderkey, l_linenumber) of the rows that a case selects."""
    groups = CASES[name]
    flat = [c for g in groups for c in g]
    marks = [F.expr(c).alias(f"m{i}") for i, c in enumerate(flat)]
    rows = numbered(view(spark, sf_dir, " ".join(flat)).select("l_orderkey", "l_linenumber", *marks))
    words = written(stored(listed(rows, [F.col(f"m{i}") for i in range(len(flat))]), rows.count()), "words")
    number = iter(range(len(flat)))
    united = []
    for group in groups:
        own = [words.where(F.col("bitmap") == next(number)) for _ in group]
        united.append(reduce(lambda a, b: wah.combined(a, b, "or"), own))
    return rows_of(reduce(lambda a, b: wah.combined(a, b, "and"), united), rows)


def case_sql(name: str) -> str:
    return f"{VIEW_SQL} SELECT l_orderkey, l_linenumber FROM view WHERE " + " AND ".join("(" + " OR ".join(f"({c})" for c in g) + ")" for g in CASES[name])


def shares(skew: float, lists: int = LISTS) -> list[float]:
    """The finite Zipf distribution over so many ranks."""
    weights = [k**-skew for k in range(1, lists + 1)]
    return [w / sum(weights) for w in weights]


def bounds(skew: float) -> list[int]:
    """List i has the rows whose residue for it is below its bound."""
    return [round(p * PRIME) for p in shares(skew)[:SHOWN]]


def skewed(spark: SparkSession, sf_dir: str, skew: float, united: bool) -> DataFrame:
    """(i, j, k, rows, digest) for every three of the first lists: i and (j or k), or i and j and k. The digest is the sum of
    words times their numbers, both modulo 65521."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("row_id"))
    r, last = F.col("row_id"), rows.agg(F.max("row_id")).first()[0] or 0
    words = stored(listed(rows, [(r * r + r * (i * FACTORS[0]) + i * FACTORS[1]) % PRIME < b for i, b in enumerate(bounds(skew))]), last)
    wide = words.groupBy("word_no").agg(*[F.coalesce(F.max(F.when(F.col("bitmap") == i, F.col("word"))), F.lit(0)).alias(f"w{i}") for i in range(SHOWN)])
    each = []
    for i, j, k in combinations(range(SHOWN), 3):
        x, y, z = (F.col(f"w{n}") for n in (i, j, k))
        each.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), x.bitwiseAND(y.bitwiseOR(z) if united else y.bitwiseAND(z)).alias("word")))
    found = wide.select("word_no", F.explode(F.array(*each)).alias("c")).select("word_no", "c.*").groupBy("i", "j", "k")
    digest = F.sum((F.col("word") % 65521) * (F.col("word_no") % 65521))
    return found.agg(F.sum(F.bit_count("word")).cast("bigint").alias("rows"), digest.cast("bigint").alias("digest"))


def skewed_sql(skew: float, united: bool) -> str:
    member = [f"(r * r + r * {i * FACTORS[0]} + {i * FACTORS[1]}) % {PRIME} < {b}" for i, b in enumerate(bounds(skew))]
    mark = ", ".join(f"{m} AS m{i}" for i, m in enumerate(member))
    each = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {k} AS k, (r - 1) // 31 AS w, sum(CASE WHEN m{i} AND (m{j} {'OR' if united else 'AND'} m{k}) THEN 1::BIGINT << (30 - CAST((r - 1) % 31 AS INT)) ELSE 0 END)::BIGINT AS word FROM marked GROUP BY 4"
        for i, j, k in combinations(range(SHOWN), 3)
    )
    return f"""WITH keyed AS (SELECT o_orderkey + 1 AS r FROM orders), marked AS (SELECT r, {mark} FROM keyed), words AS ({each})
SELECT i, j, k, CAST(sum(bit_count(word)) AS BIGINT) AS rows, CAST(sum((word % 65521) * (w % 65521)) AS BIGINT) AS digest FROM words GROUP BY ALL"""
