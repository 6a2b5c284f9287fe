"""The synthetic query: (a1 in R1 or a2 in R2) and dim.a1 in R3, counted by a small dimension attribute.

Also the choice of literals: the chance that a Zipf value falls in a window, and the window start for a target selectivity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlode.functions.predicates import Range

TERMS = 50_000
#: Fixed values, the grid of the study: skews, bits of the columns, and the largest share of a column in a window of WIDTH.
SKEWS, COLUMN_BITS, WIDTH, LAST = (1.04, 1.08, 1.12, 1.16, 1.2), (16, 32), 60, 1023
COLUMN_SHARES = (0.04, 0.06, 0.09, 0.12, 0.18, 0.25, 0.39, 0.51, 0.67, 0.82)


def count_query(fact: DataFrame, dim: DataFrame, r1: tuple[int, int], r2: tuple[int, int], r3: tuple[int, int]) -> DataFrame:
    """fact (fk, a1, a2), dim (key, attr1, attr2): (attr2, n). Ranges are half open; a key without a dim row drops out."""
    kept = fact.where(Range("a1", *r1).column() | Range("a2", *r2).column())
    joined = kept.join(dim.where(Range("attr1", *r3).column()), F.col("fk") == F.col("key"))
    return joined.groupBy("attr2").agg(F.count("*").alias("n"))


def zeta(s: float, terms: int = TERMS) -> float:
    """Riemann's zeta for s > 1: the first terms and the integral and half-term that stand for the rest."""
    return sum(k**-s for k in range(1, terms + 1)) + terms ** (1 - s) / (s - 1) - terms**-s / 2


def window_share(s: float, start: int, width: int) -> float:
    """The chance that a Zipf value minus one lies in [start, start + width)."""
    return sum((k + 1) ** -s for k in range(start, start + width)) / zeta(s)


def selectivity(s: float, start: int, width: int) -> float:
    """Of the query with the same window for its three predicates, columns being independent."""
    p = window_share(s, start, width)
    return (1 - (1 - p) ** 2) * p


def window_for(s: float, target: float, width: int = 60, last: int = 1023) -> int:
    """The window start up to ``last`` whose selectivity is nearest to a target; ties take the smaller start."""
    norm, powers = zeta(s), [(k + 1) ** -s for k in range(last + width)]
    best, at, part = None, 0, sum(powers[:width])
    for start in range(last + 1):
        p = part / norm
        gap = abs((1 - (1 - p) ** 2) * p - target)
        if best is None or gap < best:
            best, at = gap, start
        part += (powers[start + width] if start + width < len(powers) else 0) - powers[start]
    return at


def first_window(s: float, most: float, width: int = WIDTH, last: int = LAST) -> int:
    """The first window start whose share of a Zipf column is at most a bound, or the last start."""
    norm, share = zeta(s), 0.0
    weights = [(k + 1) ** -s / norm for k in range(last + width)]
    share = sum(weights[:width])
    for start in range(last):
        if share <= most:
            return start
        share += weights[start + width] - weights[start]
    return last


def grid() -> list[tuple[float, int, float, int]]:
    """(skew, bits, share, window start) of every point."""
    return [(s, bits, share, first_window(s, share)) for s in SKEWS for bits in COLUMN_BITS for share in COLUMN_SHARES]
