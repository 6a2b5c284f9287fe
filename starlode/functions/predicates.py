"""A small predicate algebra that both the scan path (to a Column) and the index path (to bins) understand."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond all codes.
FAR = 1 << 40


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def column(self) -> Column:
        raise NotImplementedError

    def ranges(self) -> Iterator[Range]:
        """The ranges at the leaves, from left to right."""
        raise NotImplementedError


@dataclass(frozen=True)
class Range(Predicate):
    """lo <= name < hi."""

    name: str
    lo: int
    hi: int

    def column(self) -> Column:
        return (F.col(self.name) >= self.lo) & (F.col(self.name) < self.hi)

    def ranges(self) -> Iterator[Range]:
        yield self


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))

    def ranges(self) -> Iterator[Range]:
        for p in self.parts:
            yield from p.ranges()


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts), F.lit(False))

    def ranges(self) -> Iterator[Range]:
        for p in self.parts:
            yield from p.ranges()


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self) -> Column:
        return ~self.part.column()

    def ranges(self) -> Iterator[Range]:
        yield from self.part.ranges()


def all_of(*parts: Predicate) -> Predicate:
    return And(parts)


def any_of(*parts: Predicate) -> Predicate:
    return Or(parts)


@dataclass(frozen=True)
class Compare:
    """One comparison of a scan: eq, lt, gt, le, ge, or bt (both ends exclusive, in either order)."""

    op: str
    value: float
    other: float | None = None

    def on(self, name: str) -> Column:
        c, v = F.col(name), self.value
        if self.op == "bt":
            low, high = sorted((v, self.other))
            return (c > low) & (c < high)
        return {"eq": c == v, "lt": c < v, "gt": c > v, "le": c <= v, "ge": c >= v}[self.op]


    def span(self) -> tuple[int, int]:
        """The whole numbers that can meet the comparison, as a half-open range; an open end is FAR."""
        if self.op == "bt":
            low, high = sorted((self.value, self.other))
            return math.floor(low) + 1, math.ceil(high)
        low = math.ceil(self.value) if self.op in ("eq", "ge") else math.floor(self.value) + 1 if self.op == "gt" else -FAR
        high = math.floor(self.value) + 1 if self.op in ("eq", "le") else math.ceil(self.value) if self.op == "lt" else FAR
        return low, high


def conjunction(conditions: dict[str, Compare]) -> Column:
    return reduce(lambda a, b: a & b, (c.on(name) for name, c in conditions.items()), F.lit(True))


def commands(lines: Iterable[str]) -> Iterator[Compare]:
    """Comparisons from lines such as ``lt 10`` or ``bt 3,7``; blank and unknown lines are skipped, ``exit`` ends."""
    for line in lines:
        words = line.replace(",", " ").split()
        if not words:
            continue
        if words[0] == "exit":
            return
        if words[0] in ("eq", "lt", "gt", "le", "ge") and len(words) == 2:
            yield Compare(words[0], float(words[1]))
        elif words[0] == "bt" and len(words) == 3:
            yield Compare("bt", float(words[1]), float(words[2]))
