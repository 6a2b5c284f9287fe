"""Benchmark queries over a stored bitmap join index: dimension codes are joined to the facts and indexed once, and every
query takes its rows from the bitmaps, checks uncertain ones, and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from starlode.functions.codes import year_starts
from starlode.functions.predicates import Predicate
from starlode.operators import bitmap, words
from starlode.plans.ssb import QUERIES
from starlode.sources.rows import numbered
from starlode.sources.star import nations, star

#: What queries read of a fact: codes of its dimensions, measures, and the columns that predicates are about.
COLUMNS = ("quantity", "discount", "price", "revenue", "lo_supplycost", "year", "day", "brand", "c_city", "s_city")
LAYOUTS = ("sparse", "medium", "dense")


def layout_of(kind: str, where: Predicate) -> bitmap.Layout:
    """sparse, medium, dense (for any query); perfect, many_or, candchk (bins made for this predicate)."""
    recipes = {"perfect": bitmap.exact, "many_or": bitmap.thirds, "candchk": bitmap.widened}
    return recipes[kind](where) if kind in recipes else bitmap.layouts(year_starts())[kind]


@dataclass
class Store:
    """The facts with their codes, placed and in buckets, and the indexes built on them so far."""

    facts: DataFrame
    buckets: int
    indexes: dict[object, words.Index] = field(default_factory=dict)

    def index(self, kind: str, where: Predicate) -> words.Index:
        """The index for a layout. The dense layout has all bins of the others, so that one index serves all three."""
        key: object = LAYOUTS if kind in LAYOUTS else (kind, where)
        if key not in self.indexes:
            self.indexes[key] = words.build(self.facts, layout_of("dense" if kind in LAYOUTS else kind, where), self.buckets)
        return self.indexes[key]


def prepared(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a folder's tables, made once in a session; the tables are taken not to change meanwhile."""
    stores = spark.__dict__.setdefault("_starlode_stores", {})
    if sf_dir not in stores:
        rows = numbered(star(spark, sf_dir).select(*COLUMNS))
        count = rows.count()
        buckets = words.buckets_for(count)
        stores[sf_dir] = Store(words.bucketed(words.placed(rows).drop("row_id"), "facts", buckets), buckets)
    return stores[sf_dir]


def run(spark: SparkSession, sf_dir: str, name: str, kind: str) -> DataFrame:
    """A benchmark query by the index path; the same result as its scan."""
    query, store = QUERIES[name], prepared(spark, sf_dir)
    rows = words.select(store.facts, store.index(kind, query.where), query.where, layout_of(kind, query.where))
    return query.grouped(rows, nations(spark, sf_dir))
