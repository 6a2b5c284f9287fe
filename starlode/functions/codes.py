"""Codes and labels of the star schema: days, cities, brands, fixed-point money and their roll-ups."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day 0. The driver tables cover 1995 to 2001 where the benchmark's literals mean 1992 to 1998.
FIRST_DAY = datetime.date(1995, 1, 1)
YEARS = 7


def day(date: datetime.date) -> int:
    return (date - FIRST_DAY).days


def day_of(date: Column) -> Column:
    return F.date_diff(date, F.lit(FIRST_DAY))


def year_starts() -> list[int]:
    """Day numbers at which the years begin, and the end of the last one."""
    return [day(datetime.date(FIRST_DAY.year + i, 1, 1)) for i in range(YEARS + 1)]


def year_of_day(days: Column) -> Column:
    """The year of a day number, by date arithmetic instead of a ladder of comparisons."""
    return F.year(F.date_add(F.lit(FIRST_DAY), days))


def whole(value: Column, factor: int = 1) -> Column:
    """A decimal number as whole multiples of 1/factor (also clears negative zeros)."""
    return F.round(value * factor).cast("bigint")


def div(value: Column, by: int) -> Column:
    """Whole-number division towards zero; both sides stay whole numbers."""
    return F.call_function("div", value, F.lit(by))


def discounted(price: Column, percent: Column) -> Column:
    return div(price * (F.lit(100) - percent), 100)


def city_code(nation_key: Column, key: Column) -> Column:
    """0 to 249: region * 50 + nation in the region * 10 + last digit."""
    return ((nation_key % 5) * 50 + div(nation_key, 5) * 10 + key % 10).cast("int")


def nation_of(city: Column) -> Column:
    return div(city, 10).cast("int")


def region_of(city: Column) -> Column:
    return div(city, 50).cast("int")


def city_label(nation_name: Column, city: Column) -> Column:
    """Nine letters of the nation, blanks behind shorter names, and the city's digit."""
    return F.concat(F.rpad(F.substring(nation_name, 1, 9), 9, " "), (city % 10).cast("string"))


def brand_code(brand: Column, part_key: Column) -> Column:
    """0 to 999 from ``Brand#1`` to ``Brand#25`` (a category of 40 brands each) and the part's key."""
    return ((F.substring(brand, 7, 2).cast("int") - 1) * 40 + part_key % 40).cast("int")


def category_of(brand: Column) -> Column:
    return div(brand, 40).cast("int")


def manufacturer_of(brand: Column) -> Column:
    return div(brand, 200).cast("int")


def category_label(brand: Column) -> Column:
    """MFGR#mc: manufacturer 1 to 5, category 1 to 5."""
    return F.concat(F.lit("MFGR#"), (manufacturer_of(brand) + 1).cast("string"), (category_of(brand) % 5 + 1).cast("string"))


def brand_label(brand: Column) -> Column:
    """The category and the number 1 to 40 in it, two digits."""
    return F.concat(category_label(brand), F.lpad((brand % 40 + 1).cast("string"), 2, "0"))


def linear(a: Column, b: Column, x: float = 2.0, y: float = 3.0) -> Column:
    return a * x + b * y


def sigmoid(a: Column, b: Column, x: float = 2.0, y: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-(a * x + b * y)))


def compact_date(date: Column) -> Column:
    """A date as the number yyyymmdd."""
    return F.date_format(date, "yyyyMMdd").cast("int")
