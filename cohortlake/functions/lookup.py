"""Looking up values in ascending lists and in maps with ascending keys, in steps that grow with the logarithm of their size.

Lists inside a row are otherwise read from their start for each question, which for a record of a million references asks a
million times a million.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists up to this size are read from their start.
SHORT = 16


def place(ordered: Column, x: Column) -> Column:
    """How many values of an ascending list without nulls are less than x, by halving."""

    def halved(s: Column, _: Column) -> Column:
        middle, open_ = F.shiftright(s["low"] + s["high"], 1), s["low"] < s["high"]
        below = F.get(ordered, middle) < x
        return F.struct(F.when(open_ & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + F.lit(1))).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), halved)["low"]


def contains(ordered: Column, x: Column) -> Column:
    """Whether an ascending list holds x; false where either is null."""
    found = F.when(F.size(ordered) <= SHORT, F.array_contains(ordered, x)).otherwise(F.get(ordered, place(ordered, x)) == x)
    return F.coalesce(found, F.lit(False))


def value_of(ordered: Column, x: Column) -> Column:
    """The value of key x in a map whose keys ascend; null without it."""
    keys = F.map_keys(ordered)
    at = place(keys, x)
    return F.when(F.size(ordered) <= SHORT, F.try_element_at(ordered, x)).otherwise(F.when(F.get(keys, at) == x, F.get(F.map_values(ordered), at)))
