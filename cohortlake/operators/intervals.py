"""Interval algebra on frames of closed day intervals: columns `start`, `end` and the keys given.

Overlaps are found without comparing all intervals of a key. Time is cut into blocks of 1, 8, 64, ... days. An interval is a
union of few such blocks, and a day lies in one of each size, so an equality join on key and block gives every pair (day,
interval around it) once; two intervals overlap if one starts in the other. Work follows the rows and the pairs that there are,
and a key with very many rows is dealt out by its blocks. Where only the existence of such an interval matters, rows of a key are
swept in order of time, by spans of four years that a hot key is dealt out by. What intervals are compared with as a whole (cut out, met
at all) is merged and goes with its key as one ascending list, no longer than the calendar, so every row moves once. Intervals with a
missing end, or reversed, overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import lookup

WHOLE = "start IS NOT NULL AND end IS NOT NULL AND start <= end"


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Joins intervals of a key that overlap or touch (the next one starts no later than the day after); those without both ends, or reversed, are left out."""
    df = df.where(WHOLE)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > F.date_add(reach, 1)), 1).otherwise(0)
    islands = df.select(*keys, "start", "end").withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


#: Sizes of blocks: 8 ** 0 to 8 ** 5 days; longer intervals take several of the largest.
_SIZES = 6


def _day(c: str) -> Column:
    return F.date_diff(F.col(c), F.lit("0001-01-01").cast("date")).cast("long")


def _numbered(size: int, at: Column) -> Column:
    return F.lit(size << 32).cast("long") + at


def _blocks_of_day(c: str) -> Column:
    """The block of each size that a day lies in."""
    return F.array(*(_numbered(k, F.shiftright(_day(c), 3 * k)) for k in range(_SIZES)))


def _blocks_between(start: str, end: str) -> Column:
    """The fewest blocks that make up an interval."""
    first = [F.shiftright(_day(start) + (8**k - 1), 3 * k) for k in range(_SIZES)]
    last = [F.shiftright(_day(end) + 1, 3 * k) for k in range(_SIZES)]
    none = F.array().cast("array<bigint>")

    def between(k: int, low: Column, high: Column) -> Column:
        return F.when(low < high, F.transform(F.sequence(low, high - 1), lambda i: _numbered(k, i))).otherwise(none)

    parts = []
    for k in range(_SIZES):
        if k == _SIZES - 1:
            parts.append(between(k, first[k], last[k]))
            continue
        larger = first[k + 1] < last[k + 1]
        parts.append(between(k, first[k], F.when(larger, 8 * first[k + 1]).otherwise(last[k])))
        parts.append(F.when(larger, between(k, 8 * last[k + 1], last[k])).otherwise(none))
    return F.concat(*parts)


def pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of left with all rows of right of the same key that overlap them; right's interval is called __s, __e.

    Rows of left meet, once for each block, rows of right: a start in the other's interval.
    """
    tagged = lambda blocks, tag: F.transform(blocks, lambda b: b * 2 + tag)
    here = left.where(WHOLE).withColumn("__block", F.explode(F.concat(tagged(_blocks_of_day("start"), 0), tagged(_blocks_between("start", "end"), 1))))
    other = right.where(WHOLE).withColumnsRenamed({"start": "__s", "end": "__e"})
    other = other.withColumn("__block", F.explode(F.concat(tagged(_blocks_between("__s", "__e"), 0), tagged(_blocks_of_day("__s"), 1))))
    # the second tag is for those that start later than the row of left; those that start on its day have met it already
    later = other.withColumn("__later", F.col("__block") % 2 == 1).withColumnsRenamed({k: f"__r{n}" for n, k in enumerate([*keys, "__block"])})
    same = [here[k] == later[f"__r{n}"] for n, k in enumerate([*keys, "__block"])]
    return here.join(later, [*same, ~later["__later"] | (here["start"] < later["__s"])]).drop("__block", "__later", *(f"__r{n}" for n in range(len(keys) + 1)))


def intersect(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise overlaps of two frames by key; other columns of both are kept."""
    return pairs(left, right, keys).withColumns({"start": F.greatest("start", "__s"), "end": F.least("end", "__e")}).drop("__s", "__e")


def _span(c: str) -> Column:
    """Four years of time; all before 1900 and all after 2100 are one span each."""
    return F.floor(F.greatest(F.lit(1899), F.least(F.lit(2101), F.year(c))) / 4)


def _swept(points: DataFrame, spans: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """points (with __at) and intervals (start, end as __s, __e) of all spans that they touch, in one frame, and what to partition it by."""
    wide = spans.where(WHOLE).select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), F.explode(F.sequence(_span("start"), _span("end"))).alias("__span"))
    both = points.withColumn("__span", _span("__at")).unionByName(wide, allowMissingColumns=True)
    return both.dropna(subset=keys), [*keys, "__span"]


def contained(df: DataFrame, spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows of df whose whole interval lies in one interval (start, end) of spans of the same key: of those that start no later, the one that ends last reaches their end."""
    both, by = _swept(df.withColumn("__at", F.col(start)), spans, keys)
    reach = F.max("__e").over(Window.partitionBy(*by).orderBy(F.coalesce("__s", "__at"), F.col("__s").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__reach", reach).where(F.col("__s").isNull() & (F.col(start) <= F.col(end)) & (F.col(end) <= F.col("__reach"))).select(*df.columns)


def _with_merged(df: DataFrame, spans: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Whole rows of df with the merged intervals of spans of their key: ascending lists of starts and ends (__s, __e)."""
    lists = merge(spans, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("c"))
    return df.where(WHOLE).join(lists.select(*keys, F.col("c.start").alias("__s"), F.col("c.end").alias("__e")).hint("merge"), keys, how)


def _met_of_lists() -> Column:
    """Of the lists of _with_merged the intervals (start, end) that a row meets; those of long lists are found by halving."""
    every = F.arrays_zip(F.col("__s").alias("start"), F.col("__e").alias("end"))
    few = F.filter(every, lambda c: (c["end"] >= F.col("start")) & (c["start"] <= F.col("end")))
    low, high = lookup.place(F.col("__e"), F.col("start")), lookup.place(F.col("__s"), F.date_add("end", 1))
    part = lambda c: F.slice(F.col(c), low + 1, F.greatest(high - low, F.lit(0)))
    many = F.arrays_zip(part("__s").alias("start"), part("__e").alias("end"))
    return F.when(F.size("__s") <= lookup.SHORT, few).otherwise(many)


def overlapping(df: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct (keys, start, end) of df that overlap some interval of spans."""
    held = _with_merged(df.select(*keys, "start", "end"), spans, keys, "inner")
    return held.where(F.size(_met_of_lists()) > 0).select(*keys, "start", "end").distinct()


def earliest_around(days: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """days (keys, start) with __to: the earliest start of an interval of spans that starts before that day and has not ended by then.

    Intervals inside an earlier one say nothing new; of the others, which end in the order in which they start, it is the
    first to end on the day or later, if it starts before.
    """
    order = Window.partitionBy(*keys, "__span").orderBy("__s", F.desc("__e"))
    both, by = _swept(days.select(*keys, "start").distinct().withColumn("__at", F.col("start")), spans, keys)
    seen = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = both.withColumn("__seen", seen).where("__s IS NULL OR __seen IS NULL OR __e > __seen")
    following = F.first(F.col("__s"), ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.coalesce("__e", "__at"), F.col("__s").isNotNull()).rowsBetween(0, Window.unboundedFollowing))
    return told.withColumn("__to", following).where("__s IS NULL AND __to < __at").select(*keys, "start", "__to")


def subtract(df: DataFrame, minus: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of each interval of df outside the intervals of minus; other columns of df are kept.

    The removed intervals are merged first, so those that meet one interval are sorted and apart; what remains lies between them.
    Neither side moves more than once, and a row stays one until it is cut.
    """
    names = [c for c in df.columns if c not in ("start", "end", *keys)]
    none = F.array().cast("array<struct<start: date, end: date>>")
    cut = _with_merged(df, minus, keys, "left").withColumn("cuts", F.coalesce(F.when(F.col("__s").isNotNull(), _met_of_lists()), none))
    starts = F.concat(F.array("start"), F.transform("cuts", lambda c: F.date_add(c["end"], 1)))
    ends = F.concat(F.transform("cuts", lambda c: F.date_sub(c["start"], 1)), F.array("end"))
    pieces = cut.select(*keys, *names, F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("p"))
    return pieces.select(*keys, *names, F.col("p.s").alias("start"), F.col("p.e").alias("end")).where("start <= end")


def intersect_all(df: DataFrame, keys: list[str], member: str, n: int) -> DataFrame:
    """Days on which all n values of `member` are covered, as merged intervals: a sweep over starts and ends."""
    apart = merge(df, [*keys, member])
    events = apart.select(*keys, F.col("start").alias("day"), F.lit(1).alias("d")).union(apart.select(*keys, F.date_add("end", 1), F.lit(-1)))
    order = Window.partitionBy(*keys).orderBy("day")
    swept = events.groupBy(*keys, "day").agg(F.sum("d").alias("d")).withColumns({"open": F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("day").over(order)})
    return merge(swept.where(F.col("open") == n).select(*keys, F.col("day").alias("start"), F.date_sub("next", 1).alias("end")), keys)
