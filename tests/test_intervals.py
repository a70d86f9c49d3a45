"""Overlaps, containment and coverage against plain comparisons, and a key with very many rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import consent, intervals

SCHEMA = "k int, i int, start date, end date"


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def some(seed, n, width):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.choice([rng.randrange(200), rng.randrange(-40000, 40000)])
        rows.append((rng.randrange(3), i, day(a), day(a + rng.choice([0, rng.randrange(width), rng.randrange(30000)]))))
    return [*rows, (0, n, None, day(3)), (0, n + 1, day(3), None), (1, n + 2, day(9), day(2)), (None, n + 3, day(0), day(9)), (2, n + 4, dt.date(1, 1, 1), dt.date(9999, 12, 30)), rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_comparisons(spark, seed):
    a, b = some(seed, 60, 20), some(seed + 10, 60, 40)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    ok = lambda r: r[0] is not None and r[2] and r[3] and r[2] <= r[3]
    meet = lambda x, y: ok(x) and ok(y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]
    got = intervals.intersect(left, right.withColumnRenamed("i", "j"), ["k"]).collect()
    assert sorted((r["k"], r["i"], r["j"], r["start"], r["end"]) for r in got) == sorted((x[0], x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if meet(x, y))
    inside = lambda x: any(ok(x) and ok(y) and x[0] == y[0] and y[2] <= x[2] and x[3] <= y[3] for y in b)
    assert sorted(r["i"] for r in intervals.contained(left, right, ["k"]).collect()) == sorted(x[1] for x in a if inside(x))
    assert sorted(map(tuple, intervals.overlapping(left, right, ["k"]).collect())) == sorted({(x[0], x[2], x[3]) for x in a if any(meet(x, y) for y in b)})
    around = lambda x: min((y[2] for y in b if ok(y) and x[0] == y[0] and y[2] < x[2] <= y[3]), default=None)
    expected = {(x[0], x[2], around(x)) for x in a if x[0] is not None and x[2] and around(x)}
    assert {tuple(r) for r in intervals.earliest_around(left.select("k", "start"), right, ["k"]).collect()} == expected


def test_a_person_with_very_many_intervals(spark):
    """A hundred thousand on either side of one person: pairs follow the overlaps, not the product."""
    n = 100_000
    rows = lambda shift: spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i" if shift else "j"), F.date_add(F.lit(dt.date(1900, 1, 1)), (F.col("id") % 40000 + shift).cast("int")).alias("start")).withColumn("end", F.date_add("start", 1))
    got = intervals.intersect(rows(1), rows(0), ["k"])
    per_day = [n // 40000 + (d < n % 40000) for d in range(40000)]
    at = lambda d: per_day[d] if 0 <= d < 40000 else 0
    assert got.count() == sum(at(d) * (at(d) + at(d + 1) + at(d + 2)) for d in range(40000))
    inside = intervals.contained(rows(1).select("k", "i", "start", "end"), rows(0).select("k", "start", "end"), ["k"])
    assert inside.count() == sum(at(d) for d in range(39999))
    left = intervals.subtract(rows(1).select("k", "start", "end").limit(1000), rows(0).select("k", "start", "end"), ["k"])
    assert left.count() == 0


def test_any_period_of_a_record(spark):
    p = "struct<start: date, end: date>"
    rows = [(1, "Observation", "a", [(day(1), day(2)), (day(50), day(60))]), (1, "Observation", "b", [(day(1), day(20))]), (1, "Organization", "c", None), (2, "Observation", "d", [(day(1), day(2))])]
    resources = spark.createDataFrame(rows, f"patient_id int, resource_type string, id string, periods array<{p}>")
    windows = spark.createDataFrame([(1, day(0), day(10))], "patient_id int, start date, end date")
    assert sorted(r["id"] for r in consent.consented_by_type(resources, windows).collect()) == ["a", "c"]
