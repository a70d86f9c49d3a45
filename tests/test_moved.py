"""What rounds send to the driver, how often rows are copied to be compared, and how wide they are while they move."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import cascade, intervals, resolve
from cohortlake.plans import lineage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of all frames that operators write."""
    plans = []
    for module in (cascade, resolve):
        monkeypatch.setattr(module, "cut", lambda df, name: (plans.append((name, plan(df))), lineage.cut(df, name))[1])
    return plans


def test_unfounded_sends_no_set_that_grows(spark, written, monkeypatch):
    n = 14
    nodes = spark.range(n + 5).selectExpr("id AS node", "id > 0 AS reference_only", "id <> 12 AS valid")
    edges = spark.range(n).selectExpr("id AS parent", "concat('P', id) AS attribute", "id + 1 AS child", "false AS must_have").union(spark.sql("SELECT 16L, 'x', 17L, false UNION ALL SELECT 17L, 'y', 16L, false"))
    for few in (lineage.FEW, 0):
        monkeypatch.setattr(lineage, "FEW", few)
        written.clear()
        assert {r[0] for r in cascade.unfounded(nodes, edges).collect()} == {*range(13, n + 5)}
        # only a frontier of few rows may be broadcast, whatever the sizes on disk
        assert all(p.count("BroadcastHashJoin") <= (1 if few else 0) for _, p in written)


def test_removed_intervals_move_once(spark):
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    rng = random.Random(5)
    a = [(k, i, s := rng.randrange(2000), s + rng.randrange(300)) for i in range(120) for k in (1, 2)]
    b = [(k, s := rng.randrange(2200), s + rng.randrange(9)) for _ in range(90) for k in (1,)] + [(2, 700, 720)]
    left = spark.createDataFrame([(k, i, day(s), day(e)) for k, i, s, e in a], "k int, i int, start date, end date")
    right = spark.createDataFrame([(k, day(s), day(e)) for k, s, e in b], "k int, start date, end date")
    gone = {(k, d) for k, s, e in b for d in range(s, e + 1)}
    out = intervals.subtract(left, right, ["k"])
    got = {}
    for r in out.collect():
        got.setdefault((r["k"], r["i"]), []).extend(range((r["start"] - day(0)).days, (r["end"] - day(0)).days + 1))
    want = {(k, i): [d for d in range(s, e + 1) if (k, d) not in gone] for k, i, s, e in a}
    assert {x: sorted(d) for x, d in got.items()} == {x: d for x, d in want.items() if d}
    met = {(k, s, e) for k, _, s, e in a if any((k, d) in gone for d in range(s, e + 1))}
    over = intervals.overlapping(left, right, ["k"])
    assert {(r["k"], (r["start"] - day(0)).days, (r["end"] - day(0)).days) for r in over.collect()} == met
    # no row is copied but for what is left of it
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized(out).count("Generate explode") == 1 and "Generate explode" not in optimized(over)


def test_names_do_not_move(spark, written):
    refs = spark.range(400).selectExpr("id % 7 AS patient_id", "'Encounter' AS src_type", "id % 50 AS src_id", "'enc' AS group_id", "'Encounter.medication' AS attribute_ref", "id % 3 = 0 AS must_have", "'med' AS linked_group", "'Medication' AS dst_type", "id AS dst_id")
    targets = spark.range(300).selectExpr("'Medication' AS type", "id", "IF(id % 5 = 0, 9L, NULL) AS patient_id", "'med' AS group_id", "id % 4 = 0 AS valid")
    seeds = spark.range(20).selectExpr("id % 7 AS patient_id", "'Encounter' AS type", "id", "'enc' AS group_id")
    got = {tuple(r) for r in resolve.closure(seeds, refs, targets).collect()}
    seen = {(i % 7, i) for i in range(20)}
    assert got == {(p, "Encounter", i, "enc") for p, i in seen} | {(None, "Medication", i, "med") for i in range(300) if i % 4 == 0 and i % 5 and (i % 7, i % 50) in seen}
    steps = next(p for name, p in written if name == "reference-steps")
    keys = " ".join(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", steps))
    assert keys and not re.search("src_type|dst_type|group", keys)
    lost = resolve.unmet(refs, targets)
    assert {tuple(r) for r in lost.collect()} == {tuple(r) for r in resolve.required_references(refs, resolve.usable(refs, targets)).collect()} != set()


def test_unmet_without_names(spark):
    ref = "patient_id long, src_type string, src_id long, group_id string, attribute_ref string, must_have boolean, linked_group string, dst_type string, dst_id long"
    rows = [(1, "E", 1, "e", "a", True, "c", "C", 1), (1, "E", 1, "e", None, True, "c", "C", 1), (1, "E", 2, "e", "a", True, None, "C", 1), (1, "E", None, "e", "a", True, "c", "C", 1), (1, "E", 3, "e", "a", True, "c", "C", 2), (1, "E", 3, "e", "a", False, "c", "C", 1), (1, "E", 4, "e", "a", False, "c", "C", 7)]
    refs = spark.createDataFrame(rows, ref)
    targets = spark.createDataFrame([("C", 1, None, "c", True), ("C", 2, 2, "c", True), ("C", 2, None, "c", False)], "type string, id long, patient_id long, group_id string, valid boolean")
    old = {tuple(r) for r in resolve.required_references(refs, resolve.usable(refs, targets)).collect()}
    assert {tuple(r) for r in resolve.unmet(refs, targets).collect()} == old == {("E", 1, "e"), ("E", 2, "e"), ("E", None, "e")}


def test_support_of_attributes_is_counted_in_one_pass(spark, written):
    nodes = spark.range(9).selectExpr("id AS node", "id > 4 AS reference_only", "id <> 7 AS valid")
    edges = spark.createDataFrame([(0, "a", 5, True), (0, "a", 7, False), (1, "b", 7, True), (2, "b", 7, False), (3, "c", 6, None), (1, "d", 6, False)], "parent long, attribute string, child long, must_have boolean")
    assert {r[0] for r in cascade.cascade(nodes, edges).collect()} == {1, 2}
    support = next(p for name, p in written if name == "attribute-support")
    assert "Join" not in support
