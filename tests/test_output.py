"""What leaves: provenance in chunks, batches that are written once, a store whose records stay where they are, cohorts by masks."""

import json
import random

from pyspark.sql import functions as F

from cohortlake.operators import codes, report, resolve
from cohortlake.plans.lineage import numbered
from cohortlake.sources import sinks


def test_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, "x"]), i) for i in rng.sample(range(1000), 300)]
    got = numbered(spark.createDataFrame(rows, "k string, g string, i int").repartition(7), ["k", "g"], ["i"], "n").collect()
    for key in {r[:2] for r in rows}:
        assert [r["n"] for r in sorted((r for r in got if (r["k"], r["g"]) == key), key=lambda r: r["i"])] == list(range(sum(r[:2] == key for r in rows)))


def test_provenance_of_core_resources_is_cut(spark):
    groups = spark.createDataFrame([(None, "g", "Medication", f"{i:03d}") for i in range(25)] * 2 + [(1, "g", "Condition", "c"), (1, "h", "Condition", "c")], "patient_id int, group_id string, type string, id string")
    lists = report.provenance(groups, 10)
    assert sorted((r["patient_id"] or 0, r["group_id"], r["chunk"], len(r["targets"])) for r in lists.collect()) == [(0, "g", 0, 10), (0, "g", 1, 10), (0, "g", 2, 5), (1, "g", 0, 1), (1, "h", 0, 1)]
    assert [t for r in sorted(lists.where("patient_id IS NULL").collect(), key=lambda r: r["chunk"]) for t in r["targets"]] == [f"Medication/{i:03d}" for i in range(25)]
    ids = lambda df: sorted(r["provenance_id"] for r in df.collect())
    assert ids(lists) == ids(report.provenance(groups.repartition(3), 10)) and len(set(ids(lists))) == 5


def test_batches_are_written_once(spark, tmp_path):
    resources = spark.createDataFrame([(p, "Condition", f"c{p}", json.dumps({"id": f"c{p}"})) for p in range(1, 24)] + [(None, "Medication", "m", "{}")], "patient_id int, resource_type string, id string, body string")
    batches = report.batch_labels(resources.where("patient_id IS NOT NULL"), 5)
    path, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    files = lambda p: {b.name: sorted(x for f in b.glob("*.txt") for x in f.read_text().splitlines()) for b in sorted(p.glob("batch=*"))}
    sinks.write_patient_bundles(resources, whole, batches=batches)
    sinks.write_patient_bundles(resources, path, batches=batches.where("batch < 2"), at_once=1)  # a run that ended early
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").glob("batch=*/*.txt")}
    sinks.write_patient_bundles(resources, path, batches=batches, at_once=2)
    assert files(tmp_path / "out") == files(tmp_path / "whole") and len(files(tmp_path / "out")) == 5
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    events = report.labelled(spark.createDataFrame([(1,), (23,), (None,)], "patient_id int"), batches)
    assert sorted((r["patient_id"] or 0, r["batch"]) for r in events.collect()) == [(0, "core"), (1, "0"), (23, "4")]


def test_completion_moves_keys_only(spark):
    store = spark.createDataFrame([("Medication", f"m{i}", None, "b") for i in range(50)] + [("Medication", "p", 1, "b"), ("Condition", "c", 1, "b")], "resource_type string, id string, patient_id int, body string")
    sinks.write_store(store, "completion_store", 4)
    links = spark.createDataFrame([("Medication/m1",), ("Medication/m1",), ("Medication/m2",), ("http://x/Medication/m3",), ("Medication/p",), ("Condition/c",), ("a/b/c",), (None,)], "child string")
    present = spark.createDataFrame([("Medication", "m2")], "type string, id string")
    got = resolve.completed_core(links, present, spark.table("completion_store").hint("merge"), ["Condition"])
    assert [r["id"] for r in got.collect()] == ["m1"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    left = plan.split("LeftSemi", 1)[1]
    store_side = left[: left.index("FileScan")]
    assert "Exchange" not in store_side
    spark.sql("DROP TABLE completion_store")


def test_cohorts_by_masks(spark):
    rng = random.Random(3)
    people = list(range(40))
    rows = [(rng.choice(people), "s", rng.choice("abcdefgh"), rng.choice([None, 1.0, 5.0, 9.0])) for _ in range(200)]
    records = spark.createDataFrame(rows, "patient_id int, system string, code string, value double")
    c = codes.Criterion
    wide = [c([("s", chr(97 + k % 8))], "ge", float(k)) for k in range(70)]  # more than the bits of one mask

    def met(p, x):
        return any(q == p and ("s", k) in x.codes and (x.comparator is None or v is not None and {"ge": v >= x.value, "lt": v < x.value}[x.comparator]) for q, _, k, v in rows)

    frame = spark.createDataFrame([(p,) for p in [*people, 99]], "patient_id int")
    for include, exclude in ([[[c([("s", "a")]), c([("s", "b")], "lt", 5.0)], [c([("s", "c"), ("s", "d")])]], []], [[[c([("s", "a")])]], [[c([("s", "b")])], [c([("s", "c")])]]], [[], [[c([("s", "a")])]]], [[wide], []], [[wide[60:]], [[x] for x in wide[:2]]], [[[]], []], [[], []], [[], [[]]]):
        expected = [p for p in [*people, 99] if all(any(met(p, x) for x in any_of) for any_of in include) and not (exclude and all(any(met(p, x) for x in any_of) for any_of in exclude))]
        assert sorted(r[0] for r in codes.select_cohort(frame, records, include, exclude).collect()) == expected
    scans = codes.select_cohort(frame, records.where(F.lit(True)), [[c([("s", "a")])], [c([("s", "b")])]])._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("LogicalRDD") == 2  # people and records once each
