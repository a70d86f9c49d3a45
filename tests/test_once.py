"""What an extraction works out once: bodies, consent windows, references that lead further."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators import resolve
from cohortlake.plans import extract, lineage, request

DAY = dt.date(2020, 1, 1)
REF = "patient_id int, src_type string, src_id string, group_id string, attribute_ref string, must_have boolean, linked_group string, dst_type string, dst_id string"
STORE = "resource_type string, id string, patient_id int, profiles array<string>, codes array<struct<system: string, code: string>>, period_start date, period_end date, body string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Names and plans of all frames that are written."""
    plans = []
    for module in (extract, resolve):
        monkeypatch.setattr(module, "cut", lambda df, name: (plans.append((name, optimized(df))), lineage.cut(df, name))[1])
    return plans


def test_bodies_are_parsed_once_for_references(spark):
    kind = T._parse_datatype_string("id string, item array<struct<reference: string>>")
    body = '{"id":"1","item":[{"reference":"Medication/m1"},{"reference":"Medication/a/b"},{"reference":"Patient/p"},{"reference":"http://x/Medication/m2"}]}'
    store = spark.createDataFrame([("Encounter", "1", 1, body), ("Encounter", "2", 1, "{}"), ("Encounter", "3", 2, None)], "resource_type string, id string, patient_id int, body string")
    out = request.references(store, [request.Link("enc", "Encounter", "Encounter.item", "item", False, "med", "Medication")], {"Encounter": kind})
    assert optimized(out).count("from_json") == 1
    assert [(r["src_id"], r["dst_type"], r["dst_id"]) for r in out.collect()] == [("1", "Medication", "m1")]


def test_windows_and_bodies_are_worked_out_once(spark, written):
    row = lambda t, i, p: (t, i, p, ["u"], [("s", "k")], DAY, DAY, '{"code":"x"}')
    resources = spark.createDataFrame([row("Condition", "c1", 1), row("Condition", "c2", 2), row("Condition", "c9", 9), row("Medication", "m1", None), row("Medication", "m2", None)], STORE)
    told = lambda p, kind, i, group, to: (p, kind, i, group, "a", False, "med", "Medication", to)
    refs = spark.createDataFrame([told(1, "Condition", "c1", "cond", "m1"), told(9, "Condition", "c9", "cond", "m2"), told(None, "Medication", "m1", "med", "m2"), told(None, "Condition", "c1", "cond", "m2")], REF)
    groups = [extract.Group("cond", "Condition", "u", must_have=[("Condition.code", F.get_json_object("body", "$.code") == "x")]), extract.Group("med", "Medication", "u", reference_only=True)]
    windows = spark.createDataFrame([(1, DAY, "2020-01-01x"), (9, DAY, "2020-01-01x")], "patient_id int, start date, end string").withColumn("end", F.regexp_extract("end", "(.*)x", 1).cast("date"))
    out = extract.extract(spark.createDataFrame([(1,), (2,)], "patient_id int"), resources, refs, groups, windows)
    assert {(r["type"], r["id"]) for r in out.groups.collect()} == {("Condition", "c1"), ("Medication", "m1"), ("Medication", "m2")}
    assert [name for name, p in written if "regexp_extract" in p] == ["windows"]
    assert [(name, p.count("get_json_object")) for name, p in written if "get_json_object" in p] == [("found", 1)]


def test_what_leads_nowhere_is_not_followed(spark, written):
    seeds = spark.createDataFrame([(1, "Encounter", "e1", "enc"), (1, "Patient", "1", "pat")], "patient_id int, type string, id string, group_id string")
    refs = spark.createDataFrame([(1, "Encounter", "e1", "enc", "a", False, "med", "Medication", "m1")], REF)
    targets = spark.createDataFrame([("Medication", "m1", None, "med", True)], "type string, id string, patient_id int, group_id string, valid boolean")
    assert {(r["type"], r["id"]) for r in resolve.closure(seeds, refs, targets).collect()} == {("Encounter", "e1"), ("Patient", "1"), ("Medication", "m1")}
    assert [name for name, _ in written].count("resolved") == 2
