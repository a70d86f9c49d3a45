"""A small extraction from end to end."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators import redact
from cohortlake.plans import extract as plan

DAY = dt.date(2020, 1, 1)
SCHEMA = "resource_type string, id string, patient_id int, profiles array<string>, codes array<struct<system: string, code: string>>, period_start date, period_end date, body string"


def test_extract(spark):
    row = lambda t, i, p, code="k", profile="u": (t, i, p, [profile], [("s", code)], DAY, DAY, f"{t}/{i}")
    resources = spark.createDataFrame([row("Patient", "1", 1), row("Patient", "2", 2), row("Patient", "3", 3), row("Condition", "c1", 1), row("Condition", "c2", 2), row("Condition", "c3", 3, "other"), row("Medication", "m1", None), row("Medication", "m2", None, "bad"), row("Medication", "m3", None)], SCHEMA)
    refs = spark.createDataFrame(
        [(1, "Condition", "c1", "cond", "Condition.drug", True, "med", "Medication", "m1"), (2, "Condition", "c2", "cond", "Condition.drug", True, "med", "Medication", "m2")],
        "patient_id int, src_type string, src_id string, group_id string, attribute_ref string, must_have boolean, linked_group string, dst_type string, dst_id string",
    )
    groups = [plan.Group("pat", "Patient"), plan.Group("cond", "Condition", "u", [("s", "k")], must_have=[("Condition.code", F.size("codes") > 0)]), plan.Group("med", "Medication", "u", [("s", "k")], reference_only=True)]
    cohort = resources.where("resource_type = 'Patient'").select("patient_id")
    windows = spark.createDataFrame([(p, DAY, DAY) for p in (1, 2, 3)], "patient_id int, start date, end date")
    out = plan.extract(cohort, resources, refs, groups, windows)
    assert [r[0] for r in out.people.collect()] == [1]
    assert {(r["type"], r["id"]) for r in out.groups.collect()} == {("Patient", "1"), ("Condition", "c1"), ("Medication", "m1")}
    assert {(r["patient_id"], r["stage"]) for r in out.patient_exclusions.collect()} == {(2, "CASCADING_DELETE"), (3, "DIRECT_LOAD")}
    assert {r["id"] for r in out.resources.collect()} == {"1", "c1", "m1"}
    assert plan.summary(out, cohort).first()["balanced"]


def small(spark):
    row = lambda t, i, p: (t, i, p, ["u"], [("s", "k")], DAY, DAY, f"{t}/{i}")
    resources = spark.createDataFrame([row("Patient", "1", 1), row("Patient", "2", 2), row("Condition", "c1", 1), row("Medication", "m1", None)], SCHEMA)
    refs = spark.createDataFrame([], "patient_id int, src_type string, src_id string, group_id string, attribute_ref string, must_have boolean, linked_group string, dst_type string, dst_id string")
    return resources.where("resource_type = 'Patient'").select("patient_id"), resources, refs


def test_required_group_without_rows_keeps_nobody(spark):
    groups = [plan.Group("pat", "Patient"), plan.Group("obs", "Observation", must_have=[("Observation.code", F.size("codes") > 0)])]
    cohort, resources, refs = small(spark)
    out = plan.extract(cohort, resources, refs, groups)
    assert out.people.count() == 0
    assert {(r["patient_id"], r["stage"]) for r in out.patient_exclusions.collect()} == {(1, "DIRECT_LOAD"), (2, "DIRECT_LOAD")}


def test_required_core_group_must_be_fulfilled(spark):
    cohort, resources, refs = small(spark)
    core = lambda present: [plan.Group("pat", "Patient"), plan.Group("med", "Medication", must_have=[("Medication.code", present)])]
    assert {r["patient_id"] for r in plan.extract(cohort, resources, refs, core(F.size("codes") > 0)).people.collect()} == {1, 2}
    with pytest.raises(ValueError, match="med"):
        plan.extract(cohort, resources, refs, core(F.size("codes") > 5))


REF = "patient_id int, src_type string, src_id string, group_id string, attribute_ref string, must_have boolean, linked_group string, dst_type string, dst_id string"


def events(out):
    return {(r["reason"], r["group_id"], r["attribute_ref"], r["resource_id"], r["patient_id"]) for r in out.resource_exclusions.collect()}


def linked(spark, refs, **more):
    """Two people with a condition each, encounters of either, a medication; conditions refer as told."""
    row = lambda t, i, p, day=DAY: (t, i, p, ["u"], [("s", "k")], day, day, f"{t}/{i}")
    rows = [row("Patient", "1", 1), row("Patient", "2", 2), row("Condition", "c1", 1), row("Condition", "c2", 2), row("Encounter", "e1", 1), row("Encounter", "e2", 2), row("Medication", "m1", None)]
    resources = spark.createDataFrame(rows, SCHEMA)
    groups = [plan.Group("pat", "Patient"), plan.Group("cond", "Condition", **more), plan.Group("enc", "Encounter", reference_only=True), plan.Group("med", "Medication", reference_only=True)]
    return plan.extract(resources.where("resource_type = 'Patient'").select("patient_id"), resources, spark.createDataFrame(refs, REF), groups)


def test_required_reference_to_another_patients_record(spark):
    refs = [(1, "Condition", "c1", "cond", "Condition.encounter", True, "enc", "Encounter", "e2"), (2, "Condition", "c2", "cond", "Condition.encounter", True, "enc", "Encounter", "e2")]
    out = linked(spark, refs)
    assert {(r["type"], r["id"]) for r in out.groups.collect()} == {("Patient", "2"), ("Condition", "c2"), ("Encounter", "e2")}
    assert {(r["patient_id"], r["stage"]) for r in out.patient_exclusions.collect()} == {(1, "CASCADING_DELETE")}  # the condition was required
    assert events(out) == {("RESOURCE_OUTSIDE_BATCH", "enc", "Condition.encounter", "Encounter/e2", 1), ("MUST_HAVE", "cond", "Condition.encounter", "Condition/c1", 1)}
    assert {(r["id"], r["child"]) for r in out.links.collect()} == {("c2", "Encounter/e2")}


def test_core_record_must_not_refer_to_a_patients(spark):
    refs = [(1, "Condition", "c1", "cond", "Condition.drug", True, "med", "Medication", "m1"), (None, "Medication", "m1", "med", "Medication.encounter", True, "enc", "Encounter", "e1")]
    out = linked(spark, refs)
    assert {r["id"] for r in out.groups.collect()} == {"2", "c2"}
    assert events(out) == {("RESOURCE_OUTSIDE_BATCH", "enc", "Medication.encounter", "Encounter/e1", None), ("MUST_HAVE", "med", "Medication.encounter", "Medication/m1", None), ("CASCADING_DELETE", "cond", None, "Condition/c1", 1)}


def test_missing_target_and_attribute_without_any_reference(spark):
    refs = [(1, "Condition", "c1", "cond", "Condition.encounter", False, "enc", "Encounter", "nowhere")]
    out = linked(spark, refs, required_refs=["Condition.encounter"])
    assert {r["id"] for r in out.groups.collect()} == {"1", "c1"}
    assert {(r["patient_id"], r["stage"]) for r in out.patient_exclusions.collect()} == {(2, "DIRECT_LOAD")}
    assert events(out) == {("REFERENCE_NOT_FOUND", "enc", "Condition.encounter", "Encounter/nowhere", 1), ("MUST_HAVE", "cond", "Condition.encounter", "Condition/c2", 2)}


def test_consent_by_type_and_its_events(spark):
    late = dt.date(2021, 1, 1)
    row = lambda t, i, p, day=DAY: (t, i, p, ["u"], [("s", "k")], day, day, f"{t}/{i}")
    rows = [row("Patient", "1", 1, None), row("Patient", "2", 2, None), row("Condition", "c1", 1), row("Condition", "c2", 1, late), row("QuestionnaireResponse", "q1", 1, None), row("QuestionnaireResponse", "q2", 2, None), row("Appointment", "a1", 1), row("Encounter", "e1", 1, late)]
    resources = spark.createDataFrame(rows, SCHEMA)
    groups = [plan.Group("pat", "Patient"), plan.Group("cond", "Condition"), plan.Group("quest", "QuestionnaireResponse"), plan.Group("app", "Appointment"), plan.Group("enc", "Encounter", reference_only=True)]
    refs = spark.createDataFrame([(1, "Condition", "c1", "cond", "Condition.encounter", False, "enc", "Encounter", "e1")], REF)
    out = plan.extract(resources.where("resource_type = 'Patient'").select("patient_id"), resources, refs, groups, spark.createDataFrame([(1, DAY, DAY)], "patient_id int, start date, end date"))
    assert {r["id"] for r in out.groups.collect()} == {"1", "c1", "q1"}
    assert events(out) == {("CONSENT", "cond", None, "Condition/c2", 1), ("CONSENT", "app", None, "Appointment/a1", 1), ("CONSENT", "enc", "Condition.encounter", "Encounter/e1", 1)}
    assert {(r["patient_id"], r["stage"]) for r in out.patient_exclusions.collect()} == {(2, "CONSENT_FETCH")}
    counted = plan.job_summary(out, resources.where("resource_type = 'Patient'").select("patient_id")).first()
    assert counted["Patient-Exclusions"] == {"CONSENT_FETCH": 1, "DIRECT_LOAD": 0, "CASCADING_DELETE": 0} and counted["Resource-Exclusions"]["cond"]["CONSENT"] == 1
    # what was observed in passing is what a count of the frames finds
    assert out.counts["lost"] == counted["Patient-Exclusions"] and out.counts["people"] == counted["Num-Final-Patients"]
    assert {g: n for g, n in out.counts["included"].items() if n} == counted["Resource-Inclusions"]
    by_reason = {(g, r): n for g, row in counted["Resource-Exclusions"].items() for r, n in row.asDict().items() if r != "mustHave"}
    assert {k: n for k, n in out.counts["excluded"].items() if n} == {k: n for k, n in by_reason.items() if n}


def test_bodies_are_cut_and_redacted(spark):
    body = lambda i, enc: json.dumps({"resourceType": "Condition", "id": i, "meta": {"profile": ["u"]}, "subject": {"reference": "Patient/1"}, "encounter": {"reference": f"Encounter/{enc}"}, "note": "private"})
    rows = [("Patient", "1", 1, ["v"], [], DAY, DAY, '{"id":"1","name":"x","gender":"y"}'), ("Condition", "c1", 1, ["u"], [], DAY, DAY, body("c1", "e1")), ("Condition", "c2", 1, ["u"], [], DAY, DAY, body("c2", "e9")), ("Encounter", "e1", 1, ["w"], [], DAY, DAY, '{"id":"e1","meta":{"profile":["w"]}}')]
    resources = spark.createDataFrame(rows, SCHEMA)
    refs = spark.createDataFrame([(1, "Condition", i, "cond", "Condition.encounter", False, "enc", "Encounter", e) for i, e in (("c1", "e1"), ("c2", "e9"))], REF)
    shape = lambda text: T._parse_datatype_string(f"struct<{text}>")
    meta = "id:string,meta:struct<profile:array<string>>"
    shapes = {"Patient": shape(f"{meta},name:string,gender:string"), "Condition": shape(f"resourceType:string,{meta},subject:struct<reference:string>,encounter:struct<reference:string>,note:string"), "Encounter": shape(meta)}
    e = redact.Element
    profiles = {"v": redact.Profile("v", [e("Patient", "Patient")]), "u": redact.Profile("u", [e("Condition", "Condition"), e("Condition.subject", "Condition.subject", min=1, types=("Reference",)), e("Condition.encounter", "Condition.encounter", types=("Reference",))]), "w": redact.Profile("w", [e("Encounter", "Encounter")])}
    groups = [plan.Group("pat", "Patient", "v", attributes=["Patient.gender"]), plan.Group("cond", "Condition", "u", attributes=["Condition.encounter"]), plan.Group("enc", "Encounter", "w", reference_only=True)]
    out = plan.extract(resources.where("resource_type = 'Patient'").select("patient_id"), resources, refs, groups, shapes=shapes, profiles=profiles)
    found = {r["id"]: json.loads(r["body"]) for r in out.resources.collect()}
    mark = {"extension": [{"url": redact.ABSENT_URL, "valueCode": "masked"}]}
    condition = {"resourceType": "Condition", "meta": {"profile": ["u"]}, "subject": {"reference": "Patient/1"}}
    assert found == {
        "1": {"id": "1", "meta": {"profile": ["v"]}, "gender": "y"}, "e1": {"id": "e1", "meta": {"profile": ["w"]}},
        "c1": {**condition, "id": "c1", "encounter": {"reference": "Encounter/e1"}}, "c2": {**condition, "id": "c2", "encounter": {"_reference": mark}},
    }
    with pytest.raises(ValueError, match="Encounter"):
        plan.extract(resources.where("resource_type = 'Patient'").select("patient_id"), resources, refs, groups, shapes={k: v for k, v in shapes.items() if k != "Encounter"}, profiles=profiles)


def test_required_core_reference(spark):
    """A core group that is required by its reference only: without a target the extraction fails."""
    row = lambda t, i, p: (t, i, p, ["u"], [("s", "k")], DAY, DAY, f"{t}/{i}")
    resources = spark.createDataFrame([row("Patient", "1", 1), row("Medication", "m1", None), row("Substance", "s1", None)], SCHEMA)
    groups = [plan.Group("pat", "Patient"), plan.Group("med", "Medication"), plan.Group("sub", "Substance", reference_only=True)]
    refs = lambda target: spark.createDataFrame([(None, "Medication", "m1", "med", "Medication.ingredient", True, "sub", "Substance", target)], REF)
    cohort = resources.where("resource_type = 'Patient'").select("patient_id")
    assert {r["id"] for r in plan.extract(cohort, resources, refs("s1"), groups).groups.collect()} == {"1", "m1", "s1"}
    with pytest.raises(ValueError, match="med"):
        plan.extract(cohort, resources, refs("none"), groups)


def test_copies_and_descendants(spark):
    """Of copies one counts, the same one always; a filter's code stands for those below it."""
    rows = [("Patient", "1", 1, ["u"], [], DAY, DAY, "p"), ("Condition", "c1", 1, ["u"], [("s", "leaf")], DAY, DAY, "b"), ("Condition", "c1", 1, ["u"], [("s", "other")], DAY, DAY, "a"), ("Condition", "c2", 1, ["u"], [("s", "leaf")], DAY, DAY, "x"), ("Condition", "c2", 1, ["u"], [("s", "leaf")], DAY, DAY, "x"), ("Condition", "c1", 2, ["u"], [("s", "leaf")], DAY, DAY, "z")]
    resources = spark.createDataFrame(rows, SCHEMA)
    groups = [plan.Group("pat", "Patient"), plan.Group("cond", "Condition", codes=[("s", "top")])]
    tree = spark.createDataFrame([("s", "top", "mid"), ("s", "mid", "leaf"), ("t", "top", "other")], "system string, parent string, child string")
    cohort = resources.where("resource_type = 'Patient'").select("patient_id")
    ids = lambda **more: sorted(r["id"] for r in plan.extract(cohort, resources, spark.createDataFrame([], REF), groups, **more).groups.collect())
    assert ids() == ["1"] and ids(code_tree=tree) == ["1", "c2"]
    assert ids(code_tree=tree, copy_order=[F.desc("body")]) == ["1", "c1", "c2"]


def test_must_have_by_path(spark):
    body = lambda i, **more: json.dumps({"id": i, "code": {"coding": [{"system": "loinc", "code": "1"}]}, **more})
    rows = [("Patient", "1", 1, ["v"], [], DAY, DAY, "{}"), ("Patient", "2", 2, ["v"], [], DAY, DAY, "{}"), *(("Observation", i, p, ["u"], [], DAY, DAY, b) for i, p, b in (
        ("o1", 1, body("o1", valueQuantity={"value": 1.0})), ("o2", 2, body("o2", valueString="x")), ("o3", 1, body("o3", code={"coding": [{"system": "sct", "code": "1"}]}, valueQuantity={"value": 1.0}))))]
    resources = spark.createDataFrame(rows, SCHEMA)
    shapes = {"Observation": T._parse_datatype_string("struct<id: string, code: struct<coding: array<struct<system: string, code: string>>>, valueQuantity: struct<value: double>, valueString: string>")}
    e = redact.Element
    profile = redact.Profile("u", [e("Observation.code.coding", "Observation.code.coding", discriminators=(("PATTERN", "$this"),)), e("Observation.code.coding:loinc", "Observation.code.coding", "loinc", pattern='{"system": "loinc"}')])
    must = ["Observation.code.coding:loinc.code", ("Observation.value[x]", "value.ofType(Quantity)")]
    groups = [plan.Group("pat", "Patient"), plan.Group("obs", "Observation", "u", must_have=must)]
    cohort = resources.where("resource_type = 'Patient'").select("patient_id")
    extract = lambda **more: plan.extract(cohort, resources, spark.createDataFrame([], REF), groups, **more)
    with pytest.raises(ValueError, match="shape"):
        extract()
    loaded = plan._loaded(resources, groups, shapes, {"u": profile}, {}).where("type = 'Observation'").collect()
    assert {(r["id"], r["valid"], r["attribute_ref"]) for r in loaded} == {("o1", True, None), ("o2", False, "Observation.value[x]"), ("o3", False, "Observation.code.coding:loinc.code")}
