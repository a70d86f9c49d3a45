"""Copying and redaction of nested records, compiled from profile elements."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators import redact
from cohortlake.operators.redact import Element, Profile, Selection

CODING = "array<struct<system:string,code:string,display:string>>"
KIND = f"""resourceType string, id string, meta struct<profile:array<string>>, status string, code struct<coding:{CODING},text:string>,
subject struct<reference:string>, encounter struct<reference:string,display:string>, valueQuantity struct<value:double,unit:string>, valueString string,
component array<struct<code:struct<coding:{CODING}>,valueString:string>>, identifier array<struct<system:string,value:string>>,
extension array<struct<url:string,valueString:string,extension:array<struct<url:string,valueString:string>>>>, note array<struct<text:string>>"""
MARK = {"url": redact.ABSENT_URL, "valueCode": "masked"}
STUB = {"extension": [MARK]}

BASE = [
    Element("Observation", "Observation"),
    Element("Observation.status", "Observation.status", min=1, types=("code",)),
    Element("Observation.code", "Observation.code", min=1, types=("CodeableConcept",)),
    Element("Observation.code.coding", "Observation.code.coding", min=1, types=("Coding",), discriminators=(("PATTERN", "$this"),)),
    Element("Observation.code.coding:loinc", "Observation.code.coding", "loinc", min=1, types=("Coding",), pattern='{"system": "loinc"}'),
    Element("Observation.code.coding:sct", "Observation.code.coding", "sct", types=("Coding",), pattern='{"system": "sct"}'),
    Element("Observation.code.coding:sct.display", "Observation.code.coding.display", min=1, types=("string",)),
    Element("Observation.subject", "Observation.subject", min=1, types=("Reference",)),
    Element("Observation.encounter", "Observation.encounter", types=("Reference",)),
    Element("Observation.value[x]", "Observation.value[x]", types=("Quantity", "string")),
    Element("Observation.extension", "Observation.extension", types=("Extension",), discriminators=(("VALUE", "url"),)),
    Element("Observation.extension:kept", "Observation.extension", "kept", types=("Extension",), type_profiles=("u/kept",)),
]
ONE = Profile("p/one", BASE)
NEEDY = Profile("p/two", [
    Element("Observation", "Observation"),
    Element("Observation.value[x]", "Observation.value[x]", min=1, types=("Quantity", "string")),
    Element("Observation.component", "Observation.component", min=1, types=("BackboneElement",)),
    Element("Observation.component.code", "Observation.component.code", min=1, types=("CodeableConcept",)),
])
ALL = ("Observation.id", "Observation.meta", "Observation.status", "Observation.code", "Observation.subject", "Observation.encounter", "Observation.value[x]", "Observation.extension", "Observation.component")


def run(spark, body, selections, refs=None):
    rows = spark.createDataFrame([(json.dumps(body), sorted(s.group_id for s in selections), refs or {})], "body string, groups array<string>, refs map<string,array<string>>")
    kind = T._parse_datatype_string(KIND)
    out = redact.copy_and_redact(rows.withColumn("body", F.from_json("body", kind)), "Observation", kind, selections).first()
    return json.loads(out["body"]), out["complete"]


def body(**more):
    return {"id": "o", "meta": {"profile": ["p/one|1.0", "p/other"]}, "status": "final", "code": {"coding": [{"system": "loinc", "code": "1"}]}, "subject": {"reference": "Patient/1"}, **more}


REFS = {"Observation.subject": ["Patient/1"]}


def one(spark, b, refs=REFS, ids=ALL):
    return run(spark, b, [Selection("g", ONE, ids)], refs)


def test_whole_record_is_kept(spark):
    out, complete = one(spark, body(valueQuantity={"value": 1.5, "unit": "mg"}))
    assert complete and out == {**body(valueQuantity={"value": 1.5, "unit": "mg"}), "meta": {"profile": ["p/one"]}}


def test_only_selected_elements(spark):
    b = body(note=[{"text": "private"}], valueString="x", code={"coding": [{"system": "loinc", "code": "1", "display": "d"}], "text": "t"})
    out, _ = one(spark, b, ids=("Observation.id", "Observation.status", "Observation.code.coding.system", "Observation.code.coding.code", "Observation.subject"))
    assert out == {"id": "o", "meta": {"profile": ["p/one"]}, "status": "final", "code": {"coding": [{"system": "loinc", "code": "1"}]}, "subject": {"reference": "Patient/1"}}


def test_slice_conditions_in_copy(spark):
    b = body(code={"coding": [{"system": "loinc", "code": "1"}, {"system": "sct", "code": "2", "display": "d"}, {"system": "x", "code": "3"}]})
    take = lambda *ids: one(spark, b, ids=("Observation.id", "Observation.status", "Observation.subject", *ids))[0]["code"]["coding"]
    assert take("Observation.code.coding:loinc") == [{"system": "loinc", "code": "1"}]
    assert take("Observation.code.coding:loinc.system", "Observation.code.coding:sct") == [{"system": "loinc"}, {"system": "sct", "code": "2", "display": "d"}]
    whole = take("Observation.code.coding", "Observation.code.coding:loinc.system")  # selected whole; what matches no slice is emptied
    assert whole == [{"system": "loinc", "code": "1"}, {"system": "sct", "code": "2", "display": "d"}, STUB]


def test_half_open_slicing_masks_what_matches_no_slice(spark):
    out, _ = one(spark, body(code={"coding": [{"system": "other", "code": "9", "display": "secret"}]}))
    assert out["code"] == {"coding": [STUB]}


def test_missing_required_slice_beside_a_matched_one(spark):
    out, _ = one(spark, body(code={"coding": [{"system": "sct", "code": "2"}]}))
    assert out["code"]["coding"] == [{"system": "sct", "code": "2", "_display": STUB}, STUB]


def test_required_but_missing(spark):
    b = body()
    del b["status"], b["code"], b["subject"]
    out, _ = one(spark, b)
    assert out["_status"] == STUB and out["code"] == STUB and out["subject"] == STUB and "status" not in out


def test_references(spark):
    out, _ = one(spark, body(encounter={"reference": "Encounter/7", "display": "shown"}), refs={**REFS, "Observation.enc": ["Encounter/7"]})
    assert out["encounter"] == {"_reference": STUB, "display": "shown"}  # a name that merely begins alike allows nothing
    out, _ = one(spark, body(encounter={"reference": "Encounter/7"}), refs={**REFS, "Observation.encounter": ["Encounter/7"]})
    assert out["encounter"] == {"reference": "Encounter/7"}
    assert one(spark, body(), refs={})[0]["subject"] == {"_reference": STUB}


def test_extensions(spark):
    e = [{"url": "u/kept", "valueString": "a"}, {"url": "u/gone", "valueString": "b"}, {"url": redact.ABSENT_URLS[1], "valueString": "c"}, {"url": "u/kept"}]
    out, _ = one(spark, body(extension=e))
    assert [x["url"] for x in out["extension"]] == ["u/kept", redact.ABSENT_URLS[1]]
    out, _ = one(spark, body(extension=[{"url": "u/kept", "extension": [{"url": "inner", "valueString": "x"}]}]))
    assert out["extension"] == [{"url": "u/kept", "extension": [{"url": "inner", "valueString": "x"}]}]
    assert "extension" not in one(spark, body(extension=[{"url": "u/gone", "valueString": "b"}]))[0]


def test_several_profiles(spark):
    both = [Selection("g", ONE, ALL), Selection("h", NEEDY, ("Observation.value[x]", "Observation.component"))]
    out, complete = run(spark, body(), both, REFS)
    assert not complete  # p/two is not claimed
    assert out["valueQuantity"] == STUB
    assert out["component"] == [{"extension": [MARK], "code": STUB}]
    claimed = body(meta={"profile": ["p/one", "p/two", "p/x"]}, valueString="there", component=[{"valueString": "v"}])
    out, complete = run(spark, claimed, both, REFS)
    assert complete and out["meta"] == {"profile": ["p/one", "p/two"]}
    assert out["valueString"] == "there" and "valueQuantity" not in out
    assert out["component"] == [{"code": STUB, "valueString": "v"}]


def test_copy_trees():
    assert redact.copy_tree(["A.b", "A.b.c", "A.b:s.d"]) == {"b": {None: {}}}
    assert redact.copy_tree(["A.b:s.d", "A.b.c"]) == {"b": {None: {"c": {None: {}}}, "s": {"d": {None: {}}}}}
    assert redact._united([{"b": {"s": {}}}, {"b": {None: {}}}]) == {"b": {None: {}}}
    assert redact._united([{"b": {None: {"x": {None: {}}}}}, {"b": {None: {"y": {None: {}}}}}]) == {"b": {None: {"x": {None: {}}, "y": {None: {}}}}}


@pytest.mark.parametrize(("pattern", "kept"), [('{"coding": [{"system": "s"}, {"system": "zzz"}]}', True), ('{"coding": [{"system": "s", "code": "2"}]}', False), ('{"coding": [{"system": "t", "code": "2"}]}', True), ('{"text": "x"}', False)])
def test_patterns(spark, pattern, kept):
    kind = T._parse_datatype_string("struct<coding:array<struct<system:string,code:string>>,text:string>")
    df = spark.createDataFrame([("""{"coding":[{"system":"s","code":"1"},{"system":"t","code":"2"}]}""",)], "v string").withColumn("v", F.from_json("v", kind))
    assert df.select(redact.holds_pattern(F.col("v"), kind, json.loads(pattern))).first()[0] is kept


KINDS = Profile("p/kinds", [
    Element("Observation", "Observation"),
    Element("Observation.component", "Observation.component", discriminators=(("TYPE", "value"),)),
    Element("Observation.component:number", "Observation.component", "number"), Element("Observation.component:number.value[x]", "Observation.component.value[x]", types=("Quantity",)),
    Element("Observation.component:text", "Observation.component", "text"), Element("Observation.component:text.value[x]", "Observation.component.value[x]", types=("string",)),
    Element("Observation.note", "Observation.note", discriminators=(("EXISTS", "author"),)), Element("Observation.note:signed", "Observation.note", "signed"),
    Element("Observation.member", "Observation.member", types=("Reference",), discriminators=(("PROFILE", "resolve()"),)), Element("Observation.member:device", "Observation.member", "device", types=("Reference",), target_profiles=("p/device",)),
    Element("Observation.value[x]", "Observation.value[x]", types=("Quantity", "Period"), discriminators=(("TYPE", "$this"),)), Element("Observation.value[x]:amount", "Observation.value[x]", "amount", types=("Quantity",)),
])
KINDS_TYPE = "struct<id: string, component: array<struct<valueQuantity: struct<value: double>, valueString: string, name: string>>, note: array<struct<text: string, author: string>>, member: array<struct<reference: string>>, valueQuantity: struct<value: double>, valuePeriod: struct<start: string>>"


def kinds(spark, b, ids, conforms=None, refs=None):
    kind = T._parse_datatype_string(KINDS_TYPE)
    rows = spark.createDataFrame([(json.dumps(b), ["g"], refs or {}, conforms or {})], "body string, groups array<string>, refs map<string,array<string>>, conforms map<string,array<string>>")
    out = redact.copy_and_redact(rows.withColumn("body", F.from_json("body", kind)), "Observation", kind, [Selection("g", KINDS, ids)])
    assert out.columns == ["body", "groups", "complete"]
    return json.loads(out.first()["body"])


def test_slices_of_all_kinds_in_copying(spark):
    b = {"id": "o", "component": [{"valueQuantity": {"value": 1.0}, "name": "a"}, {"valueString": "s", "name": "b"}, {"name": "c"}], "note": [{"text": "x", "author": "me"}, {"text": "y"}], "member": [{"reference": "Device/1"}, {"reference": "Patient/2"}, {"reference": "Device/3"}]}
    assert kinds(spark, b, ("Observation.component:number",))["component"] == [{"valueQuantity": {"value": 1.0}, "name": "a"}]
    assert kinds(spark, b, ("Observation.component:text.value[x]", "Observation.component:number"))["component"] == [{"valueQuantity": {"value": 1.0}, "name": "a"}, {"valueString": "s"}]
    assert kinds(spark, b, ("Observation.note:signed.author", "Observation.id"))["id"] == "o"
    devices = {"Device/1": ["p/x", "p/device"], "Patient/2": ["p/patient"]}
    refs = {"Observation.member": ["Device/1", "Patient/2", "Device/3"]}
    # redaction knows neither EXISTS nor PROFILE: values of such slices are emptied there, but only those of the slice were copied
    assert len(kinds(spark, b, ("Observation.note:signed",))["note"]) == 1
    assert len(kinds(spark, b, ("Observation.member:device",), devices, refs)["member"]) == 1
    assert "member" not in kinds(spark, b, ("Observation.member:device",), None, refs)


def test_slices_by_type_in_redaction(spark):
    b = {"component": [{"valueQuantity": {"value": 1.0}, "name": "a"}, {"name": "none"}], "valuePeriod": {"start": "2020"}}
    out = kinds(spark, b, ("Observation.component", "Observation.value[x]"))
    assert out["component"] == [{"valueQuantity": {"value": 1.0}, "name": "a"}, {}] and out["valuePeriod"] == {}
    assert kinds(spark, {"valueQuantity": {"value": 2.0}}, ("Observation.value[x]",))["valueQuantity"] == {"value": 2.0}


def slice_profile(name, n, shift):
    at = "Observation.code.coding"
    rows = [Element("Observation", "Observation"), Element(at, at, types=("Coding",), discriminators=(("PATTERN", "$this"),))]
    for k in range(n):
        rows.append(Element(f"{at}:s{k}", at, f"s{k}", types=("Coding",), pattern=json.dumps({"system": f"s{k + shift}"})))
        rows.append(Element(f"{at}:s{k}.display", f"{at}.display", min=k % 2, types=("string",)))
    return Profile(name, rows)


def test_many_slices_in_several_profiles(spark):
    """Three profiles of eight slices each: every value under the contexts of its slices, and a plan that grows in proportion."""
    ids = ("Observation.id", "Observation.meta", "Observation.code")
    selections = [Selection(f"g{k}", slice_profile(f"p/{k}", 8, 3 * k), ids) for k in range(3)]
    codings = [{"system": f"s{k}", "code": str(k)} for k in range(16)]
    out, _ = run(spark, {"id": "o", "code": {"coding": codings}}, selections)
    for k, value in enumerate(out["code"]["coding"]):
        slices = [k - 3 * p for p in range(3) if 0 <= k - 3 * p < 8]
        expected = {} if not slices else {**codings[k], **({"_display": STUB} if any(s % 2 for s in slices) else {})}
        assert value == expected, k

    def size(n, profiles):
        kind = T._parse_datatype_string(KIND)
        context = [(slice_profile(f"p/{k}", n, k), "Observation", None) for k in range(profiles)]
        column = redact._children(F.from_json(F.lit("{}"), kind), kind, context, F.create_map().cast("map<string,array<string>>"))
        return len(spark.range(1).select(column.alias("x"))._jdf.queryExecution().analyzed().toString())

    small, large = size(4, 1), size(8, 3)
    assert large < 10 * small  # six times the slices
