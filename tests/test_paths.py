"""Element paths against a walk over the records, and what is no path."""

import json

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import paths
from cohortlake.operators import redact

CODING = "array<struct<system: string, code: string, userSelected: boolean>>"
KIND = f"""struct<id: string, status: string, code: struct<coding: {CODING}, text: string>, valueQuantity: struct<value: double, unit: string>, valueString: string,
 subject: struct<reference: string>, component: array<struct<code: struct<coding: {CODING}>, valueQuantity: struct<value: double>, valueString: string, member: array<struct<reference: string>>>>>"""
CODE = lambda *cs: {"coding": [dict(zip(("system", "code", "userSelected"), c, strict=False)) for c in cs]}
RECORDS = [
    {"id": "1", "status": "final", "code": CODE(("loinc", "a", True), ("sct", "b")), "valueQuantity": {"value": 1.5, "unit": "mg"}, "component": [
        {"code": CODE(("loinc", "x")), "valueQuantity": {"value": 2.0}, "member": [{"reference": "Patient/1"}, {"reference": "Device/2"}]}, {"code": CODE(("sct", "y"), ("loinc", "z'")), "valueString": "s"}]},
    {"id": "2", "code": {"text": "only text"}, "valueString": "v", "subject": {"reference": "Patient/1"}, "component": []},
    {"id": "3", "code": CODE(("sct", "b", False)), "component": [{"member": []}, {"code": {"coding": []}}]},
    {"id": "4"},
]
CASES = {
    "Observation.status": [["final"], [], [], []],
    "code.coding.code": [["a", "b"], [], ["b"], []],
    "Observation.code.coding.where(system = 'loinc').code": [["a"], [], [], []],
    "code.coding.where(system = 'sct' and code = 'b').system": [["sct"], [], ["sct"], []],
    "code.coding.where($this.system = 'sct' or userSelected = true).code": [["a", "b"], [], ["b"], []],
    "code.coding.where((system = 'loinc' or system = 'sct') and userSelected.exists()).code": [["a"], [], ["b"], []],
    "value": [['{"value":1.5,"unit":"mg"}'], ["v"], [], []],
    "value.ofType(Quantity).value": [["1.5"], [], [], []],
    "value.ofType(string)": [[], ["v"], [], []],
    "component.code.coding.code": [["x", "y", "z'"], [], [], []],
    "component.where(code.coding.system = 'sct').value.ofType(string)": [["s"], [], [], []],
    "component.where(value.ofType(Quantity)).code.coding.code": [["x"], [], [], []],
    r"component.code.coding.where(code = 'z\'').system": [["loinc"], [], [], []],
    "component.where(valueQuantity.value = 2.0).member.reference": [["Patient/1", "Device/2"], [], [], []],
    "component.where(member.resolve().conformsTo('p/device')).code.coding.system": [["loinc"], [], [], []],
    "subject.where(resolve().conformsTo('p/device')).reference": [[], [], [], []],
    "subject.where($this.resolve().conformsTo('p/patient')).reference": [[], ["Patient/1"], [], []],
    "nothing.here": [[], [], [], []],
}


@pytest.fixture(scope="module")
def records(spark):
    rows = spark.createDataFrame([(r["id"], json.dumps(r), {"Patient/1": ["p/patient"], "Device/2": ["p/x", "p/device"]}) for r in RECORDS], "id string, body string, conforms map<string, array<string>>")
    return rows.withColumn("body", F.from_json("body", KIND)).coalesce(1).cache()


def test_values(records):
    kind = records.schema["body"].dataType
    got = records.orderBy("id").select(*(paths.values(p, F.col("body"), kind, F.col("conforms")).alias(str(i)) for i, p in enumerate(CASES))).collect()
    for i, (path, expected) in enumerate(CASES.items()):
        assert [r[str(i)] for r in got] == expected, path
    has = records.orderBy("id").select(*(paths.has_value(p, F.col("body"), kind, F.col("conforms")).alias(str(i)) for i, p in enumerate(CASES))).collect()
    for i, (path, expected) in enumerate(CASES.items()):
        assert [r[str(i)] for r in has] == [bool(x) for x in expected], path


@pytest.mark.parametrize("text", ["", "a.", "a.where(", "a.where(b = )", "a.first()", "a b", "a.where(b = 'x'))", "a.where(and)", "a..b", "a.ofType('x')", "a ~ b"])
def test_no_path(text):
    with pytest.raises(ValueError):
        paths.parse(text)


E = redact.Element
PROFILE = redact.Profile("p", [
    E("O.code.coding", "O.code.coding", discriminators=(("PATTERN", "$this"),)), E("O.code.coding:l", "O.code.coding", "l", pattern='{"system": "l\'x", "userSelected": true}'),
    E("O.component", "O.component", discriminators=(("VALUE", "code.text"), ("EXISTS", "note"), ("TYPE", "value"))), E("O.component:c", "O.component", "c"),
    E("O.component:c.code.text", "O.component.code.text", pattern='"t"'), E("O.component:c.value[x]", "O.component.value[x]", types=("Quantity", "string")),
    E("O.extension", "O.extension", discriminators=(("VALUE", "url"),)), E("O.extension:e", "O.extension", "e", types=("Extension",), type_profiles=("u/e",)),
    E("O.member", "O.member", discriminators=(("PROFILE", "resolve()"),)), E("O.member:m", "O.member", "m", types=("Reference",), target_profiles=("p/a", "p/b")),
    E("O.component:c.code.coding", "O.component.code.coding", discriminators=(("PATTERN", "system"),)), E("O.component:c.code.coding:s", "O.component.code.coding", "s"), E("O.component:c.code.coding:s.system", "O.component.code.coding.system", pattern='"sys"'),
])


@pytest.mark.parametrize(("element_id", "path"), [
    ("O.status", "O.status"), ("O.value[x]", "O.value"), ("O.value[x]:valueQuantity.unit", "O.value.ofType(Quantity).unit"),
    ("O.code.coding:l.code", r"O.code.coding.where($this.system = 'l\'x' and $this.userSelected = 'true').code"),
    ("O.component:c.value[x]", "O.component.where(code.text = 't' and note.exists() and (value.ofType(Quantity) or value.ofType(string))).value"),
    ("O.extension:e.value[x]", "O.extension.where(url = 'u/e').value"),
    ("O.member:m", "O.member.where((resolve().conformsTo('p/a') or resolve().conformsTo('p/b')))"),
    ("O.component:c.code.coding:s.code", "O.component.where(code.text = 't' and note.exists() and (value.ofType(Quantity) or value.ofType(string))).code.coding.where(system = 'sys').code"),
])
def test_paths_of_element_ids(element_id, path):
    assert redact.path_of(element_id, PROFILE) == path
    paths.parse(path)


def test_unknown_slice():
    with pytest.raises(ValueError, match="O.code.coding:zzz"):
        redact.path_of("O.code.coding:zzz.code", PROFILE)
