"""Value sets with trees, imports and exclusions, codings outside them, and elements with too many values."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators import bindings
from cohortlake.operators.redact import Element, Profile
from cohortlake.sources import readers

SETS = [
    {"resourceType": "ValueSet", "url": "v/tree", "compose": {"include": [{"system": "s", "filter": [{"property": "concept", "op": "is-a", "value": "a"}]}], "exclude": [{"system": "s", "concept": [{"code": "ab"}]}]}},
    {"resourceType": "ValueSet", "url": "v/all", "compose": {"include": [{"system": "t"}, {"valueSet": ["v/tree|2"]}, {"valueSet": ["v/loop"]}], "exclude": [{"system": "t", "concept": [{"code": "no"}]}]}},
    {"resourceType": "ValueSet", "url": "v/loop", "compose": {"include": [{"valueSet": ["v/all"]}]}},
    {"resourceType": "ValueSet", "url": "v/told", "expansion": {"contains": [{"system": "s", "code": "x"}]}},
]
EDGES = [("s", "a", "aa"), ("s", "a", "ab"), ("s", "ab", "aba"), ("s", "aa", "a")]


def held(spark, tmp_path):
    for n, v in enumerate(SETS):
        (tmp_path / f"{n}.json").write_text(json.dumps(v))
    return bindings.members(readers.value_sets(spark, str(tmp_path)), spark.createDataFrame(EDGES, "system string, parent string, child string"))


def test_members_of_value_sets(spark, tmp_path):
    have, _ = held(spark, tmp_path)
    got = {tuple(r) for r in have.collect()}
    tree = {("s", "a"), ("s", "aa"), ("s", "aba")}
    assert got == {("v/told", "s", "x"), *(("v/tree", *c) for c in tree), *((v, *c) for v in ("v/all", "v/loop") for c in tree | {("t", None)})}


def test_codings_outside_go_and_nulls_stay_apart(spark, tmp_path, monkeypatch):
    have, out = held(spark, tmp_path)
    c = lambda s, k: (s, k)
    rows = [
        (1, "v/all", [c("t", "any"), c("s", "ab"), c("s", "aba"), c("t", "no"), c("t", "any")], "kept"), (2, "v/loop", [c("t", "no"), c("t", "yes")], None), (3, None, [c("q", "q")], None), (4, "v/tree", None, None),
        (5, "v/tree", [], None), (6, "v/tree", [c(None, "a"), c("s", None), None], None), (7, "v/none", [c("s", "a")], None),
    ]
    df = spark.createDataFrame(rows, "id int, vs string, coding array<struct<system: string, code: string>>, __at string")
    wanted = {1: [("t", "any"), ("s", "aba"), ("t", "any")], 2: [("t", "yes")], 3: [("q", "q")], 4: None, 5: [], 6: [], 7: []}
    for most in (bindings.MOST_SENT, 0):  # verdicts sent to all tasks, or joined by shuffle
        monkeypatch.setattr(bindings, "MOST_SENT", most)
        got = bindings.bound_codings(df, ["id"], "coding", F.col("vs"), have, out)
        assert got.columns == df.columns
        assert {r["id"]: r["coding"] and [tuple(x) for x in r["coding"]] if r["coding"] is not None else None for r in got.collect()} == wanted
    assert bindings.bound_codings(df.limit(0), ["id"], "coding", F.col("vs"), have, out).count() == 0


def test_elements_with_too_many_values(spark):
    kind = T._parse_datatype_string("status string, value struct<x: int>, valueInteger int, valueString string, part array<struct<code: array<string>, kind: string>>")
    e = Element
    profile = Profile("p", [
        e("O", "O", max="*"), e("O.status", "O.status", max="0"), e("O.value[x]", "O.value[x]", max="1"), e("O.part", "O.part", max="2", discriminators=(("VALUE", "kind"),)), e("O.part.code", "O.part.code", max="1"),
        e("O.part:k", "O.part", "k", max="1"), e("O.part:k.kind", "O.part.kind", pattern='"k"'),
    ])
    part = lambda codes, k=None: {"code": codes, "kind": k}
    cases = [
        ({}, []), ({"status": "s"}, ["O.status"]), ({"valueInteger": 1}, []), ({"valueInteger": 1, "valueString": "x"}, ["O.value[x]"]), ({"part": [part(["a"]), part(["b"])]}, []),
        ({"part": [part(["a", "b"]), part([])]}, ["O.part.code"]), ({"part": [part(None, "k"), part(None, "k")]}, ["O.part:k"]), ({"part": [part(None)] * 3}, ["O.part"]), ({"part": []}, []),
    ]
    df = spark.createDataFrame([(n, json.dumps(b)) for n, (b, _) in enumerate(cases)], "n int, body string").withColumn("b", F.from_json("body", kind))
    assert [r[0] for r in df.orderBy("n").select(bindings.over_max(F.col("b"), kind, profile)).collect()] == [w for _, w in cases]
