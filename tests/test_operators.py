"""Small cases of the extraction operators."""

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlake.functions import references, temporal
from cohortlake.operators import cascade, codes, consent, intervals, load, redact, report, resolve, spec
from cohortlake.sources import readers, sinks

D0 = dt.date(2020, 1, 1)


def d(n):
    return D0 + dt.timedelta(days=n)


def frame(spark, spans):
    return spark.createDataFrame([(k, d(a), d(b)) for k, a, b in spans], "k int, start date, end date")


def got(df):
    return sorted((r["k"], (r["start"] - D0).days, (r["end"] - D0).days) for r in df.collect())


def days(spans):
    return {(k, x) for k, a, b in spans for x in range(a, b + 1)}


spans = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30), st.integers(0, 8)).map(lambda t: (t[0], t[1], t[1] + t[2])), max_size=7)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(spans, spans)
def test_interval_algebra_by_days(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    merged = got(intervals.merge(x, ["k"]))
    assert days(merged) == days(a)
    assert all(p[2] + 1 < q[1] for p, q in zip(merged, merged[1:]) if p[0] == q[0])
    assert days(got(intervals.subtract(intervals.merge(x, ["k"]), y, ["k"]))) == days(a) - days(b)
    assert days(got(intervals.intersect(x, y, ["k"]))) == days(a) & days(b)
    both = x.withColumn("m", F.lit(1)).union(y.withColumn("m", F.lit(2)))
    assert days(got(intervals.intersect_all(both, ["k"], "m", 2))) == days(a) & days(b)


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, "node string, reference_only boolean, valid boolean"), spark.createDataFrame(edges, "parent string, attribute string, child string, must_have boolean")


def test_cascade_chain_and_protected_group(spark):
    n, e = graph(spark, [("a", False, False), ("b", True, True), ("c", True, True), ("p", False, True)], [("a", "a.x", "b", False), ("b", "b.x", "c", False), ("a", "a.x", "p", False)])
    assert {r[0] for r in cascade.cascade(n, e).collect()} == {"b", "c"}


def test_cascade_must_have_goes_up_only_without_remaining_child(spark):
    n, e = graph(spark, [("a", False, True), ("b", True, False), ("c", True, True), ("z", False, True)], [("a", "a.x", "b", True), ("a", "a.x", "c", True), ("z", "z.x", "b", True)])
    assert {r[0] for r in cascade.cascade(n, e).collect()} == {"z"}


def test_attribute_shared_by_parents_lives_with_one(spark):
    n, e = graph(spark, [("a", False, False), ("a2", False, True), ("b", True, True)], [("a", "x", "b", False), ("a2", "x", "b", False)])
    assert cascade.cascade(n, e).count() == 0


def test_unfounded_cycle(spark):
    n, e = graph(spark, [("a", False, True), ("b", True, True), ("c", True, True), ("x", True, True), ("y", True, True)], [("a", "a.r", "b", False), ("b", "b.r", "c", False), ("c", "c.r", "b", False), ("x", "x.r", "y", False), ("y", "y.r", "x", False)])
    assert {r[0] for r in cascade.unfounded(n, e).collect()} == {"x", "y"}


def test_code_tree_with_cycle_and_unknown(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "a"), ("t", "a", "q")], "system string, parent string, child string")
    wanted = spark.createDataFrame([("s", "a"), ("s", "zz")], "system string, code string")
    assert {(r["root"], r["code"]) for r in codes.expand(wanted, edges).collect()} == {("a", "a"), ("a", "b"), ("zz", "zz")}


def test_closure_ends_on_cycles_and_keeps_patients_apart(spark):
    ref = "patient_id long, src_type string, src_id long, group_id string, linked_group string, dst_type string, dst_id long"
    refs = spark.createDataFrame([(1, "E", 1, "e", "c", "C", 1), (1, "C", 1, "c", "e", "E", 1), (1, "E", 1, "e", "c", "C", 2)], ref)
    targets = spark.createDataFrame([("C", 1, 1, "c", True), ("E", 1, 1, "e", True), ("C", 2, 2, "c", True)], "type string, id long, patient_id long, group_id string, valid boolean")
    seeds = spark.createDataFrame([(1, "E", 1, "e")], "patient_id long, type string, id long, group_id string")
    assert {(r["type"], r["id"]) for r in resolve.closure(seeds, refs, targets).collect()} == {("E", 1), ("C", 1)}


def test_references_and_days(spark):
    r = spark.createDataFrame([("Patient/1",), ("http://x/Patient/1",), ("urn:uuid:1",), ("/Patient/1",), ("Patient/ ",), (None,)], "ref string")
    assert [x[0] for x in r.select(references.parse_reference(F.col("ref"))["id"]).collect()] == ["1", None, None, None, None, None]
    t = spark.createDataFrame([("2020-02-03",), ("2020-02-03T23:59:00+02:00",), ("2020-02",), ("x",), (None,)], "t string")
    assert [x[0] for x in t.select(temporal.day(F.col("t"))).collect()] == [dt.date(2020, 2, 3)] * 2 + [None] * 3


def test_consent_denies_spare_extended_permits(spark):
    p = spark.createDataFrame([(1, 1, "A", d(0), d(9), True), (1, 1, "R", d(0), d(9), True), (1, 2, "A", d(4), d(5), False)], "patient_id int, consent_id int, code string, start date, end date, permit boolean")
    w = consent.windows(p, ["A"], {"A": "R"}, d(-5))
    assert [((r["start"] - D0).days, (r["end"] - D0).days) for r in w.collect()] == [(-5, 9)]
    w = consent.windows(p, ["A"])
    assert sorted(((r["start"] - D0).days, (r["end"] - D0).days) for r in w.collect()) == [(0, 3), (6, 9)]


def test_must_have_order_and_core(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None), (3, "x", "y"), (4, None, "y")], "id int, a string, b string")
    state, first = load.must_have(F.col("id") != 4, [("a", F.col("a").isNotNull()), ("b", F.col("b").isNotNull())])
    assert [tuple(r) for r in df.select(state, first).collect()] == [("violated", "a"), ("violated", "b"), ("fulfilled", None), ("not_applicable", None)]
    with pytest.raises(ValueError, match="g2"):
        load.require_core(spark.createDataFrame([("g1", True), ("g2", False)], "group_id string, fulfilled boolean"), ["g1", "g2"])


def test_copy_tree_and_lists(spark):
    assert redact.copy_tree(["R.a", "R.a.b", "R.c.d"]) == {"a": {None: {}}, "c": {None: {"d": {None: {}}}}}
    df = spark.sql("SELECT named_struct('a', 1, 'l', array(named_struct('x', 1, 'y', 2), named_struct('x', null, 'y', 3))) AS b")
    out = redact.copied(F.col("b"), df.schema["b"].dataType, [(None, "R", redact.copy_tree(["R.l.x"]))], [])
    assert df.select(F.to_json(out)).first()[0] == '{"l":[{"x":1}]}'


def test_standard_attributes_and_roles(spark):
    groups = spark.createDataFrame([(1, "p", "u", "Patient", False), (1, "o", "u", "Observation", False), (1, "m", "u", "Medication", True)], "spec_id int, group_id string, profile_url string, type string, reference_only boolean")
    elements = spark.createDataFrame([("u", "Observation.subject"), ("u", "Medication.subject"), ("v", "Observation.patient")], "profile_url string, element_id string")
    none = spark.createDataFrame([], "spec_id int, group_id string, attribute_ref string, must_have boolean, linked_groups array<string>")
    added = {(r["attribute_ref"], tuple(r["linked_groups"])) for r in spec.with_standard_attributes(none, groups, elements).collect()}
    assert ("Observation.subject", ("p",)) in added and ("Patient.id", ()) in added and len(added) == 7  # Medication is core
    roles = {r["group_id"]: r["role"] for r in spec.split_groups(groups, spark.createDataFrame([("Patient",), ("Observation",)], "type string")).collect()}
    assert roles == {"p": "direct_patient", "o": "direct_patient", "m": "reference_only"}


def test_windows_of_a_request(spark):
    rules = spark.createDataFrame([("G", True, None, None), ("A", False, ["R"], d(-5))], "code string, gate boolean, retro_codes array<string>, lookback date")
    rows = [(1, 1, "G", d(0), d(9), True), (1, 1, "A", d(1), d(9), True), (1, 1, "R", d(0), d(9), True), (2, 2, "G", d(0), d(3), True), (2, 2, "A", d(0), d(9), True)]
    p = spark.createDataFrame(rows, "patient_id int, consent_id int, code string, start date, end date, permit boolean")
    ask = lambda *codes: spark.createDataFrame([(c,) for c in codes], "code string")
    spans = lambda w: sorted((r["patient_id"], (r["start"] - D0).days, (r["end"] - D0).days) for r in w.collect())
    assert spans(consent.job_windows(p, rules, ask("G", "A"), d(5))) == [(1, 1, 9)]
    assert spans(consent.job_windows(p, rules, ask("G", "A", "R"), d(5))) == [(1, -5, 9)]
    assert spans(consent.job_windows(p, rules, ask("A", "unknown"), d(5))) == [(1, 1, 9), (2, 0, 9)]
    assert spans(consent.job_windows(p, rules, ask("G"), d(5))) == []
    visits = spark.createDataFrame([(1, d(-2), d(2))], "patient_id int, start date, end date")
    assert spans(consent.job_windows(p, rules, ask("G", "A"), d(5), visits)) == [(1, -2, 9)]


def test_any_of_several_periods_is_enough(spark):
    rows = spark.createDataFrame([("Observation", "a", 1, [(d(0), d(0)), (d(50), d(50))]), ("Observation", "b", 1, [(d(50), d(50))]), ("Observation", "c", 1, []), ("Device", "e", 1, None), ("Device", "f", 2, None), ("Slot", "g", 1, [(d(0), d(0))])], "resource_type string, id string, patient_id int, periods array<struct<start: date, end: date>>")
    windows = spark.createDataFrame([(1, d(-1), d(9))], "patient_id int, start date, end date")
    assert {r["id"] for r in consent.consented_by_type(rows, windows).collect()} == {"a", "e"}


def test_cascade_does_not_depend_on_partitions(spark):
    import random

    rng = random.Random(5)
    names = [f"n{i}" for i in range(60)]
    nodes = [(n, rng.random() < 0.6, rng.random() > 0.1) for n in names]
    edges = [(p := rng.choice(names), f"{rng.choice([p, 'shared'])}.{rng.randrange(2)}", rng.choice(names), rng.random() < 0.3) for _ in range(120)]
    need = {a: any(e[3] for e in edges if e[1] == a) for a in {e[1] for e in edges}}
    edges = [(p, a, c, need[a]) for p, a, c, _ in edges]  # an attribute is required or not as a whole
    dead = {n for n, _, ok in nodes if not ok}
    first = set(dead)
    while True:
        live = [e for e in edges if e[2] not in dead and any(f[0] not in dead for f in edges if f[1] == e[1])]
        held = {e[2] for e in live}
        more = {n for n, only, _ in nodes if only and n in {e[2] for e in edges} and n not in held}
        more |= {e[0] for e in edges if e[3] and e[1] not in {x[1] for x in live}}
        if more <= dead:
            break
        dead |= more
    for parts in (1, 7):
        n, e = graph(spark, nodes, edges)
        assert {r[0] for r in cascade.cascade(n.repartition(parts), e.repartition(parts)).collect()} == dead - first


@pytest.mark.parametrize("values", [[3], [1, 2], [5, 1, 1, 9], [2, 2, 2, 7, 8], list(range(100)), [None, 4, 6]])
def test_upper_median(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long").repartition(3)
    r = report.duration_stats(df, "g", F.col("v")).first()
    known = sorted(v for v in values if v is not None)
    assert (r["median"], r["mean"], r["n"]) == (known[len(known) // 2], sum(known) // len(known), len(known))


def test_read_and_write_bundles(spark, tmp_path):
    src = tmp_path / "in.ndjson"
    src.write_text('{"resourceType":"Patient","id":"1"}\n{"resourceType":"Condition","id":"c","subject":{"reference":"Patient/1"},"recordedDate":"2020-01-02","meta":{"profile":["u|1"]},"code":{"coding":[{"system":"s","code":"k"}]}}\n{"resourceType":"Medication","id":"m"}\n')
    df = readers.ndjson(spark, str(src))
    assert [(r["resource_type"], r["patient_id"], r["period_start"]) for r in df.orderBy("resource_type").collect()] == [("Condition", "1", dt.date(2020, 1, 2)), ("Medication", None, None), ("Patient", "1", None)]
    sinks.write_patient_bundles(df, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).collect()
    assert len(text) == 1 and text[0][0].index('"Condition/c"') < text[0][0].index('"Patient/1"')
    sinks.write_core(df, str(tmp_path / "core"))
    assert [json.loads(r[0])["request"]["url"] for r in spark.read.text(str(tmp_path / "core")).collect()] == ["Medication/m"]
    sinks.write_core(df, str(tmp_path / "one"), single_bundle=True)
    assert len(json.loads(spark.read.text(str(tmp_path / "one")).first()[0])["entry"]) == 1
    people = spark.createDataFrame([("1", "DIRECT_LOAD")], "patient_id string, stage string")
    events = spark.createDataFrame([("MUST_HAVE", "g", "a", "T/1", "1")], "reason string, group_id string, attribute_ref string, resource_id string, patient_id string")
    sinks.write_exclusions(people, events, str(tmp_path / "ex"))
    assert sorted({r[0] for r in spark.read.text(str(tmp_path / "ex" / "resources")).collect()}) == ['"0","MUST_HAVE","g","a","T/1","1"', '"Batch-ID","Reason","Group","Attribute","Resource-ID","Patient-ID"']


def test_read_profiles_and_rules(spark, tmp_path):
    element = [{"id": "Observation.code", "path": "Observation.code", "min": 1, "type": [{"code": "CodeableConcept"}]}, {"id": "Observation.code.coding", "path": "Observation.code.coding", "slicing": {"discriminator": [{"type": "pattern", "path": "$this"}]}}, {"id": "Observation.code.coding:x", "path": "Observation.code.coding", "sliceName": "x", "patternCoding": {"system": "s"}, "binding": {"strength": "required"}}, {"id": "Observation.extension:e", "path": "Observation.extension", "sliceName": "e", "type": [{"code": "Extension", "profile": ["u/e"]}]}]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"url": "u|1.2", "type": "Observation", "snapshot": {"element": element}}))
    rows = {r["element_id"]: r for r in readers.profile_elements(spark, str(tmp_path / "p")).collect()}
    assert rows["Observation.code"]["profile_url"] == "u" and rows["Observation.code"]["discriminators"] is None
    assert rows["Observation.code.coding"]["discriminators"][0]["path"] == "$this"
    assert json.loads(rows["Observation.code.coding:x"]["pattern"]) == {"system": "s"} and rows["Observation.code.coding:x"]["bound"]
    assert redact.profile_of("u", list(rows.values())).slices("Observation.code.coding")[0].slice_name == "x"
    assert rows["Observation.extension:e"]["type_profiles"] == ["u/e"]
    (tmp_path / "rules.json").write_text(json.dumps([{"system": "s", "code": "c", "validityGate": True, "required": ["d"]}, {"system": "s", "code": "d", "lookbackDate": "1900-01-01", "retroModifiers": [{"system": "s", "code": "r"}]}]))
    found = {r["code"]: r for r in readers.consent_rules(spark, str(tmp_path / "rules.json")).collect()}
    assert found["c"]["gate"] and found["c"]["required"] == ["d"] and found["d"]["retro_codes"] == ["r"] and found["d"]["lookback"] == dt.date(1900, 1, 1)
