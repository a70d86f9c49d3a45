"""Attributes of specs move once to their groups, whatever is asked of them."""

from collections import Counter

from cohortlake.operators import spec


def frames(spark):
    groups = [(1, "a", "p", "Observation"), (1, "a", "p", "Observation"), (1, "b", "none", "Patient"), (1, None, "p", "Observation"), (2, "c", "p", "Patient"), (2, "d", None, None)]
    refs = ["Observation.id", "Observation.subject", "Observation.patient", "Observation.r", "Observation.x", None, "Patient.id"]
    attributes = [(s, g, r, m, k) for s, g in ((1, "a"), (1, "b"), (1, None), (2, "c"), (2, "d"), (3, "e"), (None, "a")) for r in refs for m, k in ((True, None), (False, ["a"]), (None, []))][:-4]
    elements = [("p", "Observation.id", ["id"]), ("p", "Observation.subject", ["Reference"]), ("p", "Observation.r", ["Reference"]), ("p", "Observation.r", ["Reference"]), ("p", "Observation.x", []), (None, "Observation.r", ["Reference"])]
    make = spark.createDataFrame
    return (
        make(groups, "spec_id int, group_id string, profile_url string, type string"), make(attributes, "spec_id int, group_id string, attribute_ref string, must_have boolean, linked_groups array<string>"),
        make([(1, "a", "date")] * 2, "spec_id int, group_id string, kind string"), make(elements, "profile_url string, element_id string, types array<string>"), ["Patient", "Observation"],
    )


def test_attributes_are_read_twice(spark):
    plan = spec.violations(*frames(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("must_have" in x and "LogicalRDD" in x for x in plan.split("\n")) == 2  # to their groups, and to those they link


def test_rules_on_faulty_specs(spark):
    found = Counter(r["rule"] for r in spec.violations(*frames(spark)).collect())
    assert found == EXPECTED


EXPECTED = {"unknown_profile": 2, "duplicate_attribute": 48, "standard_must_have": 4, "unknown_attribute": 36, "reference_without_link": 18, "undefined_link": 27, "two_date_filters": 1}
