"""Checks of a table of extraction specs against the profile catalogue: one row a violation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the patient-side types of the FHIR R4 patient compartment; sources.readers.compartment reads others.
PATIENT_TYPES = tuple(
    """
    Account AdverseEvent AllergyIntolerance Appointment AppointmentResponse AuditEvent Basic BodyStructure CarePlan
    CareTeam ChargeItem Claim ClaimResponse ClinicalImpression Communication CommunicationRequest Composition Condition
    Consent Coverage CoverageEligibilityRequest CoverageEligibilityResponse DetectedIssue DeviceRequest DeviceUseStatement
    DiagnosticReport DocumentManifest DocumentReference Encounter EnrollmentRequest EpisodeOfCare ExplanationOfBenefit
    FamilyMemberHistory Flag Goal Group ImagingStudy Immunization ImmunizationEvaluation ImmunizationRecommendation
    Invoice List MeasureReport Media MedicationAdministration MedicationDispense MedicationRequest MedicationStatement
    MolecularSequence NutritionOrder Observation Patient Person Procedure Provenance QuestionnaireResponse RelatedPerson
    RequestGroup ResearchSubject RiskAssessment Schedule ServiceRequest Specimen SupplyDelivery SupplyRequest
    VisionPrescription
    """.split()
)


def _rows(df: DataFrame, rule: str, group: str | None = "group_id", attribute: str | None = None) -> DataFrame:
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    return df.select("spec_id", text(group).alias("group_id"), text(attribute).alias("attribute_ref"), F.lit(rule).alias("rule"))


def violations(groups: DataFrame, attributes: DataFrame, filters: DataFrame, elements: DataFrame, domain_types: Sequence[str], patient_types: Sequence[str] = PATIENT_TYPES) -> DataFrame:
    """spec_id, group_id, attribute_ref, rule.

    groups: spec_id, group_id, profile_url, type. attributes: spec_id, group_id, attribute_ref, must_have, linked_groups.
    filters: spec_id, group_id, kind. elements: profile_url, element_id, types.
    """
    side = F.when(F.col("element_id").rlike(r"^[^.]+[.](patient|subject)$"), F.col("element_id"))
    per_profile = elements.groupBy("profile_url").agg(F.collect_set(side).alias("sides"))
    told = groups.join(per_profile, "profile_url", "left")
    linked = attributes.select("spec_id", "group_id", "attribute_ref", F.explode("linked_groups").alias("linked"))
    found = [
        _rows(told.where("sides IS NULL"), "unknown_profile"),
        _rows(groups.groupBy("spec_id").agg(F.count_if(F.col("type") == "Patient").alias("n")).where("n <> 1"), "one_patient_group", None),
        _of_attributes(told, attributes, elements, patient_types),
        _rows(linked.join(groups.select("spec_id", F.col("group_id").alias("linked")), ["spec_id", "linked"], "left_anti"), "undefined_link", attribute="attribute_ref"),
        _rows(filters.where("kind = 'date'").groupBy("spec_id", "group_id").count().where("count > 1"), "two_date_filters"),
        _rows(groups.where(~F.col("type").isin(list(domain_types))), "not_a_domain_resource"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _of_attributes(told: DataFrame, attributes: DataFrame, elements: DataFrame, patient_types: Sequence[str]) -> DataFrame:
    """The rules about single attributes: these move once to their groups. told is groups with `sides`, the elements of a known profile that
    may be standard attributes.
    """
    name = lambda n: F.concat("type", F.lit(f".{n}"))
    own_side = F.filter("sides", lambda x: F.col("type").isin(list(patient_types)) & x.isin(name("patient"), name("subject")))
    standard = F.concat(F.array(name("id"), name("meta.profile")), F.coalesce(own_side, F.array().cast("array<string>")))
    entry = F.struct("profile_url", F.col("sides").isNotNull().alias("known"), standard.alias("standard"))
    named = told.groupBy("spec_id", "group_id").agg(F.collect_list(entry).alias("own"))  # a group of a spec has one row, but for faults
    key = ["spec_id", "group_id"]
    bare = F.coalesce(F.size("linked_groups"), F.lit(0)) <= 0
    rows = attributes.select(*key, "attribute_ref", "must_have", bare.alias("bare")).join(named, key, "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key, "attribute_ref").orderBy(F.lit(1))))
    event = lambda rule, url=None: F.struct(F.lit(rule).alias("rule"), (F.lit(None).cast("string") if url is None else url).alias("profile_url"))
    is_standard = F.col("must_have") & F.exists("own", lambda e: F.array_contains(e["standard"], F.col("attribute_ref")))
    single = F.array_compact(F.array(F.when(F.col("copy") == 2, event("duplicate_attribute")), F.when(is_standard, event("standard_must_have"))))
    asked = F.transform(F.filter("own", lambda e: e["known"]), lambda e: event("element", e["profile_url"]))
    kind = "array<struct<rule: string, profile_url: string>>"
    each = rows.select(*key, "attribute_ref", "bare", F.explode(F.concat(single.cast(kind), F.coalesce(asked.cast(kind), F.array().cast(kind)))).alias("e")).select(*key, "attribute_ref", "bare", "e.*")
    typed = elements.where(F.size("types") > 0).groupBy("profile_url", F.col("element_id").alias("attribute_ref")).agg(F.collect_list("types").alias("kinds"))
    only = F.filter("kinds", lambda t: (F.size(t) == 1) & F.array_contains(t, "Reference") & F.col("bare"))
    rule = F.when(F.col("rule") != "element", F.array("rule")).when(F.col("kinds").isNull(), F.array(F.lit("unknown_attribute"))).otherwise(F.transform(only, lambda _: F.lit("reference_without_link")))
    judged = each.join(typed, ["profile_url", "attribute_ref"], "left").select(*key, "attribute_ref", F.explode(rule).alias("rule"))
    return judged.select("spec_id", F.col("group_id").cast("string").alias("group_id"), F.col("attribute_ref").cast("string").alias("attribute_ref"), "rule")


def standard_attributes(groups: DataFrame, elements: DataFrame, patient_types: Sequence[str] = PATIENT_TYPES) -> DataFrame:
    """spec_id, group_id, attribute_ref, linked of what every group gets by itself: id, meta.profile, and for patient-side types
    those of `patient` and `subject` that the group's profile has, linked to the spec's patient group.
    """
    patient = groups.where("type = 'Patient'").select("spec_id", F.col("group_id").alias("patient_group"))
    base = groups.join(patient, "spec_id", "left").select("spec_id", "group_id", "profile_url", "type", "patient_group")
    always = base.select("spec_id", "group_id", F.explode(F.array(F.concat("type", F.lit(".id")), F.concat("type", F.lit(".meta.profile")))).alias("attribute_ref"), F.lit(None).cast("string").alias("linked"))
    fields = base.where(F.col("type").isin(list(patient_types))).select("spec_id", "group_id", "profile_url", F.col("patient_group").alias("linked"), F.explode(F.array(F.concat("type", F.lit(".patient")), F.concat("type", F.lit(".subject")))).alias("attribute_ref"))
    known = elements.select("profile_url", F.col("element_id").alias("attribute_ref")).distinct()
    return always.unionByName(fields.join(known, ["profile_url", "attribute_ref"], "left_semi").select("spec_id", "group_id", "attribute_ref", "linked"))


def with_standard_attributes(attributes: DataFrame, groups: DataFrame, elements: DataFrame, patient_types: Sequence[str] = PATIENT_TYPES) -> DataFrame:
    """attributes with the standard ones that are not among them; groups has spec_id, group_id, profile_url, type."""
    added = standard_attributes(groups, elements, patient_types)
    links = F.when(F.col("linked").isNotNull(), F.array("linked")).otherwise(F.array().cast("array<string>"))
    added = added.select("spec_id", "group_id", "attribute_ref", F.lit(False).alias("must_have"), links.alias("linked_groups"))
    return attributes.unionByName(added.join(attributes, ["spec_id", "group_id", "attribute_ref"], "left_anti"))


def slice_ids(attribute_ref: Column) -> Column:
    """The ids of the slices that an attribute lies below: `A.b:s.c:t.d` gives `A.b:s` and `A.b:s.c:t`."""
    steps = F.split(attribute_ref, r"\.")
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(steps, 1, n), ".").alias("id"), F.element_at(steps, n).alias("step")))
    return F.transform(F.filter(upto, lambda x: x["step"].contains(":") & (x["id"] != attribute_ref)), lambda x: x["id"])


def discriminator_attributes(attributes: DataFrame, groups: DataFrame, elements: DataFrame) -> DataFrame:
    """spec_id, group_id, attribute_ref of the discriminator fields of slices that attributes lie below, without those that
    are there: else a copy would leave out what tells which slice a value belongs to.

    elements has profile_url, element_id, discriminators and pattern (JSON text). A discriminator `$this` stands for
    the fields of the slice's own pattern.
    """
    base = attributes.join(groups.select("spec_id", "group_id", "profile_url"), ["spec_id", "group_id"]).select("spec_id", "group_id", "profile_url", F.explode(slice_ids(F.col("attribute_ref"))).alias("slice_id")).distinct()
    parents = elements.where("discriminators IS NOT NULL").select("profile_url", F.col("element_id").alias("parent_id"), F.explode("discriminators.path").alias("path"))
    parent_id = F.expr("substring_index(slice_id, ':', size(split(slice_id, ':')) - 1)")
    under = base.withColumn("parent_id", parent_id).join(F.broadcast(parents), ["profile_url", "parent_id"])
    own = elements.where("pattern IS NOT NULL").select("profile_url", F.col("element_id").alias("slice_id"), F.json_object_keys("pattern").alias("fields"))
    wide = under.join(F.broadcast(own), ["profile_url", "slice_id"], "left")
    names = F.when(F.col("path") == "$this", F.coalesce("fields", F.array().cast("array<string>"))).otherwise(F.array("path"))
    found = wide.withColumn("name", F.explode(names)).select("spec_id", "group_id", F.concat_ws(".", "slice_id", "name").alias("attribute_ref")).distinct()
    return found.join(attributes, ["spec_id", "group_id", "attribute_ref"], "left_anti")


def requested_consent_codes(criteria: DataFrame, context: str) -> DataFrame:
    """spec_id, system, code of the term codes of all inclusion criteria in the consent context, whatever their nesting.

    criteria: spec_id, kind (inclusion, exclusion), context_code, term_codes (array of system, code).
    """
    rows = criteria.where((F.col("kind") == "inclusion") & (F.col("context_code") == context)).select("spec_id", F.explode("term_codes").alias("t"))
    return rows.select("spec_id", "t.system", "t.code").where("system IS NOT NULL AND code IS NOT NULL").distinct()


def consent_in_exclusion(criteria: DataFrame, context: str) -> DataFrame:
    """Specs whose exclusion criteria name the consent context, as violations."""
    return _rows(criteria.where((F.col("kind") == "exclusion") & (F.col("context_code") == context)).select("spec_id").distinct(), "consent_in_exclusion", None)


def consent_codes_together(requested: DataFrame, rules: DataFrame) -> DataFrame:
    """spec_id, code, missing: codes that a requested code needs beside it; rules has code and required (array)."""
    need = requested.join(rules, "code").select("spec_id", "code", F.explode("required").alias("missing"))
    return need.join(requested.select("spec_id", F.col("code").alias("missing")), ["spec_id", "missing"], "left_anti").select("spec_id", "code", "missing")


def split_groups(groups: DataFrame, compartment: DataFrame) -> DataFrame:
    """groups with `role`: direct_patient, direct_core or reference_only; compartment lists patient-side types."""
    side = compartment.select("type", F.lit(True).alias("__p"))
    role = F.when(F.col("reference_only"), "reference_only").when(F.col("__p"), "direct_patient").otherwise("direct_core")
    return groups.join(F.broadcast(side), "type", "left").withColumn("role", role).drop("__p")
