"""Readers for resources, profiles and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.references import claims_profile, patient_of
from cohortlake.functions.temporal import day, element_period
from cohortlake.operators.consent import DATE_FIELDS, active_consents


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Resources, one JSON document a line: resource_type, id, patient_id, profiles, codes, period_start, period_end, body.

    The keys become real columns, so filters on them need not touch bodies once written as Parquet.
    """
    return keyed(spark.read.text(path).select(F.col("value").alias("body")))


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """Resources of bundles (and of bundles inside bundles), one bundle a file."""
    entries = "array<struct<resource: string>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.entry"), entries)).alias("e")).select("e.resource")
    inner = whole.where(F.get_json_object("resource", "$.resourceType") == "Bundle").select(F.explode(F.from_json(F.get_json_object("resource", "$.entry"), entries)).alias("e")).select("e.resource")
    return keyed(whole.where(F.get_json_object("resource", "$.resourceType") != "Bundle").union(inner).select(F.col("resource").alias("body")))


def keyed(bodies: DataFrame) -> DataFrame:
    """Key columns beside each body. The period is that of the element that decides about the type's consent (of a choice, the
    date, dateTime or instant as one day, or the period); it is NULL where that is missing, open, reversed or coarser than a day.
    """
    at = lambda p: F.get_json_object("body", p)
    out = bodies.withColumns({"resource_type": at("$.resourceType"), "id": at("$.id")})
    both = F.lit(None).cast("struct<start: date, end: date>")
    for kind, name in DATE_FIELDS.items():
        if name:
            both = F.when(F.col("resource_type") == kind, element_period(F.col("body"), f"$.{name}")).otherwise(both)
    return out.select(
        "resource_type", "id", patient_of(F.col("resource_type"), F.col("id"), F.col("body")).alias("patient_id"), F.from_json(at("$.meta.profile"), "array<string>").alias("profiles"),
        F.from_json(at("$.code.coding"), "array<struct<system: string, code: string>>").alias("codes"), both.alias("__period"), "body",
    ).select("resource_type", "id", "patient_id", "profiles", "codes", F.col("__period.start").alias("period_start"), F.col("__period.end").alias("period_end"), "body")


#: Elements of a profile's slicing, fixed values and patterns, which are named after their types.
_FIXED = """Boolean Canonical Code CodeableConcept Coding Date DateTime Decimal Id Identifier Instant Integer Markdown Oid Period
Quantity Reference String Uri Url""".split()


def profile_elements(spark: SparkSession, path: str) -> DataFrame:
    """profile_url (without version), resource_type, element_id, path, slice_name, min, max, types, type_profiles, target_profiles,
    discriminators (array of type, path; NULL where nothing is sliced), pattern (fixed value or pattern as JSON text) and bound (to
    a value set) of every element of a folder of profiles.
    """
    variants = ", ".join(f"fixed{t}: variant, pattern{t}: variant" for t in _FIXED)
    kind = "array<struct<code: string, profile: array<string>, targetProfile: array<string>>>"
    schema = f"url string, type string, snapshot struct<element: array<struct<id: string, path: string, sliceName: string, min: int, max: string, type: {kind}, slicing: struct<discriminator: array<struct<type: string, path: string>>>, binding: variant, {variants}>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.substring_index("url", "|", 1).alias("profile_url"), F.col("type").alias("resource_type"), F.explode("snapshot.element").alias("e"))
    pattern = F.coalesce(*(F.to_json(F.col(f"e.{how}{t}")) for how in ("fixed", "pattern") for t in _FIXED))
    return rows.select(
        "profile_url", "resource_type", F.col("e.id").alias("element_id"), F.col("e.path").alias("path"), F.col("e.sliceName").alias("slice_name"), F.col("e.min").alias("min"), F.col("e.max").alias("max"),
        F.col("e.type.code").alias("types"), F.flatten(F.transform("e.type", lambda t: F.coalesce(t["profile"], F.array().cast("array<string>")))).alias("type_profiles"),
        F.flatten(F.transform("e.type", lambda t: F.coalesce(t["targetProfile"], F.array().cast("array<string>")))).alias("target_profiles"),
        F.when(F.col("e.slicing").isNotNull(), F.coalesce("e.slicing.discriminator", F.array().cast("array<struct<type: string, path: string>>"))).alias("discriminators"),
        pattern.alias("pattern"), F.col("e.binding").isNotNull().alias("bound"),
    )


def value_sets(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a folder of value sets, as operators.bindings takes them. Codes of an expansion count as included; filters other than
    is-a and descendants by other properties are not read.
    """
    part = "array<struct<system: string, concept: array<struct<code: string>>, filter: array<struct<property: string, op: string, value: string>>, valueSet: array<string>>>"
    schema = f"resourceType string, url string, compose struct<include: {part}, exclude: {part}>, expansion struct<contains: array<struct<system: string, code: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).where("resourceType = 'ValueSet'").withColumn("value_set", F.substring_index("url", "|", 1))
    none = F.lit(None).cast("string")
    rule = lambda how, system, code, imported: F.struct(F.lit(how).alias("how"), system.alias("system"), code.alias("code"), imported.alias("imported"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0

    def rules(p: Column) -> Column:
        tops = F.filter(p["filter"], lambda f: f["op"] == "is-a")
        whole = p["system"].isNotNull() & empty(p["concept"]) & empty(p["filter"]) & empty(p["valueSet"])
        found = [
            F.transform(p["concept"], lambda c: rule("code", p["system"], c["code"], none)), F.transform(tops, lambda f: rule("is-a", p["system"], f["value"], none)),
            F.transform(p["valueSet"], lambda v: rule("import", p["system"], none, F.substring_index(v, "|", 1))), F.when(whole, F.array(rule("system", p["system"], none, none))),
        ]
        return F.flatten(F.array_compact(F.array(*found)))

    sides = [rows.select("value_set", F.lit(side).alias("part"), F.explode(f"compose.{side}").alias("p")).select("value_set", "part", F.inline(rules(F.col("p")))) for side in ("include", "exclude")]
    listed = rows.select("value_set", F.lit("include").alias("part"), F.explode("expansion.contains").alias("c")).select("value_set", "part", F.lit("code").alias("how"), "c.system", "c.code", none.alias("imported"))
    return sides[0].unionByName(sides[1]).unionByName(listed).distinct()


def provisions(resources: DataFrame) -> DataFrame:
    """patient_id, consent_id, code, start, end, permit: a row for each code of each provision of active, dated consents.

    resources as from `keyed`. Whatever is not `permit` denies; provisions without a valid period are left out.
    """
    kind = "struct<status: string, dateTime: string, provision: struct<provision: array<struct<type: string, period: struct<start: string, end: string>, code: array<struct<coding: array<struct<system: string, code: string>>>>>>>>"
    rows = resources.where("resource_type = 'Consent'").select("patient_id", F.col("id").alias("consent_id"), F.from_json("body", kind).alias("b"))
    dated = rows.select("patient_id", "consent_id", F.col("b.status").alias("status"), day(F.col("b.dateTime")).alias("consent_date"), F.col("b.provision.provision").alias("p"))
    each = active_consents(dated).select("patient_id", "consent_id", F.explode("p").alias("p"))
    wide = each.select("patient_id", "consent_id", F.explode(F.flatten(F.transform("p.code", lambda c: c["coding"]))).alias("c"), day(F.col("p.period.start")).alias("start"), day(F.col("p.period.end")).alias("end"), (F.coalesce("p.type", F.lit("")) == "permit").alias("permit"))
    return wide.where("start <= end AND c.code IS NOT NULL").select("patient_id", "consent_id", "c.code", "start", "end", "permit")


def visits(resources: DataFrame, profile: str | None = None) -> DataFrame:
    """patient_id, start, end of encounters (of a profile) with a whole period."""
    own = resources.where("resource_type = 'Encounter' AND patient_id IS NOT NULL AND period_start IS NOT NULL")
    own = own.where(claims_profile(F.col("profiles"), F.lit(profile))) if profile else own
    return own.select("patient_id", F.col("period_start").alias("start"), F.col("period_end").alias("end"))


def consent_rules(spark: SparkSession, path: str) -> DataFrame:
    """system, code, gate, required, retro_codes, lookback of a list of consent rules."""
    schema = "system string, code string, validityGate boolean, required array<string>, lookbackDate string, retroModifiers array<struct<system: string, code: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select("system", "code", F.coalesce("validityGate", F.lit(False)).alias("gate"), F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.col("retroModifiers.code").alias("retro_codes"), day(F.col("lookbackDate")).alias("lookback"))


def compartment(spark: SparkSession, path: str) -> DataFrame:
    """Resource types with parameters in a compartment definition: those that belong to a patient."""
    rows = spark.read.schema("resource array<struct<code: string, param: array<string>>>").json(path, multiLine=True)
    return rows.select(F.explode("resource").alias("r")).where(F.size("r.param") > 0).select(F.col("r.code").alias("type"), F.col("r.param").alias("params"))


def concept_edges(spark: SparkSession, path: str) -> DataFrame:
    """system, parent, child of a list of code trees."""
    schema = "context struct<system: string, code: string>, entries array<struct<key: string, children: array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("context.system").alias("system"), F.explode("entries").alias("e"))
    return rows.select("system", F.col("e.key").alias("parent"), F.explode("e.children").alias("child"))
