"""Consent windows from provisions.

A provision frame has patient_id, consent_id, code, start, end, permit. Dates are closed. Nothing here asks for today:
the day of a gate is an argument.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import intervals
from cohortlake.plans.lineage import cut

#: How far back a retro code reaches that does not say.
EVER = datetime.date(1900, 1, 1)


def active_consents(consents: DataFrame) -> DataFrame:
    """Consents (status, consent_date, patient_id) that are active, dated and belong to someone."""
    return consents.where("status = 'active' AND consent_date IS NOT NULL AND patient_id IS NOT NULL")


def requested(provisions: DataFrame, codes: list[str]) -> DataFrame:
    """Provisions with a requested code and a valid period; a type that is not `permit`, or none, counts as deny."""
    return provisions.where(F.col("code").isin(codes) & (F.col("start") <= F.col("end"))).withColumn("permit", F.coalesce("permit", F.lit(False)))


def shift_to_encounters(provisions: DataFrame, encounters: DataFrame, gate_codes: list[str], permits_only: bool = False) -> DataFrame:
    """Moves a start that falls inside an encounter to that encounter's start, the earliest if there are several.

    Gate codes stay. Encounters without both ends are ignored. Denies move as well unless permits_only is set.
    """
    moves = ~F.col("code").isin(gate_codes) & (F.col("permit") if permits_only else F.lit(True))
    found = intervals.earliest_around(provisions.where(moves).select("patient_id", "start"), encounters, ["patient_id"])
    return provisions.join(found, ["patient_id", "start"], "left").withColumn("start", F.when(moves, F.coalesce("__to", "start")).otherwise(F.col("start"))).select(*provisions.columns)


def complete_packages(provisions: DataFrame, codes: list[str]) -> DataFrame:
    """Permits of consent documents that permit every one of the codes."""
    permits = provisions.where(F.col("permit") & F.col("code").isin(codes))
    whole = permits.groupBy("consent_id").agg(F.count_distinct("code").alias("n")).where(F.col("n") == len(codes)).select("consent_id")
    return permits.join(whole, "consent_id", "left_semi")


def retro_rules(spark: SparkSession, retro: Mapping[str, str | Sequence[str]], lookback: datetime.date = EVER) -> DataFrame:
    """code, retro_code, lookback rows of a map from codes to their retro codes."""
    rows = [(c, r, lookback) for c, own in retro.items() for r in ([own] if isinstance(own, str) else own)]
    return spark.createDataFrame(rows, "code string, retro_code string, lookback date")


def retro_extended(provisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Permits whose document also permits, at an overlapping time, a retro code of their code: they start at the code's lookback.

    rules: code, retro_code, lookback; a code may have several retro codes, and any of them extends; one without lookback
    extends to EVER. Denies of all of them in the same document are cut out. Permits of codes without a rule are left out. Adds `extended`.
    """
    back = rules.groupBy("code").agg(F.coalesce(F.min("lookback"), F.lit(EVER)).alias("lookback"))
    named = provisions.where("permit").join(F.broadcast(back), "code")  # a row a rule
    pairs = F.broadcast(rules.select(F.col("code").alias("__code"), "retro_code").distinct())
    marks = provisions.join(pairs, provisions["code"] == pairs["retro_code"]).select("consent_id", F.col("__code").alias("code"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("permit").alias("__p"))
    keys = ["consent_id", "code"]
    hit = intervals.overlapping(named, marks.where("__p").select(*keys, F.col("__s").alias("start"), F.col("__e").alias("end")), keys).withColumn("extended", F.lit(True))
    told = named.join(hit, [*keys, "start", "end"], "left").withColumn("extended", F.coalesce("extended", F.lit(False)))
    moved = told.withColumn("start", F.when(F.col("extended"), F.least("start", "lookback")).otherwise(F.col("start")))
    denied = marks.where("NOT __p").select(*keys, F.lit(True).alias("extended"), F.col("__s").alias("start"), F.col("__e").alias("end"))  # cuts nothing else
    return intervals.subtract(moved, denied, [*keys, "extended"]).select("patient_id", "consent_id", "code", "start", "end", "permit", "extended")


def gate_open(provisions: DataFrame, gate_codes: list[str], as_of: datetime.date) -> DataFrame:
    """patient_id of those for whom every gate code is permitted on the day, once its denies are cut out."""
    gates = provisions.where(F.col("code").isin(gate_codes))
    left = intervals.subtract(gates.where("permit").select("patient_id", "code", "start", "end"), gates.where("NOT permit").select("patient_id", "code", "start", "end"), ["patient_id", "code"])
    today = left.where((F.col("start") <= F.lit(as_of)) & (F.lit(as_of) <= F.col("end")))
    return today.groupBy("patient_id").agg(F.count_distinct("code").alias("n")).where(F.col("n") == len(gate_codes)).select("patient_id")


def windows(provisions: DataFrame, codes: list[str], retro: DataFrame | Mapping[str, str | Sequence[str]] | None = None, lookback: datetime.date = EVER) -> DataFrame:
    """patient_id, start, end: when all codes are consented.

    Permits count from complete documents only. Denies of any document cut regular permits, never retro-extended ones.
    People without every code are left out. retro is as in retro_extended, or a map from codes to retro codes with one lookback.
    """
    asked = provisions.where(F.col("code").isin(codes))
    permits = asked.where("permit").withColumn("extended", F.lit(False))
    if retro is not None:
        rules = retro if isinstance(retro, DataFrame) else retro_rules(provisions.sparkSession, retro, lookback)
        rules = rules.where(F.col("code").isin(codes))
        columns = ["patient_id", "consent_id", "code", "start", "end", "permit", "extended"]
        plain = permits.join(F.broadcast(rules.select("code").distinct()), "code", "left_anti").select(*columns)
        permits = cut(retro_extended(provisions, rules).select(*columns).unionByName(plain), "permits")
    permits = complete_packages(permits, codes)
    keys = ["patient_id", "code"]
    regular = intervals.subtract(intervals.merge(permits.where("NOT extended"), keys), asked.where("NOT permit").select(*keys, "start", "end"), keys)
    every = regular.select(*keys, "start", "end").unionByName(permits.where("extended").select(*keys, "start", "end"))
    return intervals.intersect_all(every, ["patient_id"], "code", len(codes))


def consented(resources: DataFrame, windows_: DataFrame) -> DataFrame:
    """Resources (patient_id, period_start, period_end) whose whole period lies in a window of their patient."""
    return intervals.contained(resources, windows_, ["patient_id"], "period_start", "period_end")


#: The date element that decides about a record's consent, by type; none means that consent is given with the
#: patient's. Types that are not listed are never consented.
DATE_FIELDS = {
    "Condition": "recordedDate", "Consent": "dateTime", "Device": "", "DiagnosticReport": "effective", "DocumentReference": "date",
    "Encounter": "period", "FamilyMemberHistory": "date", "List": "date", "Medication": "", "MedicationAdministration": "effective",
    "MedicationRequest": "authoredOn", "MedicationStatement": "effective", "Observation": "effective", "Organization": "",
    "Patient": "", "Procedure": "performed", "Provenance": "recorded", "Questionnaire": "", "QuestionnaireResponse": "",
    "ResearchStudy": "", "RiskAssessment": "occurrence", "ServiceRequest": "authoredOn", "Specimen": "collection.collected",
    "Substance": "", "Task": "authoredOn",
}


def consented_by_type(resources: DataFrame, windows_: DataFrame, fields: dict[str, str] = DATE_FIELDS) -> DataFrame:
    """Patient-side resources with consent: of types with a date element those with a period in a window of their patient,
    of types without one all of patients that have a window, of unlisted types none.

    resources has period_start and period_end, or periods (array of start, end): then any of several is enough. A record
    whose period is missing, open or coarser than a day has no consent.
    """
    dated, free = ([t for t, f in fields.items() if bool(f) == has] for has in (True, False))
    listed = resources.where(F.col("resource_type").isin(dated))
    if "periods" in resources.columns:
        each = listed.select("patient_id", "resource_type", "id", F.explode("periods").alias("p")).select("patient_id", "resource_type", "id", "p.start", "p.end")
        inside = listed.join(intervals.contained(each, windows_, ["patient_id"]), ["patient_id", "resource_type", "id"], "left_semi")
    else:
        inside = consented(listed, windows_)
    open_ = resources.where(F.col("resource_type").isin(free)).join(windows_.select("patient_id").distinct(), "patient_id", "left_semi")
    return inside.select(*resources.columns).unionByName(open_.select(*resources.columns))


def code_sets(rules: DataFrame, requested: DataFrame) -> DataFrame:
    """code, role of the requested codes (code): gate and prospective codes, and retro ones of requested prospective codes.

    rules (as sources.readers.consent_rules): code, gate, retro_codes, lookback. Requested codes without a rule are left out.
    """
    own = rules.join(requested.select("code").distinct(), "code", "left_semi")
    roles = own.select("code", F.when(F.col("gate"), "gate").otherwise("non_gate").alias("role"))
    retro = own.select(F.explode("retro_codes").alias("code")).distinct().join(requested.select("code").distinct(), "code", "left_semi")
    return roles.union(retro.select("code", F.lit("retro").alias("role")))


def job_windows(provisions: DataFrame, rules: DataFrame, asked: DataFrame, as_of: datetime.date, encounters: DataFrame | None = None) -> DataFrame:
    """patient_id, start, end of a request: gates are tested on the day, all other requested codes give the windows.

    Nobody is left if no requested code other than gates has a rule. Starts move to encounters first, where these are given.
    """
    sets: dict[str, list[str]] = {"gate": [], "non_gate": [], "retro": []}
    for r in code_sets(rules, asked).collect():  # a row a requested code
        sets[r["role"]].append(r["code"])
    empty = provisions.limit(0).select("patient_id", "start", "end")
    if not sets["non_gate"]:
        return empty
    if encounters is not None:
        provisions = shift_to_encounters(provisions, encounters, sets["gate"])
    own = rules.where(F.col("code").isin(sets["non_gate"])).select("code", "lookback", F.explode("retro_codes").alias("retro_code"))
    retro = own.where(F.col("retro_code").isin(sets["retro"])).select("code", "retro_code", "lookback")
    out = windows(requested(provisions, [*sets["gate"], *sets["non_gate"], *sets["retro"]]), sets["non_gate"], retro)
    return out.join(gate_open(provisions, sets["gate"], as_of), "patient_id", "left_semi") if sets["gate"] else out


def minimised(resources: DataFrame) -> DataFrame:
    """Consents and encounters for an audit: patient_id, resource_type, id, body with identifying and consent fields only."""
    text = lambda p: F.get_json_object("body", p)
    part = lambda p, kind: F.from_json(text(p), kind)
    variant = lambda p: F.try_parse_json(text(p))
    common = [F.col("resource_type").alias("resourceType"), F.col("id"), F.struct(part("$.meta.profile", "array<string>").alias("profile")).alias("meta")]
    consent = F.struct(*common, text("$.status").alias("status"), variant("$.patient").alias("patient"), text("$.dateTime").alias("dateTime"), variant("$.provision").alias("provision"))
    visit = F.struct(*common, variant("$.subject").alias("subject"), variant("$.period").alias("period"))
    body = F.when(F.col("resource_type") == "Consent", F.to_json(consent)).otherwise(F.to_json(visit))
    return resources.where("resource_type IN ('Consent', 'Encounter')").select("patient_id", "resource_type", "id", body.alias("body"))
