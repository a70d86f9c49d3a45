"""Direct load: filters on resources, required attributes, and who survives them.

A resource frame has resource_type, id, patient_id (null for core resources), profiles, codes (array of system, code),
period_start and period_end.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.references import claims_profile
from cohortlake.plans.lineage import cut

Code = tuple[str, str]


def token_filter(codes: Column, wanted: Sequence[Code]) -> Column:
    """Whether any coding is one of the wanted (system, code) pairs. Several token filters are OR-ed: pass their union."""
    return F.exists(codes, lambda c: F.struct(c["system"], c["code"]).isin([F.struct(F.lit(s).alias("system"), F.lit(k).alias("code")) for s, k in wanted]))


def date_filter(start: Column, end: Column, low: datetime.date | None, high: datetime.date | None) -> Column:
    """Whether a period reaches into [low, high]; either bound may be open."""
    out = F.lit(True)
    if low is not None:
        out &= end >= F.lit(low)
    if high is not None:
        out &= start <= F.lit(high)
    return out


def group_predicate(resource_type: str, profile: str | None = None, codes: Sequence[Code] = (), low: datetime.date | None = None, high: datetime.date | None = None) -> Column:
    """Whether a resource is one that a group asks for: of its type, profile, any of its codes, and date range. Patients ignore filters."""
    out = F.col("resource_type") == resource_type
    if resource_type == "Patient":
        return out
    if profile:
        out &= claims_profile(F.col("profiles"), F.lit(profile))
    if codes:
        out &= token_filter(F.col("codes"), codes)
    if low or high:
        out &= date_filter(F.col("period_start"), F.col("period_end"), low, high)
    return F.coalesce(out & F.expr("id IS NOT NULL AND trim(id) <> ''"), F.lit(False))


def group_filter(df: DataFrame, resource_type: str, profile: str | None = None, codes: Sequence[Code] = (), low: datetime.date | None = None, high: datetime.date | None = None) -> DataFrame:
    """The resources a group asks for (group_predicate); patients get its profile."""
    own = df.where(F.col("resource_type") == resource_type).where(group_predicate(resource_type, profile, codes, low, high))
    return own.withColumn("profiles", F.array(F.lit(profile))) if resource_type == "Patient" and profile else own


def in_cohort(df: DataFrame, cohort: DataFrame, key: str = "patient_id") -> DataFrame:
    """Resources of people in the cohort; those without a person, or of another, are left out."""
    return df.join(cohort.select(key), key, "left_semi")


def first_copy(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


COPY_KEYS = ["patient_id", "resource_type", "id"]


def without_copies(resources: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Resources with one row for each patient, type and id: of several copies the first in the order given.

    Without an order that is the one of least body, or of least hash of all columns where there is no body: the same one in
    every run, however the copies differ. Only records that have copies move; their keys are counted first.
    """
    several = cut(resources.groupBy(*COPY_KEYS).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*COPY_KEYS), "copied-keys")
    if several.isEmpty():
        return resources
    default = [F.col("body")] if "body" in resources.columns else [F.xxhash64(*resources.columns)]
    same = lambda: [resources[c].eqNullSafe(several[c]) for c in COPY_KEYS]
    once = resources.join(several, same(), "left_anti")
    return once.unionByName(first_copy(resources.join(several, same(), "left_semi"), COPY_KEYS, order or default))


def must_have(in_scope: Column, attributes: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(state, first violated attribute): not_applicable, fulfilled or violated, attributes in declaration order."""
    violated = F.lit(None).cast("string")
    for name, present in reversed(attributes):
        violated = F.when(~F.coalesce(present, F.lit(False)), F.lit(name)).otherwise(violated)
    first = F.when(in_scope, violated)
    state = F.when(~in_scope, "not_applicable").when(first.isNull(), "fulfilled").otherwise("violated")
    return state, first


def first_violations(attributes: DataFrame) -> DataFrame:
    """The first violated attribute of each resource from long rows (resource_id, ord, attribute_ref, present)."""
    return first_copy(attributes.where(~F.coalesce("present", F.lit(False))), ["resource_id"], [F.col("ord")]).select("resource_id", "attribute_ref")


def survivors(cohort: DataFrame, evaluated: DataFrame, required: Sequence[str]) -> DataFrame:
    """People with at least one fulfilled resource in every required group; evaluated has patient_id, group_id, fulfilled."""
    if not required:
        return cohort
    kept = evaluated.where(F.col("group_id").isin(list(required)) & F.col("fulfilled")).groupBy("patient_id").agg(F.count_distinct("group_id").alias("n"))
    return cohort.join(kept.where(F.col("n") == len(required)), "patient_id", "left_semi")


def require_core(evaluated: DataFrame, required: Sequence[str]) -> None:
    """Raises if a required group has no fulfilled core resource."""
    found = {r["group_id"] for r in evaluated.where("fulfilled").select("group_id").distinct().collect()}  # a row a group
    missing = sorted(set(required) - found)
    if missing:
        raise ValueError(f"no core resource fulfils {', '.join(missing)}")
