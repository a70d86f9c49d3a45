"""What was extracted from what, and what was not and why."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.plans.lineage import cut, numbered

#: Why a resource was left out, and at which stage a person was.
RESOURCE_REASONS = ("MUST_HAVE", "CONSENT", "REFERENCE_NOT_FOUND", "RESOURCE_OUTSIDE_BATCH", "CASCADING_DELETE")
PATIENT_STAGES = ("CONSENT_FETCH", "DIRECT_LOAD", "CASCADING_DELETE")
#: What group and extraction are identified by, and who makes an extraction.
PROVENANCE_SYSTEMS = ("urn:cohortlake:attribute-group", "urn:cohortlake:extraction")
PROVENANCE_AGENT = ("urn:cohortlake:program", "cohortlake")


def extraction_info(groups: DataFrame, attributes: DataFrame) -> DataFrame:
    """For each resource (type, id) its valid groups, and a map from attribute to the ids of its valid children."""
    g = groups.where("valid").groupBy("type", "id").agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    refs = attributes.where("valid").groupBy("type", "id", "attribute_ref").agg(F.array_sort(F.collect_set("child")).alias("children"))
    return g.join(refs.groupBy("type", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute_ref", "children")))).alias("refs")), ["type", "id"], "left")


#: Targets of one provenance record at most; longer lists take several.
TARGETS = 1000


def provenance(groups: DataFrame, size: int = TARGETS) -> DataFrame:
    """patient_id, group_id, chunk, targets, provenance_id: for each patient and group the resources present, in order of type and id.

    Lists of more than `size` targets go on in further chunks: core resources (without a patient) are one list for each group,
    which no task could hold. Ids are made from patient, group and chunk, so they are the same in every run.
    """
    rows = numbered(groups.select("patient_id", "group_id", "type", "id").distinct(), ["patient_id", "group_id"], ["type", "id"], "__n")
    out = rows.groupBy("patient_id", "group_id", F.floor(F.col("__n") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.concat_ws("/", "type", "id"))).alias("targets"))
    return out.withColumn("provenance_id", F.sha2(F.concat_ws("|", F.col("patient_id").cast("string"), "group_id", F.when(F.col("chunk") > 0, F.col("chunk").cast("string"))), 256))


def provenance_resources(provenance_: DataFrame, extraction_id: str, recorded: datetime.datetime, systems: tuple[str, str] = PROVENANCE_SYSTEMS, agent: tuple[str, str] = PROVENANCE_AGENT) -> DataFrame:
    """patient_id, resource_type, id, group_id, chunk, body: a record for each list of targets, which names its group, the extraction, and who made it when."""
    named = lambda system, value: F.struct(F.struct(F.lit(system).alias("system"), value.alias("value")).alias("identifier"))
    source = lambda what: F.struct(F.lit("source").alias("role"), what.alias("what"))
    stamp = F.lit(recorded.isoformat())
    body = F.struct(
        F.lit("Provenance").alias("resourceType"), F.col("provenance_id").alias("id"), F.transform("targets", lambda t: F.struct(t.alias("reference"))).alias("target"), F.struct(stamp.alias("start")).alias("occurredPeriod"), stamp.alias("recorded"),
        F.array(F.struct(named(agent[0], F.lit(agent[1])).alias("who"))).alias("agent"), F.array(source(named(systems[0], F.col("group_id"))), source(named(systems[1], F.lit(extraction_id)))).alias("entity"),
    )
    return provenance_.select("patient_id", F.lit("Provenance").alias("resource_type"), F.col("provenance_id").alias("id"), "group_id", "chunk", F.to_json(body).alias("body"))


def inclusion_counts(groups: DataFrame) -> DataFrame:
    """Resources and people for each group."""
    return groups.groupBy("group_id").agg(F.count_distinct("type", "id").alias("resources"), F.count_distinct("patient_id").alias("patients"))


def exclusion_summary(events: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """A row a group and a column a reason, zero where there was none."""
    return events.groupBy("group_id").pivot("reason", list(reasons)).count().na.fill(0)


def exclusions_by_attribute(events: DataFrame) -> DataFrame:
    return events.where("lower(reason) = 'must_have'").groupBy("group_id", "attribute_ref").agg(F.count(F.lit(1)).alias("n"))


def patient_exclusions(events: DataFrame, stages: Sequence[str]) -> DataFrame:
    """People excluded at each stage, zero where none was."""
    every = events.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return F.broadcast(every).join(events.groupBy("stage").agg(F.count_distinct("patient_id").alias("n")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("patients"))


def reconcile(cohort: DataFrame, final: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: sizes, and whether cohort = final + excluded."""
    n = lambda df, name: df.agg(F.count_distinct("patient_id").alias(name))
    one = n(cohort, "cohort").crossJoin(n(final, "final")).crossJoin(n(excluded, "excluded"))  # one row each
    return one.withColumn("balanced", F.col("cohort") == F.col("final") + F.col("excluded"))


def duration_stats(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Upper median (the element at n div 2 of the sorted values) and integer mean, over run metrics of a group.

    Values are counted, and the counts sorted by range: sums of each task's rows tell in which of them the median lies, and
    only that one is looked through. No task needs a whole group.
    """
    counts = df.select(group, value.alias("__v")).where("__v IS NOT NULL").groupBy(group, "__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = cut(counts.repartitionByRange(group, "__v").withColumn("__part", F.spark_partition_id()), "sorted-values")
    parts = placed.groupBy(group, "__part").agg(F.sum("__n").alias("__m"), F.sum(F.col("__n") * F.col("__v")).alias("__s"))
    before = F.coalesce(F.sum("__m").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(group)  # a row a task
    seen = parts.select(group, "__part", "__m", before.alias("__b"), F.sum("__m").over(whole).alias("n"), F.sum("__s").over(whole).alias("__s"))
    here = seen.where("__b <= n div 2 AND n div 2 < __b + __m")
    running = F.col("__b") + F.sum("__n").over(Window.partitionBy(group, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.join(F.broadcast(here), [group, "__part"]).withColumn("__r", running).where("__r > n div 2")
    return found.groupBy(group).agg(F.min("__v").alias("median"), F.first(F.expr("__s div n")).alias("mean"), F.first("n").alias("n"))


def united_info(infos: DataFrame) -> DataFrame:
    """One row a resource (type, id) from several extraction infos of it: groups and, for each attribute, children united."""
    groups = infos.select("type", "id", F.explode("groups").alias("g")).groupBy("type", "id").agg(F.array_sort(F.collect_set("g")).alias("groups"))
    pairs = infos.select("type", "id", F.explode("refs").alias("attribute_ref", "c")).select("type", "id", "attribute_ref", F.explode("c").alias("child"))
    refs = pairs.groupBy("type", "id", "attribute_ref").agg(F.array_sort(F.collect_set("child")).alias("children"))
    return groups.join(refs.groupBy("type", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute_ref", "children")))).alias("refs")), ["type", "id"], "left")


def batch_labels(people: DataFrame, size: int) -> DataFrame:
    """people with `batch`: numbers from 0, `size` people each but for the last, in order of patient_id.

    Numbers come from counts for each range of ids, so people are never gathered in one task.
    """
    placed = cut(people.select("patient_id").distinct().repartitionByRange("patient_id").withColumn("__part", F.spark_partition_id()), "people")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    at = F.row_number().over(Window.partitionBy("__part").orderBy("patient_id")) - 1
    return placed.withColumn("__at", at).join(F.broadcast(counts.select("__part", before.alias("__b"))), "__part").select("patient_id", F.expr(f"CAST((__b + __at) div {size} AS INT)").alias("batch"))


def labelled(events: DataFrame, batches: DataFrame, core: str = "core") -> DataFrame:
    """events with `batch`: that of their patient (batches: patient_id, batch), or the name for what belongs to no patient."""
    own = batches.select("patient_id", F.col("batch").cast("string").alias("batch"))
    return events.join(own, "patient_id", "left").withColumn("batch", F.coalesce("batch", F.lit(core)))


def job_summary(cohort: DataFrame, final: DataFrame, patient_events: DataFrame, resource_events: DataFrame, inclusions: DataFrame, stages: Sequence[str]) -> DataFrame:
    """One row (and one JSON object when written): sizes, people excluded by stage, resources excluded and included by group."""
    as_map = lambda df, key, value: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)), lambda a, b: F.when(a[key] < b[key], -1).otherwise(1))).alias("m"))
    sizes = reconcile(cohort, final, patient_events).select(F.col("cohort").alias("Num-Cohort-Patients"), F.col("final").alias("Num-Final-Patients"))
    people = as_map(patient_exclusions(patient_events, stages), "stage", "patients").withColumnRenamed("m", "Patient-Exclusions")
    must = resource_events.where("reason = 'MUST_HAVE'").groupBy("group_id", "attribute_ref").agg(F.count(F.lit(1)).alias("n")).groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute_ref", "n")))).alias("mustHave"))
    other = resource_events.groupBy("group_id").agg(*(F.count_if(F.col("reason") == r).alias(r) for r in RESOURCE_REASONS[1:]))
    groups = as_map(other.join(must, "group_id", "left").select("group_id", F.struct("mustHave", *RESOURCE_REASONS[1:]).alias("s")), "group_id", "s").withColumnRenamed("m", "Resource-Exclusions")
    taken = as_map(inclusions.select("group_id", "resources"), "group_id", "resources").withColumnRenamed("m", "Resource-Inclusions")
    return sizes.crossJoin(people).crossJoin(groups).crossJoin(taken)  # a row each; keys are groups and stages
