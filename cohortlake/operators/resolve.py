"""Following references to a fixpoint.

references: src_type, src_id, patient_id, group_id, attribute_ref, must_have, linked_group, dst_type, dst_id.
targets: type, id, patient_id (null for core), group_id, valid: what each linked group's filters and checks let through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.references import nested_references, parse_reference, strip_version
from cohortlake.plans.lineage import cut, sized

#: Depth is the longest chain of references, not the size of the data.
MAX_ROUNDS = 100


def link_groups(references: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each reference and linked group of its type; references has linked_groups, groups has group_id and type."""
    wide = references.withColumn("linked_group", F.explode("linked_groups")).drop("linked_groups")
    named = groups.select(F.col("group_id").alias("linked_group"), F.col("type").alias("dst_type"))
    return wide.join(F.broadcast(named), ["linked_group", "dst_type"])


def usable(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References whose target is there under the linked group and is core or belongs to the same patient; core resources may not refer to patients."""
    t = targets.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id"), F.col("group_id").alias("linked_group"), F.col("patient_id").alias("__owner"), "valid")
    return references.join(t, ["dst_type", "dst_id", "linked_group"]).where("__owner IS NULL OR __owner <=> patient_id")


def not_found(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References without a target under their linked group's filters."""
    t = targets.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id"), F.col("group_id").alias("linked_group"))
    return references.join(t, ["dst_type", "dst_id", "linked_group"], "left_anti")


def required_references(references: DataFrame, valid: DataFrame) -> DataFrame:
    """Resource groups (src_type, src_id, group_id) that lose: a must-have attribute without any valid target."""
    keys = ["src_type", "src_id", "group_id", "attribute_ref"]
    ok = valid.where("valid").select(*keys).distinct()
    return references.where("must_have").select(*keys).distinct().join(ok, keys, "left_anti").select("src_type", "src_id", "group_id").distinct()


def _labels(names: DataFrame, out: str) -> DataFrame:
    """The distinct rows of names, few as a request's groups and attributes are, with a number each.

    Rows that carry numbers take a fraction of the memory of rows that carry names: these shrink so far in a shuffle that Spark, which
    deals rows by their size there, puts too many of them in one task.
    """
    rows = [tuple(r) for r in names.distinct().collect()]  # a row a group, or an attribute of one
    return names.sparkSession.createDataFrame([(*r, n) for n, r in enumerate(rows)], T.StructType([*names.schema.fields, T.StructField(out, T.IntegerType())]))


def _labelled(rows: DataFrame, labels: DataFrame, names: Sequence[str], how: str = "inner", nulls: bool = False) -> DataFrame:
    """rows with the number of their names (those of labels, in that order) in the place of them; with nulls, a missing name is one of its own."""
    own = labels.toDF(*(f"__{n}" for n in range(len(names))), labels.columns[-1])
    same = [rows[c].eqNullSafe(own[f"__{n}"]) if nulls else rows[c] == own[f"__{n}"] for n, c in enumerate(names)]
    return rows.join(F.broadcast(own), same, how).drop(*names, *(f"__{n}" for n in range(len(names))))


def unmet(references: DataFrame, targets: DataFrame) -> DataFrame:
    """required_references of references and the usable ones among them, by numbers in the place of names."""
    names = ["src_type", "group_id", "attribute_ref"]
    refs = references.select(*names, "src_id", "patient_id", "must_have", "dst_type", "linked_group", "dst_id")
    sources = _labels(refs.select(*names), "__from")
    ends = _labels(targets.select("type", "group_id"), "__to")
    rows = _labelled(_labelled(refs, sources, names, nulls=True), ends, ["dst_type", "linked_group"], "left")
    held = _labelled(targets.where("valid").select("type", "group_id", F.col("id").alias("__id"), F.col("patient_id").alias("__owner")), ends, ["type", "group_id"])
    held = held.select(F.col("__to").alias("__at"), "__id", "__owner", F.lit(True).alias("__ok"))
    met = rows.join(held, F.expr("__to = __at AND dst_id = __id AND (__owner IS NULL OR __owner <=> patient_id)"), "left")
    told = met.groupBy("__from", "src_id").agg(F.bool_or("must_have").alias("must_have"), F.bool_or("__ok").alias("__ok")).where("must_have")
    # as in a join, what has no name is not found
    lost = told.join(F.broadcast(sources), "__from").where(F.col("__ok").isNull() | F.col("src_id").isNull() | F.expr(" OR ".join(f"{n} IS NULL" for n in names)))
    return lost.select("src_type", "src_id", "group_id").distinct()


def fetch(keys: DataFrame, store: DataFrame) -> DataFrame:
    """The resources of store with the keys (type, id), each once, without any filter.

    Only keys move if the store is a table bucketed by type and id (sources.sinks.write_store).
    """
    wanted = keys.select(F.col("type").alias("resource_type"), "id").where("resource_type IS NOT NULL AND trim(id) <> ''").distinct()
    return store.join(wanted, ["resource_type", "id"], "left_semi")


def missing_core(links: DataFrame, present: DataFrame, patient_types: Sequence[str]) -> DataFrame:
    """(type, id): what references (`child`, as Type/id) lead to on the core side and is not among present (type, id), each once.

    Absolute and malformed references are left out.
    """
    parsed = links.select(parse_reference(F.col("child")).alias("r")).where("r IS NOT NULL").select("r.type", "r.id")
    return parsed.where(~F.col("type").isin(list(patient_types))).distinct().join(present.select("type", "id"), ["type", "id"], "left_anti")


def completed_core(links: DataFrame, present: DataFrame, store: DataFrame, patient_types: Sequence[str]) -> DataFrame:
    """The core resources that links of any patient lead to and that are not present yet, fetched once for all patients."""
    return fetch(missing_core(links, present, patient_types), store).where("patient_id IS NULL")


def conformance(records: DataFrame, resources: DataFrame) -> DataFrame:
    """patient_id, id, conforms: for each record (patient_id, id, body) a map from its references, ascending, to the profiles that their targets claim.

    resources has resource_type, id, patient_id, profiles; a target is core or of the record's own patient. Records without such
    a reference are left out. Only references and profiles move, and each reference of a record once.
    """
    refs = records.select(F.col("patient_id").alias("__p"), F.col("id").alias("__i"), F.explode(F.array_distinct(nested_references(F.col("body")))).alias("__ref"))
    named = refs.withColumn("__t", parse_reference(F.col("__ref"))).where("__t IS NOT NULL")
    claims = resources.where(F.size("profiles") > 0).select(F.col("resource_type").alias("__type"), "id", F.col("patient_id").alias("__owner"), F.transform("profiles", strip_version).alias("__profiles"))
    met = named.join(claims, (F.col("__t.type") == F.col("__type")) & (F.col("__t.id") == F.col("id"))).where("__owner IS NULL OR __owner <=> __p")
    one = met.groupBy("__p", "__i", "__ref").agg(F.array_distinct(F.flatten(F.collect_list("__profiles"))).alias("__profiles"))
    return one.groupBy(F.col("__p").alias("patient_id"), F.col("__i").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__ref", "__profiles")))).alias("conforms"))


def allowed_references(links: DataFrame) -> DataFrame:
    """patient_id, type, id, refs: for each record that links (with attribute_ref and child) lead out of, a map from its attributes to their
    children, ascending. What is grouped is no larger than the record's own body; links of no patient stay together.
    """
    one = links.groupBy("patient_id", "type", "id", "attribute_ref").agg(F.array_sort(F.collect_set("child")).alias("c"))
    return one.groupBy("patient_id", "type", "id").agg(F.map_from_entries(F.collect_list(F.struct("attribute_ref", "c"))).alias("refs"))


def closure(seeds: DataFrame, references: DataFrame, targets: DataFrame) -> DataFrame:
    """(patient_id, type, id, group_id) reached from the seeds over usable references; what is known is not followed again.

    A core resource is reached once, without a patient, whoever refers to it.
    """
    labels = _labels(seeds.select("type", "group_id").union(targets.select("type", "group_id")), "label")
    refs = references.select("patient_id", "src_type", "src_id", "group_id", "linked_group", "dst_type", "dst_id")
    refs = _labelled(refs, labels, ["src_type", "group_id"]).withColumnRenamed("label", "src")
    refs = _labelled(refs, labels, ["dst_type", "linked_group"]).withColumnRenamed("label", "dst")
    held = _labelled(targets.where("valid").select("type", "group_id", F.col("id").alias("__id"), F.col("patient_id").alias("dst_patient")), labels, ["type", "group_id"])
    steps = refs.join(held, F.expr("dst = label AND dst_id = __id AND (dst_patient IS NULL OR dst_patient <=> patient_id)"))
    steps = cut(steps.select("patient_id", "src", "src_id", "dst_patient", "dst", "dst_id").distinct(), "reference-steps")
    leading = [r["src"] for r in steps.select("src").distinct().collect()]  # a row a group; what is of another one is reached, but not followed
    columns = ["patient_id", "label", "id"]
    known = frontier = cut(_labelled(seeds.select("patient_id", "type", "id", "group_id"), labels, ["type", "group_id"], nulls=True).select(*columns).distinct(), "resolved")
    for _ in range(MAX_ROUNDS):
        follow = frontier.where(F.col("label").isin(leading))
        if follow.isEmpty():
            return known.join(F.broadcast(labels), "label").select("patient_id", "type", "id", "group_id")
        near = sized(follow.toDF(*(f"__{c}" for c in columns)))
        found = steps.join(near, F.expr("patient_id <=> __patient_id AND src = __label AND src_id = __id")).select(F.col("dst_patient").alias("patient_id"), F.col("dst").alias("label"), F.col("dst_id").alias("id")).distinct()
        same = [found[c].eqNullSafe(known[c]) for c in columns]
        frontier = cut(found.join(known.hint("merge"), same, "left_anti"), "resolved")
        known = known.union(frontier)
    raise RuntimeError(f"references did not settle in {MAX_ROUNDS} rounds")
