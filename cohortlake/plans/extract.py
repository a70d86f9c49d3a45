"""A whole extraction as one plan: consent, load, references, cascade, survival, bundles and reports.

The people of a cohort are one set, not batches: every step is keyed by patient_id, core resources have none and are
fetched once whoever refers to them. Bodies are joined last; until then only keys move. What leaves is cut down to the
attributes of a record's groups and redacted by their profiles.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions import paths
from cohortlake.operators import cascade, codes, consent, load, redact, report, resolve, spec
from cohortlake.plans.lineage import cut, sized


@dataclass(frozen=True)
class Group:
    """What is asked of one kind of resource.

    must_have names attributes that need a value, in their order: element ids of the group's profile, or pairs of an attribute
    and its path (functions.paths) or a condition on the resource's columns. required_refs are attributes that need at least
    one reference of their own; whether its target is there is for `references` (must_have) to say. Either makes the group a
    required one. attributes are the element ids to copy; id, meta.profile and the link to the patient are copied anyway.
    """

    group_id: str
    resource_type: str
    profile: str | None = None
    codes: Sequence[tuple[str, str]] = ()
    low: datetime.date | None = None
    high: datetime.date | None = None
    must_have: Sequence[str | tuple[str, Column | str]] = field(default_factory=tuple)
    reference_only: bool = False
    required_refs: Sequence[str] = ()
    attributes: Sequence[str] = ()


@dataclass(frozen=True)
class Extraction:
    """The frames that come out of an extraction.

    groups has KEYS; links the surviving references (KEYS of the source, attribute_ref, child); resources the records with
    redacted bodies, or keys only where no shapes were given; rejected those that do not claim the profiles of their groups.
    counts were observed while these frames were written, so they cost no further pass: people who are left, `included` resources by
    group, `excluded` resources by (group, reason), `lost` people by stage.
    """

    people: DataFrame
    groups: DataFrame
    resources: DataFrame
    resource_exclusions: DataFrame
    patient_exclusions: DataFrame
    links: DataFrame
    rejected: DataFrame
    counts: Mapping[str, Any] = field(default_factory=dict)


KEYS = ["patient_id", "type", "id", "group_id"]
EVENT = ["reason", "group_id", "attribute_ref", "resource_id", "patient_id"]


def _observed(df: DataFrame, name: str, wanted: Mapping[Any, Column]) -> tuple[DataFrame, dict]:
    """df, written, and how many of its rows met each condition while they were."""
    if not wanted:
        return cut(df, name), {}
    seen = Observation(name)
    out = cut(df.observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"n{i}") for i, c in enumerate(wanted.values()))), name)
    return out, dict(zip(wanted, (seen.get[f"n{i}"] for i in range(len(wanted))), strict=True))


def _present(group: Group, shapes: Mapping[str, T.StructType] | None, profiles: Mapping[str, redact.Profile]) -> list[tuple[str, Column]]:
    """The group's must-have attributes with the condition that they have a value; paths are compiled over the shape of its type."""
    out = []
    for wanted in group.must_have:
        name, test = wanted if isinstance(wanted, tuple) else (wanted, None)
        if isinstance(test, Column):
            out.append((name, test))
            continue
        if shapes is None or group.resource_type not in shapes:
            raise ValueError(f"{name} is a path: {group.resource_type} needs a shape")
        if test is None:
            if group.profile not in profiles:
                raise ValueError(f"{name} is an element id: {group.group_id} needs a known profile")
            test = redact.path_of(name, profiles[group.profile])
        kind = shapes[group.resource_type]
        out.append((name, paths.has_value(test, F.from_json("body", kind), kind)))
    return out


def _loaded(resources: DataFrame, groups: Sequence[Group], shapes: Mapping[str, T.StructType] | None, profiles: Mapping[str, redact.Profile], codes: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """KEYS, valid, the first violated attribute and reference_only of all resources of all groups: one scan, in which each resource finds its groups."""
    found = []
    for g in groups:
        _, first = load.must_have(F.lit(True), _present(g, shapes, profiles))
        row = F.struct(F.lit(g.group_id).alias("group_id"), first.alias("attribute_ref"), F.lit(g.reference_only).alias("reference_only"))
        found.append(F.when(load.group_predicate(g.resource_type, g.profile, codes.get(g.group_id, g.codes), g.low, g.high), row))
    own = resources.where(F.col("resource_type").isin(sorted({g.resource_type for g in groups})))
    each = own.select("patient_id", F.col("resource_type").alias("type"), "id", F.explode_outer(F.array_compact(F.array(*found))).alias("g"))
    return each.where("g IS NOT NULL").select("patient_id", "type", "id", "g.group_id", F.col("g.attribute_ref").isNull().alias("valid"), "g.attribute_ref", "g.reference_only")


def _of_people(rows: DataFrame, people: DataFrame, core: Column | None = None) -> DataFrame:
    """rows of people (written), and those of nobody (that meet `core`): apart, as a join would bring all of these to one task."""
    nobody = F.col("patient_id").isNull()
    return rows.join(sized(people), "patient_id", "left_semi").unionByName(rows.where(nobody if core is None else core & nobody))


def _widened(groups: Sequence[Group], tree: DataFrame | None) -> dict[str, list[tuple[str, str]]]:
    """Each group's filter codes with all below them in the tree; what comes back is part of the request."""
    wanted = sorted({c for g in groups for c in g.codes})
    if tree is None or not wanted:
        return {}
    below: dict[tuple[str, str], list] = {}
    for r in codes.expand(tree.sparkSession.createDataFrame(wanted, "system string, code string"), tree).collect():
        below.setdefault((r["system"], r["root"]), []).append((r["system"], r["code"]))
    return {g.group_id: sorted({x for c in g.codes for x in below.get(tuple(c), [tuple(c)])}) for g in groups}


def _without_references(loaded: DataFrame, references: DataFrame, groups: Sequence[Group]) -> DataFrame:
    """loaded, where resources that lack a reference in one of their group's required_refs are violated by the first such attribute."""
    needs = [(g.group_id, g.resource_type, n, a) for g in groups for n, a in enumerate(g.required_refs)]
    if not needs:
        return loaded
    wanted = loaded.sparkSession.createDataFrame(needs, "group_id string, type string, ord int, attribute_ref string")
    have = references.select(F.col("patient_id").alias("__p"), F.col("src_type").alias("__t"), F.col("src_id").alias("__i"), F.col("group_id").alias("__g"), F.col("attribute_ref").alias("__a")).distinct()
    asked = loaded.select("patient_id", "type", "id", "group_id").join(F.broadcast(wanted), ["group_id", "type"])  # a row a required attribute
    met = asked.join(have, F.expr("patient_id <=> __p AND type = __t AND id = __i AND group_id = __g AND attribute_ref = __a"), "left_anti")
    first = met.groupBy(F.col("patient_id").alias("__p"), F.col("type").alias("__t"), F.col("id").alias("__i"), F.col("group_id").alias("__g")).agg(F.min_by("attribute_ref", "ord").alias("__bare"))
    out = loaded.join(first, F.expr("patient_id <=> __p AND type = __t AND id = __i AND group_id = __g"), "left").drop("__p", "__t", "__i", "__g")
    return out.withColumns({"valid": F.col("valid") & F.col("__bare").isNull(), "attribute_ref": F.coalesce("attribute_ref", "__bare")}).drop("__bare")


def _events(rows: DataFrame, reason: str, resource_id: Column) -> DataFrame:
    return rows.select(F.lit(reason).alias("reason"), "group_id", F.col("attribute_ref").cast("string").alias("attribute_ref"), resource_id.alias("resource_id"), "patient_id")


def _required(cohort: DataFrame, references: DataFrame, groups: Sequence[Group], patient_types: Sequence[str]) -> tuple[list[str], list[str]]:
    """The direct groups with required attributes: those on the patients' side, and core ones; by type, whatever was loaded.

    An attribute is required by the group's own word, or by that of the references out of it.
    """
    spark = cohort.sparkSession
    open_ = [g.group_id for g in groups if not (g.must_have or g.required_refs or g.reference_only)]  # only these need to be looked up
    told = {r["group_id"] for r in references.where(F.col("must_have") & F.col("group_id").isin(open_)).select("group_id").distinct().collect()} if open_ else set()  # a row a group
    table = spark.createDataFrame([(g.group_id, g.resource_type, g.reference_only) for g in groups if g.must_have or g.required_refs or g.group_id in told], "group_id string, type string, reference_only boolean")
    roles = {r["group_id"]: r["role"] for r in spec.split_groups(table, spark.createDataFrame([(t,) for t in patient_types], "type string")).collect()}  # a row a group
    patient, core = ([g.group_id for g in groups if roles.get(g.group_id) == role] for role in ("direct_patient", "direct_core"))
    return patient, core


def extract(
    cohort: DataFrame, resources: DataFrame, references: DataFrame, groups: Sequence[Group], windows: DataFrame | None = None, patient_types: Sequence[str] = spec.PATIENT_TYPES,
    shapes: Mapping[str, T.StructType] | None = None, profiles: Mapping[str, redact.Profile] | None = None, date_fields: Mapping[str, str] = consent.DATE_FIELDS,
    code_tree: DataFrame | None = None, copy_order: Sequence[Column] | None = None,
) -> Extraction:
    """Runs all steps; references is as in operators.resolve, windows as from operators.consent.

    With windows, records need consent by their type (consent.consented_by_type). Everyone needs a fulfilled resource in each
    required group of a patient-side type: at load, and again after the cascade. A required core group that no core resource fulfils, at load or after the
    cascade, fails the extraction (ValueError). shapes are the struct types of bodies by resource type; with them bodies are
    copied and redacted, and every group needs its profile among `profiles` (by url). With a code_tree (system, parent, child) a
    filter's codes stand for all below them. Of several copies of a resource the first by copy_order counts (load.without_copies).

    Reasons of exclusion: MUST_HAVE (an attribute has no value, or no usable target), CONSENT, REFERENCE_NOT_FOUND (no target
    under the linked group's filters), RESOURCE_OUTSIDE_BATCH (it is another patient's, or a core record refers to a
    patient's) and CASCADING_DELETE.
    """
    people = cut(cohort.select("patient_id").distinct(), "cohort")
    lost = people.limit(0).select("patient_id", F.lit("").alias("stage"))
    if windows is not None:
        windows = cut(windows, "windows")
        kept = cut(people.join(windows.select("patient_id").distinct(), "patient_id", "left_semi"), "consenting")
        lost = lost.union(people.join(kept, "patient_id", "left_anti").select("patient_id", F.lit("CONSENT_FETCH")))
        people = kept
    required, required_core = _required(cohort, references, groups, patient_types)
    resources = load.without_copies(resources, copy_order)
    found = cut(_loaded(resources, groups, shapes, profiles or {}, _widened(groups, code_tree)), "found")  # bodies are read once
    core = [r["group_id"] for r in found.where("patient_id IS NULL").select("group_id").distinct().collect()]  # a row a group
    references = cut(_of_people(references, people, F.col("group_id").isin(core)), "own-references")
    loaded = _without_references(_of_people(found, people), references, groups)
    identity = F.concat_ws("/", "type", "id")
    excluded = []
    if windows is not None:
        dated = [c for c in ("periods", "period_start", "period_end") if c in resources.columns]
        side = resources.select("patient_id", "resource_type", "id", *dated).join(sized(people), "patient_id", "left_semi")
        allowed = consent.consented_by_type(side, windows, dict(date_fields)).select("patient_id", F.col("resource_type").alias("type"), "id").distinct().withColumn("__ok", F.lit(True))
        marked = cut(loaded.join(allowed, ["patient_id", "type", "id"], "left"), "consented")
        excluded.append(_events(marked.where("patient_id IS NOT NULL AND __ok IS NULL AND NOT reference_only").withColumn("attribute_ref", F.lit(None)), "CONSENT", identity))
        loaded = marked.where("patient_id IS NULL OR __ok").drop("__ok")
        unconsented = marked.where("patient_id IS NOT NULL AND __ok IS NULL")
    else:
        unconsented = None
    loaded = cut(loaded, "loaded")
    if required_core:
        load.require_core(loaded.where("patient_id IS NULL").withColumn("fulfilled", F.col("valid")), required_core)
    kept = load.survivors(people, loaded.withColumn("fulfilled", F.col("valid")), required)
    lost = lost.union(people.join(kept, "patient_id", "left_anti").select("patient_id", F.lit("DIRECT_LOAD")))
    people = cut(kept, "survivors")
    excluded.append(_events(loaded.where("NOT valid AND NOT reference_only"), "MUST_HAVE", identity))

    own = cut(_of_people(loaded, people), "own")
    seeds = own.where("valid AND NOT reference_only")
    reached = resolve.closure(seeds, references, own.select("type", "id", "patient_id", "group_id", "valid"))
    node = F.concat_ws("|", F.coalesce(F.col("patient_id").cast("string"), F.lit("")), "type", "id", "group_id")
    same = [reached[c].eqNullSafe(own[c]) for c in KEYS]
    members = cut(own.join(reached, same, "left_semi").withColumn("node", node), "members")
    ends = references.select("patient_id", "src_type", "src_id", "group_id", "attribute_ref", "must_have", "linked_group", "dst_type", "dst_id")
    parents = members.select("node", F.col("patient_id").alias("__p"), F.col("type").alias("src_type"), F.col("id").alias("src_id"), "group_id")
    asked = cut(parents.join(ends, ["src_type", "src_id", "group_id"]).where("__p <=> patient_id").drop("__p"), "asked")
    children = members.select(F.col("node").alias("child"), F.col("patient_id").alias("__c"), F.col("type").alias("__t"), F.col("id").alias("__i"), F.col("group_id").alias("__g"))
    # the owner belongs to the join: a reference that only reaches another patient's record stays, without a child
    linked = asked.join(children, F.expr("dst_type = __t AND dst_id = __i AND linked_group = __g AND (__c IS NULL OR __c <=> patient_id)"), "left")
    attribute = F.concat_ws("|", F.coalesce(F.col("patient_id").cast("string"), F.lit("")), "src_type", "src_id", "attribute_ref")
    edges = cut(linked.select(F.col("node").alias("parent"), attribute.alias("attribute"), F.coalesce("child", F.lit("")).alias("child"), "must_have", "attribute_ref", "dst_type", "dst_id"), "graph-edges")

    # what is missing at the end of a reference, and why
    target = F.concat_ws("/", "dst_type", "dst_id")
    under = own.select(F.col("type").alias("__t"), F.col("id").alias("__i"), F.col("group_id").alias("__g"), F.col("patient_id").alias("__o"), F.col("valid").alias("__v"), F.col("attribute_ref").alias("__a"))
    at_target = F.expr("dst_type = __t AND dst_id = __i AND linked_group = __g")
    met = asked.join(under, at_target, "left").select("patient_id", F.col("linked_group").alias("group_id"), "attribute_ref", "dst_type", "dst_id", "__t", "__o", "__v", "__a")
    foreign = F.expr("__o IS NOT NULL AND NOT (__o <=> patient_id)")
    met = cut(met.distinct(), "targets")
    gap = met.where("__t IS NULL").select("patient_id", "group_id", "attribute_ref", "dst_type", "dst_id")
    if unconsented is not None:
        held = unconsented.select(F.col("patient_id").alias("__o"), F.col("type").alias("__t"), F.col("id").alias("__i"), F.col("group_id").alias("__g"))
        without = gap.join(held, F.expr("dst_type = __t AND dst_id = __i AND group_id = __g"), "left_semi")
        excluded.append(_events(without, "CONSENT", target))
        gap = gap.join(held, F.expr("dst_type = __t AND dst_id = __i AND group_id = __g"), "left_anti")
    excluded.append(_events(gap, "REFERENCE_NOT_FOUND", target))
    excluded.append(_events(met.where(foreign), "RESOURCE_OUTSIDE_BATCH", target))
    excluded.append(_events(met.where(~F.coalesce(foreign, F.lit(False)) & ~F.col("__v")).withColumn("attribute_ref", F.col("__a")), "MUST_HAVE", target).distinct())

    # attributes that need a reference whose target is usable; those without any were violated at load
    live = edges.where("child <> ''").select("attribute").distinct()
    unmet = edges.where("must_have").join(live, "attribute", "left_anti").select(F.col("parent").alias("node"), "attribute_ref")
    broken = cut(unmet.distinct(), "unmet")
    violated = broken.groupBy("node").agg(F.min("attribute_ref").alias("attribute_ref"))
    excluded.append(_events(members.drop("attribute_ref").join(violated, "node"), "MUST_HAVE", identity))
    nothing = members.sparkSession.createDataFrame([("", True, False)], "node string, reference_only boolean, valid boolean")  # stands for targets that are not there
    start = members.join(violated.select("node", F.lit(True).alias("__v")), "node", "left").select("node", "reference_only", (F.col("valid") & F.col("__v").isNull()).alias("valid"))
    nodes = cut(start.unionByName(nothing), "graph-nodes")
    graph = edges.select("parent", "attribute", "child", "must_have")
    gone = cut(cascade.cascade(nodes, graph), "cascaded")
    nodes = nodes.join(gone.withColumn("__gone", F.lit(True)), "node", "left").select("node", "reference_only", (F.col("valid") & F.col("__gone").isNull()).alias("valid"))
    # nothing founded refers to what is afloat, so removing that violates nobody
    afloat = cascade.unfounded(nodes, graph)
    fallen = gone.union(afloat)
    excluded.append(_events(members.join(fallen, "node", "left_semi").withColumn("attribute_ref", F.lit(None)), "CASCADING_DELETE", identity))
    valid = members.where("valid").join(violated.select("node").union(fallen), "node", "left_anti")

    if required_core:
        load.require_core(valid.where("patient_id IS NULL").withColumn("fulfilled", F.col("valid")), required_core)
    kept = cascade.group_survivors(people, valid, required)
    lost = lost.union(people.join(kept, "patient_id", "left_anti").select("patient_id", F.lit("CASCADING_DELETE")))
    kept, left = _observed(kept, "people", {"people": F.lit(True)})
    taken = valid.join(kept, "patient_id", "left_semi").unionByName(valid.where("patient_id IS NULL")).select(*KEYS, "node")
    final, included = _observed(taken, "extracted", {g.group_id: F.col("group_id") == g.group_id for g in groups})
    ok = final.select(F.col("node").alias("child"))
    links = final.withColumnRenamed("node", "parent").join(edges, "parent").join(ok, "child", "left_semi").select(*KEYS, "attribute_ref", target.alias("child")).distinct()
    events = excluded[0]
    for e in excluded[1:]:
        events = events.unionByName(e)
    events, why = _observed(events, "exclusions", {(g.group_id, r): (F.col("group_id") == g.group_id) & (F.col("reason") == r) for g in groups for r in report.RESOURCE_REASONS})
    lost, stages = _observed(lost, "lost", {s: F.col("stage") == s for s in report.PATIENT_STAGES})
    counts = {**left, "included": included, "excluded": why, "lost": stages}
    out, rejected = _bodies(resources, final, links, groups, shapes, profiles or {}, patient_types)
    return Extraction(kept, final.select(*KEYS), out, events, lost, links, rejected, counts)


def _bodies(resources: DataFrame, final: DataFrame, links: DataFrame, groups: Sequence[Group], shapes: Mapping[str, T.StructType] | None, profiles: Mapping[str, redact.Profile], patient_types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Records cut down and redacted, and those rejected; keys only where no shapes are given."""
    keys = final.groupBy("patient_id", "type", "id").agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    bare = keys.select("patient_id", F.col("type").alias("resource_type"), "id")
    if shapes is None:
        return bare, bare.limit(0)
    refs = resolve.allowed_references(links)
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("patient_id", "type", "id")]
    keyed = cut(keys.alias("k").join(refs.alias("r"), same, "left").select("k.*", "r.refs"), "keyed")
    out = None
    for kind in dict.fromkeys(g.resource_type for g in groups):
        own = [g for g in groups if g.resource_type == kind]
        unknown = sorted({str(g.profile) for g in own if g.profile not in profiles})
        if kind not in shapes or unknown:
            raise ValueError(f"{kind} needs a shape and known profiles ({', '.join(unknown)})")
        side = [f"{kind}.{n}" for n in ("patient", "subject")] if kind in patient_types and kind != "Patient" else []
        always = [f"{kind}.id", f"{kind}.meta.profile", f"{kind}.resourceType"]
        taken = [redact.Selection(g.group_id, profiles[g.profile], tuple(dict.fromkeys([*always, *(a for a in side if a in profiles[g.profile].by_id), *g.attributes]))) for g in own]
        mine = keyed.where(F.col("type") == kind)
        self_ref = F.array(F.concat(F.lit("Patient/"), F.col("patient_id").cast("string")))
        if side:
            extra = F.create_map(*(x for a in side for x in (F.lit(a), self_ref)))
            have = F.coalesce("refs", F.create_map().cast("map<string,array<string>>"))
            mine = mine.withColumn("refs", F.map_concat(F.map_filter(have, lambda k, _: ~k.isin(side)), extra))
        body = resources.where(F.col("resource_type") == kind).select(F.col("patient_id").alias("__p"), "id", "body")
        records = mine.join(body, "id").where("__p <=> patient_id").drop("__p")
        if any(redact.asks_targets(t.profile, t.element_ids) for t in taken):
            told = resolve.conformance(resources.where(F.col("resource_type") == kind).join(mine.select("id").distinct(), "id", "left_semi"), resources)
            records = records.join(told.select(F.col("patient_id").alias("__p"), F.col("id").alias("__i"), "conforms"), F.expr("id = __i AND patient_id <=> __p"), "left").drop("__p", "__i")
        # written as texts: only those that are taken are read as structs, and their sets of groups are found without another join
        records = cut(records, "taken").withColumn("body", F.from_json("body", shapes[kind]))
        done = redact.copy_and_redact(records, kind, shapes[kind], taken).select("patient_id", F.col("type").alias("resource_type"), "id", "body", "complete")
        out = done if out is None else out.unionByName(done)
    out = cut(out, "redacted")
    return out.where("complete").drop("complete"), out.where("NOT complete").select("patient_id", "resource_type", "id")


def summary(out: Extraction, cohort: DataFrame) -> DataFrame:
    """Sizes of an extraction, and whether cohort = final + excluded."""
    return report.reconcile(cohort, out.people, out.patient_exclusions)


def job_summary(out: Extraction, cohort: DataFrame) -> DataFrame:
    """The one-row report of an extraction."""
    taken = report.inclusion_counts(out.groups)
    return report.job_summary(cohort, out.people, out.patient_exclusions, out.resource_exclusions, taken, report.PATIENT_STAGES)
