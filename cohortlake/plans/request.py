"""An extraction from the rows of one request: what they ask for as groups, references out of bodies, consent, and the run.

groups: group_id, profile_url, type, reference_only. attributes: group_id, attribute_ref, must_have, linked_groups. filters:
group_id, kind (token, date), codes (array of system, code), start, end. elements is the catalogue of profiles (as
sources.readers.profile_elements). What comes to the driver is the request itself and the elements of its own profiles.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions import paths
from cohortlake.functions.references import nested_references, parse_reference
from cohortlake.operators import consent, redact, spec
from cohortlake.plans import extract as plan
from cohortlake.plans.lineage import cut


@dataclass(frozen=True)
class Link:
    """An attribute whose references lead to resources of a linked group."""

    group_id: str
    resource_type: str
    attribute_ref: str
    path: str
    must_have: bool
    linked_group: str
    linked_type: str


@dataclass(frozen=True)
class Request:
    groups: tuple[plan.Group, ...]
    links: tuple[Link, ...]
    profiles: Mapping[str, redact.Profile]


@dataclass(frozen=True)
class Consent:
    """What decides about consent: provisions (as in operators.consent), rules (as sources.readers.consent_rules), the codes that are
    asked for (code), the day on which gates are tested, and encounters (patient_id, start, end) that provisions may begin with.
    """

    provisions: DataFrame
    rules: DataFrame
    asked: DataFrame
    as_of: datetime.date
    encounters: DataFrame | None = None

    def windows(self) -> DataFrame:
        return consent.job_windows(self.provisions, self.rules, self.asked, self.as_of, self.encounters)


def checked(groups: DataFrame, attributes: DataFrame, filters: DataFrame, elements: DataFrame, domain_types: Sequence[str], patient_types: Sequence[str] = spec.PATIENT_TYPES) -> None:
    """ValueError with the rules (operators.spec.violations) that the request breaks."""
    named = (df.withColumn("spec_id", F.lit(0)) for df in (groups, attributes, filters))
    found = spec.violations(*named, elements, domain_types, patient_types).collect()  # a row a broken rule
    if found:
        raise ValueError("; ".join(sorted(f"{r['rule']}: {r['group_id'] or '-'} {r['attribute_ref'] or ''}".strip() for r in found)))


def read(groups: DataFrame, attributes: DataFrame, filters: DataFrame, elements: DataFrame) -> Request:
    """The request as groups and links.

    Must-have attributes keep the order of `ord`, where attributes has it. Those with linked groups are required references, the others
    are tested by their paths. Fields that tell slices apart are added (spec.discriminator_attributes). Of several date filters the
    first counts; codes of all token filters of a group count together.
    """
    asked = {r["group_id"]: r for r in groups.collect()}
    order = ["ord"] if "ord" in attributes.columns else []
    own = elements.join(F.broadcast(groups.select("profile_url").distinct()), "profile_url", "left_semi").collect()
    profiles = {u: redact.profile_of(u, [e for e in own if e["profile_url"] == u]) for u in {r["profile_url"] for r in asked.values()}}
    named = (df.withColumn("spec_id", F.lit(0)) for df in (attributes.select("group_id", "attribute_ref"), groups))
    more = [(r["group_id"], r["attribute_ref"]) for r in spec.discriminator_attributes(*named, elements).collect()]
    rows = attributes.orderBy(*order).collect()
    limits = filters.collect()
    out, links = [], []
    for g, r in sorted(asked.items()):
        profile = profiles[r["profile_url"]]
        mine = [a for a in rows if a["group_id"] == g]
        linked = [a for a in mine if a["linked_groups"]]
        for a in linked:
            path = redact.path_of(a["attribute_ref"], profile)
            links += [Link(g, r["type"], a["attribute_ref"], path, bool(a["must_have"]), to, asked[to]["type"]) for to in a["linked_groups"]]
        tokens = [(c["system"], c["code"]) for f in limits if f["group_id"] == g and f["kind"] == "token" for c in f["codes"] or ()]
        day = next((f for f in limits if f["group_id"] == g and f["kind"] == "date"), None)
        out.append(plan.Group(
            g, r["type"], r["profile_url"], tuple(tokens), day["start"] if day else None, day["end"] if day else None, tuple(a["attribute_ref"] for a in mine if a["must_have"] and not a["linked_groups"]),
            bool(r["reference_only"]), tuple(a["attribute_ref"] for a in linked if a["must_have"]), tuple(dict.fromkeys([*(a["attribute_ref"] for a in mine), *(x for to, x in more if to == g)])),
        ))
    return Request(tuple(out), tuple(links), profiles)


def references(resources: DataFrame, links: Sequence[Link], shapes: Mapping[str, T.StructType]) -> DataFrame:
    """The references that lie at or below the links' attributes, as operators.resolve takes them: one scan, a row a reference and linked group of its type."""
    found = []
    for x in links:
        if x.resource_type not in shapes:
            raise ValueError(f"{x.attribute_ref} is a path: {x.resource_type} needs a shape")
        kind = shapes[x.resource_type]
        texts = F.flatten(F.transform(paths.values(x.path, F.from_json("body", kind), kind), nested_references))
        told = [F.lit(v).alias(k) for k, v in (("group_id", x.group_id), ("attribute_ref", x.attribute_ref), ("must_have", x.must_have), ("linked_group", x.linked_group), ("linked_type", x.linked_type))]
        found.append(F.when(F.col("resource_type") == x.resource_type, F.struct(*told, F.array_distinct(texts).alias("refs"))))
    kind = "struct<group_id: string, attribute_ref: string, must_have: boolean, linked_group: string, linked_type: string, refs: array<string>>"
    rows = resources.where(F.col("resource_type").isin(sorted({x.resource_type for x in links})))
    each = rows.select("patient_id", F.col("resource_type").alias("src_type"), F.col("id").alias("src_id"), F.explode_outer(F.array_compact(F.array(*found)).cast(f"array<{kind}>")).alias("l"))
    named = each.select("patient_id", "src_type", "src_id", "l.*").withColumn("ref", F.explode_outer("refs"))
    parsed = named.withColumn("t", parse_reference(F.col("ref"))).where("t.type = linked_type")
    return parsed.select("patient_id", "src_type", "src_id", "group_id", "attribute_ref", "must_have", "linked_group", F.col("t.type").alias("dst_type"), F.col("t.id").alias("dst_id"))


def run(cohort: DataFrame, resources: DataFrame, request: Request, shapes: Mapping[str, T.StructType], asked: Consent | None = None, code_tree: DataFrame | None = None, patient_types: Sequence[str] = spec.PATIENT_TYPES, copy_order: Sequence[Column] | None = None) -> plan.Extraction:
    """The whole extraction of a request; see plans.extract.extract. With `asked` only what its windows cover is taken."""
    refs = cut(references(resources, request.links, shapes), "references")  # bodies are taken apart once
    windows = asked.windows() if asked is not None else None
    return plan.extract(cohort, resources, refs, request.groups, windows, patient_types, shapes, request.profiles, code_tree=code_tree, copy_order=copy_order)
