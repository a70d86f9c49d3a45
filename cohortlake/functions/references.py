"""Resource keys: relative references, patient ids and profile urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_reference(ref: Column) -> Column:
    """STRUCT<type, id> of a relative reference `Type/id`; NULL for absolute, urn, blank or malformed ones."""
    kind, ident = F.substring_index(ref, "/", 1), F.substring_index(ref, "/", -1)
    apart = F.length(kind) + F.length(ident) + 1 == F.length(ref)  # by one slash, and no other
    bad = ~apart | ref.startswith("urn:") | (F.trim(kind) == "") | (F.trim(ident) == "")
    return F.when(ref.isNotNull() & ~bad, F.struct(kind.alias("type"), ident.alias("id")))


def strip_version(url: Column) -> Column:
    """A profile url without `|version`."""
    return F.substring_index(url, "|", 1)


def claims_profile(profiles: Column, url: Column) -> Column:
    """Whether one of the profiles, without its version, is exactly url."""
    return F.exists(profiles, lambda p: strip_version(p) == url)


def patient_of(resource_type: Column, ident: Column, body: Column) -> Column:
    """The patient a resource belongs to: its own id, else the target of `patient` (consents) or `subject`."""
    at = F.when(resource_type == "Consent", F.get_json_object(body, "$.patient.reference")).otherwise(F.get_json_object(body, "$.subject.reference"))
    target = parse_reference(at)
    return F.when(resource_type == "Patient", ident).when(target["type"] == "Patient", target["id"])


def nested_references(json: Column) -> Column:
    """All reference strings anywhere below an element given as JSON text."""
    return F.regexp_extract_all(json, F.lit(r'"reference"\s*:\s*"([^"]+)"'), 1)
