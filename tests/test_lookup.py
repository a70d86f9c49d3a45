"""Look-ups in ascending lists and maps, and records of very many references."""

import time

from pyspark.sql import functions as F

from cohortlake.functions import lookup
from cohortlake.operators import redact, resolve
from cohortlake.operators.redact import Element, Profile, Selection


def test_lists_and_maps_of_all_sizes(spark):
    asked = ["", "k", *(f"k{n:04}" for n in range(0, 90)), "z", None]
    rows = [(sorted(f"k{n:04}" for n in range(1, 2 * size, 2)), x) for size in (0, 1, 2, 3, 15, 16, 17, 31, 32, 33, 40) for x in asked]
    df = spark.createDataFrame(rows, "v array<string>, x string").withColumn("m", F.map_from_arrays("v", F.transform("v", lambda s: F.concat(s, F.lit("!")))))
    got = df.select("v", "x", lookup.contains(F.col("v"), F.col("x")).alias("has"), lookup.value_of(F.col("m"), F.col("x")).alias("at"), lookup.place(F.col("v"), F.col("x")).alias("place")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["has"] == (r["x"] in r["v"]) and r["at"] == (r["x"] + "!" if r["has"] else None)
        assert r["x"] is None or r["place"] == sum(v < r["x"] for v in r["v"])


def test_record_of_very_many_references(spark):
    """Every third of 200,000 references may be shown; lists read from their start would take some 10^10 comparisons."""
    n = 200_000
    ref = F.concat(F.lit("Encounter/"), "id")
    every = spark.range(n).withColumn("ref", ref)
    kind = "struct<resourceType: string, id: string, meta: struct<profile: array<string>>, entry: array<struct<item: struct<reference: string>>>>"
    record = every.agg(F.array_sort(F.collect_list("ref")).alias("e")).select(
        F.lit(1).cast("long").alias("patient_id"), F.lit("List").alias("type"), F.lit("a").alias("id"), F.array(F.lit("g")).alias("groups"),
        F.struct(F.lit("List").alias("resourceType"), F.lit("a").alias("id"), F.struct(F.array(F.lit("p")).alias("profile")).alias("meta"), F.transform("e", lambda r: F.struct(F.struct(r.alias("reference")).alias("item"))).alias("entry")).cast(kind).alias("body"),
    )
    links = every.where("id % 3 = 0").select(F.lit(1).cast("long").alias("patient_id"), F.lit("List").alias("type"), F.lit("a").alias("id"), F.lit("List.entry.item").alias("attribute_ref"), F.col("ref").alias("child"))
    profile = Profile("p", [Element("List", "List"), Element("List.entry", "List.entry", types=("BackboneElement",)), Element("List.entry.item", "List.entry.item", types=("Reference",))])
    rows = record.join(resolve.allowed_references(links), ["patient_id", "type", "id"], "left")
    began = time.time()
    out = redact.copy_and_redact(rows, "List", record.schema["body"].dataType, [Selection("g", profile, ("List.id", "List.meta", "List.entry"))])
    items = out.select("complete", F.explode(F.from_json("body", "entry array<struct<item: struct<reference: string, _reference: struct<extension: array<struct<valueCode: string>>>>>>")["entry"]).alias("e"))
    got = items.agg(F.bool_and("complete").alias("complete"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("e.item.reference").isNotNull()).alias("shown"), F.sum(F.crc32(F.col("e.item.reference"))).alias("sum"), F.count_if(F.col("e.item._reference.extension")[0]["valueCode"] == "masked").alias("masked")).first()
    wanted = every.where("id % 3 = 0").agg(F.sum(F.crc32("ref"))).first()[0]
    assert (got["complete"], got["n"], got["shown"], got["sum"], got["masked"]) == (True, n, -(-n // 3), wanted, n - -(-n // 3))
    assert time.time() - began < 60
