"""Times a whole extraction of 25,000 people, each with a record that refers to a core record of its own, and prints one JSON line.

PEOPLE sets another number, BENCH_CPUS the threads. Records are made by Spark below a temporary folder before the clock starts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortlake.plans import request
from cohortlake.sources import readers, sinks

PEOPLE, CPUS = int(os.environ.get("PEOPLE", "25000")), os.environ.get("BENCH_CPUS", "8")
HEAD = "resourceType: string, id: string, meta: struct<profile: array<string>>"
SHAPES = {"Patient": f"{HEAD}, gender: string", "MedicationAdministration": f"{HEAD}, status: string, subject: struct<reference: string>, medicationReference: struct<reference: string>", "Medication": f"{HEAD}, code: struct<text: string>"}


def bodies(spark: SparkSession, path: str) -> None:
    """NDJSON of people, administrations and medications."""
    k = F.col("id").cast("string")
    meta = lambda url: F.struct(F.array(F.lit(url)).alias("profile")).alias("meta")
    ref = lambda kind, name: F.struct(F.concat(F.lit(f"{kind}/"), k).alias("reference")).alias(name)
    kinds = [
        (F.lit("Patient").alias("resourceType"), k.alias("id"), meta("p/patient"), F.lit("other").alias("gender")),
        (F.lit("MedicationAdministration").alias("resourceType"), k.alias("id"), meta("p/given"), F.lit("completed").alias("status"), ref("Patient", "subject"), ref("Medication", "medicationReference"), F.lit("2020-01-01").alias("effectiveDateTime")),
        (F.lit("Medication").alias("resourceType"), k.alias("id"), meta("p/drug"), F.struct(F.concat(F.lit("drug "), k).alias("text")).alias("code")),
    ]
    for n, kind in enumerate(kinds):
        spark.range(PEOPLE).select(F.to_json(F.struct(*kind)).alias("value")).write.mode("append" if n else "overwrite").text(path)


def main() -> None:
    root = tempfile.mkdtemp(prefix="spark-people-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("people").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.local.dir", root).config("spark.sql.warehouse.dir", f"{root}/warehouse").config("spark.checkpoint.dir", f"file://{root}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bodies(spark, f"{root}/in")
    began = time.time()
    readers.ndjson(spark, f"{root}/in").write.parquet(f"{root}/store")
    store = spark.read.parquet(f"{root}/store")
    stored = time.time()
    groups = spark.createDataFrame([("pat", "p/patient", "Patient", False), ("given", "p/given", "MedicationAdministration", False), ("drug", "p/drug", "Medication", True)], "group_id string, profile_url string, type string, reference_only boolean")
    wanted = [("pat", 0, "Patient.gender", False, []), ("given", 0, "MedicationAdministration.status", True, []), ("given", 1, "MedicationAdministration.medicationReference", True, ["drug"]), ("drug", 0, "Medication.code", False, [])]
    attributes = spark.createDataFrame(wanted, "group_id string, ord int, attribute_ref string, must_have boolean, linked_groups array<string>")
    filters = spark.createDataFrame([], "group_id string, kind string, codes array<struct<system: string, code: string>>, start date, end date")
    kinds = {"Patient": "p/patient", "MedicationAdministration": "p/given", "Medication": "p/drug"}
    rows = [(kinds[k], k, i, i, None, 0, [t], [], [], None, None, False) for k, i, t in (("Patient", "Patient.gender", "code"), ("MedicationAdministration", "MedicationAdministration.status", "code"), ("MedicationAdministration", "MedicationAdministration.medicationReference", "Reference"), ("MedicationAdministration", "MedicationAdministration.subject", "Reference"), ("Medication", "Medication.code", "CodeableConcept"))]
    elements = spark.createDataFrame(rows, "profile_url string, resource_type string, element_id string, path string, slice_name string, min int, types array<string>, type_profiles array<string>, target_profiles array<string>, discriminators array<struct<type: string, path: string>>, pattern string, bound boolean")
    shapes = {k: spark.createDataFrame([], f"b struct<{v}>").schema["b"].dataType for k, v in SHAPES.items()}
    cohort = store.where("resource_type = 'Patient'").select("patient_id")
    out = request.run(cohort, store, request.read(groups, attributes, filters, elements), shapes)
    sinks.write_patient_bundles(out.resources, f"{root}/bundles")
    sinks.write_core(out.resources, f"{root}/core")
    ended = time.time()
    bundles, core = spark.read.text(f"{root}/bundles").count(), spark.read.text(f"{root}/core").count()
    print(json.dumps({"people": PEOPLE, "bundles": bundles, "core_records": core, "load_s": round(stored - began, 1), "extract_and_write_s": round(ended - stored, 1)}))


if __name__ == "__main__":
    main()
