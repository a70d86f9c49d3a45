"""Writers: bundles as NDJSON, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.operators import consent


def _put(order: int, *keys: str) -> Column:
    """An entry of a transaction, which sorts by these keys."""
    name = F.concat_ws("/", "resource_type", "id")
    entry = F.concat(F.lit('{"fullUrl":"'), name, F.lit('","resource":'), F.col("body"), F.lit(',"request":{"method":"PUT","url":"'), name, F.lit('"}}'))
    return F.struct(F.lit(order).alias("o"), *(F.col(k).cast("string").alias(f"k{n}") for n, k in enumerate(keys)), entry.alias("json"))


def transaction_bundles(resources: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """(patient_id, value): one transaction bundle for each patient that has resources; entries in order of type and id, then
    provenance records (report.provenance_resources) in order of group and chunk.
    """
    entries = resources.where("patient_id IS NOT NULL").select("patient_id", _put(0, "resource_type", "id").alias("e"))
    if provenance is not None:
        more = provenance.where("patient_id IS NOT NULL").withColumn("__chunk", F.lpad(F.col("chunk").cast("string"), 12, "0"))
        entries = entries.union(more.select("patient_id", _put(1, "group_id", "__chunk").alias("e")))
    own = entries.groupBy("patient_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return own.select("patient_id", F.concat(F.lit('{"resourceType":"Bundle","type":"transaction","entry":['), F.array_join(F.transform("e", lambda x: x["json"]), ","), F.lit("]}")).alias("value"))


def write_patient_bundles(resources: DataFrame, path: str, provenance: DataFrame | None = None, batches: DataFrame | None = None, at_once: int | None = None) -> None:
    """Bundles as NDJSON. With batches (patient_id, batch; see report.batch_labels) in a folder for each batch, `at_once` of them
    in one job; a batch that was written whole is noted in `_batches` below path, and a later call goes on with the others.
    """
    bundles = transaction_bundles(resources, provenance)
    if batches is None:
        bundles.select("value").write.text(path)
        return
    spark, noted = resources.sparkSession, f"{path}/_batches"
    labels = [r["batch"] for r in batches.select("batch").distinct().orderBy("batch").collect()]  # a row a batch
    held = spark._jvm.org.apache.hadoop.fs.Path(noted)
    done = {r["batch"] for r in spark.read.schema("batch int").parquet(noted).collect()} if held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held) else set()
    left = [b for b in labels if b not in done]
    for start in range(0, len(left), at_once or max(1, len(left))):
        now = left[start : start + (at_once or len(left))]
        own = batches.where(F.col("batch").isin(now)).select("patient_id", "batch")
        rows = bundles.join(own, "patient_id").select("batch", "value")
        rows.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)
        spark.createDataFrame([(b,) for b in now], "batch int").coalesce(1).write.mode("append").parquet(noted)


def write_store(resources: DataFrame, name: str, buckets: int = 200) -> None:
    """Resources as a table bucketed by type and id: fetching by these keys (resolve.fetch) then moves keys only."""
    resources.write.bucketBy(buckets, "resource_type", "id").sortBy("resource_type", "id").mode("overwrite").saveAsTable(name)


def audit_bundles(resources: DataFrame) -> DataFrame:
    """(patient_id, value): one collection bundle for each patient of the consents and encounters that decided about consent, minimised."""
    own = consent.minimised(resources)
    entry = F.struct("resource_type", "id", F.concat(F.lit('{"fullUrl":"'), F.concat_ws("/", "resource_type", "id"), F.lit('","resource":'), F.col("body"), F.lit("}")).alias("json"))
    out = own.where("patient_id IS NOT NULL").groupBy("patient_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return out.select("patient_id", F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join(F.transform("e", lambda x: x["json"]), ","), F.lit("]}")).alias("value"))


def write_consent_audit(resources: DataFrame, path: str) -> None:
    audit_bundles(resources).select("value").write.text(path)


def core_entries(resources: DataFrame) -> DataFrame:
    """(value): core resources (or provenance records) as transaction entries, one a row."""
    return resources.where("patient_id IS NULL").select(_put(0)["json"].alias("value"))


def write_core(resources: DataFrame, path: str, single_bundle: bool = False, provenance: DataFrame | None = None) -> None:
    """Core resources, one entry a line, in parallel; or as one bundle on one line, which one task then writes. Nothing is
    written where there is none.
    """
    core = core_entries(resources)
    if provenance is not None:
        core = core.union(core_entries(provenance))
    if core.isEmpty():
        return
    if single_bundle:
        core = core.agg(F.concat(F.lit('{"resourceType":"Bundle","type":"transaction","entry":['), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
    core.write.text(path)


def write_exclusions(patients: DataFrame, resources: DataFrame, path: str, batch: str = "0") -> None:
    """The two exclusion tables as quoted CSV with headers, in the folders `patients` and `resources` of path.

    A column `batch` names the batch of a row where there is one.
    """
    label = lambda df: (F.col("batch").cast("string") if "batch" in df.columns else F.lit(batch)).alias("Batch-ID")
    people = patients.select(label(patients), F.col("stage").alias("Stage"), F.col("patient_id").cast("string").alias("Patient-ID"))
    events = resources.select(label(resources), F.col("reason").alias("Reason"), F.col("group_id").alias("Group"), F.col("attribute_ref").alias("Attribute"), F.col("resource_id").alias("Resource-ID"), F.col("patient_id").cast("string").alias("Patient-ID"))
    for df, name in ((people, "patients"), (events, "resources")):
        df.write.option("header", True).option("quoteAll", True).csv(f"{path}/{name}")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.json(path)
