"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a local session gets a temporary folder; on a cluster that would be one that nobody else
    reads, so there it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("cohortlake.shared.dir", None) or tempfile.mkdtemp(prefix="cohortlake-")
        spark.conf.set("cohortlake.shared.dir", found)
    return f"{found.rstrip('/')}/cohortlake-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so a round's plan does not hold all rounds before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a round sends to all tasks at most; more are joined by shuffle, whatever their size on disk.
FEW = 10_000


def sized(keys: DataFrame) -> DataFrame:
    """Keys that were written, for a join: few are broadcast. Many would look few by their size on disk, which is a fraction of that in memory."""
    return F.broadcast(keys) if keys.count() <= FEW else keys.hint("merge")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: a gapless number from 0 among the rows of a key (nulls are a key), in the order given.

    Rows are dealt by ranges of keys and order, so a key may be spread over many tasks; numbers follow from counts for each task.
    """
    by = [*keys, *order]
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "numbered")
    counts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    sides = counts.select(*(F.col(k).alias(f"__{n}") for n, k in enumerate(keys)), F.col("__part").alias("__p"), "__first", before.alias("__before"))
    same = [placed[k].eqNullSafe(sides[f"__{n}"]) for n, k in enumerate(keys)]
    return placed.join(sides, [*same, placed["__part"] == sides["__p"]]).withColumn(out, F.col("__at") - F.col("__first") + F.col("__before")).select(*df.columns, out)


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; frames that read it end with that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
