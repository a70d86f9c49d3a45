"""What the corpus operators share: cutting lineage, reading text columns, numbering rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.plans.lineage import shared_dir

#: Bytes of text that a Python task works on at a time, so that its memory does not follow the batch size.
CHUNK_BYTES = 4 << 20


_memories: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    """Tells that an operator keeps a memory in this Python worker; those of other operators are forgotten first.

    Workers are used again from stage to stage, and each memory has its bound, but their sum should not add up.
    """
    for other in [x for x in _memories if x != owner]:
        _memories.pop(other)()
    _memories[owner] = forget


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of about limit bytes of one string or binary column (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def empty_to_text(column: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def held(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5: the fold of a row; -1 without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)), F.lit(-1))


def numbered(df: DataFrame, group: str, order: list, name: str, out: str) -> DataFrame:
    """Adds `out`: a gapless number from 0 within `group`, in the order given.

    Rows are range-partitioned by (group, order); only a row count for each task and group leaves the tasks, so a group
    may be spread over many tasks and no task needs a whole group.
    """
    key = [F.col(group), *order]
    placed = df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__part", F.shiftright("__at", 33)), name)
    # a row a task and group: sums within a group go over its tasks in order
    counts = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(offsets, F.expr(f"{group} <=> __g AND __part = __p")).withColumn(out, F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__first", "__before", "__part", "__g", "__p")


class KeyFilter:
    """A Bloom filter of 64-bit keys: it may let other keys pass, it never holds back its own.

    It has FILTER_BITS_A_KEY bits for each key, up to a bound. Beyond that more rows pass and the joins behind it do more work;
    results stay the same.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        mask = np.uint64(64 * len(self.words) - 1)
        found = np.ones(len(keys), bool)
        for shift in FILTER_SHIFTS:
            at = (keys >> np.uint64(shift)) & mask
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


#: Bits of a KeyFilter for each key; bits at least, and at most (16 MB); and where a key's three places are read from.
FILTER_BITS_A_KEY, FILTER_LEAST, FILTER_MOST = 12, 1 << 16, 1 << 27
FILTER_SHIFTS = (0, 18, 36)


def key_filter(df: DataFrame, key: Column) -> KeyFilter:
    """The filter of the values of a long column. What comes to the driver is the filter itself: FILTER_MOST / 64 numbers at most."""
    bits = FILTER_LEAST
    wanted = FILTER_BITS_A_KEY * df.count()
    while bits < min(wanted, FILTER_MOST):
        bits *= 2
    at = F.explode(F.array(*(F.shiftrightunsigned(key, s).bitwiseAND(F.lit(bits - 1)) for s in FILTER_SHIFTS)))
    words = df.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return KeyFilter(out)
