"""Canonical exact fingerprints: wide hashes of normalised texts, grouped, with bytes compared inside equal buckets.

The canonical form is Unicode NFKC with case folded and white space folded to single spaces; its fingerprint is the 128-bit
xxhash. Where several texts share a hash their canonical bytes are compared: the least and the greatest of a bucket are
equal if all are, so a bucket that holds a third of all rows costs each task one row. Classes that really differ under one
hash get a number behind it. Texts whose hash is alone are not moved for that.

Defined results: a null text is an empty one; repeated rows have repeated results; rows without doc_id count as the lowest
id; rows that share a doc_id are ordered by text; extra columns are ignored; an empty table gives an empty result; a table
of one row is its own next document.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Bits of the hash; fewer only to force collisions in tests.
DIGEST_BITS = 128


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes, bits: int = DIGEST_BITS) -> bytes:
    found = xxhash.xxh3_128_digest(form)
    return found if bits == 128 else (int.from_bytes(found, "big") & ((1 << bits) - 1)).to_bytes(16, "big")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many, or all, from the start of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame) -> DataFrame:
    """(range, ghost, doc_id, text), dealt by ranges of doc_id and sorted so that each row stands before the next document.

    The first document of a range is copied to the range before it as a ghost, so no task needs another's rows: whatever
    the size, only one row a range moves twice.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("at"), "doc_id", common.empty_to_text())
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("at", F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else F.array(F.lit(0.5)), F.lit(10_000)).alias("c")).first()["c"] or []
    of = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts)))), lambda c: c > F.col("at"))) if cuts else F.lit(0)  # range 0 has the highest ids
    ranged = rows.withColumn("range", of)
    heads = {r["range"]: r["head"] for r in ranged.groupBy("range").agg(F.max("at").alias("head")).collect()}  # a row a range
    present = sorted(heads)
    table = docs.sparkSession.createDataFrame([(r, heads[r], present[i - 1]) for i, r in enumerate(present)], "range int, head long, to int")
    home = F.struct(F.col("range"), F.lit(0).alias("ghost"))
    copies = F.when(F.col("at") == F.col("head"), F.array(home, F.struct(F.col("to").alias("range"), F.lit(1).alias("ghost")))).otherwise(F.array(home))
    placed = ranged.join(F.broadcast(table), "range").withColumn("copy", F.explode(copies)).select("copy.range", "copy.ghost", "at", "doc_id", "text")
    return placed.repartitionById(max(present, default=0) + 1, F.col("range")).sortWithinPartitions("range", "ghost", F.col("at").desc(), "text").select("range", "ghost", "doc_id", "text")


def _pairs(bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "n_chars", "edited_sha256", "digest", "form", "edited_digest", "edited_form", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its next document, with its canonical form
        for batch in common.chunks(batches):
            out = []
            for where, ghost, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "ghost", "doc_id", "text")), strict=True):
                form = canonical(text)
                if held and held[0] == where:
                    _, own_id, own, own_form = held
                    new = edited(own, text)
                    new_form = canonical(new)
                    out.append((own_id, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), digest(own_form, bits), hashlib.sha256(own_form).digest(), digest(new_form, bits), hashlib.sha256(new_form).digest(), float(own_form == new_form), float(own_form == form)))
                held = None if ghost else (where, doc_id, text, form)
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _forms(shared: common.KeyFilter, bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)  # the same bytes for the same form, and nothing is lost
        for batch in common.chunks(batches):
            forms = [canonical(t or "") for t in batch.column("text").to_pylist()]
            digests = [digest(f, bits) for f in forms]
            keep = shared(np.array([_key(d) for d in digests], np.int64)) if digests else []
            own = [(d, packer.compress(f)) for d, f, k in zip(digests, forms, keep, strict=True) if k]
            yield pa.record_batch([pa.array([x[i] for x in own], pa.binary()) for i in (0, 1)], names=["digest", "form"])

    return run


def _key(found: bytes) -> int:
    return int.from_bytes(found[8:], "big", signed=True)


def fingerprints(docs: DataFrame, bits: int = DIGEST_BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    An exact fingerprint is as another or not, so likenesses are 1 or 0. Edited texts, which have no rows of their own,
    are told apart inside buckets by the sha-256 of their canonical bytes.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, digest binary, form binary, edited_digest binary, edited_form binary, near_edited double, near_next double"
    rows = common.written(in_order(docs).mapInArrow(_pairs(bits), schema), "fingerprints")
    each = rows.select("digest", "form").union(rows.select("edited_digest", "edited_form"))
    buckets = common.written(each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("a"), F.max("form").alias("b")).where("n > 1"), "buckets")
    key = F.conv(F.hex(F.substring("digest", 9, 8)), 16, -10).cast("long")
    shared = common.key_filter(buckets.select("digest"), key)
    compared = docs.select("text").mapInArrow(_forms(shared, bits), "digest binary, form binary").groupBy("digest").agg(F.min("form").alias("a"), F.max("form").alias("b"))
    differ = common.written(compared.where("a <> b").select("digest").union(buckets.where("a <> b").select("digest")).distinct(), "collisions")
    if differ.isEmpty():
        out = rows.withColumns({"class": F.lit(0), "edited_class": F.lit(0)})
    else:
        classes = each.distinct().join(differ, "digest", "left_semi").withColumn("class", F.dense_rank().over(Window.partitionBy("digest").orderBy("form")) - 1)
        again = classes.toDF("edited_digest", "edited_form", "edited_class")
        out = rows.join(classes, ["digest", "form"], "left").join(again, ["edited_digest", "edited_form"], "left")
    name = lambda d, c: F.concat(F.lower(F.hex(d)), F.when(F.col(c) > 0, F.concat(F.lit("-"), F.col(c).cast("string"))).otherwise(F.lit("")))
    return out.select("doc_id", "n_chars", "edited_sha256", name("digest", "class").alias("fingerprint"), name("edited_digest", "edited_class").alias("edited_fingerprint"), "near_edited", "near_next")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
