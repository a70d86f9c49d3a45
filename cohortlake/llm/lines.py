"""Line dedup across documents by a deletion-neighbourhood join.

Lines within one edit (a character inserted, deleted or replaced) share a variant: the line itself or the line without one
character. Variants are emitted as hashed keys, equal keys are joined, the edit distance of what meets is verified, and the
earliest line stays. Equal lines are one line from the start.

A line of n characters has n + 1 variants, so lines that can have no partner are sifted out before: one edit lies in one of
S segments, so both lines agree in all the others. Lines emit a key for each segment left out, first with S = 2, those that
share one again with S = 16, and only those that share one of these emit all their variants. No partner is lost by that.

A line is dropped if an equal or near line comes before it, in order of doc_id and line number.

Defined results: lines end at U+000A; blank lines are never dropped; with min_chars, lines of fewer characters are copies of
equal ones only (a changed character in a short line makes another item of a list, not a copy); null and empty texts have
no lines and stay as they are; rows that share a doc_id count as one document of which none is earlier, and only what is
dropped for its own content is dropped; rows without doc_id come first; extra columns are kept (but for names that begin with
two underscores, which are this module's); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Text that a task holds as numbers at a time; about forty times as many bytes.
CHUNK_BYTES = 1 << 20
#: In the pipeline, shorter lines are copies of equal ones only.
PIPELINE_MIN_CHARS = 20
#: Segments of the first and of the second sieve.
SIEVES = (2, 16)

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_H = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _H)) * _MIX
    return (x ^ (x >> _H)) * np.uint64(0xC4CEB9FE1A85EC53)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolled:
    """Hashes of all prefixes of some lines, from which those of any part follow."""

    def __init__(self, lines: list[str]) -> None:
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.n = np.array([len(x) for x in lines], np.int64)
        self.start = np.cumsum(np.r_[0, self.n])[:-1]
        longest = int(self.n.max(initial=0))
        self.power, self.inverse = _powers(_B, longest), _powers(_B_INVERSE, longest)
        self.local = np.arange(len(points)) - np.repeat(self.start, self.n)
        self.sums = np.r_[np.uint64(0), np.cumsum(_mixed(points + np.uint64(1)) * self.power[self.local])]

    def prefix(self, p: np.ndarray) -> np.ndarray:
        """Of each line, the hash of its first p characters."""
        return self.sums[self.start + p] - self.sums[self.start]

    def suffix(self, s: np.ndarray) -> np.ndarray:
        """Of each line, the hash of its last s characters."""
        end = self.start + self.n
        return (self.sums[end] - self.sums[end - s]) * self.inverse[self.n - s]

    def segment_keys(self, segments: int) -> np.ndarray:
        """A row a line: for its length and one less, a key for each segment left out of a line of that length."""
        out = []
        for m in (self.n, np.maximum(self.n - 1, 0)):
            for w in range(segments):
                p, s = m * w // segments, m - m * (w + 1) // segments
                place = _mixed(m.astype(np.uint64) * np.uint64(64) + np.uint64(w))
                out.append(_mixed(_mixed(self.prefix(p) + place) + self.suffix(s)))
        return np.stack(out, axis=1)

    def variants(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of each line without each of its characters, in a row; and keys of the lines themselves."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        whole = self.prefix(self.n)
        before = self.sums[:-1] - self.sums[self.start[line]]
        after = whole[line] - (self.sums[1:] - self.sums[self.start[line]])
        size = self.n.astype(np.uint64)
        return _mixed(_mixed(before + after * _B_INVERSE) + size[line] - np.uint64(1)), _mixed(_mixed(whole) + size)


def _hash(line: str) -> tuple[int, int]:
    found = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(found[:8], "big", signed=True), int.from_bytes(found[8:], "big", signed=True)


def _lines(min_chars: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, doc_id, line_no, h1, h2, keys) of all lines that are not blank."""
    names, kinds = ["row", "doc_id", "line_no", "h1", "h2"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def out(at: list[tuple], texts: list[str]) -> pa.RecordBatch:
        fuzzy = [len(x) >= min_chars for x in texts]
        keys = Rolled([x for x, f in zip(texts, fuzzy, strict=True) if f]).segment_keys(SIEVES[0]).view(np.int64)
        ends = np.cumsum(np.r_[0, np.where(fuzzy, keys.shape[1], 0)]).astype(np.int32)
        columns = [pa.array(c, k) for c, k in zip(zip(*at, strict=True), kinds, strict=True)]
        return pa.record_batch([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], names=[*names, "keys"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remember("lines", lambda: None)
        for batch in common.chunks(batches, limit=CHUNK_BYTES):
            at, texts, size = [], [], 0
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                for i, line in enumerate(text.split("\n") if text else ()):
                    if line and not line.isspace():
                        at.append((row, doc_id, i, *_hash(line)))
                        texts.append(line)
                        size += len(line)
                        if size >= CHUNK_BYTES:  # a long text is not held as numbers at once
                            yield out(at, texts)
                            at, texts, size = [], [], 0
            if at:
                yield out(at, texts)

    return run


def _candidates(wanted: common.KeyFilter) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts of the lines whose hash and document pass the filter, each once for its document."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, limit=CHUNK_BYTES):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {x for x in text.split("\n") if x and not x.isspace()} if text else ()
                rows += [(doc_id, *_hash(x), x) for x in own]
            if rows:
                keep = wanted(np.array([r[1] for r in rows], np.int64) ^ np.array([r[0] or 0 for r in rows], np.int64))
                rows = [r for r, k in zip(rows, keep.tolist(), strict=True) if k]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "h1", "h2", "line"])

    return find


def _segment_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, "line", CHUNK_BYTES):
        keys = Rolled(batch.column("line").to_pylist()).segment_keys(SIEVES[1]).view(np.int64)
        ends = (np.arange(len(keys) + 1) * keys.shape[1]).astype(np.int32)
        yield pa.record_batch([batch.column("at"), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], names=["at", "keys"])


def _variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, at): place is that of the character left out, or -1 for the line itself."""
    for batch in common.chunks(batches, "line", CHUNK_BYTES // 4):
        rolled = Rolled(batch.column("line").to_pylist())
        shorter, whole = rolled.variants()
        line = np.r_[np.repeat(np.arange(len(whole)), rolled.n), np.arange(len(whole))]
        place = np.r_[rolled.local, np.full(len(whole), -1)]
        yield pa.record_batch([pa.array(np.r_[shorter, whole].view(np.int64)), pa.array(place.astype(np.int32)), batch.column("at").take(pa.array(line))], names=["key", "place", "at"])


#: A distinct line: its first place, and its hash, as rows that share a doc_id may have different lines in one place.
_AT = "at struct<doc_id: long, line_no: int, h1: long, h2: long>"


def _sharing(keyed: DataFrame) -> DataFrame:
    """The lines (at) of a frame (at, keys) that share one of their keys with another line."""
    each = keyed.select("at", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("key")
    return each.join(shared, "key", "left_semi").select("at").distinct()


def near_pairs(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(later, earlier): of the distinct lines (at, keys), all verified pairs that make the later one a near copy."""
    first = common.written(_sharing(distinct.where(F.size("keys") > 0)), "sifted-lines")
    wanted = common.key_filter(first, F.col("at.h1").bitwiseXOR(F.coalesce("at.doc_id", F.lit(0))))
    texts = docs.select("doc_id", "text").mapInArrow(_candidates(wanted), "doc_id long, h1 long, h2 long, line string")
    named = first.select("at", F.col("at.h1").alias("h1"), F.col("at.h2").alias("h2"), F.coalesce("at.doc_id", F.lit(0)).alias("doc_id"))
    found = common.written(named.join(texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))), ["doc_id", "h1", "h2"]).select("at", "line").dropDuplicates(["at"]), "sifted-texts")
    second = _sharing(found.mapInArrow(_segment_keys, f"{_AT}, keys array<long>"))
    rows = common.written(found.join(second, "at", "left_semi").mapInArrow(_variants, f"key long, place int, {_AT}"), "line-variants")
    less = rows.where("place >= 0")
    replaced = less.groupBy("key", "place").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least <> most")
    same_place = less.join(replaced, ["key", "place"]).where("at <> least").select(F.col("at").alias("later"), F.col("least").alias("earlier"))
    longer = less.select("key", "at").distinct().join(rows.where("place < 0").select("key", F.col("at").alias("short")), "key").select(F.greatest("at", "short").alias("later"), F.least("at", "short").alias("earlier"))
    pairs = common.written(same_place.union(longer).distinct(), "line-pairs")
    sides = pairs.join(found.select(F.col("at").alias("later"), F.col("line").alias("x")), "later").join(found.select(F.col("at").alias("earlier"), F.col("line").alias("y")), "earlier")
    return sides.where(F.levenshtein("x", "y", 1) >= 0).select("later", "earlier")


def dropped_lines(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """__row, __exact, __near, __drops (array of line_no and hash) for each row that loses lines; __row is _row()."""
    lines = common.written(docs.select(_row().alias("row"), "doc_id", "text").mapInArrow(_lines(min_chars), "row long, doc_id long, line_no int, h1 long, h2 long, keys array<long>"), "lines")
    place = F.struct("doc_id", "line_no", "h1", "h2")
    distinct = common.written(lines.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "distinct-lines")
    near = near_pairs(docs, distinct.select("at", "keys")).select(F.col("later").alias("at")).distinct().withColumn("near", F.lit(True))
    flagged = common.written(distinct.select("h1", "h2", "at", "copies").join(near, "at", "left").where("near OR copies > 1").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near")), "flagged-lines")
    gone = lines.select("row", "doc_id", "line_no", "h1", "h2").join(flagged, ["h1", "h2"]).withColumn("copy", ~place.eqNullSafe(F.col("at"))).where("near OR copy")
    # equal rows have equal drops, so each place counts once for them
    each = gone.groupBy("row", "line_no", "h1").agg(F.max("copy").alias("copy"))
    return common.written(each.groupBy("row").agg(F.sum(F.col("copy").cast("long")).alias("__exact"), F.sum((~F.col("copy")).cast("long")).alias("__near"), F.collect_list(F.struct("line_no", "h1")).alias("__drops")).withColumnRenamed("row", "__row"), "dropped-lines")


def _row() -> Column:
    """What tells rows apart: rows without doc_id, or that share one, by their texts."""
    return F.xxhash64("doc_id", "text")


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        out = []
        for text, drops in zip(batch.column("text").to_pylist(), batch.column("__drops").to_pylist(), strict=True):
            if text and drops:
                gone: dict[int, set[int]] = {}
                for d in drops:
                    gone.setdefault(d["line_no"], set()).add(d["h1"])
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone or _hash(x)[0] not in gone[i])
            out.append(text)
        names = [c for c in batch.schema.names if c != "__drops"]
        yield pa.record_batch([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)


def _split(chosen: common.KeyFilter, inside: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passes = chosen(batch.column("__key").to_numpy(zero_copy_only=False).astype(np.int64))
            kept = batch.filter(pa.array(passes if inside else ~passes))
            if kept.num_rows:
                yield kept.drop_columns(["__key"])

    return run


def line_dedup(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """All rows and columns of docs with the repeated lines gone from text, and __n_exact, __n_near: the lines dropped.

    Only documents that lose lines are joined with their drops; the others pass by.
    """
    drops = dropped_lines(docs, min_chars)
    chosen = common.key_filter(drops.select("__row"), F.col("__row"))
    keyed = docs.withColumn("__key", _row())
    untouched = keyed.mapInArrow(_split(chosen, False), docs.schema).withColumns({"__n_exact": F.lit(0).cast("long"), "__n_near": F.lit(0).cast("long")})
    changed = keyed.mapInArrow(_split(chosen, True), docs.schema).withColumn("__row", _row())
    counts = [F.coalesce(c, F.lit(0)).alias(f"__n{c[1:]}") for c in ("__exact", "__near")]
    joined = changed.join(drops, "__row", "left").select(*docs.columns, *counts, "__drops")
    return untouched.unionByName(joined.mapInArrow(_without, untouched.schema))


def keep_first_lines(docs: DataFrame, min_chars: int = PIPELINE_MIN_CHARS) -> DataFrame:
    """Documents without repeated lines and with n_chars to match; those of which nothing is left go."""
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""
    found = line_dedup(docs, min_chars).where(~(blank("text") & (F.col("__n_exact") + F.col("__n_near") > 0)))
    return found.withColumn("n_chars", F.when(F.col("__n_exact") + F.col("__n_near") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what is left of their text, and how many lines went as copies and as near copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("__n_exact").alias("n_exact"), F.col("__n_near").alias("n_near"), "text")
