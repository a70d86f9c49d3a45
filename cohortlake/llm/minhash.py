"""MinHash near-duplicates with tensored banding.

Two small collections of minhash triples are computed for each document, A_1..A_m and B_1..B_m; the key of table (i, j) is
the combination of A_i and B_j. So 6m minhashes serve m*m tables of six minhashes each, about a square root of what
separate tables would need. Documents that share a key are candidates; each candidate link is confirmed on the full sets.

What may be hot is thinned before it is dealt: equal sets are one class from the start; a document enters the tables only
where both its A_i and its B_j occur with another class; a table bucket is compared with its most central member first, so
most of its members are one component. Only what still meets in a bucket from several components is compared further, in packs
of sets, once whatever the number of buckets shared.

Defined results: words are runs other than white space (U+0020, U+0009 to U+000D) with A-Z lower-cased; a set holds the
distinct shingles of five words, or the whole sequence if there are fewer; a text that is null, empty or without words has
the empty set and is linked with nothing; rows that share a doc_id count as linked, rows
without one are linked with nothing and kept; extra columns are ignored; an empty
table gives an empty result. Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import common
from cohortlake.llm.components import connected_components

SHINGLE_WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Minhashes joined in each value of a collection, and values in it: a pair with similarity s is missed with probability
#: below 2 * (1 - s ** JOINED) ** COLLECTION, at 0.75 about 0.003 and at 0.8 about 0.0004.
JOINED, COLLECTION = 3, 12
#: Sets that are compared in one go with as many others.
PACK = 64
#: Words whose hashes a worker remembers.
CACHE_WORDS = 200_000
#: Text that a task takes apart at a time.
CHUNK_BYTES = 1 << 20

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHashes()


def shingle_sets(texts: list[str | None], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((_words[w] for ws in words for w in ws), np.uint64, sum(sizes))
    if len(flat) >= width:
        sums = np.zeros(len(flat) - width + 1, np.uint64)
        for j in range(width):
            sums = sums * np.uint64(0x9E3779B97F4A7C15) + _mixed(flat[j : len(flat) - width + 1 + j] + np.uint64(j))
        sums = _mixed(sums)
    out, at = [], 0
    for ws, n in zip(words, sizes, strict=True):
        if n >= width:
            out.append(np.unique(sums[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\x00%d " % n + b" ".join(ws))], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Seeds and odd factors of the hash functions."""
    n = 2 * JOINED * COLLECTION
    x = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return x[:n], x[n:] | np.uint64(1)


def tensored(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Collections A and B, one row a set (none of them empty): each value joins JOINED minhashes."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds, factors = _functions()
    least = np.stack([np.minimum.reduceat((flat ^ s) * f, starts) for s, f in zip(seeds, factors, strict=True)], axis=1)
    joined = np.zeros((len(sets), 2 * COLLECTION), np.uint64)
    for j in range(JOINED):
        joined = _mixed(joined + least[:, j::JOINED])
    return joined[:, :COLLECTION], joined[:, COLLECTION:]


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.remember("minhash", _words.clear)
    for batch in common.chunks(batches, limit=CHUNK_BYTES):
        sets = shingle_sets(batch.column("text").to_pylist())
        full = [s for s in sets if len(s)]
        a, b = tensored(full) if full else (np.empty((0, COLLECTION), np.uint64),) * 2
        ends = np.cumsum([0] + [COLLECTION * bool(len(s)) for s in sets]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).view(np.int64).ravel())) for x in (a, b)]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), *lists],
            names=["doc_id", "n_shingles", "digest", "a", "b"],
        )


def _sets(wanted: common.KeyFilter) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sets of the rows whose key passes."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remember("minhash", _words.clear)
        for whole in batches:
            passed = whole.filter(pa.array(wanted(whole.column("key").to_numpy(zero_copy_only=False))))
            for batch in common.chunks([passed], limit=CHUNK_BYTES):
                sets = shingle_sets(batch.column("text").to_pylist())
                yield pa.record_batch([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "shingles"])

    return find


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets, those that are linked."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            common_ = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * common_ >= PERCENT * (len(both) - common_))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all pairs between two packs of sets, those that are linked."""
    common.remember("packs of sets", lambda: None)
    for batch in batches:
        a, b = [], []
        for xs, ys in zip(batch.column("xs"), batch.column("ys"), strict=True):
            left, right = ([(r["rep"].as_py(), np.frombuffer(r["shingles"].as_buffer(), np.uint64)) for r in side] for side in (xs, ys))
            every = np.concatenate([s for _, s in right])
            owner = np.repeat(np.arange(len(right)), [len(s) for _, s in right])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            sizes = np.array([len(s) for _, s in right])
            for rep, own in left:
                at = np.searchsorted(own, every)
                hit = own[np.minimum(at, len(own) - 1)] == every
                shared = np.bincount(owner[hit], minlength=len(right))
                for k in np.flatnonzero(100 * shared >= PERCENT * (sizes + len(own) - shared)).tolist():
                    a.append(rep)
                    b.append(right[k][0])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _fits(n: str, m: str):
    """Sets of such sizes can be linked at all."""
    return F.expr(f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})")


def _tables(reps: DataFrame) -> DataFrame:
    """(key, rep, n): for each class its keys in the tables where it may meet another class."""
    each = reps.select("rep", "n_shingles", F.posexplode("a").alias("i", "v"), F.lit("a").alias("side")).union(reps.select("rep", "n_shingles", F.posexplode("b").alias("i", "v"), F.lit("b").alias("side")))
    live = each.groupBy("side", "i", "v").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("side", "i", "v")
    own = each.join(live, ["side", "i", "v"], "left_semi").groupBy("rep", "n_shingles").agg(*(F.collect_list(F.when(F.col("side") == s, F.struct("i", "v"))).alias(s) for s in "ab"))
    keys = own.select("rep", F.col("n_shingles").alias("n"), "b", F.explode("a").alias("a")).select("rep", "n", "a", F.explode("b").alias("b"))
    return keys.select(F.xxhash64("a.i", "a.v", "b.i", "b.v").alias("key"), "rep", "n")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among the candidate pairs (a, b)."""
    found = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("ys")), "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xs")), "a")
    return common.written(found.select("a", "b", "xs", "ys").mapInArrow(_confirm, "a long, b long"), "near-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sketched = common.written(docs.select("doc_id", "text").mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, a array<long>, b array<long>"), "sketches")
    reps = common.written(
        sketched.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("a").alias("a"), F.first("b").alias("b")),
        "set-classes",
    )
    rows = common.written(_tables(reps), "table-keys")
    sizes = rows.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count(F.lit(1)).alias("size")).where("least < most")
    shared = common.written(rows.join(sizes.select("key", "size"), "key"), "shared-keys")
    # who shares most keys with most others: near copies share more with what they were made from than with each other
    central = shared.groupBy("rep").agg(F.sum("size").alias("central"))
    members = common.written(shared.join(central, "rep").select("key", "rep", "n", "size", "central"), "table-members")
    centres = members.groupBy("key").agg(F.max(F.struct("central", F.negative("rep").alias("minus"), "n")).alias("c")).select("key", F.negative("c.minus").alias("centre"), F.col("c.n").alias("m"))
    first = members.join(centres, "key").where("rep <> centre").where(_fits("n", "m"))
    tested = common.written(first.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct(), "near-candidates")
    key = F.xxhash64("doc_id")
    wanted = common.key_filter(central.select(F.col("rep").alias("doc_id")), key)
    sets = common.written(docs.select("doc_id", "text", key.alias("key")).mapInArrow(_sets(wanted), "rep long, shingles binary"), "shingle-sets")
    links = _confirmed(tested, sets)
    labels = connected_components(links)

    # What the centres left in several components. Of a bucket's components the largest is its home; members of the others
    # are strays. Strays are compared with their home, and with those they share a bucket with, in packs of sets: how
    # often two packs share a bucket does not matter, so the number of buckets and their squares stay out of it.
    of = common.written(members.select("rep").distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")), "component-of")
    counts = of.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    placed = members.select("key", "rep").join(of.join(counts, "component"), "rep")
    homes = placed.groupBy("key").agg(F.max(F.struct("c", "component")).alias("h"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key", F.col("h.component").alias("home"))
    strays = common.written(placed.join(homes, "key").where("component <> home").select("key", "home", "rep"), "strays")
    each = strays.select("home", "rep").distinct()
    pack = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(F.col(n) / PACK).cast("long"))
    sizes = each.groupBy("home").agg(F.count(F.lit(1)).alias("s"))
    together = lambda df, *keys: df.join(sets, "rep").groupBy(*keys).agg(F.collect_list(F.struct("rep", "shingles")).alias("xs"))
    packs = common.written(together(each.join(sizes, "home").withColumn("p", pack("s")), "home", "p"), "stray-packs")
    own = together(of.withColumnRenamed("component", "home").join(sizes, "home", "left_semi").join(counts.withColumnRenamed("component", "home"), "home").withColumn("q", pack("c")), "home", "q")
    at_home = packs.select("home", "xs").join(own.select("home", F.col("xs").alias("ys")), "home").select("xs", "ys")
    seen = strays.join(sizes, "home").select("key", "home", pack("s").alias("p")).distinct()
    meet = seen.join(seen.withColumnRenamed("p", "q"), ["key", "home"]).where("p <= q").select("home", "p", "q").distinct()
    abroad = meet.join(packs, ["home", "p"]).select("home", "q", "xs").join(packs.select("home", F.col("p").alias("q"), F.col("xs").alias("ys")), ["home", "q"]).select("xs", "ys")
    found = common.written(at_home.union(abroad).mapInArrow(_compare, "a long, b long").where("a <> b"), "near-links")
    if not found.isEmpty():
        labels = connected_components(links.union(found))

    of_class = reps.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked, over any steps, with one of smaller doc_id."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
