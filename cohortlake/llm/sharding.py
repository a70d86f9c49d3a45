"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Every document has a position in each metadata dimension (size, language, source, id). A node that still holds m shards'
worth of bytes is cut along the dimension in which its rows spread widest, at the weighted quantile floor(m/2)/m, until
each leaf holds one shard's target. The quantile is searched over counts of bytes per bin, so a node may hold a third of
all rows, or all of them, without any task seeing more than its own share: only bins leave the tasks.

Equal texts are one group: all have the metadata of the member with the lowest id and stand together in every dimension, told
apart by a hash of their ids only below a hash of the text. A cut that falls into a group moves to its nearer end where that costs a
shard at most SLACK of its bytes; larger groups (a group of a third of all rows among them) are cut, as shards would not be near equal.

Defined results: null texts have no bytes; null metadata sort lowest; rows that agree in a dimension (a hot source, equal
texts, repeated ids) are told apart by hashes of text and id, so a hot value can be cut anywhere; rows with equal id and text stay together; an empty
table gives an empty result; fewer rows than shards leave shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Bytes that each row costs besides its text.
ROW_BYTES = 16
#: Bins for each node and pass of the median search, as bits.
BIN_BITS = 12
#: The search ends when the bin that holds the median has at most this share of a shard.
TOLERANCE = 2e-4
#: A cut leaves a group of equal texts whole where this costs at most this share of a shard.
SLACK = 5e-3
#: Low bits of a key that tell the members of a group apart, by their ids.
MEMBER_BITS = 16
#: Groups of more rows than this are sent to every task (a row a group, so fewer than one for so many rows); others meet their rows by shuffle.
HOT_ROWS = 1 << 16


def _position(value: Column, low: Column, high: Column) -> Column:
    """31 bits that order a number between two bounds; null is lowest."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.coalesce(F.round((value - low) / span * F.lit(2.0**31 - 1)).cast("long"), F.lit(0))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one 63-bit key a dimension: 31 bits of position, 16 of the text and 16 of the id that break ties."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    code = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary"))
    own = F.struct("doc_id", code("lang").alias("lang_code"), code("source").alias("source_code"))
    rows = common.written(docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"), own.alias("own")), "shard-rows")
    groups = common.written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("first")).where("n > 1"), "shard-groups")
    hot, others = groups.where(F.col("n") > HOT_ROWS).select("digest", F.col("first").alias("hot")), groups.where(F.col("n") <= HOT_ROWS).select("digest", F.col("first").alias("other"))
    told = rows.join(F.broadcast(hot), "digest", "left")
    few = told.where("hot IS NULL").join(others, "digest", "left").withColumn("first", F.coalesce("other", "own")).drop("other", "hot")
    base = few.unionByName(told.where("hot IS NOT NULL").withColumnRenamed("hot", "first")).select("doc_id", "size", "text_crc32", "digest", F.col("first.doc_id").alias("first_id"), "first.lang_code", "first.source_code")
    logs = base.withColumn("log_size", F.log2(F.col("size").cast("double")))
    b = logs.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in ("log_size", "first_id") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    bound = lambda n, c: F.lit(b[f"{n}_{c}"]).cast("double")
    tie = F.shiftleft(F.pmod("digest", F.lit(2 ** (32 - MEMBER_BITS))), MEMBER_BITS) + F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(2**MEMBER_BITS))
    dims = {
        "k0": _position(F.col("log_size"), bound("lo", "log_size"), bound("hi", "log_size")),
        "k1": _position(F.col("lang_code").cast("double"), F.lit(0.0), F.lit(2.0**32)),
        "k2": _position(F.col("source_code").cast("double"), F.lit(0.0), F.lit(2.0**32)),
        "k3": _position(F.col("first_id").cast("double"), bound("lo", "first_id"), bound("hi", "first_id")),
    }
    return logs.select("doc_id", "size", "text_crc32", *((F.shiftleft(v, 32) + tie).alias(k) for k, v in dims.items()))


def _node(splits: dict[int, tuple[str, int]], at: int = 1) -> Column:
    """The node of a row: children of node n are 2n and 2n+1."""
    if at not in splits:
        return F.lit(at)
    dim, cut = splits[at]
    return F.when(F.col(dim) < F.lit(cut), _node(splits, 2 * at)).otherwise(_node(splits, 2 * at + 1))


def _medians(spark: SparkSession, rows: DataFrame, todo: dict[int, tuple[str, int, int, float]], leaf: float) -> dict[int, int]:
    """For each node (dimension, lowest and highest key, bytes wanted on the left): the key to cut at.

    Each pass cuts the range in 2^12 bins, sums bytes by bin and goes on in the bin where the wanted bytes are reached.
    """
    state = {n: (d, lo, hi, want) for n, (d, lo, hi, want) in todo.items()}
    cuts: dict[int, int] = {}
    while state:
        bounds = spark.createDataFrame([(n, lo, max(1, -(-(hi - lo + 1) >> BIN_BITS) if hi - lo + 1 > 1 << BIN_BITS else 1), hi, float(want)) for n, (_, lo, hi, want) in state.items()], "node int, lo long, width long, hi long, want double")
        key = F.coalesce(*(F.when(F.col("node").isin([n for n, s in state.items() if s[0] == d]), F.col(d)) for d in {s[0] for s in state.values()}))
        bins = (
            rows.withColumn("__key", key).join(F.broadcast(bounds), "node").where("__key BETWEEN lo AND hi")
            .groupBy("node", F.expr("(__key - lo) div width").alias("bin")).agg(F.sum("size").alias("bytes"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("want").alias("want"))
        )
        so_far = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))
        reached = bins.withColumn("upto", so_far).where("upto >= want").groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto", "lo", "width")).alias("b"))
        found = {r["node"]: r["b"] for r in reached.collect()}  # a row a node, 2 * shards at most
        following = {}
        for n, (d, _, hi, want) in state.items():
            if n not in found:  # all bytes are wanted on the left
                cuts[n] = hi + 1
                continue
            b = found[n]
            start = b["lo"] + b["bin"] * b["width"]
            before = b["upto"] - b["bytes"]
            if b["bytes"] <= TOLERANCE * leaf or b["width"] == 1:
                cuts[n] = start + b["width"] if b["upto"] - want <= want - before else start
            else:
                following[n] = (d, start, min(hi, start + b["width"] - 1), want - before)
        state = following
    return cuts


def _between_groups(rows: DataFrame, dims: dict[int, str], cuts: dict[int, int], most: float) -> dict[int, int]:
    """The cuts, those inside a group moved to its nearer end if at most so many bytes change sides."""
    inside = {n: c for n, c in cuts.items() if c % (1 << MEMBER_BITS)}
    if not inside:
        return cuts
    sums = []
    for n, c in inside.items():
        key, low = F.col(dims[n]), c >> MEMBER_BITS << MEMBER_BITS
        for side, (a, b) in (("left", (low, c)), ("right", (c, low + (1 << MEMBER_BITS)))):
            sums.append(F.coalesce(F.sum(F.when((F.col("node") == n) & (key >= F.lit(a)) & (key < F.lit(b)), F.col("size"))), F.lit(0)).alias(f"{side}_{n}"))
    found = rows.agg(*sums).first()  # two numbers a node
    out = dict(cuts)
    for n, c in inside.items():
        left, right, low = found[f"left_{n}"], found[f"right_{n}"], c >> MEMBER_BITS << MEMBER_BITS
        if min(left, right) <= most:
            out[n] = low if left <= right else low + (1 << MEMBER_BITS)
    return out


def kd_tree_shards(docs: DataFrame, shards: int = 40, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law); sizes are near equal."""
    spark = docs.sparkSession
    meta = common.written(metadata(docs), "shard-keys")
    total = meta.agg(F.sum("size")).first()[0] or 0
    leaf = total / shards
    splits: dict[int, tuple[str, int]] = {}
    open_nodes = {1: shards} if total else {}
    first = {1: 0}
    leaves: dict[int, int] = {}
    while open_nodes:
        for n in [n for n, m in open_nodes.items() if m == 1]:
            leaves[n] = first[n]
            del open_nodes[n]
        if not open_nodes:
            break
        rows = meta.withColumn("node", _node(splits)).where(F.col("node").isin(list(open_nodes)))
        wide = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(k).alias(f"{n}_{k}") for k in ("k0", "k1", "k2", "k3") for n, f in (("lo", F.min), ("hi", F.max)))).collect()  # a row a node
        todo = {}
        for r in wide:
            dim = max(("k0", "k1", "k2", "k3"), key=lambda k: ((r[f"hi_{k}"] >> 32) - (r[f"lo_{k}"] >> 32), r[f"hi_{k}"] - r[f"lo_{k}"]))
            m = open_nodes[r["node"]]
            todo[r["node"]] = (dim, r[f"lo_{dim}"], r[f"hi_{dim}"], r["bytes"] * (m // 2) / m)
        cuts = _between_groups(rows, {n: t[0] for n, t in todo.items()}, _medians(spark, rows, todo, leaf), slack * leaf)
        following = {}
        for n, m in open_nodes.items():
            if n in cuts:
                splits[n] = (todo[n][0], cuts[n])
                following |= {2 * n: m // 2, 2 * n + 1: m - m // 2}
                first |= {2 * n: first[n], 2 * n + 1: first[n] + m // 2}
        open_nodes = following
    shard = F.create_map(*(F.lit(x) for n, s in leaves.items() for x in (n, s)))[_node(splits)] if leaves else F.lit(0)
    placed = meta.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))
    out = common.numbered(placed, "shard", [F.col("doc_id"), F.col("text_crc32")], "shard-slots", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes."""
    return kd_tree_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
