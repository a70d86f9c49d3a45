"""The trie of conversations by their turns: what they share, and what computing shared prefixes once would save.

Conversations become arrays of turn keys (a digest of role and text, and the text's length); texts do not move. Equal ones are
one class, with the number and a digest of their ids. Classes are ordered by their keys and cut into shards; a shard encodes its
own trie as balanced parentheses in that order. Blocks of the excess with a range min-max tree over them find the closing
parenthesis of every node, which delimits its subtree; the rank of "()" counts its leaves, and cumulative arrays give members and
savings. Nodes on the outermost paths of a shard (its spines) may belong to its neighbours as well. How deep a shard's first path
is its predecessor's last one, already counted there, follows from a join of these paths by node; less that, sums are merged by node.

Defined results: rows without conv_id are left out; null role and text are empty; turns are ordered by number, nulls first, those
of equal number by role and digest; repeated rows are turns of their own; extra columns are ignored; without conversations there is
no node, not even a root. One conversation's keys (24 bytes a turn, or so) are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Turns of a shard, or those of one conversation where that has more.
SHARD_TURNS = 1 << 17
#: Parentheses of a block.
BLOCK = 64
#: Bytes of ids that a task hands on at once when it lists those of a class.
LIST_BYTES = 1 << 20
#: Turns of the first conversation of a hundred that another may take over, less one; and of how many it is the first.
OPENING, FAMILY = 6, 100


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (key, points) in order; points are the code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("points"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))  # nulls first
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["points"].alias("points"))).alias("turns"))


def rebuilt(sequences_: DataFrame) -> DataFrame:
    """conv_id, turns, where each conversation opens with the first turns of the first one of its hundred, h of them by its id."""
    family = (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("family")
    h = F.expr(f"int(crc32(cast(cast(conv_id AS string) AS binary)) % {OPENING})")
    # a hundred conversations at most meet here
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, OPENING - 1))).over(Window.partitionBy("family"))
    known = sequences_.select("conv_id", "turns", family).withColumns({"first": first, "h": h})
    opening = F.coalesce(F.expr("slice(first, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return known.select("conv_id", F.concat(opening, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


_TURN = pa.struct([("key", pa.binary()), ("points", pa.int64())])
_LISTED = pa.schema([("end_key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("turns", pa.list_(_TURN))])
_CLASS = pa.schema([("turns", pa.list_(_TURN)), ("first", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by class and id: ids of a class as text, in rows of LIST_BYTES; a task's first of each class has the turns."""
    key, ids, size, turns, first = None, [], 0, None, None
    for batch in batches:
        out: list[tuple] = []
        keys, convs, sequence = batch.column("end_key").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("turns")
        for i, (k, c) in enumerate(zip(keys, convs, strict=True)):
            if k != key or size > LIST_BYTES:
                if ids:
                    out.append((key, first, len(ids), ",".join(ids).encode(), turns))
                turns = sequence[i].as_py() if k != key else None
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _LISTED, strict=True)], schema=_LISTED)
    if ids:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip((key, first, len(ids), ",".join(ids).encode(), turns), _LISTED, strict=True)], schema=_LISTED)


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by class and first id: one row a class; lists of ids pass through the digest one after the other."""
    key, held, digest = None, None, None
    for batch in batches:
        out: list[tuple] = []
        for k, first, n, ids, turns in zip(*(batch.column(c).to_pylist() for c in ("end_key", "first", "n", "ids", "turns")), strict=True):
            if k != key:
                if held:
                    out.append((*held, digest.hexdigest()))
                key, held, digest = k, [turns, first, 0], hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
            held[2] += n
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _CLASS, strict=True)], schema=_CLASS)
    if held:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip((*held, digest.hexdigest()), _CLASS, strict=True)], schema=_CLASS)


def classes(sequences_: DataFrame) -> DataFrame:
    """turns, first (the least conv_id), n and ends (the digest of all conv_ids in order) of each distinct conversation.

    A class may hold a third of all rows: its ids are listed where range partitions put them, and only these lists meet, one
    after the other, as their digest must be fed in order.
    """
    end = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "").cast("binary"), 256)).alias("end_key")
    kind = "array<struct<key binary, points long>>"
    ranged = sequences_.select(end, "conv_id", F.col("turns").cast(kind).alias("turns")).repartitionByRange("end_key", "conv_id").sortWithinPartitions("end_key", "conv_id")
    lists = ranged.mapInArrow(_listed, f"end_key binary, first long, n long, ids binary, turns {kind}")
    return lists.repartition("end_key").sortWithinPartitions("end_key", "first").mapInArrow(_digested, f"turns {kind}, first long, n long, ends string")


class Parentheses:
    """A trie as balanced parentheses (1 opens), with blocks of excess and a min-max tree over their least values."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-len(bits) // BLOCK)
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        padded = np.full(self.leaves * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(self.leaves, BLOCK)
        self.least = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.least[self.leaves :] = self.blocks.min(axis=1)
        width = self.leaves
        while width > 1:
            self.least[width // 2 : width] = np.minimum(self.least[width : 2 * width : 2], self.least[width + 1 : 2 * width : 2])
            width //= 2

    def opens(self) -> np.ndarray:
        """Places of the opening parentheses: node k, in preorder, has the k-th."""
        return np.flatnonzero(self.bits)

    def leaf_rank(self) -> np.ndarray:
        """How many "()" begin before each place."""
        pairs = self.bits[:-1] & (1 - self.bits[1:])
        return np.concatenate([[0], np.cumsum(pairs), [pairs.sum()]])

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first later place where the excess falls below its own.

        Looks in the place's own block, then up the tree to a later subtree whose least is low enough, and down to its first block.
        """
        target = self.excess[at] - 1
        block = at // BLOCK
        inside = np.arange(BLOCK)[None, :] > (at % BLOCK)[:, None]
        hit = inside & (self.blocks[block] <= target[:, None])
        out = np.where(hit.any(axis=1), block * BLOCK + hit.argmax(axis=1), -1)
        rest = np.flatnonzero(out < 0)
        node, want = block[rest] + self.leaves, target[rest]
        climbing = np.ones(len(rest), bool)
        while climbing.any():
            right = climbing & (node % 2 == 0) & (self.least[np.minimum(node + 1, 2 * self.leaves - 1)] <= want)
            node = np.where(right, node + 1, np.where(climbing, node // 2, node))
            climbing &= ~right
        while (inner := node < self.leaves).any():
            left = 2 * node
            node = np.where(inner, left + (self.least[np.minimum(left, 2 * self.leaves - 1)] > want), node)
        block = node - self.leaves
        out[rest] = block * BLOCK + (self.blocks[block] <= want[:, None]).argmax(axis=1)
        return out


def _least_within(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of values[first : first + size] each, by stretches of powers of two."""
    out, level, power = np.zeros(len(first), values.dtype), values, 0
    log = np.floor(np.log2(size)).astype(np.int64)
    while True:
        own = np.flatnonzero(log == power)
        out[own] = np.minimum(level[first[own]], level[first[own] + size[own] - (1 << power)])
        power += 1
        if not (log >= power).any():
            return out
        level = np.minimum(level[: -(1 << power - 1)], level[1 << power - 1 :])


#: Of a node in its shard: depth; the row of its parent there, and the parent's least member unless it lies on a spine; members;
#: the least; children; leaves and savings of its subtree (members * points, and points); who ends there; its own points; whether it
#: lies on the first and last path, and then its name, its parent's, and the points down to it.
_NODE = "shard long, row long, parent long, above long, depth long, n long, least long, children long, leaves long, paid long, points long, own long, ends string, head boolean, tail boolean, name binary, parent_name binary, upto long"
_KINDS = [*[pa.int64()] * 12, pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.int64()]
_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def _shard(number: int, held: list[tuple[list[bytes], list[int], int, int, str]]) -> pa.RecordBatch:
    """The nodes of a shard's classes (keys, points, least conv_id, members, digest), which come in order of their keys."""
    bits: list[int] = [1]
    depth, parent, points, path, before = [0], [-1], [0], [0], []
    ends: dict[int, tuple[int, int, str]] = {}
    for keys, own, first, n, digest in held:
        shared = 0
        for a, b in zip(before, keys, strict=False):
            if a != b:
                break
            shared += 1
        bits += [0] * (len(before) - shared) + [1] * (len(keys) - shared)
        del path[shared + 1 :]
        for d in range(shared, len(keys)):
            depth.append(d + 1)
            parent.append(path[-1])
            points.append(own[d])
            path.append(len(depth) - 1)
        ends[path[-1]], before = (n, first, digest), keys
    bits += [0] * (len(before) + 1)
    nodes = len(depth)
    trie = Parentheses(np.array(bits, np.int8))
    opens = trie.opens()
    close = trie.find_close(opens)
    size, rank, row = (close - opens + 1) // 2, trie.leaf_rank(), np.arange(nodes)
    summed = lambda v: (lambda c: c[row + size] - c[row])(np.concatenate([[0], np.cumsum(v)]))
    here, least = np.zeros(nodes, np.int64), np.full(nodes, np.iinfo(np.int64).max)
    for k, (n, first, _) in ends.items():
        here[k], least[k] = n, first
    points_ = np.array(points, np.int64)
    members = summed(here)
    children = np.bincount(np.array(parent[1:], np.int64), minlength=nodes)
    head, tail, name, parent_name, upto = np.zeros(nodes, bool), np.zeros(nodes, bool), [None] * nodes, [None] * nodes, np.zeros(nodes, np.int64)
    for mark, way, keys in ((head, range(len(held[0][0]) + 1), held[0][0]), (tail, path, held[-1][0])):
        digest, total = b"", 0
        for d, k in enumerate(way):
            if d:
                parent_name[k] = digest
                digest, total = hashlib.blake2b(digest + keys[d - 1], digest_size=16).digest(), total + points[k]
            mark[k], name[k], upto[k] = True, digest, total
    least = _least_within(least, row, size)
    up = np.maximum(parent, 0)
    above = pa.array(least[up], mask=(head | tail)[up])
    columns = [
        np.full(nodes, number), row, parent, above, depth, members, least, children, rank[close] - rank[opens], summed(members * points_), summed(points_), points_,
        [ends[k][2] if k in ends else None for k in range(nodes)], head, tail, name, parent_name, upto,
    ]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, turns = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for own, first, n, ends in zip(*(batch.column(c).to_pylist() for c in ("turns", "first", "n", "ends")), strict=True):
            if held and turns + len(own) > SHARD_TURNS:
                yield _shard(number, held)
                number, held, turns = number + 1, [], 0
            held.append(([t["key"] for t in own], [t["points"] for t in own], first, n, ends))
            turns += len(own)
    if held:
        yield _shard(number, held)


def _counted_once(spines: DataFrame) -> DataFrame:
    """The nodes of spines, less what a shard before has counted of them and below them, and less leaves that a later shard goes on from."""
    # a row a shard: which one follows
    order = spines.where("depth = 0").select("shard", F.lead("shard").over(Window.orderBy("shard")).alias("following"))
    left = spines.where("tail").join(order, "shard").select(F.col("following").alias("shard"), F.col("shard").alias("earlier"), "depth", "name", (F.col("children") == 0).alias("bare"))
    # the deepest node that a shard has in common with the end of the one before it
    deepest = F.max_by(F.struct("earlier", "bare", "upto", "depth"), "depth").alias("m")
    seams = common.written(spines.where("head").join(left, ["shard", "depth", "name"]).groupBy("shard").agg(deepest).select("shard", "m.*"), "trie-seams")
    before = seams.select("shard", F.col("depth").alias("deep"), F.col("upto").alias("down"))
    reopened = seams.where("bare").select(F.col("earlier").alias("shard"), F.lit(1).alias("reopened"))
    less = lambda condition, n: F.when(condition, n).otherwise(0)
    return spines.join(before, "shard", "left").join(reopened, "shard", "left").withColumns({
        "children": F.col("children") - less(F.expr("head AND depth < deep"), F.lit(1)),
        "leaves": F.col("leaves") - less(F.expr("tail AND reopened = 1"), F.lit(1)),
        "points": F.col("points") - less(F.expr("head AND depth <= deep"), F.expr("down - upto + own")),
    })


def _result(least: str, parent: str) -> list[Column]:
    saved = (F.col("paid") - F.col("points")).alias("saved_tokens")
    ends = F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return [F.col(least).alias("conv_id"), F.col("depth"), F.col(parent).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), saved, ends]


def trie(sequences_: DataFrame) -> DataFrame:
    """conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    distinct = common.written(classes(sequences_), "trie-classes")
    nodes = common.written(distinct.repartitionByRange("turns").sortWithinPartitions("turns").mapInArrow(_shards, _NODE), "trie-nodes")
    counted = common.written(_counted_once(nodes.where("head OR tail")), "trie-spines")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "paid", "points")]
    merged = common.written(counted.groupBy("depth", "name").agg(*sums, F.min("least").alias("least"), F.max("ends").alias("ends"), F.max("parent_name").alias("parent_name")), "trie-merged")
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent_name"), F.col("least").alias("up"))
    on_spines = merged.join(parents, ["depth", "parent_name"], "left").select(*_result("least", "up"))
    beside = nodes.where("NOT head AND NOT tail")
    # in its shard the parent of a node beside the spines is known, unless it lies on one
    hanging = counted.select("shard", F.col("row").alias("parent"), "depth", "name").join(merged.select("depth", "name", F.col("least").alias("up")), ["depth", "name"]).select("shard", "parent", "up")
    below_spines = beside.where("above IS NULL").join(hanging, ["shard", "parent"]).select(*_result("least", "up"))
    return on_spines.union(below_spines).union(beside.where("above IS NOT NULL").select(*_result("least", "above")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations (conv_id, turn, role, text) as they are; see trie."""
    return trie(sequences(conversations))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all conversations, each rebuilt on the opening of the first of its hundred."""
    return trie(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
