"""Packing of token sequences: large-item matching, and best fit decreasing into id matrices.

A packing depends on how many pieces there are of each length only, so it is planned on those counts: at most one number
for each length up to the capacity, whatever the number of documents. The plan is a list of allotments "the pieces of
length l with ranks r to s fill sequences q, q+1, ... with k each, from offset o on", and each piece finds its place by its
rank among the pieces of its length. Nothing but counts meets in one place, and the result is the one that the algorithm
gives on all pieces together, not one for each task.

Defined results: null and empty texts are the end id alone; documents above the capacity are cut into full pieces and a
rest; repeated rows are packed like any others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm import common, tokens

CAPACITY = 4096
#: Rows of (length, task, number before) that are sent to all tasks at most: 24 bytes each.
BROADCAST_ROWS = 1_000_000


class CapacityTree:
    """A segment tree over room 0..capacity: which amounts of room some sequence has, and the least that is enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)

    def set(self, room: int, present: bool) -> None:
        at = room + self.leaves
        self.some[at] = int(present)
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def least(self, room: int) -> int | None:
        """The smallest amount of room >= room that is present."""
        at = room + self.leaves
        if self.some[at]:
            return room
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.some[2 * at])
                return at - self.leaves
            at //= 2
        return None


@dataclass
class Plan:
    """Allotments (length, first rank, ranks, first sequence, pieces in each, offset), and the open room."""

    capacity: int
    allotments: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)
    open: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    tree: CapacityTree | None = None

    def __post_init__(self) -> None:
        self.tree = CapacityTree(self.capacity)

    def give(self, length: int, many: int, first: int, each: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.allotments.append((length, rank, many, first, each, offset))
        self.used[length] = rank + many

    def leave(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.open.setdefault(room, []).append((first, count))
            self.tree.set(room, True)

    def take(self, room: int) -> tuple[int, int]:
        found = self.open[room].pop()
        if not self.open[room]:
            self.tree.set(room, False)
        return found

    def best_fit(self, length: int, many: int) -> None:
        """Places pieces of one length, each where the least room is left; opens sequences when none has room."""
        while many:
            room = self.tree.least(length)
            if room is None:
                count = -(-many // (self.capacity // length))
                self.leave(self.capacity, self.sequences, count)
                self.sequences += count
                continue
            first, count = self.take(room)
            each = room // length
            full = min(count, many // each)
            if full:
                self.give(length, full * each, first, each, self.capacity - room)
                self.leave(room - each * length, first, full)
                self.leave(room, first + full, count - full)
                many -= full * each
            else:
                self.give(length, many, first, many, self.capacity - room)
                self.leave(room - many * length, first, 1)
                self.leave(room, first + 1, count - 1)
                many = 0


def large_item_matching(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pieces above a third of the capacity: at most two fit together, so the longest takes the longest partner that fits.

    That greedy matching makes as many pairs as possible. Shorter pieces follow, longest first, into the best gap.
    """
    plan, left = Plan(capacity), dict(counts)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    partners = CapacityTree(capacity)  # by capacity - length: the least is the longest partner
    for n in large:
        partners.set(capacity - n, True)

    def use(n: int, many: int) -> None:
        left[n] -= many
        if not left[n]:
            partners.set(capacity - n, False)

    for n in large:
        while left[n]:
            found = partners.least(max(n, capacity - n))  # no longer than n, and fits beside it
            partner = capacity - found if found is not None else None
            if partner == n and left[n] < 2:
                found = partners.least(max(n, capacity - n + 1))
                partner = capacity - found if found is not None else None
            first = plan.sequences
            if partner is None or partner == n and left[n] < 2:
                pairs = left[n]
                use(n, pairs)
                plan.give(n, pairs, first, 1, 0)
                plan.leave(capacity - n, first, pairs)
            elif partner == n:
                pairs = left[n] // 2
                use(n, 2 * pairs)
                plan.give(n, 2 * pairs, first, 2, 0)
                plan.leave(capacity - 2 * n, first, pairs)
            else:
                pairs = min(left[n], left[partner])
                use(n, pairs)
                use(partner, pairs)
                plan.give(n, pairs, first, 1, 0)
                plan.give(partner, pairs, first, 1, n)
                plan.leave(capacity - n - partner, first, pairs)
            plan.sequences += pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        plan.best_fit(n, left[n])
    return plan


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """All pieces, longest first, each into the sequence with the least room that is enough."""
    plan = Plan(capacity)
    for n in sorted(counts, reverse=True):
        plan.best_fit(n, counts[n])
    return plan


#: What a task hands on of each piece.
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ordinal long, part long"
#: Ids that a task holds before it hands pieces on, in bytes.
_HELD_BYTES = 8 << 20


def _encoded(encoder: tokens.WordIds, texts: list[str | None]) -> Iterator[tuple[int, bytes, bool]]:
    """(row, ids, last): the ids of each text, END_ID at its end; those of long texts in several parts."""
    end, held, size = np.array([tokens.END_ID], "<u4").tobytes(), [], 0

    def out() -> Iterator[tuple[int, bytes, bool]]:
        for (row, _, last), ids in zip(held, encoder.encode([t for _, t, _ in held]), strict=True):
            yield row, ids + end if last else ids, last

    for row, text in enumerate(texts):
        part = None
        for following in tokens.parts(text or ""):
            if part is not None:
                held.append((row, part, False))
            part = following
            size += len(part)
            if size >= common.CHUNK_BYTES and held:
                yield from out()
                held, size = [], len(part)
        held.append((row, part, True))
    yield from out()


def _pieces(capacity: int, path: str | None, with_ids: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ordinal", pa.int64()), ("part", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remember("packing", tokens.forget)
        encoder, task, seen, rows, size = tokens.word_ids(path), TaskContext.get().partitionId(), {}, [], 0
        for batch in common.chunks(batches):
            docs = batch.column("doc_id").to_pylist()
            piece, rest = 0, b""
            for row, ids, last in _encoded(encoder, batch.column("text").to_pylist()):
                ids = memoryview(rest + ids if rest else ids)
                at, n = 0, len(ids)
                while n - at > 4 * capacity or last and at < n:
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    ordinal = seen.get(length, 0)
                    seen[length] = ordinal + 1
                    rows.append((docs[row], piece, piece * capacity, length, zlib.crc32(own), ordinal, task, *([bytes(own)] if with_ids else [])))
                    size += 64 + len(own) * with_ids
                    at, piece = at + len(own), piece + 1
                    if size >= _HELD_BYTES:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                rest = bytes(ids[at:])
                if last:
                    piece, rest = 0, b""
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return cut


def pieces(docs: DataFrame, capacity: int, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row a piece, with the number `ordinal` that it has among the pieces of its length in its task `part`."""
    return common.written(docs.select("doc_id", "text").mapInArrow(_pieces(capacity, path, with_ids), _PIECE + ", ids binary" * with_ids), "pieces")


def _places(starts: np.ndarray, table: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 3] + at // row[:, 4], row[:, 5] + at % row[:, 4] * length
            own = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sequence), pa.array(offset)], names=[*own.schema.names, "sequence_id", "offset"])

    return place


def packed(cut: DataFrame, planner: Callable[[dict[int, int], int], Plan], capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset."""
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = common.written(counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")), "piece-counts")
    # a number for each length: `capacity` rows at most
    plan = planner({r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = np.array(sorted(plan.allotments), np.int64).reshape(-1, 6)
    # a row a task and length: sent along only up to a bound, joined by shuffle beyond it
    before_all = offsets.select("length", "part", "before")
    few = offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ranked = cut.join(F.broadcast(before_all) if few else before_all.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("ordinal")).drop("before", "ordinal", "part")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_places((table[:, 0] << 44) + table[:, 1], table), schema)


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset by large-item matching."""
    return packed(pieces(docs, capacity, path), large_item_matching, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _matrices(capacity: int, unit: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sequences from pieces that come in order of sequence and offset."""
    names = ["sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def row(held: list[tuple]) -> tuple:
        lengths = [len(x[3]) // 4 for x in held]
        used = sum(lengths)
        ids, positions = np.zeros((2, capacity), unit)
        ids[:used] = np.frombuffer(b"".join(x[3] for x in held), "<u4")
        positions[:used] = np.concatenate([np.arange(n) for n in lengths])
        return (held[0][0], used, [x[1] for x in held], [x[2] for x in held], [0, *np.cumsum(lengths).tolist()], ids.tobytes(), positions.tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []
        for batch in batches:
            for piece in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "doc_id", "piece", "ids")), strict=True):
                if held and held[0][0] != piece[0]:
                    done.append(row(held))
                    held = []
                held.append(piece)
                if len(done) >= 256:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                    done = []
        if held:
            done.append(row(held))
        if done:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return run


def packed_matrices(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row a sequence: `input_ids` as `capacity` little-endian unsigned numbers (0 behind the last token), the cumulative
    lengths of its segments (0 first), and `position_ids`, which start anew with each segment. Numbers have 16 bits, or 32
    where the vocabulary or the capacity needs them. Write it with DataFrame.write: the binary columns are the matrices' rows.
    """
    unit = "<u2" if max(capacity, tokens.word_ids(path).tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"
    placed = packed(pieces(docs, capacity, path, with_ids=True), best_fit_decreasing, capacity)
    ordered = placed.select("sequence_id", "offset", "doc_id", "piece", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return ordered.mapInArrow(_matrices(capacity, unit), "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed id matrices of 4096 columns."""
    return packed_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
