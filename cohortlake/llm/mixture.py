"""Packing to target proportions: deficit round-robin over one queue of tokens for each source.

Every round gives each queue a quantum of credit, in proportion to its target; a queue hands on as many tokens as its credit
has whole ones, and carries the fraction, its deficit, to the next round. A round's quanta fill one window, so each window of
the stream so made holds every source in its target proportion, within a token or two, wherever the window is cut. Credit only
accrues, so what a queue has handed on after k rounds is floor(k * quantum), no more than it has: the state at any round is
known without running those before it. A task that knows the totals of the queues and where its documents stand in theirs finds
the windows of its tokens by itself, and deficits carry over windows and partitions alike. A queue that runs dry is passed over;
the others fill the windows then.

Documents are cut freely. All windows are full; the rest of the stream is cut into powers of two, longest first, so nothing is padded.

Defined results: null and empty texts are the end id alone; a null source is a source; repeated rows are packed like any others;
a null doc_id is kept; extra columns are ignored; an empty table gives an empty result. A text's ids (two or four bytes each) are
held by one task. Quanta have 16 binary digits behind the point, which is exact enough up to 2 ** 46 tokens.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm import common
from cohortlake.llm.packing import BROADCAST_ROWS
from cohortlake.llm.tokens import CACHE_CHARS, END_ID, PART_CHARS, _byte_letters

CAPACITY = 2048
#: Sources with a queue of their own where no targets are given: those with most tokens. All others share one.
QUEUES = 1024
#: Binary digits behind the point of a quantum.
POINT = 16
#: Tokens of a row of ids at most; longer texts take several rows.
SEGMENT = 1 << 18
#: Chunks of text that a worker remembers before it starts anew.
CACHE_ENTRIES = 400_000

#: A space beside other white space: there a pre-token may take in more than one of them.
_JOINT = re.compile(r"\s | \s")
#: A place between words where no pre-token crosses.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class ByteIds:
    """Encodes texts with a byte-level vocabulary file of the tokenizers library; its special tokens are ordinary text.

    The vocabulary's order is that of its merges, so the tiktoken library, which is faster, finds the same ids.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model["added_tokens"]}
        letters = {chr(v): b for b, v in _byte_letters().items()}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unit = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.unit).tobytes()

    def encode(self, text: str) -> bytes:
        """A text's ids. A space between two words begins a pre-token, so what stands between such spaces is remembered."""
        if not text or text[0] == " " or text[-1] == " " or _JOINT.search(text):
            return self.direct(text)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known, (first, *rest) = self.known, text.split(" ")
        out = [self.direct(first)]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self.direct(" " + word)
                if len(word) <= CACHE_CHARS:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def document(self, text: str) -> bytes:
        """A whole text's ids and the end id; long texts are encoded in parts."""
        out, start = [], 0
        while len(text) - start > PART_CHARS and (cut := _CUT.search(text, start + PART_CHARS)):
            out.append(self.encode(text[start : cut.start()]))
            start = cut.start()
        out.append(self.encode(text[start:] if start else text))
        return b"".join([*out, np.array([END_ID], self.unit).tobytes()])


_encoders: dict[str, ByteIds] = {}


def byte_ids(path: str | None = None) -> ByteIds:
    """The worker's encoder for a vocabulary file; one for each file."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = ByteIds(path)
    return _encoders[path]


def _forget() -> None:
    for e in _encoders.values():
        e.known.clear()


_ENCODED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("before", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _encoded(path: str | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        common.remember("mixture", _forget)
        encoder, task = byte_ids(path), TaskContext.get().partitionId()
        width, seen = np.dtype(encoder.unit).itemsize, {}
        for batch in common.chunks(batches):
            rows = []
            for doc, source, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "text")), strict=True):
                ids = encoder.document(text or "")
                total = len(ids) // width
                for start in range(0, total, SEGMENT):
                    own = ids[start * width : (start + SEGMENT) * width]
                    n = len(own) // width
                    rows.append((doc, source, total, start, seen.get(source, 0), task, n, own))
                    seen[source] = seen.get(source, 0) + n
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENCODED, strict=True)], schema=_ENCODED)

    return encode


def quanta(weights: list[float], capacity: int) -> np.ndarray:
    """Tokens that each queue is credited a round, with POINT binary digits behind the point, for given proportions."""
    total = sum(weights)
    return np.array([max(1, round(w / total * (capacity << POINT))) for w in weights], np.int64)


def windows_of(tokens: int, capacity: int) -> tuple[int, np.ndarray]:
    """The number of full windows, and the edges of the shorter ones behind them: the rest in powers of two."""
    full, rest = divmod(tokens, capacity)
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return full, full * capacity + np.cumsum([0, *powers])


def served(queue: int, start: int, end: int, totals: np.ndarray, quantum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens start..end of a queue as stretches that it hands on in one round each: first, last + 1, and place in the stream."""
    first, last = (-(-((t + 1) << POINT) // int(quantum[queue])) for t in (start, end - 1))
    rounds = np.arange(first, last + 1)
    a, b = np.maximum(start, (rounds - 1) * quantum[queue] >> POINT), np.minimum(end, rounds * quantum[queue] >> POINT)
    place = a + np.minimum(totals[:queue], rounds[:, None] * quantum[:queue] >> POINT).sum(axis=1) + np.minimum(totals[queue + 1 :], (rounds[:, None] - 1) * quantum[queue + 1 :] >> POINT).sum(axis=1)
    return a[a < b], b[a < b], place[a < b]


_PIECE = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_HELD_ROWS = 50_000


def _cut(unit: str, capacity: int, totals: np.ndarray, quantum: np.ndarray, with_ids: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    full, tail = windows_of(int(totals.sum()), capacity)
    schema = _PIECE.append(pa.field("ids", pa.binary())) if with_ids else _PIECE

    def window(place: int) -> tuple[int, int, int]:
        """Number, first place and end of the window at a place of the stream."""
        if place < full * capacity:
            number = place // capacity
            return number, number * capacity, (number + 1) * capacity
        at = int(np.searchsorted(tail, place, "right"))
        return full + at - 1, int(tail[at - 1]), int(tail[at])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in common.chunks(batches, "ids"):
            for doc, source, total, start, queue, at, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "doc_tokens", "start", "queue", "at", "ids")), strict=True):
                own = memoryview(np.frombuffer(ids, unit).astype("<u4").tobytes())
                for a, b, place in zip(*(x.tolist() for x in served(queue, at, at + len(own) // 4, totals, quantum)), strict=True):
                    while a < b:
                        number, first, end = window(place)
                        n = min(b - a, end - place)
                        piece = own[4 * (a - at) : 4 * (a - at + n)]
                        rows.append((doc, source, start + a - at, n, zlib.crc32(piece), total, number, place - first, *([bytes(piece)] if with_ids else [])))
                        a, place = a + n, place + n
                if len(rows) >= _HELD_ROWS:
                    yield out()
                    rows = []
        if rows:
            yield out()

    return run


def mixture_packing(docs: DataFrame, targets: Mapping[str | None, float] | None = None, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and its ids if asked for.

    targets are proportions of tokens by source; sources that they do not name share what is left to 1 (a queue of their own
    where nothing is: it is served when the others have run dry). Without targets every source keeps its own proportion.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    kinds = "doc_id long, source string, doc_tokens long, start long, before long, part long, n long, ids binary"
    held = common.written(docs.select("doc_id", source.alias("source"), "text").mapInArrow(_encoded(path), kinds), "byte-ids")
    counts = common.written(held.groupBy("source", "part").agg(F.sum("n").alias("n")), "source-counts")
    spark = docs.sparkSession
    if targets is None:  # a row a queue: QUEUES at most
        named = [r["source"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(QUEUES - 1).collect()]
    else:
        named = list(targets)
    queues = spark.createDataFrame([(k, s) for k, s in enumerate(named)], "queue int, __s string")
    of = counts.join(F.broadcast(queues), counts["source"].eqNullSafe(queues["__s"]), "left").select("source", "part", "n", F.coalesce("queue", F.lit(len(named))).alias("queue"))
    # a row a source and task: the places of a queue go over these in order
    base = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = common.written(of.select(F.col("source").alias("__s"), F.col("part").alias("__p"), "queue", "n", base.alias("base")), "source-starts")
    totals = np.zeros(len(named) + 1, np.int64)
    for r in starts.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # a row a queue
        totals[r["queue"]] = r["n"]
    if targets is None:
        weights = [float(t) for t in totals]
    else:
        weights = [*map(float, targets.values()), max(0.0, 1 - sum(targets.values()))]
    quantum = quanta(weights if sum(weights) > 0 else [1.0] * len(weights), capacity)
    side = starts.drop("n")
    side = F.broadcast(side) if starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side.hint("merge")
    at = (F.col("base") + F.col("before")).alias("at")
    placed = held.join(side, F.expr("source <=> __s AND part = __p")).select("doc_id", "source", "doc_tokens", "start", "queue", at, "ids")
    out = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(_cut(byte_ids(path).unit, capacity, totals, quantum, with_ids), out)


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens, every source in each by its share of all tokens."""
    return mixture_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
