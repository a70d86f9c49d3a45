"""Periodic runs of words, found by string synchronising sets.

A run is a maximal stretch of at least three periods. Periods below FIRST are scanned for directly. For each dyadic scale t,
periods from 2t to 4t are found from few positions: of the windows of t words, each named by a hash of its words, a position is
chosen where its own or the t-th following window has the least name among those between. That choice follows from the 2t words
from there on alone, so in a run it repeats with the period; two chosen positions with equal 2t words at a distance from 2t to
4t propose that distance. Windows that are themselves periodic by t/3 or less have no name: there is none to choose in a long
enough stretch of them, so the last window of each such stretch is chosen as well. These stretches are runs with smaller periods
and are known from the scales before. A proposal is extended word by word as far as its period holds, so hashes only propose.

All texts of a batch lie in one array, each with an end of its own behind it, and those too short for a scale leave it: work is
n log n array steps, and a run is extended once for all proposals in it.

Defined results: null and empty texts have no words and no runs; repeated rows are treated alike; extra columns are ignored; an
empty table gives an empty result. One text is held by one task, with about a hundred bytes a word while it is searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Words of a run at least, and periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods below this are scanned for; it is twice the first scale.
FIRST = 8
#: Texts of a batch are searched together up to so many bytes.
BATCH_BYTES = 1 << 20
_NO_NAME = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _joined(names: np.ndarray, step: int) -> np.ndarray:
    """Names of windows twice as long, of those at i and i + step; windows beyond the end get those that stand there."""
    later = np.concatenate([names[step:], np.arange(min(step, len(names)), dtype=np.uint64)])
    return _mixed(names * np.uint64(0x9E3779B97F4A7C15) + _mixed(later + np.uint64(0x632BE59BD9B4E019)))


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def _same(x: np.ndarray, i: int, j: int, step: int, low: int, high: int) -> int:
    """How many words agree from i and j on, going by step; places lie in low..high."""
    n, block = 0, 64
    while True:
        room = min(block, high - j) if step > 0 else min(block, i - low + 1)
        if room <= 0:
            return n
        a, b = (x[i : i + room], x[j : j + room]) if step > 0 else (x[i - room + 1 : i + 1][::-1], x[j - room + 1 : j + 1][::-1])
        apart = a != b
        at = int(apart.argmax())
        if apart[at]:
            return n + at
        n, i, j, block = n + room, i + step * room, j + step * room, block * 2


def _chosen(names: np.ndarray, t: int) -> np.ndarray:
    """Where the window or the t-th following one has the least name of those between; windows without name are never least."""
    least, width = names, 1
    while width * 2 <= t:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    least = np.minimum(least[:-1], least[1:])  # t is a power of two, so these are the t + 1 windows from i to i + t
    return (least != _NO_NAME) & ((least == names[: len(least)]) | (least == names[t : t + len(least)]))


def _proposals(at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): pairs of chosen places with one context at a distance from 2t to 4t."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    places, periods = [], []
    for k in range(1, len(at)):
        near = (context[k:] == context[:-k]) & (at[k:] - at[:-k] < 4 * t)
        if not near.any():
            break
        far = np.flatnonzero(near & (at[k:] - at[:-k] >= 2 * t))
        places.append(at[far])
        periods.append(at[far + k] - at[far])
    return (np.concatenate(places), np.concatenate(periods)) if places else (at[:0], at[:0])


def find_runs(words: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The (start, length, period) of all runs of at least three periods, by text, in order of start and period.

    words are numbers of all texts in a row; text k has those from starts[k] to starts[k + 1].
    """
    texts = len(starts) - 1
    lengths = np.diff(starts)
    x = np.insert(words.astype(np.int64), starts[1:], -1 - np.arange(texts))  # an end of its own behind each text
    begin = starts[:-1] + np.arange(texts)  # places of the texts in x
    found: dict[tuple[int, int, int], int] = {}  # (text, first, last + 1) -> least period

    def keep(text: int, first: int, end: int, period: int) -> None:
        key = (text, first, end)
        found[key] = min(found.get(key, period), period)

    for period in range(1, FIRST):
        first, end = _stretches(x[period:] == x[:-period])
        long = end - first >= (LEAST_PERIODS - 1) * period
        of = np.searchsorted(begin, first[long], "right") - 1
        for text, a, b in zip(of.tolist(), (first[long] - begin[of]).tolist(), (end[long] + period - begin[of]).tolist(), strict=True):
            keep(text, a, b, period)
    t = FIRST // 2
    names = _mixed(x.view(np.uint64))
    for step in (1, 2):
        names = _joined(names, step)
    live = np.arange(texts)
    while True:
        # only texts that have room for three periods of 2t words stay in the array
        enough = lengths[live] >= 2 * t * LEAST_PERIODS
        if not enough.any():
            break
        if not enough.all():
            taken = np.repeat(enough, lengths[live] + 1)
            x, names, live = x[taken], names[taken], live[enough]
        begin = np.concatenate([[0], np.cumsum(lengths[live] + 1)[:-1]])
        doubled = _joined(names, t)
        unnamed = np.zeros(len(x) + 1, np.int32)
        row = {text: k for k, text in enumerate(live.tolist())}
        for (text, first, end), period in found.items():
            if LEAST_PERIODS * period <= t <= end - first and text in row:
                at = int(begin[row[text]])
                unnamed[at + first] += 1
                unnamed[at + end - t + 1] -= 1
        bare = np.cumsum(unnamed[:-1]) > 0
        picked = _chosen(np.where(bare, _NO_NAME, names), t)
        last = bare[:-1] & ~bare[1:]
        at = np.flatnonzero(np.concatenate([picked, np.zeros(len(x) - len(picked), bool)]) | np.concatenate([last, [False]]))
        places, periods = _proposals(at, doubled[at], t)
        order = np.lexsort((places, periods))
        done, before = -1, 0
        for place, period in zip(places[order].tolist(), periods[order].tolist(), strict=True):
            if period == before and place < done:
                continue
            k = int(np.searchsorted(begin, place, "right")) - 1
            low, high = int(begin[k]), int(begin[k] + lengths[live[k]])
            first = place - _same(x, place - 1, place + period - 1, -1, low, high)
            end = place + period + _same(x, place, place + period, 1, low, high)
            before, done = period, end - period
            if end - first >= LEAST_PERIODS * period:
                keep(int(live[k]), first - low, end - low, period)
        names, t = doubled, 2 * t
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    for (text, first, end), period in sorted(found.items()):
        out[text].append((first, end - first, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as numbers, where each text starts, and the words by number."""
    seen: dict[bytes, int] = {}
    rows, starts = [], [0]
    for text in texts:
        words = text.split()  # at the six white-space bytes of ASCII only
        rows.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
        starts.append(starts[-1] + len(words))
    return np.concatenate(rows) if rows else np.zeros(0, np.int32), np.array(starts, np.int64), list(seen)


def _collapsed(words: np.ndarray, names: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([names[i] for i in words[np.cumsum(change[:-1]) == 0].tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, limit=BATCH_BYTES):
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        words, starts, names = _numbers(texts)
        rows, kept = [], []
        for k, runs in enumerate(find_runs(words, starts)):
            runs = [r for r in runs if r[1] >= LEAST_WORDS]
            rows.append([{"start": a, "length": n, "period": p} for a, n, p in runs])
            kept.append(_collapsed(words[starts[k] : starts[k + 1]], names, runs).decode())
        yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.list_(_RUN)), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period) and the text without repeated periods."""
    return docs.select("doc_id", "text").mapInArrow(_runs, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, where about every tenth text (by its id) is made periodic from some word on; rows without id stay as they are."""
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    asked = docs.select("doc_id", common.empty_to_text(), h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10))
    cut = asked.withColumn("a", F.when(F.size("w") > 0, F.expr("int(g % size(w))"))).withColumn("p", F.expr("int(1 + (size(w) - a) div (3 + g % 8))"))
    altered = F.expr("array_join(concat(slice(w, 1, a), transform(sequence(0, size(w) - a - 1), k -> get(w, a + k % p))), ' ')")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), altered).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents: how many, the one with most periods, and digests of all runs and of the texts without repetitions."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # runs come by start and period, so of equally high ones the first stays
    top = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (m, r) -> CASE WHEN m IS NULL OR r.length * m.period > m.length * r.period THEN r ELSE m END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.withColumn("top", top)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
