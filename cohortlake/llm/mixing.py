"""Language-model scores by online logistic context mixing.

A text is read as the bytes of its words, a space behind each, and a line end. Each byte is a path of binary decisions (the
Huffman code of the training bytes). Four predictors, chosen by hashed contexts, give log-odds for each decision: the last two
and the last three bytes, the word so far, and the byte that followed when the last six bytes stood in this text before. A
logistic mixer joins them. Its weights are chosen by a gate (how well the word so far is known, how long the repeat has held);
they start from values fitted on training documents and are refined by a gradient step after every byte.
The score is the log10 of the product of all mixed probabilities; equal texts have equal scores, wherever they stand.

What the corpus teaches are exact counts over all training documents. Those of the word so far are prefixes of words: all
distinct words with their counts are sorted and cut in blocks, and a block holds its contexts whole (but for the prefixes of
its first and last word, whose counts are joined from all blocks). Each chunk of texts asks each block that has words of it for
the log-odds along these words, packed in one row. They grow with the corpus; of them only the first word of each
block (of 50,000 words) is sent to tasks. Contexts of two
and three bytes are sent along if they cover at least 1 / SHARE of the training bytes, so there are at most SHARE of either.

The starting weights are fitted on all training documents, from counts of decisions by their inputs, so texts are not read
again. Bytes of a word behind its third come from the distinct words with their counts, as if nothing were repeated; those
before it from the counts of a byte behind three others, which hold the whole word so far, by what repeats said there. Each
occurrence is taken out of the counts of words that its own inputs come from, so that the fit sees words as a new text does.

Settings of the model: refined weights start anew every SEGMENT bytes; texts over RUN_BYTES are read in runs that do not see
each other's repeats; contexts of words end after WORD_BYTES bytes.

Defined results: a null text is an empty one and consists of the end token; rows that share a doc_id are rows of their own,
those without one belong to the training documents; without training documents all counts are 0 and the predictors of the
corpus silent; bits_per_byte is null for empty texts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Words that a counting task holds before it hands counts on.
HELD_WORDS = 300_000
#: Words of a block, and bytes of its words, at most (one word at least).
BLOCK_KEYS, BLOCK_BYTES = 50_000, 1 << 19
#: Blocks whose first words are joined by broadcast at most.
MOST_SENT = 1 << 18
#: Text of a row of chunks, and of a run.
CHUNK_BYTES, RUN_BYTES = 4 << 20, 1 << 18
#: Bytes that a task mixes at a time.
MIX_BYTES = 1 << 19
#: Bytes from one start of the weights to the next.
SEGMENT = 512
#: Two- and three-byte contexts rarer than one in SHARE training bytes are silent.
SHARE = 1 << 17
#: Bytes of a word that have contexts of their own.
WORD_BYTES = 64
#: Bytes that must recur for a prediction from this text itself, and how long predictions held for each state of the gate.
REPEAT, HELD = 6, (8, 24)
#: Log-odds of a repeated byte's decisions, in units; the gate's weight makes them what they are worth.
REPEAT_ODDS = 8
#: Unit of the stored log-odds, which have six bits; two more say how well they are known.
UNIT = 0.25
#: Bytes whose repeats a counting task looks for at a time (one run at least; all are looked for).
SAMPLE = 1 << 20
#: What the weights of a gate are drawn to where training documents say little, and how strongly (decisions).
PRIOR, PRIOR_STRENGTH = (0.1, 0.3, 0.6, 0.8), 20.0
#: Rate of refinement.
RATE = 0.02
GATES = 16

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xFF51AFD7ED558CCD)
_H = np.uint64(32)
END = b"\n"
#: Decisions of a byte are mixed in parts that end here (and at the longest code); none goes on beyond a multiple of eight.
PARTS = (4, 8, 16, 24, 32, 40, 48)
#: Bytes whose inputs a task widens at a time.
TOGETHER = 1 << 13
#: The four weights of a gate move as one value of this kind.
_FOUR = np.complex128
#: Two-byte contexts have this bit set.
_TWO = 1 << 24


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _H)) * _N
    return x ^ (x >> _H)


_SYMBOLS = _mixed(np.arange(1, 257, dtype=np.uint64) * _M)


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def eights(values: np.ndarray) -> np.ndarray:
    """For each eight columns of bytes and each row: these bytes as one number."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint64).T)


class Code:
    """The Huffman code of 256 byte counts: a path of nodes and bits for each byte."""

    def __init__(self, counts: np.ndarray) -> None:
        heap = [(int(c) + 1, i, (i,)) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        for node in range(255):
            (a, i, left), (b, j, right) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in ((0, left), (1, right)):
                for s in side:
                    paths[s].append((254 - node, bit))
            heapq.heappush(heap, (a + b, min(i, j), left + right))
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(np.r_[0, self.length])[:-1]
        self.node = np.array([n for p in paths for n, _ in reversed(p)], np.int32)
        self.bit = np.array([b for p in paths for _, b in reversed(p)], np.int8)
        #: For each byte and node: whether the byte passes the node with bit 0, with bit 1.
        self.passes = np.zeros((2, 256, 256), np.float32)
        for s, p in enumerate(paths):
            for n, b in p:
                self.passes[b, s, n] = 1
        #: For each byte and node: 1 if the byte takes bit 1 there, -1 for bit 0, 0 if it does not come there.
        self.way = (self.passes[1] - self.passes[0]).astype(np.int8).ravel()
        #: For each decision and byte: its node, and 1 or -1 for the way taken there, 0 behind the last one.
        self.node_at = np.zeros((int(self.length.max()), 256), np.int64)
        self.sign_at = np.zeros(self.node_at.shape, np.int8)
        for s, p in enumerate(paths):
            for d, (n, b) in enumerate(reversed(p)):
                self.node_at[d, s], self.sign_at[d, s] = n, 2 * b - 1
        #: Eights of decisions, and for each eight and byte the bits of its decisions there.
        self.eights = -(-len(self.node_at) // 8)
        self.kept = eights(-(np.arange(8 * self.eights)[:, None] < self.length).astype(np.int8).T)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each decision along the bytes: the index of its byte and its index in the code."""
        n = self.length[symbols]
        of = np.repeat(np.arange(len(n), dtype=np.int32), n)
        return of, np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(n) - n - self.start[symbols]).astype(np.int32), n)


def stored_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of a one in six bits, and in the two low bits how well known they are: seen never, under 4 times, under 32, more."""
    known = np.searchsorted([1, 4, 32], zeros + ones, "right").astype(np.int8)
    odds = np.clip(np.rint((np.log(ones + 0.2) - np.log(zeros + 0.2)) / UNIT), -31, 31).astype(np.int8)
    return (odds << 2) + known


def towards(odds: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Stored log-odds of a one as those of the decision taken."""
    return np.where(one, odds, (-(odds >> 2) << 2) | (odds & 3)).astype(np.int8)


def runs_of(text: str | None) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they are the last) of a text in runs cut at white space (a longer word stays whole)."""
    raw, start = raw_bytes(text), 0
    while len(raw) - start > RUN_BYTES:
        words = raw[start : start + RUN_BYTES].rsplit(None, 1)
        end = start + RUN_BYTES - len(words[1]) if len(words) == 2 and not raw[start + RUN_BYTES - 1 : start + RUN_BYTES].isspace() else start + RUN_BYTES
        if len(words) < 2:  # no white space, or nothing else
            rest = raw[end : end + 1]
            while rest and not rest.isspace():
                ahead = raw[end : end + RUN_BYTES].split(None, 1)[0]
                end += len(ahead)
                rest = raw[end : end + 1]
        yield raw[start:end], False
        start = end
    yield raw[start:] if start else raw, True


class Uneven:
    """Values of uneven length behind one another, read by their numbers."""

    def __init__(self, values: list[bytes], kind: type) -> None:
        self.values = np.frombuffer(b"".join(values), kind)
        self.size = np.fromiter(map(len, values), np.int64, len(values))
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size.take(ids)
        ends = np.cumsum(n)
        at = np.repeat(self.start.take(ids) - ends + n, n)
        at += np.arange(len(at))
        return self.values.take(at)


def spelled(words: list[bytes]) -> Uneven:
    """The bytes to predict of words."""
    return Uneven([w if w == END else w + b" " for w in words], np.uint8)


class Chunk(NamedTuple):
    """Runs of about CHUNK_BYTES of text: row, doc_id, held_out, last and bytes of each; their distinct words and END in order,
    and the numbers in `words` of each run's words.
    """

    runs: list[tuple]
    words: list[bytes]
    ids: list[np.ndarray]

    def tokens(self, run: int, end: int) -> np.ndarray:
        """The numbers of a run's words, and that of END where the text ends."""
        return np.r_[self.ids[run], np.int32(end)] if self.runs[run][3] else self.ids[run]


#: Columns of a chunk's row.
_LISTS = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "last": pa.bool_(), "n_bytes": pa.int64(), "n_words": pa.int64()}
_CHUNK = "row array<long>, doc_id array<long>, held_out array<boolean>, last array<boolean>, n_bytes array<long>, n_words array<long>, words binary, ids binary"


def _chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about CHUNK_BYTES of text (Chunk), an entry of each list a run. Words are told apart here once for all steps."""
    pack = zstandard.ZstdCompressor(level=1).compress
    rows, size, row, ids, number = [], 0, TaskContext.get().partitionId() << 33, array("i"), defaultdict(int, {END: 0})
    number.default_factory = number.__len__

    def out() -> pa.RecordBatch:
        words = sorted(number, key=sort_key if max(map(len, number)) >= WORD_BYTES else None)
        place = np.empty(len(words), np.int32)
        place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        lists = [pa.array([list(c)], pa.list_(k)) for c, k in zip(zip(*rows, strict=True), _LISTS.values(), strict=True)]
        blobs = [pa.array([pack(b)], pa.binary()) for b in (b" ".join(words), place[np.frombuffer(ids, np.int32)].tobytes())]
        return pa.record_batch([*lists, *blobs], names=[*_LISTS, "words", "ids"])

    for batch in common.chunks(batches, limit=CHUNK_BYTES):
        for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
            for run, last in runs_of(text):
                if rows and size + len(run) > CHUNK_BYTES:
                    yield out()
                    rows, size, ids = [], 0, array("i")
                    number.clear()
                    number[END] = 0
                words = run.split()
                ids.extend(map(number.__getitem__, words))
                rows.append((row, doc_id, held, last, len(run), len(words)))
                size += len(run)
            row += 1
    if rows:
        yield out()


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[Chunk]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            *runs, n_words = (batch.column(c)[i].as_py() for c in _LISTS)
            words, ids = (unpack(batch.column(c)[i].as_py()) for c in ("words", "ids"))
            yield Chunk(list(zip(*runs, strict=True)), words.split(b" "), np.split(np.frombuffer(ids, np.int32), np.cumsum(n_words)[:-1]))


def _coded(words: list[bytes], last: bool) -> bytes:
    """The bytes to predict."""
    return b" ".join([*words, END if last else b""])


def repeats(text: np.ndarray, at: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of `text` at `at`: what followed when the REPEAT bytes before it stood in its span before, and the gate's
    state: 0 without such a place, more the longer it has held.
    """
    if not len(at):
        return text[:0], np.zeros(0, np.int8)
    last = text.astype(np.uint64)
    last = last[:-1] << np.uint64(8) | last[1:]
    last = (last[:-4] << np.uint64(32) | last[2:-2] << np.uint64(16) | last[4:])[at - REPEAT]  # REPEAT is six
    # places in the low bits: sorting values is faster than sorting places by values
    low = np.uint64((1 << max(len(at) - 1, 1).bit_length()) - 1)
    key = np.sort(_mixed(last * _M ^ _mixed((span.astype(np.uint64) + np.uint64(1)) * _N)) & ~low | np.arange(len(at), dtype=np.uint64))
    order, key = (key & low).astype(np.int64), key & ~low
    same = np.flatnonzero(key[1:] == key[:-1])
    one, other = order[same + 1], order[same]
    if np.any((last[one] != last[other]) | (span[one] != span[other])):  # a key of different bytes
        order = np.lexsort((last, span))
        same = np.flatnonzero((last[order[1:]] == last[order[:-1]]) & (span[order[1:]] == span[order[:-1]]))
        one, other = order[same + 1], order[same]
    before = np.full(len(at), -1)
    before[one] = other
    symbol = text[at]
    guess, found = symbol[before], before >= 0
    index = np.arange(len(at), dtype=np.int32)
    held = np.zeros(len(at), np.int32)
    np.subtract(index[:-1], np.maximum.accumulate(np.where(found & (guess == symbol), np.int32(-1), index))[:-1], out=held[1:])
    return guess, found.view(np.int8) * (1 + (held >= HELD[0]).view(np.int8) + (held >= HELD[1]).view(np.int8))


def _told(runs: list[np.ndarray]) -> np.ndarray:
    """For each byte to predict: the three before it and itself as one number, and above them what a repeat foretells and its
    state where the word so far has less than three bytes.
    """
    sizes = np.array([len(r) for r in runs])
    lead = np.full(REPEAT, 10, np.uint8)
    text = np.concatenate([x for r in runs for x in (lead, r)])
    span = np.repeat(np.arange(len(runs)), sizes)
    at = np.arange(len(span)) + (span + 1) * REPEAT
    guess, state = repeats(text, at, span)
    out, early = np.zeros(len(at), np.uint64), np.zeros(len(at), bool)
    for k in (3, 2, 1, 0):
        b = text[at - k]
        out = out << np.uint64(8) | b
        if k:
            early |= (b == 32) | (b == 10)
    told = np.flatnonzero(early & (state > 0))
    out[told] |= (state[told].astype(np.uint64) << np.uint64(8) | guess[told]) << np.uint64(32)
    return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): all words, and how often they stand in training documents; END for ends of texts; a space and six
    bytes for a byte behind three others (_told).
    """
    counts: Counter = Counter()
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    record = lambda words, n: pa.record_batch([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        quads, many = (np.concatenate(x) for x in zip(*seen, strict=True))
        known, at = np.unique(quads, return_inverse=True)
        return known, np.bincount(at, many).astype(np.int64)

    for chunk in _chunks(batches):
        streams: list[np.ndarray] = []
        n = np.zeros(len(chunk.words), np.int64)
        end, text = chunk.words.index(END), spelled(chunk.words)
        for i, ((_, _, held, last, _), ids) in enumerate(zip(chunk.runs, chunk.ids, strict=True)):
            if held:
                continue
            n[end] += last
            if len(ids) or last:
                streams.append(text.of(chunk.tokens(i, end)))
        training = [ids for (_, _, held, *_), ids in zip(chunk.runs, chunk.ids, strict=True) if not held]
        if training:
            n += np.bincount(np.concatenate(training), minlength=len(n))
        counts.update(dict(zip(chunk.words, n.tolist(), strict=True)))
        while streams:
            some, size = [streams.pop()], 0
            while streams and (size := size + len(some[-1])) + len(streams[-1]) <= SAMPLE:
                some.append(streams.pop())
            seen.append(np.unique(_told(some), return_counts=True))
        if sum(len(q) for q, _ in seen) > 1 << 22:
            seen = [merged()]
        if len(counts) > HELD_WORDS:
            yield record(list(counts), list(counts.values()))
            counts.clear()
    if counts:
        yield record(list(counts), list(counts.values()))
    if seen:
        quads, many = merged()
        for a in range(0, len(quads), 1 << 16):
            yield record([b" " + q.to_bytes(6, "big") for q in quads[a : a + (1 << 16)].tolist()], many[a : a + (1 << 16)])


def sort_key(word: bytes) -> bytes:
    """Words in the order of their contexts; a hash keeps long words apart."""
    return word if len(word) < WORD_BYTES else word[:WORD_BYTES] + xxhash.xxh64_digest(word, seed=42)


def _sort_key() -> Column:
    """The same in Spark, whose xxhash64 has that seed."""
    return F.when(F.length("word") < WORD_BYTES, F.col("word")).otherwise(F.concat(F.substring("word", 1, WORD_BYTES), F.unhex(F.lpad(F.hex(F.xxhash64("word")), 16, "0"))))


def _key_blocks(most: int, most_bytes: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts sorted words into blocks, one a row: the first one's sort key, and lists of word and n."""
    record = lambda keys, many: pa.record_batch([pa.array([sort_key(keys[0])]), pa.array([keys], pa.list_(pa.binary())), pa.array([many], pa.list_(pa.int64()))], names=["first", "word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many, total = [], [], 0
        for batch in batches:
            for k, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if keys and (len(keys) >= most or total + len(k) > most_bytes):
                    yield record(keys, many)
                    keys, many, total = [], [], 0
                keys.append(k)
                many.append(n)
                total += len(k)
        if keys:
            yield record(keys, many)

    return run


def _positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte with a context of its own (those of a word and the space behind it): its context, itself, its word."""
    whole = [w if w == END else (w[:WORD_BYTES] + b" ")[:WORD_BYTES] for w in words]
    text = np.frombuffer(b"".join(whole), np.uint8)
    size = np.array([len(w) for w in whole])
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    place = (np.arange(len(text)) - first[of]).astype(np.uint64) + np.uint64(1)
    sums = np.r_[np.uint64(0), np.cumsum(_SYMBOLS[text] * (_mixed(place * _N) | np.uint64(1)))]
    context = _mixed(sums[:-1] - sums[first[of]] + _mixed(place * _M))
    return context.view(np.int64), text.astype(np.int64), of


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, context, symbol, n) of the contexts of a block's first and last word: those that other blocks may share."""

    for batch in batches:
        for block, words, n in zip(batch.column("block").to_pylist(), batch.column("word"), batch.column("n"), strict=True):
            context, symbol, of = _positions(words.as_py())
            at = np.flatnonzero(np.isin(context, context[(of == 0) | (of == of[-1])]))
            at = at[np.lexsort((symbol[at], context[at]))]
            context, symbol = context[at], symbol[at]
            starts = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])])
            sums = np.add.reduceat(n.values.to_numpy()[of[at]], starts)
            yield pa.record_batch([pa.array(np.full(len(starts), block)), pa.array(context[starts]), pa.array(symbol[starts].astype(np.int32)), pa.array(sums)], names=["block", "context", "symbol", "n"])


def cells(gate: np.ndarray, two: np.ndarray, three: np.ndarray, word: np.ndarray, repeat: np.ndarray | int) -> np.ndarray:
    """Gate and inputs of decisions as one number; inputs in units, repeat -1 to 1."""
    out = gate.astype(np.int32)
    for x in (two, three, word):
        out = out << 6 | (x.astype(np.int32) + 32)
    return out << 2 | (repeat + 1)


def _summed(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(cell, return_inverse=True)
    return known, np.bincount(at, n, len(known)).astype(np.int64)


def _block_odds(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with the stored log-odds of the decisions taken along each word, and their cells behind the third byte of words."""
    code = model.code

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, n, shared in zip(batch.column("block"), batch.column("word"), batch.column("n"), batch.column("shared"), strict=True):
                keys, n = words.as_py(), n.values.to_numpy()
                context, symbol, of = _positions(keys)
                known, index = np.unique(context, return_inverse=True)
                pairs, first, at = np.unique((index << 8) + symbol, return_index=True, return_inverse=True)
                also, also_symbol, also_n = (shared.values.field(c).to_numpy(zero_copy_only=False) for c in ("context", "symbol", "n"))
                of_pair = np.r_[pairs >> 8, np.searchsorted(known, also)]
                byte, way = code.decisions(np.r_[pairs & 255, also_symbol])
                place, to = np.unique((of_pair[byte] << 8) + code.node[way], return_inverse=True)
                one = code.bit[way] == 1
                inner = ~np.isin(known, also)[pairs >> 8]  # the others' counts are those of all blocks
                here = np.bincount(at, n[of], len(pairs))
                weight = np.r_[here * inner, also_n][byte]
                ones, zeros = (np.bincount(to, weight * w, len(place))[to] for w in (one, ~one))
                # along the words: the decisions of the pair at each position
                length, ahead = code.length[pairs & 255], np.cumsum(code.length[pairs & 255]) - code.length[pairs & 255]
                steps = length[at]
                ends = np.cumsum(steps)
                along = np.repeat(ahead[at] - ends + steps, steps) + np.arange(ends[-1])
                cuts = np.r_[0, np.cumsum(np.bincount(of, steps, len(keys)).astype(np.int64))]
                odds = towards(stored_odds(zeros, ones), one)[along]
                values = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(odds.tobytes())])
                # those of this block's words, each without itself
                start = np.searchsorted(of, of[first])
                deep = np.flatnonzero((first - start >= 3) & (here > 0))
                lead = [symbol[first[deep] - k] for k in (3, 2, 1)]
                those = np.repeat(ahead[deep] - np.cumsum(length[deep]) + length[deep], length[deep]) + np.arange(length[deep].sum())
                cell, many = model.counted(np.stack(lead), pairs[deep] & 255, here[deep], zeros[those], ones[those])
                whole, its = pa.array([0, len(keys)], pa.int32()), pa.array([0, len(cell)], pa.int32())
                lists = [*(pa.ListArray.from_arrays(whole, x) for x in (words.values, pa.array(n), values)), *(pa.ListArray.from_arrays(its, pa.array(x)) for x in (cell, many))]
                yield pa.record_batch([pa.array([block.as_py()], pa.int64()), *lists], names=["block", "word", "n", "odds", "cell", "many"])

    return run


def _early(model: Model, prefix: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, many) of bytes before the fourth of a word, from their counts (_told); prefix, symbol and n count the bytes behind
    each word so far.
    """
    known = np.unique(prefix)
    seen = np.zeros((len(known), 256), np.float32)
    seen[np.searchsorted(known, prefix), symbol] = n
    sides = [(seen @ p).ravel() for p in model.code.passes]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, n, prefix = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("told", "n", "prefix"))
            byte, way = model.code.decisions(told & 255)
            place = (np.searchsorted(known, prefix)[byte] << 8) + model.code.node[way]
            found = model.counted(np.stack([told >> 24 & 255, told >> 16 & 255, told >> 8 & 255]), told & 255, n, *(x[place] for x in sides), told >> 32 & 255, told >> 40)
            yield pa.record_batch([pa.array(x) for x in found], names=["cell", "many"])

    return run


def _asked(blocks: list[int], firsts: list[bytes]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, chunk, words): what each chunk asks of each block, its words in order behind one another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words, rows, start = unpack(blob).split(b" "), [], 0
                while start < len(words):
                    which = max(bisect.bisect_right(firsts, sort_key(words[start])) - 1, 0)
                    end = bisect.bisect_left(words, firsts[which + 1], start + 1, key=sort_key) if which + 1 < len(firsts) else len(words)
                    rows.append((blocks[which], chunk, pack(b" ".join(words[start:end]))))
                    start = end
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "chunk", "words"])

    return run


def _answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, block, answer): counts, sizes and log-odds of the words asked for; a block comes before what is asked of it."""
    pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    known: dict[bytes, tuple[int, bytes]] = {}
    for batch in batches:
        rows = []
        for i, (block, chunk, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "chunk", "words")), strict=True)):
            if chunk < 0:
                known = dict(zip(batch.column("word")[i].as_py(), zip(batch.column("n")[i].as_py(), batch.column("odds")[i].as_py(), strict=True), strict=True))
                continue
            found = [known[w] for w in unpack(words).split(b" ")]
            n, size = np.array([n for n, _ in found], np.int64), np.array([len(o) for _, o in found], np.int32)
            rows.append((chunk, block, pack(b"".join([len(found).to_bytes(4, "little"), n.tobytes(), size.tobytes(), *(o for _, o in found)]))))
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "block", "answer"])


def padded(code: Code, word: bytes, odds: bytes) -> bytes:
    """Log-odds along a word and the space behind it, zero where its bytes have no contexts of their own."""
    if len(word) < WORD_BYTES:
        return odds
    return odds + bytes(int(code.length[np.frombuffer(word + b" ", np.uint8)].sum()) - len(odds))


def _together(code: Code, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Chunk, np.ndarray, Uneven]]:
    """Each chunk, and the counts and log-odds of its words; answers come in the order of their blocks, the chunk last."""
    unpack, answers = zstandard.ZstdDecompressor().decompress, []
    for batch in batches:
        for i, (first, answer) in enumerate(zip(batch.column("first").to_pylist(), batch.column("answer").to_pylist(), strict=True)):
            if answer is not None:
                answers.append((first, answer))
                continue
            (chunk,) = _chunks([batch.slice(i, 1)])
            counts, odds = [], []
            for _, blob in sorted(answers, key=lambda x: x[0]):
                raw = unpack(blob)
                many = int.from_bytes(raw[:4], "little")
                counts.append(np.frombuffer(raw, np.int64, many, 4))
                ends = (np.r_[0, np.cumsum(np.frombuffer(raw, np.int32, many, 4 + 8 * many))] + 4 + 12 * many).tolist()
                odds += [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            answers = []
            yield chunk, np.concatenate(counts), Uneven([padded(code, w, o) if len(w) >= WORD_BYTES else o for w, o in zip(chunk.words, odds, strict=True)], np.int8)


class Paths:
    """Log-odds along the decisions of a byte behind a context, towards those taken, eight in a number; each context and byte is
    worked out when it is first met.
    """

    def __init__(self, code: Code, flat: np.ndarray) -> None:
        self.code, self.flat = code, flat
        #: By row of `flat` and byte: where its numbers stand, 0 if not met.
        self.number = np.zeros(len(flat), np.int32)
        self.odds = np.zeros((code.eights, 1), np.uint64)

    def at(self, pair: np.ndarray) -> np.ndarray:
        """Where the numbers of each row and byte stand."""
        found = self.number.take(pair)
        new = np.unique(pair[found == 0])
        if len(new):
            row, symbol = new & ~255, new & 255
            odds = np.zeros((len(new), 8 * self.code.eights), np.int8)
            for d, (node, sign) in enumerate(zip(self.code.node_at, self.code.sign_at, strict=True)):
                odds[:, d] = self.flat.take(row + node.take(symbol)) * sign.take(symbol)
            self.number[new] = np.arange(len(new)) + self.odds.shape[1]
            self.odds = np.concatenate([self.odds, eights(odds)], 1)
            found = self.number.take(pair)
        return found


class Model:
    """The code, the two- and three-byte contexts, and the starting weights for each gate."""

    def __init__(self, code: Code, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> None:
        self.code = code
        self.known = np.unique(context)
        # the last row is that of silent contexts
        rows = np.zeros((len(self.known) + 1, 256), np.int8)
        order = np.argsort(context, kind="stable")
        context, symbol, n = context[order], symbol[order], n[order]
        for a in range(0, len(self.known), 4096):  # in parts, as counts of bytes take four times the room of log-odds
            part = self.known[a : a + 4096]
            lo, hi = np.searchsorted(context, part[0]), np.searchsorted(context, part[-1], "right")
            seen = np.zeros((len(part), 256), np.float32)
            seen[np.searchsorted(part, context[lo:hi]), symbol[lo:hi]] = n[lo:hi]
            rows[a : a + len(part)] = stored_odds(seen @ code.passes[0], seen @ code.passes[1])
        self.flat = (rows >> 2).ravel()
        self.two = self._row(np.arange(1 << 16) | _TWO)
        # rows of three-byte contexts: a page for each last two bytes that have any, by the byte before
        three = self.known[self.known < _TWO]
        ends = np.unique(three & 0xFFFF)
        self.page = np.full(1 << 16, len(ends), np.int32)
        self.page[ends] = np.arange(len(ends))
        self.three = np.full((len(ends) + 1, 256), len(self.known), np.int32)
        self.three[self.page[three & 0xFFFF], three >> 16] = self._row(three)
        self.weights = np.tile(np.array(PRIOR, np.float32), (GATES, 1))

    def _row(self, context: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, context)
        if not len(self.known):
            return at
        return np.where(self.known[np.minimum(at, len(self.known) - 1)] == context, at, len(self.known))

    def spans(self, row: int, words: list[bytes], last: bool, odds: dict[bytes, bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, bytes, word log-odds along them) of a run, in spans of RUN_BYTES at most."""
        tokens = [*words, END] if last else words
        at = np.arange(len(tokens))
        return self.cut(row, spelled(tokens).of(at), Uneven([odds[w] for w in tokens], np.int8).of(at))

    def cut(self, row: int, symbols: np.ndarray, along: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A run's bytes and log-odds in spans."""
        if len(symbols) <= RUN_BYTES:
            yield row, symbols, along
            return
        ends = np.cumsum(self.code.length[symbols])
        for a in range(0, len(symbols), RUN_BYTES):
            b = min(a + RUN_BYTES, len(symbols))
            yield row, symbols[a:b], along[ends[a - 1] if a else 0 : ends[b - 1]]

    def counted(self, lead: np.ndarray, symbol: np.ndarray, n: np.ndarray, zeros: np.ndarray, ones: np.ndarray, guess: np.ndarray | None = None, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The cells of the decisions along bytes that stand n times behind three others, and how often each occurs. zeros and ones
        count the ways behind the word so far; one occurrence is taken out of them.
        """
        byte, way = self.code.decisions(symbol)
        node, one = self.code.node[way], self.code.bit[way] == 1
        sign = np.where(one, 1, -1)
        odds = stored_odds((zeros - ~one).clip(0), (ones - one).clip(0))
        root = np.cumsum(self.code.length[symbol]) - self.code.length[symbol]
        gate = (odds[root].astype(np.int32) & 3) << 2
        two = lead[1] << 8 | lead[2]
        row2, row3 = self.two[two], self.three[self.page[two], lead[0]]
        x2, x3 = (self.flat.take((row[byte].astype(np.int64) << 8) + node) * sign for row in (row2, row3))
        repeat = np.zeros(len(byte), np.int32)
        if state is not None:
            gate = gate + state.astype(np.int32)
            repeat = np.where(state[byte] > 0, self.code.way.take((guess[byte] << 8) + node) * sign, 0).astype(np.int32)
        return _summed(cells(gate[byte], x2, x3, (odds >> 2) * sign, repeat), n[byte])

    @cached_property
    def paths(self) -> tuple[Paths, Paths]:
        """Log-odds behind contexts, and those of repeats by the byte foretold (256: none); a task's own, never sent."""
        return Paths(self.code, self.flat), Paths(self.code, np.r_[REPEAT_ODDS * self.code.way, np.zeros(256, np.int8)])

    def prepared(self, spans: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple:
        """Bytes in order of their place in their segment, those of longer codes first: (gate and segment of each, first byte of each
        place, and for each part of the codes: inputs of its decisions towards the one taken, which of them it takes, the bytes
        that have some, span of each, first byte of each place).
        """
        code = self.code
        lead = np.full(REPEAT, 10, np.uint8)
        text = np.concatenate([x for _, s, _ in spans for x in (lead, s)])
        along = np.concatenate([*(o for _, _, o in spans), np.zeros(8 * code.eights, np.int8)])
        sizes = np.array([len(s) for _, s, _ in spans])
        span = np.repeat(np.arange(len(spans), dtype=np.int32), sizes)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(span), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
        at = np.arange(len(span)) + (span + 1) * REPEAT
        guess, state = repeats(text, at, span)
        symbol = text[at]
        n = code.length.take(symbol)
        ahead = np.cumsum(n) - n
        gate = ((along.take(ahead) & 3) << 2) + state
        along >>= 2
        # the decisions of a byte lie behind one another, so eight are read at once wherever they begin
        words = np.ndarray(len(along) - 7, np.uint64, along, strides=(1,))
        two = text[at - 2].astype(np.intp) << 8 | text[at - 1]
        rows = (self.two.take(two), self.three.ravel().take(self.page.take(two).astype(np.intp) << 8 | text[at - 3]), np.where(state > 0, guess.astype(np.intp), 256))
        found = [(p, p.at(row.astype(np.intp) << 8 | symbol)) for p, row in zip((*self.paths[:1] * 2, self.paths[1]), rows, strict=True)]

        def inputs(eight: int, own: np.ndarray) -> list[np.ndarray]:
            two, three, repeat = (p.odds[eight].take(number[own]) for p, number in found)
            word = words[ahead[own] + 8 * eight]
            word &= code.kept[eight].take(symbol[own])
            return [two, three, word, repeat]

        ends = [p for p in PARTS if p < len(code.node_at)] + [len(code.node_at)]
        part = np.searchsorted(ends, code.length).astype(np.int16).take(symbol)
        step = (place % SEGMENT).astype(np.int16)
        segment = np.cumsum(step == 0, dtype=np.int32) - 1
        order = np.argsort(step * np.int16(len(ends)) + (np.int16(len(ends) - 1) - part), kind="stable")
        step, part, span = step[order], part[order], span[order]
        places = np.arange(int(step[-1]) + 2)
        parts, start = [], 0
        for i, end in enumerate(ends):
            own = np.flatnonzero(part >= i)
            if start % 8 == 0:
                held, base = inputs(start // 8, order[own]), own
            takes = None if start % 8 == 0 else own if start < 8 else np.searchsorted(base, own)
            parts.append((held, slice(start % 8, (end - 1) % 8 + 1), takes, span[own], np.searchsorted(step[own], places).tolist()))
            start = end
        return gate[order], segment[order], np.searchsorted(step, places).tolist(), parts

    def scores(self, spans: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 probability of each span."""
        gate, segment, steps, parts = self.prepared(spans)
        unit = np.float32(UNIT)
        # those of each gate in each segment, with their signs changed: all sums are log-odds against the decision taken
        weights = np.tile(self.weights * -unit, (int(segment.max()) + 1, 1)).view(_FOUR)[:, 0]
        own = segment * GATES + gate
        rate = np.float32(RATE) * unit * unit  # inputs and weights are in units of the stored log-odds
        most, one = np.float32(30), np.float32(1)
        nats = np.zeros(len(spans))
        some = max(1, TOGETHER * (len(steps) - 1) // len(own))
        told = [np.empty(len(p[3]), np.float32) for p in parts]
        for first in range(0, len(steps) - 1, some):
            until = min(first + some, len(steps) - 1)
            # the inputs of a few places at once, so that they lie close together
            held = []
            for inputs, which, takes, _, t in parts:
                those = slice(t[first], t[until])
                x = np.empty((4, which.stop - which.start, t[until] - t[first]), np.float32)
                for packed, to in zip(inputs, x, strict=True):
                    packed = packed[those] if takes is None else packed.take(takes[those])
                    to[:] = packed.view(np.int8).reshape(-1, 8).T[which]
                held.append((x, np.empty(x.shape[1:], np.float32), t))
            for i in range(first, until):
                which = own[steps[i] : steps[i + 1]]
                w = np.ascontiguousarray(weights.take(which).view(np.float32).reshape(-1, 4).T)
                moved = w.copy()
                for inputs, out, t in held:
                    lo, hi = t[i] - t[first], t[i + 1] - t[first]
                    if lo == hi:
                        break
                    x, one_more = inputs[:, :, lo:hi], out[:, lo:hi]
                    m = np.einsum("kdn,kn->dn", x, w[:, : hi - lo])
                    np.minimum(m, most, out=m)
                    np.exp(m, out=m)
                    np.add(m, one, out=one_more)
                    np.divide(m, one_more, out=m)  # how far the decision taken was from certain
                    toward = np.einsum("kdn,dn->kn", x, m)
                    toward *= rate
                    moved[:, : hi - lo] -= toward
                weights[which] = np.ascontiguousarray(moved.T).view(_FOUR)[:, 0]
            for (_, out, t), found in zip(held, told, strict=True):
                sums = found[t[first] : t[until]]
                # two at most fit their product into 32 bits
                if len(out) > 1:
                    half = len(out) // 2
                    np.multiply(out[:half], out[half : 2 * half], out=out[:half])
                    out = np.concatenate([out[:half], out[2 * half :]]) if len(out) % 2 else out[:half]
                np.log(out, out=out)
                np.add.reduce(out, 0, out=sums)
        # what stands behind a byte's last decision in a part has no inputs, so it is even
        for (_, which, _, span, _), found in zip(parts, told, strict=True):
            nats += np.bincount(span, found, len(spans)) - (which.stop - which.start) * math.log(2) * np.bincount(span, minlength=len(spans))
        nats += math.log(2) * np.array([len(o) for _, _, o in spans])
        return -nats / math.log(10)

    def fit(self, cell: np.ndarray, n: np.ndarray) -> None:
        """Sets the starting weights: logistic regression for each gate over counted cells, by Newton steps. Gates without repeats come first; what
        the others are drawn to are their weights, and for repeats the weight where the word so far is known best.
        """
        values = np.stack([(cell >> 14 & 63) - 32, (cell >> 8 & 63) - 32, (cell >> 2 & 63) - 32, ((cell & 3) - 1) * REPEAT_ODDS], 1) * UNIT
        for g in sorted(range(GATES), key=lambda g: (g & 3 > 0, -g)):
            prior = np.array(PRIOR)
            if g & 3:
                prior[:3] = self.weights[g & ~3, :3]
                if g >> 2 < 3:
                    prior[3] = self.weights[12 | g & 3, 3]
            own = cell >> 20 == g
            x, many, w = values[own], n[own], prior.copy()
            for _ in range(20):
                miss = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
                curve = (x * (many * miss * (1 - miss))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(4)
                step = np.linalg.solve(curve, x.T @ (many * miss) - PRIOR_STRENGTH * (w - prior))
                w += step
                if np.abs(step).max() < 1e-6:
                    break
            self.weights[g] = w


def learn(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame, DataFrame, int, int]:
    """The model, all documents in chunks, the first word of each block, the blocks with their words' counts and log-odds, and how
    many training tokens there are, in all and distinct.
    """
    nested = docs.select("doc_id", (common.held() == 1).alias("held_out"), "text").mapInArrow(_chunked, _CHUNK)
    chunked = common.written(nested.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    everything = common.written(chunked.drop("chunk").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    is_bytes = F.substring("word", 1, 1) == F.lit(b" ")
    words = everything.where(~is_bytes)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    quads = everything.where(is_bytes).select(F.conv(F.hex(F.substring("word", 2, 6)), 16, 10).cast("long").alias("told"), "n")
    byte = lambda k: f"(shiftright(told, {8 * k}) & 255)"
    # the word so far, where it has less than three bytes
    prefix = F.expr(f"CASE WHEN {byte(1)} IN (32, 10) THEN 0 WHEN {byte(2)} IN (32, 10) THEN 65536 + {byte(1)} WHEN {byte(3)} IN (32, 10) THEN 131072 + {byte(2)} * 256 + {byte(1)} END")
    early = quads.select("told", "n", prefix.alias("prefix"), F.expr(f"cast({byte(0)} AS int)").alias("symbol")).where("prefix IS NOT NULL")
    quads = quads.select(F.expr("shiftright(told, 8) & 16777215").alias("three"), (F.expr("shiftright(told, 8) & 65535") + F.lit(_TWO)).alias("two"), F.expr(f"cast({byte(0)} AS int)").alias("symbol"), "n")
    seen = np.zeros(256, np.int64)
    for r in quads.groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # 256 rows at most
        seen[r["symbol"]] = r["n"]
    code = Code(seen)
    # SHARE contexts of either length at most, with the bytes behind them
    both = quads.select(F.explode(F.array("three", "two")).alias("context"), "symbol", "n").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    kept = both.groupBy("context").agg(F.sum("n").alias("all"), F.collect_list(F.struct("symbol", "n")).alias("s")).where(F.col("all") * F.lit(SHARE) >= F.lit(int(seen.sum())))
    contexts = kept.select("context", F.explode("s").alias("s")).select("context", "s.symbol", "s.n").toArrow()
    model = Model(code, *(contexts.column(c).to_numpy() for c in ("context", "symbol", "n")))
    before = early.groupBy("prefix", "symbol").agg(F.sum("n").alias("n")).toArrow()  # three bytes at most, so 2^24 rows at most
    first_cells = early.select("told", "n", "prefix").mapInArrow(_early(model, *(before.column(c).to_numpy() for c in ("prefix", "symbol", "n"))), "cell int, many long")
    placed = words.withColumn("key", _sort_key()).repartitionByRange("key").sortWithinPartitions("key").drop("key")
    blocks = placed.mapInArrow(_key_blocks(BLOCK_KEYS, BLOCK_BYTES), "first binary, word array<binary>, n array<long>")
    blocks = common.written(blocks.withColumn("block", F.monotonically_increasing_id()), "word-blocks")
    edges = common.written(blocks.mapInArrow(_edges, "block long, context long, symbol int, n long"), "edges")
    summed = edges.groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    # of two words a block: 2 * WORD_BYTES contexts at most
    shared = edges.select("block", "context").distinct().join(summed, "context").groupBy("block").agg(F.collect_list(F.struct("context", "symbol", "n")).alias("shared"))
    with_shared = blocks.join(shared, "block").select("block", "word", "n", "shared").repartition(F.col("block"))
    odds = common.written(with_shared.mapInArrow(_block_odds(model), "block long, word array<binary>, n array<long>, odds array<binary>, cell array<int>, many array<long>"), "word-odds")
    deep_cells = odds.select(F.explode(F.arrays_zip("cell", "many")).alias("c")).select("c.cell", "c.many")
    known = first_cells.unionByName(deep_cells).groupBy("cell").agg(F.sum("many").alias("many")).toArrow()  # 63^3 a gate at most, thrice that with repeats
    model.fit(*(known.column(c).to_numpy() for c in ("cell", "many")))
    return model, chunked, blocks.select("block", "first"), odds.drop("cell", "many"), total["n"], total["v"]


def _scored(model: Model, total: int, distinct: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each run: row, doc_id, held_out, n_tokens, n_known, n_bytes, base_score, score."""
    bottom = math.log10(total + 0.5 * (distinct + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, counts, odds in _together(model.code, batches):
            end, text, tokens = chunk.words.index(END), spelled(chunk.words), np.array([len(ids) for ids in chunk.ids])
            of = np.repeat(np.arange(len(tokens)), tokens)
            lasts = np.array([last for _, _, _, last, _ in chunk.runs])
            ids = np.concatenate(chunk.ids)
            logs, known = np.log10(counts + 0.5) - bottom, counts > 0
            base = np.bincount(of, logs[ids], len(tokens)) + lasts * logs[end]
            n_known = np.bincount(of, known[ids], len(tokens)).astype(np.int64) + lasts * known[end]
            held, size, found = [], 0, np.zeros(len(tokens))

            def mix() -> None:
                for (i, *_), s in zip(held, model.scores(held), strict=True):  # noqa: B023
                    found[i] += s  # noqa: B023

            for i in range(len(chunk.runs)):
                own = chunk.tokens(i, end)
                for span in model.cut(i, text.of(own), odds.of(own)):
                    if held and size + len(span[1]) > MIX_BYTES:
                        mix()
                        held, size = [], 0
                    if len(span[1]):
                        held.append(span)
                        size += len(span[1])
            if held:
                mix()
            row, doc_id, out, _, n_bytes = (pa.array(c, k) for c, k in zip(zip(*chunk.runs, strict=True), list(_LISTS.values())[:5], strict=True))
            names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score"]
            yield pa.record_batch([row, doc_id, out, pa.array(tokens + lasts), pa.array(n_known), n_bytes, pa.array(base), pa.array(found)], names=names)

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row."""
    model, chunked, firsts, odds, total, distinct = learn(docs)
    order = firsts.orderBy("first").collect()  # a row for BLOCK_KEYS words
    asks = chunked.select("chunk", "words").mapInArrow(_asked([r["block"] for r in order], [bytes(r["first"]) for r in order]), "block long, chunk long, words binary")
    asked = asks.unionByName(odds.withColumn("chunk", F.lit(-1).cast("long")), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "chunk")
    answers = asked.mapInArrow(_answered, "chunk long, block long, answer binary").join(F.broadcast(firsts) if len(order) <= MOST_SENT else firsts, "block").drop("block")
    together = answers.withColumn("late", F.lit(0)).unionByName(chunked.withColumn("late", F.lit(1)), allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "late")
    runs = together.mapInArrow(_scored(model, total, distinct), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base_score", "score")]
    return runs.groupBy("row", "doc_id", "held_out").agg(*sums).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of the training folds."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
