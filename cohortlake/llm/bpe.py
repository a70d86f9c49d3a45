"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary (hash and displace: one slot an entry, none free) resolves every
pre-token that is an entry as a whole. Second tier: what misses is merged by a heap of ranked pairs over linked bytes.
Pieces of text between single spaces recur, so each worker remembers the ids of those it has met, in bounded memory.

Defined results: null and empty texts have no ids; the encoding is that of the whole text, each match of the pattern by
itself, without special tokens; repeated rows give repeated results; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import common

#: Entries of a worker's memory before it starts anew.
CACHE_ENTRIES = 600_000
#: Keys in a displacement bucket, on average.
BUCKET_KEYS = 4

#: Unicode white space, which \s means in the vocabulary's own library.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pre_token_pattern(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The splitting pattern with white space spelled out, as libraries differ in what \\s holds."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


def read_ranks(path: str) -> list[bytes]:
    """Entries in order of rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class PerfectHash:
    """A minimal perfect hash: n keys to the slots 0..n-1, from one displacement for each bucket of keys."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        hashes = self.hashes(keys)
        self.buckets = max(1, self.n // BUCKET_KEYS)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.displacement = np.zeros(self.buckets, np.uint64)
        taken = np.zeros(self.n, bool)
        self.slot_key = np.full(self.n, -1, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: starts[b] - starts[b + 1]):
            own = order[starts[b] : starts[b + 1]]
            if not len(own):
                break
            at = 0
            while True:  # displacements are tried 256 at a time
                tries = np.arange(at, at + 256, dtype=np.uint64)
                slots = self._slots(hashes[own][:, None], tries[None, :])
                good = ~taken[slots].any(axis=0)
                if len(own) > 1:
                    ranked = np.sort(slots, axis=0)
                    good &= (ranked[1:] != ranked[:-1]).all(axis=0)
                if good.any():
                    k = int(good.argmax())
                    self.displacement[b] = tries[k]
                    taken[slots[:, k]] = True
                    self.slot_key[slots[:, k]] = own
                    break
                at += 256

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)

    def _slots(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        x = (hashes ^ (displacement * _ODD)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(self.n)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key the only entry that it can be."""
        hashes = self.hashes(keys)
        return self.slot_key[self._slots(hashes, self.displacement[(hashes % np.uint64(self.buckets)).astype(np.int64)])]


class ByteBpe:
    """Encodes and decodes with a table of ranked byte strings."""

    def __init__(self, entries: list[bytes], pattern: str = public_tokenizers.PATTERN) -> None:
        self.entries = entries
        self.used = [i for i, e in enumerate(entries) if e]
        self.hash = PerfectHash([entries[i] for i in self.used])
        self.ranks = {entries[i]: i for i in self.used}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern = pre_token_pattern(pattern)
        self.joint = regex.compile(f"[{_SPACE}][ ]|[ ][{_SPACE}]")
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, leftmost first, until none is an entry.

        A heap entry is one number: rank, place and end of the merged part, so that it costs no tuple.
        """
        n, rank_of = len(word), self.ranks.get
        bits = n.bit_length()
        mask, top = (1 << bits) - 1, 2 * bits
        ends = list(range(1, n + 1))  # part i holds word[i:ends[i]] while it lives
        before = list(range(-1, n - 1))
        ids = [self.single[b] for b in word]  # -1 for a part that another one took in
        heap = [r << top | i << bits | i + 2 for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i, end = x >> bits & mask, x & mask
            j = ends[i]
            if ids[i] < 0 or j >= n or ids[j] < 0 or ends[j] != end:
                continue
            ends[i], ids[i], ids[j] = end, x >> top, -1
            if end < n:
                before[end] = i
                if (r := rank_of(word[i : ends[end]])) is not None:
                    heapq.heappush(heap, r << top | i << bits | ends[end])
            if (k := before[i]) >= 0 and (r := rank_of(word[k:end])) is not None:
                heapq.heappush(heap, r << top | k << bits | end)
        return [r for r in ids if r >= 0]

    def _learn(self, words: set[str]) -> None:
        """Looks new pre-tokens up, all at once, and merges those that are no entries."""
        new = sorted(words - self.words.keys())
        keys = [w.encode("utf-8", "surrogatepass") for w in new]
        if not keys:
            return
        for w, key, at in zip(new, keys, self.hash.candidates(keys).tolist(), strict=True):
            rank = self.used[at]
            self.words[w] = rank.to_bytes(4, "little") if self.entries[rank] == key else np.array(self.merge(key), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers.

        No pre-token crosses the place before a single space that stands between two other characters, so texts are
        cut there; texts with longer or outer white space around a space are split whole.
        """
        if len(self.words) + len(self.chunks) > CACHE_ENTRIES:
            self._forget()
        parts: list[list[str] | None] = []
        for t in texts:
            if not t or t[0] == " " or t[-1] == " " or self.joint.search(t):
                parts.append(None)
            else:
                first, *rest = t.split(" ")
                parts.append([first, *[" " + x for x in rest]] if rest else [first])
        new = {c for p in parts if p for c in p} - self.chunks.keys()
        split = {c: self.pattern.findall(c) for c in new}
        whole = {i: self.pattern.findall(t) for i, (t, p) in enumerate(zip(texts, parts, strict=True)) if p is None}
        self._learn({w for found in (*split.values(), *whole.values()) for w in found})
        for c, found in split.items():
            self.chunks[c] = b"".join([self.words[w] for w in found])
        return [b"".join([self.words[w] for w in whole[i]]) if p is None else b"".join(map(self.chunks.__getitem__, p)) for i, p in enumerate(parts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """The worker's coder for a vocabulary file; one for each file."""
    if path not in _coders:
        _coders[path] = ByteBpe(read_ranks(path))
    return _coders[path]


def _encoded(path: str, digests: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        common.remember("bpe", own._forget)
        for batch in common.chunks(batches):
            ids = own.encode([t or "" for t in batch.column("text").to_pylist()])
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                columns = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids])]
                yield pa.record_batch([batch.column("doc_id"), counts, *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.record_batch([batch.column("doc_id"), counts, pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encode


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (little-endian unsigned 32-bit) with the bytes decoded from them, or the digests of both."""
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    return docs.select("doc_id", "text").mapInArrow(_encoded(path, digests), f"doc_id long, n_tokens long, {kinds}")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the bytes decoded from them, as digests."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True)
