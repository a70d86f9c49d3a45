"""Mixture-controlled packing: every token once, windows full, sources in their proportions, as a token-by-token round-robin gives them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlake.llm import mixture
from tests.llm.helpers import odd_texts, prose

SCHEMA = "doc_id long, text string, source string, queue long, base string"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [*odd_texts(), "It's WE'LL 'S", "a\x85b\xa0c d", "  two  spaces \n here ", "tab\t \tx", "<|endoftext|> 1234", "İstanbul ﬁ", "　x  y", "a b", " a", "a ", *[prose(s, 30 + 40 * s) for s in range(30)]]


def own_ids(text):
    return np.frombuffer(mixture.byte_ids().document(text or ""), mixture.byte_ids().unit).tolist()


def test_ids_are_the_tokenizers(tokenizer):
    for t in TEXTS:
        assert own_ids(t) == ids_of(tokenizer, t), t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(tokenizer, text):
    assert own_ids(text) == ids_of(tokenizer, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\ta1'.é", max_size=40))
def test_ids_of_white_space(tokenizer, text):
    assert own_ids(text) == ids_of(tokenizer, text)


def test_long_texts_are_encoded_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(mixture, "PART_CHARS", 50)
    for t in TEXTS:
        assert own_ids(t) == ids_of(tokenizer, t), t


def round_robin(totals, weights, capacity):
    """(queue, token) in the order in which deficit round-robin hands them on, one token at a time."""
    quantum, deficit, at, out = mixture.quanta(weights, capacity).tolist(), [0] * len(totals), [0] * len(totals), []
    while len(out) < sum(totals):
        for q, total in enumerate(totals):
            deficit[q] += quantum[q]
            while deficit[q] >= 1 << mixture.POINT:
                deficit[q] -= 1 << mixture.POINT
                if at[q] < total:
                    out.append((q, at[q]))
                    at[q] += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_places_are_those_of_round_robin(seed):
    rng = random.Random(seed)
    totals = [rng.choice([0, 1, 5, 300, 2000]) for _ in range(rng.randrange(1, 7))]
    weights = [float(t) for t in totals] if seed % 2 and sum(totals) else [rng.random() + 1e-4 for _ in totals]
    place = {x: i for i, x in enumerate(round_robin(totals, weights, 64))}
    quantum = mixture.quanta(weights, 64)
    for q, total in enumerate(totals):
        at = 0
        while at < total:
            end = min(total, at + rng.randrange(1, 200))
            got = [(q, t, p + t - a) for a, b, p in zip(*(x.tolist() for x in mixture.served(q, at, end, np.array(totals), quantum)), strict=True) for t in range(a, b)]
            assert got == [(q, t, place[q, t]) for t in range(at, end)]
            at = end


def checked(tokenizer, docs, rows, capacity):
    """Every token once, pieces equal to the ids they stand for, sequences gapless, none padded."""
    texts, starts, sequences = Counter(), defaultdict(list), defaultdict(list)
    for r in rows:
        starts[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text, _ in docs:
        texts[doc] += 1
        ids, at = ids_of(tokenizer, text), 0
        for start, n, crc, total in sorted(set(starts[doc])):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return sequences


@pytest.mark.parametrize("segment", [1 << 18, 37])
def test_packing(spark, tokenizer, monkeypatch, segment):
    monkeypatch.setattr(mixture, "_encoded", lambda path: lambda batches: _with(segment, path, batches))
    rng = random.Random(1)
    docs = [(i, t, rng.choice(["a", "b", None, "c"])) for i, t in enumerate(TEXTS)] + [(1000 + i, prose(i, 200), "a") for i in range(40)]
    frame = spark.createDataFrame([(*d, 3, "b") for d in docs], SCHEMA).repartition(5)
    rows = mixture.mixture_packing(frame, capacity=256).collect()
    sequences = checked(tokenizer, docs, rows, 256)
    total = sum(len(ids_of(tokenizer, t)) for _, t, _ in docs)
    assert sum(sum(n for _, n in s) == 256 for s in sequences.values()) == total // 256
    share, of = Counter(), {d: s for d, _, s in docs}
    for d, t, s in docs:
        share[s] += len(ids_of(tokenizer, t)) / total
    for number in range(total // 256):
        held = Counter()
        for r in rows:
            if r["sequence_id"] == number:
                held[of[r["doc_id"]]] += r["length"]
        assert all(abs(held[s] - 256 * share[s]) <= 4 for s in share)


def _with(segment, path, batches):
    from cohortlake.llm import mixture as own

    own.SEGMENT = segment
    own_encoded = own.__dict__["_encoded"]
    yield from own_encoded(path)(batches)


def test_targets(spark, tokenizer):
    docs = [(i, prose(i, 120), "abc"[i % 3]) for i in range(60)]
    frame = spark.createDataFrame([(*d, 3, "b") for d in docs], SCHEMA)
    rows = mixture.mixture_packing(frame, {"a": 0.6, "b": 0.3}, capacity=512, with_ids=True).collect()
    checked(tokenizer, docs, rows, 512)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    held = Counter()
    for r in rows:
        if r["sequence_id"] < 5:
            held[r["source"]] += r["length"]
    assert abs(held["a"] - 0.6 * 5 * 512) < 10 and abs(held["b"] - 0.3 * 5 * 512) < 10
    checked(tokenizer, docs, mixture.mixture_packing(frame, {"a": 1.0, "z": 1.0}, capacity=512).collect(), 512)


def test_odd_frames(spark, tokenizer):
    docs = [(1, "a", "s"), (1, "a", "s"), (None, None, None)]
    rows = mixture.mixture_packing(spark.createDataFrame([(*d, 3, "b") for d in docs], SCHEMA)).collect()
    assert sum(r["length"] for r in rows) == 5
    assert mixture.mixture_packing(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixture.mixture_packing(spark.createDataFrame([(1, "x y")], "doc_id long, text string")).count() == 2  # of two tokens and one
