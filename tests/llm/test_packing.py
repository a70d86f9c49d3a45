"""Packing: every token once, gapless, and close to the fewest sequences that an exhaustive search finds."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlake.llm import packing, tokens
from tests.llm.helpers import odd_texts, prose, table


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [*odd_texts(), "It's WE'LL 'S", "a\x85b\xa0c d", "Σίσυφος ΟΔΟΣ", "ﬁ Å é", "<|endoftext|> 1234", "İstanbul", *[prose(s, 30 + 40 * s) for s in range(30)]]


def test_ids_are_the_tokenizers(tokenizer):
    own = tokens.word_ids()
    for t in TEXTS:
        assert np.frombuffer(own.encode([t or ""])[0], "<u4").tolist() == ids_of(tokenizer, t)[:-1]


def test_ids_of_every_plain_character(tokenizer):
    own = tokens.word_ids()
    for c in map(chr, range(1, 0x250)):
        for t in (c, f"a{c}b", f"{c}{c}1", f" {c}"):
            assert own.encode([t])[0] == own.direct(t), t


def test_long_texts_are_encoded_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "PART_CHARS", 100)
    monkeypatch.setattr(packing.common, "CHUNK_BYTES", 250)
    texts = [prose(1, 300), None, "x" * 500 + " " + prose(2, 50), "", "a b", "y" * 450, " " * 300]
    found = {}
    for row, ids, last in packing._encoded(tokens.word_ids(), texts):
        assert row not in found or not found[row][1]
        found[row] = (found.get(row, ([], False))[0] + np.frombuffer(ids, "<u4").tolist(), last)
    assert {k: v[0] for k, v in found.items()} == {i: ids_of(tokenizer, t) for i, t in enumerate(texts)}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(tokenizer, text):
    assert np.frombuffer(tokens.word_ids().encode([text])[0], "<u4").tolist() == ids_of(tokenizer, text)[:-1]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_best_fit_packing(spark, tokenizer, monkeypatch, bound):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", bound)  # offsets sent along, and joined by shuffle
    rows = packing.best_fit_packing(table(spark, TEXTS)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        ids, at = ids_of(tokenizer, t), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            assert r["length"] == min(4096, len(ids) - at)
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_packed_matrices(spark, tokenizer):
    rows = packing.packed_matrices(table(spark, TEXTS), capacity=512).collect()
    found = {}
    for r in rows:
        ids, positions = np.frombuffer(r["input_ids"], "<u2").tolist(), np.frombuffer(r["position_ids"], "<u2").tolist()
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 512 == len(ids) == len(positions) and not any(ids[cu[-1] :])
        for k, (a, b) in enumerate(zip(cu, cu[1:])):
            assert positions[a:b] == list(range(b - a))
            found[r["doc_ids"][k], r["pieces"][k]] = ids[a:b]
    for i, t in enumerate(TEXTS):
        assert [x for k in sorted(k for d, k in found if d == i) for x in found[i, k]] == ids_of(tokenizer, t)


def test_empty_tables(spark):
    assert packing.best_fit_packing(table(spark, [])).count() == 0
    assert packing.packed_matrices(table(spark, [])).count() == 0


def filled(plan, counts):
    """The fill of every sequence of a plan; all pieces must be placed without overlap."""
    out, placed = {}, {}
    for length, rank, many, first, each, offset in plan.allotments:
        assert rank == placed.get(length, 0)
        placed[length] = rank + many
        for i in range(many):
            out.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert placed == {k: v for k, v in counts.items() if v}
    for own in out.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= plan.capacity
    return out


sizes = st.dictionaries(st.integers(1, 60), st.integers(1, 6), max_size=14)


def one_by_one(counts, capacity):
    """Best fit decreasing, piece by piece."""
    room = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(sizes)
def test_plans_on_counts_are_plans_on_pieces(counts):
    plan = packing.best_fit_decreasing(counts, 60)
    own = filled(plan, counts)
    assert sorted(60 - sum(n for _, n in x) for x in own.values()) == one_by_one(counts, 60)
    large = packing.large_item_matching(counts, 60)
    bins = filled(large, counts)
    total = sum(n * c for n, c in counts.items())
    assert len(bins) >= -(-total // 60)
    # no two sequences with one large piece each could be one
    alone = sorted(x[0][1] for x in ([p for p in own if 3 * p[1] > 60] for own in bins.values()) if len(x) == 1)
    assert len(alone) < 2 or alone[0] + alone[1] > 60 or all(60 - sum(n for _, n in x) < alone[0] for x in bins.values())


def fewest(pieces, capacity):
    """The least number of sequences, by trying every place for every piece."""
    best = [len(pieces)]

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= pieces[i]}.values():
            place(i + 1, [*room[:k], room[k] - pieces[i], *room[k + 1 :]])
        place(i + 1, [*room, capacity - pieces[i]])

    place(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_against_the_fewest_sequences(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    least = fewest(sorted(lengths, reverse=True), 20)
    for planner in (packing.large_item_matching, packing.best_fit_decreasing):
        assert planner(counts, 20).sequences <= 11 * least / 9 + 1
    large = {n: c for n, c in counts.items() if 3 * n > 20}
    assert packing.large_item_matching(large, 20).sequences == fewest(sorted((n for n in lengths if 3 * n > 20), reverse=True), 20)
