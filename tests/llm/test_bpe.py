"""Byte-level BPE against the tiktoken library."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import bpe
from tests.llm.helpers import odd_texts, prose, table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    entries = bpe.read_ranks(PATH)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: i for i, e in enumerate(entries) if e}, special_tokens={})
    return bpe.coder(PATH), reference


def ids(x: bytes) -> list[int]:
    return [int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)]


CASES = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\nx", "it's we'll 'S don't", "naïve café", "日本語テキスト", "x y  z", "a\x1cb \x1f c", "🙂🙂 👩‍👩‍👧", "12345 6 78", "<|endoftext|>", "́a", "a　 b", "word " * 500, "ab" * 3000]


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    own, reference = both
    found = own.encode([text])[0]
    assert ids(found) == reference.encode_ordinary(text)
    assert own.decode(found) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    own, reference = both
    assert ids(own.encode([text])[0]) == reference.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_exact():
    keys = [b"%d" % i for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot_key) == list(range(3000))
    assert (h.candidates(keys) == range(3000)).all()


def test_query_on_frames(spark, both):
    _, reference = both
    texts = [*odd_texts(), *CASES, prose(7, 20_000)]
    rows = {r["doc_id"]: r for r in bpe.encode_decode(table(spark, texts), PATH, digests=True).collect()}
    plain = {r["doc_id"]: r for r in bpe.encode_decode(table(spark, texts), PATH).collect()}
    assert len(rows) == len(plain) == len(texts)
    for i, t in enumerate(texts):
        found = reference.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in found)
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(found), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (bytes(plain[i]["ids"]), bytes(plain[i]["decoded"])) == (raw, (t or "").encode())
    assert bpe.encode_decode(table(spark, []), PATH).count() == 0
    assert [r["doc_id"] for r in bpe.encode_decode(table(spark, ["a", "a"], [None, None]), PATH).collect()] == [None, None]
