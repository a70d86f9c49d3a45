"""Fingerprints against a plain version, forced collisions included."""

import hashlib

import pytest

from cohortlake.llm import fingerprints as fp
from tests.llm.helpers import odd_texts, prose, table


def plain(texts, ids):
    order = sorted(range(len(texts)), key=lambda i: (-ids[i], texts[i] or ""))
    out = {}
    for k, i in enumerate(order):
        own, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(own) // 3
        new = own[: len(own) - n] + following[:n]
        same = lambda a, b: float(fp.canonical(a) == fp.canonical(b))
        out[i] = (len(own), hashlib.sha256(new.encode()).hexdigest(), same(own, new), same(own, following))
    return out


TEXTS = [*odd_texts(), "ﬁne Text", "FINE  text", "Straße", "STRASSE", *[prose(s % 20, 50) for s in range(60)]]


@pytest.mark.parametrize("bits", [128, 3])
def test_fingerprints(spark, bits):
    ids = [(i * 37) % 1009 for i in range(len(TEXTS))]
    got = {r["doc_id"]: r for r in fp.fingerprints(table(spark, TEXTS, ids), bits).collect()}
    assert len(got) == len(TEXTS)
    for i, expected in plain(TEXTS, ids).items():
        r = got[ids[i]]
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == expected
        assert (r["fingerprint"] == r["edited_fingerprint"]) == bool(r["near_edited"])
    forms = {}
    for i, t in enumerate(TEXTS):
        forms.setdefault(got[ids[i]]["fingerprint"], set()).add(fp.canonical(t or ""))
    assert all(len(x) == 1 for x in forms.values())  # equal fingerprints, equal bytes
    assert len(forms) == len({fp.canonical(t or "") for t in TEXTS})


def test_few_rows(spark):
    assert fp.fingerprints(table(spark, [])).count() == 0
    one = fp.fingerprints(table(spark, ["abcdef"])).first()
    assert one["near_next"] == 1.0
    assert fp.fingerprints(table(spark, ["abc", "abc", None], [4, 4, None])).count() == 3
