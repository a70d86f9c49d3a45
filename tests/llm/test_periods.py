"""Periodic runs against all stretches of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import periods
from tests.llm.helpers import WORDS, odd_texts, prose, table


def plain_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            n = 0
            while i + n + q < len(words) and words[i + n] == words[i + n + q]:
                n += 1
            if n + q >= max(least, 3 * q):
                found.setdefault((i, n + q), q)
            i += n + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def own_runs(texts):
    names = {}
    words = [[names.setdefault(w, len(names)) for w in t] for t in texts]
    starts = np.cumsum([0, *map(len, words)])
    return periods.find_runs(np.array([w for t in words for w in t], np.int64), starts)


@pytest.mark.parametrize("seed", range(60))
def test_equals_all_stretches(seed):
    """Texts with planted periods, inside which there are planted periods, at all scales."""
    rng, texts = random.Random(seed), []
    for _ in range(rng.choice([1, 6])):
        words = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(4)):
            if words:
                at, p = rng.randrange(len(words)), rng.randrange(1, 50)
                unit = [rng.randrange(rng.choice([1, 2, 40])) for _ in range(p)]
                if rng.random() < 0.5:
                    inner = unit[: rng.randrange(1, 4)]
                    unit += inner * rng.randrange(3, 30)
                words[at:at] = (unit * 5)[: int(len(unit) * rng.uniform(2.9, 4.5))]
        texts.append(words)
    assert own_runs(texts) == [plain_runs(t, 0) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=200), max_size=3))
def test_equals_all_stretches_of_two_words(texts):
    assert own_runs(texts) == [plain_runs(t, 0) for t in texts]


def test_long_periods_and_words_of_sturm():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    rng = random.Random(5)
    unit = [rng.randrange(3) for _ in range(700)]
    texts = [b, unit * 3, [*unit, *([7] * 900), *unit, *([7] * 900), *unit, *([7] * 900)], [1] * 4000, []]
    own = own_runs(texts)
    assert own[1:] == [plain_runs(t, 0) for t in texts[1:]] and own[0] == plain_runs(b, 0)
    assert (0, 4800, 1600) in own[2]


def planted(doc, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc, text):
    words = planted(doc, text)
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query(spark, tmp_path):
    line = " ".join(f"l{k}" for k in range(9))
    texts = [*odd_texts(), *[prose(s, 60 + 5 * s, 30) for s in range(60)], "\n".join([line] * 5), "a b " * 40 + "c", "same " * 30 + "x " + "same\x0b" * 30, prose(3, 400) + " " + (prose(4, 100) + " ") * 3, "é\x85è " * 40]
    ids = [*range(len(texts) - 1), None]
    table(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    rows = periods.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == sorted((expected(i, t) for i, t in zip(ids, texts, strict=True)), key=str)
    assert sum(r["n_runs"] > 0 for r in rows) >= 8
    empty = table(spark, ["x"]).limit(0)
    assert periods.periodic_runs(periods.with_planted_runs(empty)).count() == 0
