"""Language-model scores: exact base scores, and a model that equals a plain one, decision by decision."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlake.llm import mixing
from tests.llm.helpers import WORDS, lower, odd_texts, prose, table

FOLD = [zlib.crc32(str(i).encode()) % 5 for i in range(1000)]


def base(texts):
    tokens = [[*WORDS.findall(lower(t)), None] for t in texts]
    counts = Counter(w for f, ws in zip(FOLD, tokens) if f != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    score = [sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws) for ws in tokens]
    return [(f == 1, len(ws), sum(counts[w] > 0 for w in ws), total, s) for f, ws, s in zip(FOLD, tokens, score)]


def spelled(text):
    """The bytes to predict of a whole text."""
    return b"".join(w + b" " for w in mixing.raw_bytes(text).split()) + b"\n"


def word_so_far(stream, i):
    start = i
    while start and stream[start - 1] not in b" \n":
        start -= 1
    return stream[start:i] if i - start < mixing.WORD_BYTES else None


class Plain:
    """The same model with dictionaries, one decision after another."""

    def __init__(self, texts, code):
        self.code = code
        self.byte, self.word = {}, {}
        total = 0
        for f, t in zip(FOLD, texts):
            if f == 1:
                continue
            stream = spelled(t)
            total += len(stream)
            for i, s in enumerate(stream):
                lead = b"\n\n\n" + stream[:i]
                for context in (lead[-2:], lead[-3:]):
                    self.byte.setdefault(context, Counter())[s] += 1
                so_far = word_so_far(stream, i)
                if so_far is not None:
                    self.word.setdefault(so_far, Counter())[s] += 1
        self.byte = {k: c for k, c in self.byte.items() if sum(c.values()) * mixing.SHARE >= total}

    def path(self, s):
        a = self.code.start[s]
        return [(self.code.node[d], self.code.bit[d]) for d in range(a, a + self.code.length[s])]

    def odds(self, counts, node, bit):
        """(log-odds towards bit, how well known)"""
        ways = [self.code.passes[b, :, node] for b in (0, 1)]
        zeros, ones = (sum(n for s, n in counts.items() if w[s]) for w in ways)
        value = mixing.stored_odds(np.array([zeros], np.float32), np.array([ones], np.float32))[0]
        return (value >> 2) * mixing.UNIT * (1 if bit else -1), value & 3

    def score(self, text, weights):
        stream, nats, held, last_seen = spelled(text), 0.0, 0, {}
        for i, s in enumerate(stream):
            if i % mixing.SEGMENT == 0:
                moved = np.zeros((mixing.GATES, 4))
            lead = b"\n" * mixing.REPEAT + stream[:i]
            so_far = word_so_far(stream, i)
            at = last_seen.get(lead[-mixing.REPEAT :])
            last_seen[lead[-mixing.REPEAT :]] = i
            state = 0 if at is None else 1 + sum(held >= h for h in mixing.HELD)
            root, one = self.path(s)[0]
            gate = 4 * (self.odds(self.word.get(so_far, {}), root, one)[1] if so_far is not None else 0) + state
            step = np.zeros(4)
            for k, (node, bit) in enumerate(self.path(s)):
                x = [self.odds(self.byte.get(lead[-2:], {}), node, bit)[0], self.odds(self.byte.get(lead[-3:], {}), node, bit)[0]]
                x.append(self.odds(self.word.get(so_far, {}), node, bit)[0] if so_far is not None else 0)
                guess = dict(self.path(stream[at])).get(node) if state else None
                x.append(0 if guess is None else 2 if guess == bit else -2)
                z = np.dot(weights[gate] + moved[gate], x)
                nats += math.log1p(math.exp(-z))
                step += mixing.RATE / (1 + math.exp(z)) * np.array(x)
            moved[gate] += step
            held = held + 1 if at is not None and stream[at] == s else 0
        return -nats / math.log(10)


def along(blocks):
    return {bytes(w): bytes(o) for r in blocks.collect() for w, o in zip(r["word"], r["odds"])}


@pytest.fixture(scope="module")
def learnt(spark):
    texts = [*odd_texts(), *[prose(s, 80, 60) for s in range(60)], prose(3, 80, 60), prose(5, 30, 9) * 12, "a" * 70 + " b"]
    model, _, _, odds, total, distinct = mixing.learn(table(spark, texts))
    return texts, model, {w: mixing.padded(model.code, w, o) for w, o in along(odds).items()}


def scored(model, odds, texts):
    return model.scores([s for i, t in enumerate(texts) for s in model.spans(i, mixing.raw_bytes(t).split(), True, odds)]).tolist()


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAMPLE", 20)
    texts = [*odd_texts(), *[prose(s, 80, 60) for s in range(60)], prose(3, 80, 60)]
    got = {r["doc_id"]: r for r in mixing.scores(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, (held, n, known, total, score) in enumerate(base(texts)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["score"] < 0
        assert (r["bits_per_byte"] is None) == (not texts[i])
    assert got[len(texts) - 1]["score"] == got[len(odd_texts()) + 3]["score"]  # equal texts
    held = [got[i] for i in range(len(odd_texts()), len(texts)) if FOLD[i] == 1]
    assert len(held) > 5  # words are drawn evenly here, so the base score is the best there is
    assert sum(r["score"] for r in held) > 1.1 * sum(r["base_score"] for r in held)


def test_rows_without_and_with_equal_ids(spark):
    texts = [prose(s, 40, 30) for s in range(8)]
    rows = mixing.scores(table(spark, texts, ids=[None, None, 7, 7, 1, 2, 3, 4])).collect()
    assert len(rows) == 8 and sum(r["doc_id"] is None for r in rows) == 2
    assert len({round(r["score"], 6) for r in rows}) == 8


def test_equals_the_plain_model(learnt):
    texts, model, odds = learnt
    plain = Plain(texts, model.code)
    some = [i for i in range(len(texts)) if len(texts[i] or "") < 3000]
    for i, s in zip(some, scored(model, odds, [texts[i] for i in some])):
        assert s == pytest.approx(plain.score(texts[i], model.weights), rel=2e-4), texts[i]


def test_weights_are_fitted(learnt):
    _, model, _ = learnt
    assert np.abs(model.weights - np.array(mixing.PRIOR, np.float32)).max() > 0.05


def test_probabilities_of_different_texts_stay_below_one(learnt):
    _, model, odds = learnt
    silent = {w: bytes(int(model.code.length[np.frombuffer(w + b" " * (w != b"\n"), np.uint8)].sum())) for w in [bytes([a, b]) for a in range(256) for b in range(97, 107)] + [bytes([a]) for a in range(256)]}
    letters = [bytes([b]) for b in range(256) if bytes([b]).split()]
    short = [[], *[[x] for x in letters], *[[x + bytes([y])] for x in letters[:40] for y in range(97, 107)]]
    found = model.scores([s for i, ws in enumerate(short) for s in model.spans(i, ws, True, silent)])
    assert 0 < sum(10.0**s for s in found) < 1
    assert np.sum(2.0**-model.code.length) == pytest.approx(1)  # each path of decisions is one byte


def test_batches_do_not_matter(learnt):
    texts, model, odds = learnt
    some = [*texts[-6:], prose(3, 2000, 60)]
    assert scored(model, odds, some) == pytest.approx([scored(model, odds, [t])[0] for t in some], rel=1e-6)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_runs_hold_all_words(monkeypatch, size):
    monkeypatch.setattr(mixing, "RUN_BYTES", size)
    for t in [*odd_texts(), " " * 50, "ab " * 30, "x" * 90 + " y", " x  y\n\tz "]:
        runs = list(mixing.runs_of(t))
        assert b"".join(r for r, _ in runs) == mixing.raw_bytes(t)
        assert [w for r, _ in runs for w in r.split()] == mixing.raw_bytes(t).split()
        assert [last for _, last in runs] == [False] * (len(runs) - 1) + [True]


def test_long_texts_are_mixed_in_spans(learnt, monkeypatch):
    _, model, odds = learnt
    monkeypatch.setattr(mixing, "RUN_BYTES", 500)
    words = mixing.raw_bytes(prose(3, 400, 60)).split() + [b"a" * 70]
    spans = list(model.spans(3, words, True, odds))
    assert b"".join(s.tobytes() for _, s, _ in spans) == mixing._coded(words, True)
    assert all(len(a) == model.code.length[s].sum() for _, s, a in spans) and len(spans) > 3


def test_empty_table(spark):
    assert mixing.scores(table(spark, [])).count() == 0


def test_without_training_documents(spark):
    rows = mixing.scores(table(spark, ["one two", None], ids=[i for i in range(1000) if FOLD[i] == 1][:2])).collect()
    assert [r["train_tokens"] for r in rows] == [0, 0] and all(r["n_known"] == 0 and r["score"] < 0 for r in rows)


def test_sort_keys_are_sparks(spark):
    words = [b"a", b"x" * 63, b"x" * 64, b"x" * 64 + b"y", b"\xff" * 70, mixing.END]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    assert [bytes(r[0]) for r in df.select(mixing._sort_key()).collect()] == [mixing.sort_key(w) for w in words]


def test_small_blocks_give_the_same_scores(spark, monkeypatch):
    texts = [*odd_texts(), *[prose(s, 60, 200) for s in range(30)], "z" * 80 + " " + "z" * 90]
    whole = {r["doc_id"]: r for r in mixing.scores(table(spark, texts)).collect()}
    monkeypatch.setattr(mixing, "BLOCK_KEYS", 7)
    for r in mixing.scores(table(spark, texts)).collect():
        assert r["score"] == pytest.approx(whole[r["doc_id"]]["score"], rel=1e-6) and r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"])


def test_contexts_share_no_counts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_KEYS", 7)
    texts = [*odd_texts(), *[prose(s, 80, 60) for s in range(40)]]
    model, _, _, odds, *_ = mixing.learn(table(spark, texts))
    plain = Plain(texts, model.code)
    got = {w: np.frombuffer(o, np.int8) for w, o in along(odds).items()}
    words = {w for t in texts for w in mixing.raw_bytes(t).split()}
    assert got.keys() == words | {b"\n"}
    for w, values in got.items():
        whole = w if w == b"\n" else (w + b" ")[: mixing.WORD_BYTES]
        steps = [plain.odds(plain.word.get(whole[:i], {}), n, b) for i in range(len(whole)) for n, b in plain.path(whole[i])]
        assert ((values >> 2) * mixing.UNIT).tolist() == [o for o, _ in steps]
        assert (values & 3).tolist() == [k for _, k in steps]


def test_starting_weights_come_from_all_training_documents(spark):
    """128 of them fixed the weights before, so most could say what they liked."""
    texts = [prose(s, 40, 60) for s in range(400)]
    weights = mixing.learn(table(spark, texts))[0].weights
    for gone in [i for i in range(400) if FOLD[i] != 1][5::150]:
        other = mixing.learn(table(spark, [t if i != gone else "q" * 900 + " " + "zx" * 700 for i, t in enumerate(texts)]))[0].weights
        assert np.abs(weights - other).max() > 1e-6


def test_cells_count_each_decision_of_the_training_documents(spark, monkeypatch):
    found = []
    monkeypatch.setattr(mixing.Model, "fit", lambda self, cell, n: found.append((cell, n)))
    monkeypatch.setattr(mixing, "BLOCK_KEYS", 7)
    texts = [*odd_texts(), *[prose(s, 40, 60) for s in range(30)], prose(5, 30, 9) * 12]
    code = mixing.learn(table(spark, texts))[0].code
    cell, n = found[0]
    own = [spelled(t) for f, t in zip(FOLD, texts) if f != 1]
    positions = [(b, word_so_far(s, i)) for s in own for i, b in enumerate(s)]
    assert n.sum() == sum(int(code.length[b]) for b, so_far in positions if so_far is not None)
    assert n[cell >> 20 & 3 > 0].sum() > 0  # repeats


def test_repeats_compare_bytes(monkeypatch):
    rng = np.random.default_rng(5)
    runs = [rng.integers(97, 100, n).astype(np.uint8) for n in (1, 50, 900, 300)]
    lead = np.full(mixing.REPEAT, 10, np.uint8)
    text, span = np.concatenate([x for r in runs for x in (lead, r)]), np.repeat(np.arange(4), [len(r) for r in runs])
    at = np.arange(len(span)) + (span + 1) * mixing.REPEAT
    want = mixing.repeats(text, at, span)
    assert (want[1] > 0).sum() > 300
    monkeypatch.setattr(mixing, "_mixed", lambda x: x & np.uint64(0x7 << 60))  # nearly all contexts share a key
    got = mixing.repeats(text, at, span)
    assert (got[1] == want[1]).all() and (got[0] == want[0])[want[1] > 0].all()


def test_few_inputs_stand_behind_a_last_decision(learnt):
    """All bytes had inputs for eight decisions before, and take some four."""
    texts, model, odds = learnt
    spans = [s for i, t in enumerate(texts) for s in model.spans(i, mixing.raw_bytes(t).split(), True, odds)]
    parts = model.prepared(spans)[3]
    assert sum((which.stop - which.start) * len(span) for _, which, _, span, _ in parts) < 1.5 * sum(len(a) for *_, a in spans)


def test_each_context_and_byte_is_worked_out_once(learnt):
    _, model, _ = learnt
    paths = mixing.Paths(model.code, model.flat)
    rng = np.random.default_rng(2)
    for _ in range(3):
        row, symbol = rng.integers(0, len(model.known) + 1, 3000), rng.integers(0, 256, 3000)
        at = paths.at(row << 8 | symbol)
        found = paths.odds[:, at]
        for d, (node, sign) in enumerate(zip(model.code.node_at, model.code.sign_at)):
            got = np.ascontiguousarray(found[d // 8]).view(np.int8).reshape(-1, 8)[:, d % 8]
            assert (got == model.flat[(row << 8) + node[symbol]] * sign[symbol]).all()
    assert paths.odds.shape[1] == 1 + (paths.number > 0).sum()


def test_chunks_hold_words_once_by_number(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_BYTES", 300)
    texts = [*odd_texts(), prose(3, 400, 60), "z" * 80 + " " + "z" * 90 + " b"]
    chunked = table(spark, texts).selectExpr("doc_id", "false held_out", "text").mapInArrow(mixing._chunked, mixing._CHUNK)
    chunks = list(mixing._chunks(chunked.toArrow().to_batches()))
    found = Counter()
    for c in chunks:
        assert c.words == sorted({*c.words, mixing.END}, key=mixing.sort_key)
        text, end = mixing.spelled(c.words), c.words.index(mixing.END)
        for i, (row, *_) in enumerate(c.runs):
            found[row] = (found[row] or b"") + text.of(c.tokens(i, end)).tobytes()
    assert sorted(found.values()) == sorted(spelled(t) for t in texts)
