"""The prefix trie against one built by hand, whatever the shards."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortlake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, shard long, name string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "n") for r in rows], SCHEMA)


def ordered(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in found.items()}


def rebuilt(convs):
    def own(c):
        h = zlib.crc32(str(c).encode()) % 6
        return [*convs.get(c - c % 100, [])[:h], *convs[c][h:]]

    return {c: own(c) for c in convs}


def nodes_of(convs):
    """Every node by brute force."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(key))))
        out.append((
            min(own), len(key), min(members[key[:-1]]) if key else None, len(own), sum(len(k) == len(key) + 1 for k in below),
            sum(all(len(x) <= len(k) or x[: len(k)] != k for x in below) for k in below), sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def collected(df):
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()), key=str)


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(900), n):
        kind = rng.random()
        length = 0 if kind < 0.3 else rng.randrange(1, 8)
        turns = [("user" if k % 2 else None, rng.choice(["", None, "à🙂", "ab", "abc"])) for k in range(length)] or [("user", "hi"), ("bot", "hello"), ("user", "bye")]
        rows += [(c, None if k == 0 else k, *t) for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("turns", [1 << 17, 1, 9])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed, turns):
    rows = conversations(seed, 150)
    convs = rebuilt(ordered(rows))
    shards = lambda batches: _with(turns, batches)
    monkeypatch.setattr(trie, "_shards", shards)
    assert collected(trie.trie(trie.rebuilt(trie.sequences(frame(spark, rows))))) == nodes_of(convs)


def _with(turns, batches):
    from cohortlake.llm import trie as own

    own.SHARD_TURNS, own.BLOCK = turns, 4
    yield from own._shards(batches)


def test_a_hot_class_and_plain_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "_listed", lambda batches: _listing(batches))
    rows = [(c, k, "r", "t" * k) for c in range(300) for k in range(3)] + [(c, 0, "r", "x") for c in range(1000, 1010)]
    assert collected(trie.prefix_trie(frame(spark, rows))) == nodes_of(ordered(rows))


def _listing(batches):
    from cohortlake.llm import trie as own

    own.LIST_BYTES = 20
    yield from own._listed(batches)


def test_odd_rows(spark):
    rows = [(None, 0, "a", "b"), (1, 0, None, None), (1, 0, None, None), (2, 0, "", ""), (2, None, "z", "y"), (3, 5, "q", "w" * 3000), (-7, 1, "a", "b"), (4, 0, "1:a", "b"), (5, 0, "1", ":ab")]
    assert collected(trie.prefix_trie(frame(spark, rows))) == nodes_of(ordered(rows))
    assert trie.prefix_trie(frame(spark, [(None, 0, "a", "b")])).count() == 0
    assert trie.prefix_trie(frame(spark, []).limit(0)).count() == 0


def test_a_deep_conversation(spark):
    rows = [(1, k, "r", f"t{k}") for k in range(3000)] + [(2, k, "r", f"t{k}") for k in range(1500)] + [(3, 0, "r", "t0")]
    own = trie.prefix_trie(frame(spark, rows)).toPandas()
    assert len(own) == 3001 and own.n_convs.sum() == 3001 + 1501 + 2 and own.n_leaves.eq(1).all()
    assert own[own.depth == 0].saved_tokens.item() == 2 * 2 + sum(len(f"t{k}") for k in range(1, 1500))


@pytest.mark.parametrize("seed", range(20))
def test_closing_parentheses(seed):
    rng, bits, open_ = random.Random(seed), [1], 1
    for _ in range(rng.choice([1, 10, 3000])):
        one = open_ == 1 or rng.random() < 0.5
        bits.append(int(one))
        open_ += 1 if one else -1
    bits += [0] * open_
    own, stack, close = trie.Parentheses(np.array(bits, np.int8)), [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    at = own.opens()
    assert own.find_close(at).tolist() == [close[i] for i in at.tolist()]
