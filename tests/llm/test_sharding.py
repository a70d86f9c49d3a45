"""Shards: whole, near equal, gapless, alike on every run."""

import zlib

from cohortlake.llm import sharding
from tests.llm.helpers import odd_texts, prose, table


def test_shards(spark):
    texts = [*odd_texts(), *[prose(s % 50, 20 + s % 90) for s in range(900)], *["one text of a hot group"] * 500]
    rows = sharding.kd_tree_shards(table(spark, texts), 8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = {}
    slots = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(size) == set(range(8))
    largest = max(len((t or "").encode()) for t in texts) + 16
    assert max(size.values()) - min(size.values()) <= 3 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.kd_tree_shards(table(spark, texts), 8).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)


def test_few_and_repeated_rows(spark):
    assert sharding.kd_tree_shards(table(spark, []), 4).count() == 0
    rows = sharding.kd_tree_shards(table(spark, ["a", "a", None], [1, 1, None]), 4).collect()
    assert len(rows) == 3 and all(0 <= r["shard"] < 4 for r in rows)


def test_equal_texts_stay_together_but_for_large_groups(spark, monkeypatch):
    texts = [prose(s % 300, 20 + s % 300 % 40) for s in range(900)] + ["one text of a hot group"] * 2000
    for hot_rows in (sharding.HOT_ROWS, 2):  # groups that meet their rows by shuffle, or are sent to every task
        monkeypatch.setattr(sharding, "HOT_ROWS", hot_rows)
        rows = sharding.kd_tree_shards(table(spark, texts), 8, slack=0.1).collect()
        where, size = {}, {}
        for r in rows:
            where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
            size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        assert len(rows) == len(texts) and set(size) == set(range(8))
        assert all(len(w) == 1 for t, w in where.items() if t != "one text of a hot group")
        assert max(size.values()) <= 1.4 * min(size.values())
