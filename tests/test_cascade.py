"""Cascades on random graphs against a loop over plain sets, whatever the number of parents, children and rounds."""

import random

import pytest

from cohortlake.operators import cascade


def plain(nodes, edges, down):
    dead = {n for n, _, valid in nodes if not valid}
    first, only = set(dead), {n for n, reference_only, _ in nodes if reference_only}
    attributes = {}
    for parent, attribute, child, must in edges:
        own = attributes.setdefault(attribute, (set(), set(), []))
        own[0].add(parent), own[1].add(child), own[2].append(must)
    while True:
        new = set()
        for parents, children, must in attributes.values():
            if any(must) and children <= dead:
                new |= parents
        if down:
            for n in only:
                own = [parents for parents, children, _ in attributes.values() if n in children]
                if own and all(parents <= dead for parents in own):
                    new.add(n)
        if new <= dead:
            return dead - first
        dead |= new


@pytest.mark.parametrize(("seed", "down"), [(1, True), (2, True), (3, True), (4, False), (5, True)])
def test_against_plain_sets(spark, monkeypatch, seed, down):
    monkeypatch.setattr(cascade, "_COMPACT", 2)
    rng = random.Random(seed)
    n = rng.choice([12, 60])
    nodes = [(f"n{i}", rng.random() < 0.6, rng.random() < 0.8) for i in range(n)]
    edges = []
    for a in range(n):
        must = rng.random() < 0.4
        for parent in rng.sample(range(n), rng.choice([1, 1, 2])):
            edges += [(f"n{parent}", f"a{a}", f"n{c}", must) for c in rng.sample(range(n), rng.choice([1, 1, 2, 3]))]
    edges += edges[:3]
    got = cascade.cascade(spark.createDataFrame(nodes, "node string, reference_only boolean, valid boolean"), spark.createDataFrame(edges, "parent string, attribute string, child string, must_have boolean"), down)
    assert sorted(r[0] for r in got.collect()) == sorted(plain(nodes, edges, down))


def test_a_chain_and_nothing(spark):
    """A chain of must-haves falls one by one; without invalid nodes nothing does."""
    node, edge = "node string, reference_only boolean, valid boolean", "parent string, attribute string, child string, must_have boolean"
    edges = spark.createDataFrame([(f"n{i}", f"a{i}", f"n{i + 1}", True) for i in range(12)], edge)
    chain = lambda last: spark.createDataFrame([(f"n{i}", i > 0, i < 12 or last) for i in range(13)], node)
    assert cascade.cascade(chain(False), edges).count() == 12
    assert cascade.cascade(chain(True), edges).count() == 0
    assert cascade.cascade(spark.createDataFrame([], node), spark.createDataFrame([], edge)).count() == 0
