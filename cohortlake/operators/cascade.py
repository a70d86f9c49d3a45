"""Removing what hangs on removed resources.

nodes: node, reference_only, valid. edges: parent, attribute, child, must_have: attribute is one attribute of one resource,
shared by all groups that ask for it alike, so it has several parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.plans.lineage import cut, sized

MAX_ROUNDS = 1000


#: Rounds after which counters are added up again, so that they are not read from ever more files.
_COMPACT = 8


class _Counters:
    """How much of its support each key has lost: a row for every loss, added up for the keys that lose something now."""

    def __init__(self, support: DataFrame, key: str, losses: list[str]) -> None:
        self.support, self.key, self.losses = support, key, losses
        self.held: list[DataFrame] = []

    def lose(self, rows: DataFrame) -> DataFrame:
        """Takes what keys lose in this round (a row a key) and gives each with its support, and what is lost with and without this round."""
        now = cut(rows, "losses")
        before = reduce(DataFrame.unionByName, self.held) if self.held else now.limit(0)
        own = before.join(now.select(self.key), self.key, "left_semi").groupBy(self.key).agg(*(F.sum(c).alias(f"had_{c}") for c in self.losses))
        if len(self.held) == _COMPACT:
            self.held = [cut(before.groupBy(self.key).agg(*(F.sum(c).alias(c) for c in self.losses)), "losses")]
        self.held.append(now)
        known = now.join(own, self.key, "left").join(self.support, self.key)
        return known.withColumns({f"had_{c}": F.coalesce(f"had_{c}", F.lit(0)) for c in self.losses})


def cascade(nodes: DataFrame, edges: DataFrame, down: bool = True) -> DataFrame:
    """(node) newly invalid: the least fixpoint of both directions (or of the upward one), whatever the order of rows.

    Down: an attribute dies when all its parents are invalid; a reference-only child without any attribute left is
    invalid. Up: a must-have attribute without any child left makes all its parents invalid.

    Attributes know how many parents and children they have, children how many attributes: counted once. A round takes from
    these counts what the nodes that fell in the last one held, and only what loses something is looked at.
    """
    edges = cut(edges.select("parent", "attribute", "child", "must_have"), "edges")
    above = cut(edges.groupBy("parent", "attribute").agg(F.bool_or("must_have").alias("must_have")), "attributes-above")
    below = cut(edges.select("attribute", "child").distinct(), "children-below")
    sides = above.select("attribute", F.lit(1).alias("p"), F.lit(0).alias("c"), "must_have").union(below.select("attribute", F.lit(0), F.lit(1), F.lit(False)))
    support = sides.groupBy("attribute").agg(F.sum("p").alias("parents"), F.sum("c").alias("children"), F.bool_or("must_have").alias("must_have"))
    attributes = _Counters(cut(support, "attribute-support"), "attribute", ["lost_parents", "lost_children"])
    if down:
        held = below.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("attributes"))
        children = _Counters(cut(held.join(nodes.where("reference_only").select("node").distinct(), "node", "left_semi"), "child-support"), "node", ["lost_attributes"])
    first = cut(nodes.where("NOT valid").select("node").distinct(), "invalid")
    dead = fresh = first
    for _ in range(MAX_ROUNDS):
        up = below.join(fresh.withColumnRenamed("node", "child"), "child", "left_semi").select("attribute", F.lit(0).alias("p"), F.lit(1).alias("c"))
        both = up.union(above.join(fresh.withColumnRenamed("node", "parent"), "parent", "left_semi").select("attribute", F.lit(1).alias("p"), F.lit(0).alias("c"))) if down else up
        met = attributes.lose(both.groupBy("attribute").agg(F.sum("p").alias("lost_parents"), F.sum("c").alias("lost_children")))
        bare = met.where("must_have AND had_lost_children < children AND had_lost_children + lost_children = children").select("attribute")
        found = above.join(bare, "attribute", "left_semi").select(F.col("parent").alias("node"))
        if down:
            over = met.where("had_lost_parents < parents AND had_lost_parents + lost_parents = parents").select("attribute")
            loose = below.join(over, "attribute", "left_semi").groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("lost_attributes"))
            left = children.lose(loose).where("had_lost_attributes < attributes AND had_lost_attributes + lost_attributes = attributes")
            found = found.union(left.select("node"))
        fresh = cut(found.distinct().join(dead, "node", "left_anti"), "invalid")
        if fresh.isEmpty():
            return dead.join(first, "node", "left_anti")
        dead = dead.union(fresh)
    raise RuntimeError(f"cascade did not settle in {MAX_ROUNDS} rounds")


def unfounded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) reference-only and valid, but not reached from any valid direct node: cycles that only hold each other up.

    Edges to what is reached are dropped every few rounds, and nodes reached before that are not asked for again: a round reads what
    is left, and no set that grows with the rounds is sent to the driver.
    """
    alive = nodes.where("valid").select("node", "reference_only")
    sides = [alive.select(F.col("node").alias(c)).distinct().hint("merge") for c in ("parent", "child")]
    frontier = cut(alive.where("NOT reference_only").select("node").distinct(), "founded")
    reached, recent = [frontier], []  # recent: since steps were last thinned out
    steps = edges.select("parent", "child").distinct().join(sides[0], "parent", "left_semi").join(sides[1], "child", "left_semi")
    steps = cut(steps.join(frontier.withColumnRenamed("node", "child").hint("merge"), "child", "left_anti"), "live-edges")
    for _ in range(MAX_ROUNDS):
        found = steps.join(sized(frontier.withColumnRenamed("node", "parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        if recent:
            found = found.join(reduce(DataFrame.unionByName, recent).hint("merge"), "node", "left_anti")
        frontier = cut(found, "founded")
        if frontier.isEmpty():
            known = reduce(DataFrame.unionByName, [*reached, *recent])
            return alive.where("reference_only").select("node").distinct().join(known.hint("merge"), "node", "left_anti")
        recent.append(frontier)
        if len(recent) == _COMPACT:
            gone = cut(reduce(DataFrame.unionByName, recent), "founded")
            steps = cut(steps.join(gone.withColumnRenamed("node", "child").hint("merge"), "child", "left_anti"), "live-edges")
            reached, recent = [*reached, gone], []
    raise RuntimeError(f"reachability did not settle in {MAX_ROUNDS} rounds")


def group_survivors(people: DataFrame, groups: DataFrame, required: list[str]) -> DataFrame:
    """People who still have a valid resource in every required group; groups has patient_id, group_id, valid."""
    if not required:
        return people
    kept = groups.where(F.col("valid") & F.col("group_id").isin(required)).groupBy("patient_id").agg(F.count_distinct("group_id").alias("n"))
    return people.join(kept.where(F.col("n") == len(required)), "patient_id", "left_semi")
