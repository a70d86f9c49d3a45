"""Connected components by contraction, without moving links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Far beyond need: each round at least halves the expected number of vertices that still have links.
MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (a, b); component is the smallest node that can be reached.

    Each round, every vertex moves to the least of itself and its neighbours; links follow and loops go. Rounds order
    vertices by id and by a hash of the id in turn: ids collapse stars at once, hashes shorten long chains.
    """
    live = common.written(edges.select("a", "b").where("a <> b").distinct(), "links")
    labels = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    for round_ in range(MAX_ROUNDS):
        if live.isEmpty():
            return labels.join(labels.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
        rank = (lambda c: F.col(c)) if round_ % 2 == 0 else (lambda c: F.xxhash64(F.col(c)))
        ways = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("n"))).alias("m"))
        moves = common.written(least.select("a", F.least(F.col("m"), F.struct(rank("a").alias("r"), F.col("a").alias("n")))["n"].alias("to")), "moves")
        labels = common.written(labels.join(moves.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ends = live.join(moves, "a").select(F.col("to").alias("x"), "b").join(moves.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        live = common.written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
