"""Connected components of an edge table, as joins and aggregations.

Every round lets each node's neighbours meet at the smallest of them, first the larger ones, then the
smaller ones, which keeps components together and shortens all paths; edges end as stars. Each round is
written to the shared folder, so lineage stays short and an executor may be lost at any time. Only the
number of changed edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the smallest node it sees.

    The minimum is an aggregate, written and joined back, so a node with very many neighbours is no single
    task: the join reads two plain exchanges, of which its part can be split.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars")
    linked = both.join(least, "a")
    if larger:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node it can reach. ``edges`` has a, b."""
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        new = materialize(_star(_star(now, True), False), "edges")
        # stars: no node is both an end and a centre, and no end has two centres
        done = new.select("b").distinct().join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and new.groupBy("a").count().filter("count > 1").isEmpty()
        now = new
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
