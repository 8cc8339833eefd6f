"""Connected components as rounds of joins (contraction to the smallest neighbour).

Each round points every node at its smallest neighbour, shortens the pointers until all lead to the
root of their tree, and replaces both ends of every edge by their roots. Edges that became loops
vanish; the number of trees at least halves per round. Neighbour minima are partial aggregates, and
joins on a popular root are plain equi-joins that the adaptive planner may split, so one giant
component does not gather in a task. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.core import is_empty, materialize


def _shortened(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, root) pointers that always lead to a smaller node or to itself."""
    parents = materialize(parents)
    while True:
        above = parents.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_up"))
        step = materialize(parents.join(above, "root", "left").select(
            "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        parents = step.select("node", "root")
        if step.where("_moved").isEmpty():
            return parents


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b); root is the smallest node of its component.

    Edges may repeat, run in either direction or be loops; rows with a null end are no edges.
    """
    edges = materialize(edges.where("a is not null and b is not null")
                        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        stars = _shortened(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
        if roots is None:
            roots = stars
        else:
            onward = stars.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            roots = materialize(roots.join(onward, "root", "left").select(
                "node", F.coalesce("_next", "root").alias("root")))
        at = stars.select("node", "root")
        edges = materialize(
            edges.join(at.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a")
            .join(at.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b")
            .where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if is_empty(edges):
            return roots
