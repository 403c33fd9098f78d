"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.session import Cut


def _canonical(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def components(edges: DataFrame, cut: Cut) -> DataFrame:
    """(node, component) for every node of edges(a, b), both long; component is the smallest node reached.

    Minimum labels propagate across the edges, pointer jumping shortens the chains they form, and the edges are then
    drawn between the labels, until none is left; each round is written to the shared folder. Both directions of an
    edge count, and repeated edges once. A null end ties nothing; a loop yields its node alone. An empty table
    gives an empty result. Hubs are pre-aggregated before the shuffle of the minima, and in joins their rows meet one
    row of a unique side, where adaptive execution splits them.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    left = cut.keep(edges.select(*_canonical(F.col("a"), F.col("b"))).distinct())
    nodes = left.select(F.col("a").alias("node")).unionAll(left.select("b")).distinct()
    labels = cut.keep(nodes.withColumn("component", F.col("node")))
    while not left.where("a <> b").isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select("b", "a"))
        near = cut.keep(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up")))
        jump = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        top = cut.keep(near.join(jump, "up").select("node", "top"))
        moved = labels.join(top.select(F.col("node").alias("component"), "top"), "component", "left")
        moved = cut.keep(moved.select("node", F.coalesce("top", "component").alias("component")))
        to_a, to_b = top.select(F.col("node").alias("a"), F.col("top").alias("x")), top.select(F.col("node").alias("b"), F.col("top").alias("y"))
        drawn = left.join(to_a, "a").join(to_b, "b").where("x <> y")
        drawn = cut.keep(drawn.select(*_canonical(F.col("x"), F.col("y"))).distinct())
        cut.drop(near, top, labels, left)
        left, labels = drawn, moved
    return labels
