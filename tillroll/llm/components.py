"""Connected components by repeated contraction, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node. Self-loops and repeated edges are harmless."""
    live = C.materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    levels: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = C.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "parents")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = C.materialize(parent.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")), "parents")
        levels.append(jumped)
        a = live.join(jumped.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").select("pa", "b")
        b = a.join(jumped.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b").where("pa != pb")
        live = C.materialize(b.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not levels:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = levels[-1].withColumnRenamed("parent", "component")
    for level in reversed(levels[:-1]):
        out = C.materialize(level.join(out.withColumnRenamed("node", "parent"), "parent", "left").select("node", F.coalesce("component", "parent").alias("component")), "components")
    return out
