"""Groups of rows that links hold together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_groups(links: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, group_id) for the nodes of links (a, b): the smallest node that can be reached. written: cuts a frame's lineage.

    Each round hangs every node on its smallest neighbour, halves the way up by one jump and draws links between what is then
    on top, so the number of rounds grows with the logarithm of the longest way.
    """
    ends = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct()
    left, rounds = written(ends(links, "a", "b")), []
    while not left.isEmpty():
        around = left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        around = written(around)
        above = around.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hung = written(around.join(above, "up").select("node", F.col("top").alias("up")))
        rounds.append(hung)
        side = lambda name: hung.select(F.col("node").alias(name), F.col("up").alias(f"up_{name}"))
        left = written(ends(left.join(side("a"), "a").join(side("b"), "b"), "up_a", "up_b"))
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("group_id"))
    out = rounds[-1].withColumnRenamed("up", "group_id")
    for hung in reversed(rounds[:-1]):
        out = written(hung.join(out.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("group_id", "up").alias("group_id")))
    return out
