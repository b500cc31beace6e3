"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.session import write_out


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: the smallest node of its component.

    Each round a node takes the smallest root among its own and its neighbours', and then the root
    of that root. Minima are merged within tasks, so a node with many links is no hot
    spot; every round is a table in the shared folder and only a count comes to the driver.
    """
    both = write_out(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    roots = write_out(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hop = roots.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        over = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = write_out(hop.join(over, "root").select(
            "node", "old", F.least("root", "next").alias("root")), "roots")
        changed = moved.filter("old <> root").limit(1).count()
        roots = moved.drop("old")
        if not changed:
            return roots
