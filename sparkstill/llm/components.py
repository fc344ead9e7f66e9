"""Connected components by alternating large-star and small-star steps, as joins and groups.

Nodes may be of any type that has an order. Edges may repeat, in both directions, and link a
node with itself; such loops alone give no node. Null ends link nothing. Without edges there
are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy


@tidy
def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """`node`, `root`: of each node in `edges` (a, b) the smallest node it reaches, itself included.

    Each step writes the edges to the shared folder; stops when a step changes nothing.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(most):
        # large star: each node's larger neighbours are linked to the least of its neighbours and itself
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node's smaller neighbours and itself are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sums == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = sums
    raise RuntimeError(f"components did not settle in {most} steps")
