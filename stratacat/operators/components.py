"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacat.durable import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component``: for each node of an edge, the smallest node that it is linked to over any path.

    ``edges`` has ``a`` and ``b``. Each round first hangs every larger neighbour of a node onto the smallest one
    around it (large star), then does so with the smaller neighbours (small star). The edges become stars
    after about the squared logarithm of the longest path. Only sums and joins on nodes are used, so the many
    edges of one node are split over tasks. Rounds are written to the shared folder.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(large.join(least, "u").select(F.explode(ends).alias("e")).select("e.*").filter("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
