"""Connected components of a link table by alternating large and small stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b: of any type that has an order, a != b) -> node, root: the least node that each node reaches; nodes that are the least themselves are left out.

    Rounds grow with the logarithm of the longest chain. A star's centre is grouped by min alone, so no neighbourhood meets in one task's memory; the join of a node with its least neighbour is left to adaptive skew handling. Only counts come to the driver. No links give no rows.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        # Large star: every larger neighbour of a node is tied to the least of the node and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours and the node itself are tied to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        met = large.join(least, F.col("u") == F.col("k"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            roots = edges.groupBy("u").agg(F.min("v").alias("v"))
            return roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
