"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of edges(u, v) reaches. Nodes without edges don't appear.

    Each round is a few aggregations and joins that Spark deals out by node; the rounds grow with the logarithm of the
    longest path, and each starts from a table written to the shared folder. Self-loops and repeated edges are ignored.
    """
    spark = edges.sparkSession
    now = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct(), "edges")
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is tied to the least node around it.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours are tied to the least of these.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        after = common.written(small.select("e.v", "e.u").where("u <> v").distinct(), "edges")
        moved = after.join(now, ["u", "v"], "left_anti").limit(1).count() + (after.count() != now.count())
        common.dropped(now)
        now = after
        if not moved:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    raise RuntimeError("components did not settle")
