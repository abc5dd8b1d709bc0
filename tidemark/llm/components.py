"""Connected components of an edge table, as Spark jobs; nothing but a count of changes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the least node that each reaches.

    Large and small stars in turn: each node's neighbours are hung on the least
    of them, first the larger ones, then the smaller; what remains are stars
    around the components' least nodes. Every round is written to the shared
    folder, and hubs are only ever grouped by partial minima.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = materialize(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        # done when every node hangs on one that hangs on nothing
        ends = small.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(small.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        open_ = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").limit(1)
        edges = small
        if not open_.count():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
