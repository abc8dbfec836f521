"""Connected components of an undirected graph, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dugout.llm.common import stored


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the smallest node reachable.

    A round points every neighbour of a node at the smallest node in its neighbourhood, first the larger ones,
    then the smaller ones. Each is a grouped minimum and a join; no list of neighbours is built. The number of
    rounds grows with the logarithm of the graph's size. Null ends and loops are ignored.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    now = stored(now.where("u is not null and v is not null and u <> v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct()
        after = stored(after, "edges")
        # Contraction is done when it changes nothing: every node then points at its root.
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        now = after
