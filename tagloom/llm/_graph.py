"""Connected components of a graph that no machine holds: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm._work import remove, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component, for all nodes of ``edges`` (u, v: long).

    Each round links every larger neighbour of a node to its smallest one, then every smaller
    neighbour (Kiveris et al., 2014); the number of rounds grows with the logarithm of the size. The
    smallest neighbour is summed up before the shuffle, so a node with many edges costs no more than
    its edges. The rounds end when every edge ends in a root: each node is the least of its
    neighbours or has only one, which the same sums show. Edges from a node to itself and repeated
    edges are allowed; no edges give no nodes.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        least = stored(ends.select("u", F.least("u", "low").alias("m"), ((F.col("low") < F.col("u")) & (F.col("low") < F.col("high"))).alias("inner")), "least")
        if least.where("inner").isEmpty():
            remove(now.sparkSession, now)
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        # large star: neighbours above a node go to the smallest of its neighbours
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: so do those below it, and the node itself
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(down.withColumnRenamed("m", "v")).distinct(), "edges")
        remove(now.sparkSession, now, least)
        now = after
