"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.llm._store import Store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller, with the node itself) neighbours of each node on the least of them."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(least, "u")
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame, store: Store) -> DataFrame:
    """edges (u long, v long), in any direction and with repeats -> (node, component), the least node reachable.

    Nodes without an edge aren't listed. An empty table gives an empty one.
    Rounds end when the edges no longer change; they grow with the logarithm
    of the number of nodes, and each reads and writes a table of edges only.
    """
    now = store.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark, old = seen, now
        now = store.keep(_star(_star(old, True), False))
        store.drop(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
