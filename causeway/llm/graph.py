"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import drop_path, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the component's smallest node.

    Each round links every larger neighbour of a node to the smallest node
    around it, then every smaller one (two minimum aggregations and two
    equi-joins); the number of rounds grows with the logarithm of the longest
    path.  No link leaves the executors: only a row count and a hash sum are
    read on the driver.  Self-links and null ends are ignored, repeated links
    count once, an empty table gives an empty result.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col(a).isNotNull()) & (F.col(b).isNotNull()) & (F.col("u") != F.col("v"))).distinct(),
        "links",
    )
    state = _state(now)
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        after = written(small, "links")
        before, state_before, now, state = now, state, after, _state(after)
        drop_path(now.sparkSession, before._scratch_path)
        if state == state_before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
