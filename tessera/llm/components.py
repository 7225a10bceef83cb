"""Connected components by alternating large-star and small-star, as joins and aggregations.

large-star: every node links its neighbours that are larger than itself to the least node it sees.
small-star: every node links its smaller neighbours, and itself, to the least of them.
Alternated until nothing changes, each component becomes a star around its least node.  No component or link list
reaches the driver, which only compares counts and checksums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import by_hub, materialize


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
    return by_hub(both.filter("v > u"), least, "u", "v", "degree", hub).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    near = by_hub(down, least, "u", "v", "degree", hub)
    return near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60, hub: int = 100_000) -> DataFrame:
    """edges: u long, v long (undirected; repeats, loops and nulls do no harm).  Returns node, component: for every
    node of some non-loop edge the least node of its component.  No edges: no rows.  A node with more than `hub` edges is
    joined in portions of that many."""
    now = materialize(edges.select("u", "v").filter("u is not null and v is not null and u != v").distinct())
    before = _sum(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = materialize(_small_star(materialize(_large_star(now, hub)), hub))
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
