"""Connected components of an edge table, as alternating star contractions.

Every round is two aggregations and two joins on the node; a hot node is
pre-aggregated before its shuffle and its join side can be split by AQE.  Each
round is written to the shared folder, so lineage stays flat and nothing but one
row of totals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _totals(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node with an edge to another node;
    ``component`` is the smallest node it reaches.  Nodes may be of any ordered
    type; null ends and self loops carry no link."""
    pair = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u != v").distinct())
    pair = stored(pair)
    before = _totals(pair)
    while before[0]:
        pair = stored(_small_star(_large_star(pair)))
        after = _totals(pair)
        if after == before:
            break
        before = after
    roots = pair.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
