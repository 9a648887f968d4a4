"""Connected components of a link table, by alternating large and small stars.

Every round is a handful of aggregations and joins; no node's links are gathered
in one task and nothing but two counters reaches the driver. The rounds grow with
the logarithm of the longest chain. Each round is written to the shared folder,
which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docflow.llm.storage import discard, stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _keyed(least: DataFrame) -> DataFrame:
    """An aggregate under the complement of its key: it is dealt out anew for the join, which AQE can then split at a hot node."""
    return least.select(F.bitwise_not("u").alias("k"), "m")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node with a link to another; root is the smallest node of its component.

    Null ends and links of a node to itself are ignored; repeated links count once.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").withColumn("k", F.bitwise_not("u")).join(_keyed(least), "k").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.withColumn("k", F.bitwise_not("u")).join(_keyed(lower), "k").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        after = stored(small.where("u != v").distinct(), "links")
        now = _signature(after)
        discard(edges)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
