"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (u, v) with u > v: every node hands its neighbours (large: the greater ones) to its least neighbour.

    The least neighbour comes from a pre-aggregated minimum and an ordinary join, which Spark can split where a node
    has very many neighbours.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of long, in any direction -> (node, root): the least node of each component, for all nodes but the roots themselves.

    Self-links, repeated links and nulls are ignored; no edges give no rows. Each round is written to the checkpoint
    folder, so that lineage stays short and a lost executor costs one round at most. Rounds grow with the logarithm of the nodes.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    while True:
        e = _star(_star(e, large=True), large=False).checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
