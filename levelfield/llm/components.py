"""Connected components of a link table, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (u < v); root is the smallest node joined.

    Each round is written to the shared folder.  The largest star is pre-aggregated and
    joined back, never gathered.  Ends when a round changes nothing.
    """
    edges = materialise(links.select("u", "v"), "links")
    mark = None
    while True:
        edges = materialise(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
