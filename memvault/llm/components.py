"""Connected components by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memvault.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (u, v) with u > v; the result again has u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    twice = edges.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").select("u")
    between = edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    return twice.unionByName(between.select(F.col("v").alias("u"))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, root): for every end of a link (a, b), the least id of its component. Isolated ids are absent.

    Edges are written after each round, so a lost executor costs one round; rounds grow with the log of the size.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _are_stars(edges):
        edges = written(_stars(edges), "edges")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
