"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from .skew import join_groups


def _hooked(rows: DataFrame, total: int) -> DataFrame:
    """Rows (a, b) with m, the least of a and its partners; a's of very many rows are spread over tasks."""
    low = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("c"))
    return join_groups(rows, low, ["a"], "c", total)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a > b) hangs from one node, which hangs from none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs")))
    by = ends.groupBy("node").agg(F.sum("hangs").alias("from"), F.min("hangs").alias("least"))
    return not by.filter("from > 1 or (from = 1 and least = 0)").head(1)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b; bigint), staged; comp is its smallest node.

    Each round is two grouped minima and equi-joins over the links, staged to the
    shared folder; rounds grow with the logarithm of the longest chain, and none
    follows once the links are stars.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _are_stars(edges):
        count, = edges.agg(F.count(F.lit(1))).first()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hooked(both, 2 * count).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "stars")
        hooked = _hooked(large, 2 * count)
        small = hooked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(small.unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct(), "edges")
        drop(edges, large)
        edges = after
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    out = stage(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots), "components")
    drop(edges)
    return out
