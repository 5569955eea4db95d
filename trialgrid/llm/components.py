"""Connected components of an edge table, in a few rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every vertex tells its larger (large star) or smaller (small star) neighbours the least vertex it knows."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # written, so that the edges of a hot vertex can be split among tasks
    linked = both.join(written(least, "least"), "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every vertex is a root or hangs from one root."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    seen = ends.groupBy("v").agg(F.sum("up").alias("ups"), F.min("up").alias("is_root"))
    return seen.where("ups > 1 OR (ups = 1 AND is_root = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every vertex with an edge; comp is the component's smallest vertex. `edges` has long columns a and b."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars_only(edges):
        edges = written(_star(_star(edges, True), False), "edges")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)
