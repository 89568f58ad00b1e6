"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(v long, component long): for each vertex of edges (a long, b long; loops and repeats are
    fine) the smallest vertex that it reaches.

    A round moves every larger neighbour of a vertex to its smallest neighbour, then every smaller
    one, until all edges point at the smallest vertex; their number never grows, and the rounds are
    logarithmic in the vertices.  Minima are combined before they are shuffled, and joined back, so
    a vertex with very many edges is spread over tasks."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    top = e.select(F.col("v").alias("u")).distinct()
    return e.select("u", "v").unionByName(top.select("u", F.col("u").alias("v"))).select(F.col("u").alias("v"), F.col("v").alias("component"))
