"""Statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bucket bounds of the latency histogram, in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def memory_stats(mem: DataFrame) -> DataFrame:
    """Of each user in one pass over grouping sets: counts in all, by status, by type and by scope
    (kind, name), and averages of active memories on the row of kind 'all' (A5)."""
    active = F.when(F.col("status") == "active", 1)
    averages = [F.round(F.avg(F.when(active == 1, F.col(c))), 6).alias(f"avg_{a}") for c, a in (("importance_score", "importance"), ("confidence", "confidence"))]
    sets = mem.groupingSets([["user_id"], ["user_id", "status"], ["user_id", "memory_type"], ["user_id", "scope"]], "user_id", "status", "memory_type", "scope")
    rows = sets.agg(F.count("*").alias("n"), *averages, F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "status").when(F.col("g") == 5, "type").otherwise("scope")
    name = F.when(kind == "all", "").otherwise(F.coalesce("status", "memory_type", "scope"))
    only = lambda c: F.when(kind == "all", F.col(c)).alias(c)
    return rows.select("user_id", kind.alias("kind"), name.alias("name"), "n", only("avg_importance"), only("avg_confidence"))


def masking_stats(logs: DataFrame) -> DataFrame:
    """Audit rows by entity type, and in all (null)."""
    return logs.rollup("entity_type").agg(F.count("*").alias("n"))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """A8; upserts by action, searches by strategy, deliveries by event and success."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def latency_histogram(df: DataFrame, column: str, buckets: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts: le, n rows of at most le; the last bound is infinite (null)."""
    sums = [F.sum(F.when(F.col(column) <= b, 1).otherwise(0)).alias(f"_{k}") for k, b in enumerate(buckets)]
    one = df.agg(*sums, F.count(column).alias("_all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.coalesce(F.col(f"_{k}"), F.lit(0)).cast("long").alias("n")) for k, b in enumerate(buckets)]
    return one.select(F.inline(F.array(*pairs, F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("n")))))
