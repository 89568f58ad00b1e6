"""Duplicates and merging (A1, K1-K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components


def exact_duplicates(mem: DataFrame, status: str = "active") -> DataFrame:
    """Groups of a user's memories of equal content: user_id, content_hash, n, memory_ids in the
    order of creation (A1)."""
    rows = mem.where(F.col("status") == status).groupBy("user_id", "content_hash").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("created_at", "id"))).alias("m")).where("n > 1")
    return rows.select("user_id", "content_hash", "n", F.col("m.id").alias("memory_ids"))


def merge_pairs(mem: DataFrame, pairs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state', snapshots, links) of merges (keep_id, drop_id) (K1): the kept memory takes the greatest
    authority, confidence and importance, recency 1 and as_of; the dropped one is archived, with a
    snapshot; a `supersedes` link joins them.  A keeper may absorb many."""
    drop = pairs.select("keep_id", "drop_id").distinct()
    values = mem.select(F.col("id").alias("drop_id"), "authority_level", "confidence", "importance_score")
    best = drop.join(values, "drop_id").groupBy(F.col("keep_id").alias("_k")).agg(*(F.max(c).alias(f"_{c}") for c in ("authority_level", "confidence", "importance_score")))
    gone = drop.select(F.col("drop_id").alias("_d")).distinct()
    joined = mem.join(best, F.col("id") == F.col("_k"), "left").join(gone, F.col("id") == F.col("_d"), "left")
    kept, dropped = F.col("_k").isNotNull(), F.col("_d").isNotNull()
    new = joined.withColumns(
        {
            **{c: F.when(kept, F.greatest(c, f"_{c}")).otherwise(F.col(c)) for c in ("authority_level", "confidence", "importance_score")},
            "recency_score": F.when(kept, F.lit(1.0)).otherwise(F.col("recency_score")),
            "updated_at": F.when(kept | dropped, as_of).otherwise(F.col("updated_at")),
            "status": F.when(dropped, "archived").otherwise(F.col("status")),
        }
    ).select(*mem.columns)
    snapshots = mem.join(gone, F.col("id") == F.col("_d"), "left_semi").select(F.col("id").alias("memory_id"), "version", "content_hash", "status", "confidence", "importance_score", "created_at")
    return new, snapshots, drop.select(F.col("keep_id").alias("source_id"), F.col("drop_id").alias("target_id"), F.lit("supersedes").alias("link_type"))


def duplicate_pairs(mem: DataFrame, group: list[str]) -> DataFrame:
    """(keep_id, drop_id) within groups of active memories: kept is the one of most authority, then
    importance, then the earliest, then the smallest id."""
    # ranks need no sort of a group in one task: the keeper is an aggregate, joined back
    order = F.struct(F.col("authority_level").alias("a"), F.col("importance_score").alias("i"), (-F.unix_micros("created_at")).alias("c"), (-F.col("id")).alias("d"))
    active = mem.where("status = 'active'")
    keeper = active.groupBy(*group).agg((-F.max(order)["d"]).alias("keep_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return active.select(*group, "id").join(keeper, group).where("id <> keep_id").select("keep_id", F.col("id").alias("drop_id"))


def consolidate(mem: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every user's exact duplicates merged, without a loop (K2)."""
    return merge_pairs(mem, duplicate_pairs(mem, ["user_id", "content_hash"]), as_of)


def consolidate_near(mem: DataFrame, near: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters of near-duplicate pairs (id_a, id_b) merged, transitively (K3)."""
    groups = components(near.select(F.col("id_a").alias("source_id"), F.col("id_b").alias("target_id"), F.lit("near").alias("link_type")))
    grouped = mem.join(groups, F.col("id") == F.col("node"))
    return merge_pairs(mem, duplicate_pairs(grouped, ["component"]), as_of)


