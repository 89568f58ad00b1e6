"""Access analytics and boosting (A2-A4, M1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


def access_counts(log: DataFrame, since: Column | None = None) -> DataFrame:
    rows = log if since is None else log.where(F.col("created_at") >= since)
    return rows.groupBy("user_id", "memory_id").agg(F.count("*").alias("n"))


def top_accessed(log: DataFrame, since: Column | None = None, k: int = 20) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "memory_id")
    return access_counts(log, since).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def access_stats(log: DataFrame, as_of: Column, window_hours: int = 168, approximate: bool = False) -> DataFrame:
    """Of each user in the window: total, distinct memories, and the counts by type as a map."""
    rows = log.where((F.col("created_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(window_hours))) & (F.col("created_at") <= as_of))
    by_type = rows.groupBy("user_id", "access_type").agg(F.count("*").alias("n"))
    distinct = F.approx_count_distinct("memory_id") if approximate else F.countDistinct("memory_id")
    totals = rows.groupBy("user_id").agg(distinct.alias("memories"))
    maps = by_type.groupBy("user_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("access_type", "n")))).alias("by_type"))
    return maps.join(totals, "user_id")


def access_sketches(log: DataFrame, unit: str = "day") -> DataFrame:
    """Of each user and day (of date_trunc) the accesses and a HyperLogLog sketch of the memories (A4):
    user_id, day, n, sketch.  Sketches are kept, and added to by the day; no window reads the log again."""
    return log.groupBy("user_id", F.date_trunc(unit, "created_at").alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg("memory_id", F.lit(14)).alias("sketch"))


def window_stats(sketches: DataFrame, since: Column, until: Column) -> DataFrame:
    """Of each user the accesses and about the number of distinct memories from `since` to before
    `until`, by union of the days' sketches (A4, A9)."""
    rows = sketches.where((F.col("day") >= since) & (F.col("day") < until))
    return rows.groupBy("user_id").agg(F.sum("n").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("memories"))


def boost_importance(mem: DataFrame, log: DataFrame, as_of: Column, window_hours: int = 168, factor: float = 0.05, cap: float = 1.0, top_n: int = 100) -> tuple[DataFrame, DataFrame]:
    """(state', boosted) (M1): active memories among their user's top_n in the window get
    min(importance + ln(1+n)*factor, cap), rounded to 4 places, where that is more."""
    top = top_accessed(log, as_of - F.make_dt_interval(F.lit(0), F.lit(window_hours)), top_n).select(F.col("memory_id").alias("_id"), "n")
    top = top.groupBy("_id").agg(F.sum("n").alias("_n"))
    joined = mem.join(top, F.col("id") == F.col("_id"), "left")
    new = F.round(F.least(F.col("importance_score") + scoring.boost(F.col("_n"), factor), F.lit(cap)), 4)
    joined = joined.withColumn("_new", new).withColumn("_go", F.coalesce((F.col("status") == "active") & F.col("_n").isNotNull() & (F.col("_new") > F.col("importance_score")), F.lit(False)))
    boosted = joined.where("_go").select("id", F.col("importance_score").alias("old"), F.col("_new").alias("new"), F.col("_n").alias("n"))
    state = joined.withColumns({"importance_score": F.when(F.col("_go"), F.col("_new")).otherwise(F.col("importance_score")), "updated_at": F.when(F.col("_go"), as_of).otherwise(F.col("updated_at"))})
    return state.select(*mem.columns), boosted
