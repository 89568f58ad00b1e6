"""Maintenance jobs as functions of the state (M2-M7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scoring
from .consolidate import consolidate, duplicate_pairs


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def stale_test(as_of: Column, days: int = 90, max_importance: float = 0.3) -> Column:
    return (F.col("status") == "active") & (F.col("updated_at") < as_of - _days(days)) & (F.col("importance_score") < max_importance)


def invalid_test(as_of: Column) -> Column:
    past = F.coalesce(F.col("expires_at") <= as_of, F.lit(False)) | F.coalesce(F.col("valid_to") <= as_of, F.lit(False))
    return (F.col("status") == "active") & past


def expired_test(as_of: Column) -> Column:
    return (F.col("status") == "active") & F.coalesce(F.col("expires_at") < as_of, F.lit(False))


def _move(mem: DataFrame, test: Column, status: str, as_of: Column) -> DataFrame:
    return mem.withColumns({"updated_at": F.when(test, as_of).otherwise(F.col("updated_at")), "status": F.when(test, status).otherwise(F.col("status"))})


def archive_stale(mem: DataFrame, as_of: Column, days: int = 90, max_importance: float = 0.3) -> DataFrame:
    return _move(mem, stale_test(as_of, days, max_importance), "archived", as_of)


def mark_stale(mem: DataFrame, as_of: Column) -> DataFrame:
    return _move(mem, invalid_test(as_of), "stale", as_of)


def retract_expired(mem: DataFrame, as_of: Column) -> DataFrame:
    return _move(mem, expired_test(as_of), "retracted", as_of)


def recompute_recency(mem: DataFrame, as_of: Column) -> DataFrame:
    new = F.round(scoring.recency(F.col("updated_at"), as_of), 6)
    return mem.withColumn("recency_score", F.when(F.col("status") == "active", new).otherwise(F.col("recency_score")))


def prune_access(log: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return log.where(F.col("created_at") >= as_of - _days(days))


def maintain(mem: DataFrame, log: DataFrame, as_of: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(state', access log') after all jobs in a row, each on the state that the one before left (M7):
    duplicates merged, stale ones archived, invalid ones marked, expired ones retracted, recency
    computed anew, old accesses pruned."""
    new = consolidate(mem, as_of)[0]
    new = retract_expired(mark_stale(archive_stale(new, as_of, days), as_of), as_of)
    return recompute_recency(new, as_of), prune_access(log, as_of, days)


JOBS = ("consolidate", "archive_stale", "mark_stale", "retract_expired", "recompute_recency", "prune_access")


def maintain_counted(mem: DataFrame, log: DataFrame, as_of: Column, path: str, days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state', access log', report) of maintain() (M7): each job runs on the state that the one before
    left, and is counted while that state is computed, by observed metrics; the two tables are written
    to `path`, one pass each.  The metrics are observed in the stage that writes, of which each task
    counts once, however often it was tried.  report: job, affected."""
    seen, pruned = Observation(), Observation()
    count = lambda test, job: F.count_if(F.coalesce(test, F.lit(False))).alias(job)
    before = mem.withColumn("_before", F.col("status"))
    state = consolidate(before, as_of)[0]
    state = state.withColumn("_merged", (F.col("_before") == "active") & (F.col("status") == "archived"))
    marks = {"consolidate": F.col("_merged")}
    for job, test, status in (("archive_stale", stale_test(as_of, days), "archived"), ("mark_stale", invalid_test(as_of), "stale"), ("retract_expired", expired_test(as_of), "retracted")):
        state = _move(state.withColumn(f"_{job}", test), F.col(f"_{job}"), status, as_of)
        marks[job] = F.col(f"_{job}")
    marks["recompute_recency"] = F.col("status") == "active"
    state = recompute_recency(state, as_of).observe(seen, *(count(test, job) for job, test in marks.items())).select(*mem.columns)
    state.write.mode("overwrite").parquet(f"{path}/memories")
    log.observe(pruned, count(F.col("created_at") < as_of - _days(days), "prune_access")).transform(prune_access, as_of, days).write.mode("overwrite").parquet(f"{path}/access_log")
    found = seen.get | pruned.get
    spark = mem.sparkSession
    report = spark.createDataFrame([(job, found[job]) for job in JOBS], "job string, affected long")
    return spark.read.schema(mem.schema).parquet(f"{path}/memories"), spark.read.schema(log.schema).parquet(f"{path}/access_log"), report


def run_maintenance(mem: DataFrame, log: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """A report of what each job would touch on this state (M7): job, affected."""
    jobs = [
        ("archive_stale", mem.where(stale_test(as_of, days))),
        ("mark_stale", mem.where(invalid_test(as_of))),
        ("retract_expired", mem.where(expired_test(as_of))),
        ("recompute_recency", mem.where("status = 'active'")),
        ("consolidate", duplicate_pairs(mem, ["user_id", "content_hash"])),
        ("prune_access", log.where(F.col("created_at") < as_of - _days(days))),
    ]
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("affected")).select(F.lit(job).alias("job"), "affected") for job, df in jobs))
