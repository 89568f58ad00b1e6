"""The store's tables derived from the given ones (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _pick(number, *names: str):
    found = F.when(number == 0, names[0])
    for k, name in enumerate(names[1:-1], 1):
        found = found.when(number == k, name)
    return found.otherwise(names[-1])


def memories(spark: SparkSession, sf_dir: str, embedding: bool = True) -> DataFrame:
    """The store's memories; without `embedding` no vectors are joined, by which texts are shuffled."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    m = vectors.count() if embedding else 1
    i = F.col("doc_id")
    start = F.lit("2023-10-01").cast("timestamp")
    days = lambda base, n: base + F.make_dt_interval(n.cast("int"))
    made = docs.select(
        i.alias("id"),
        (i % 10).alias("user_id"),
        F.when(i % 3 == 0, i % 7).alias("project_id"),
        F.concat(F.lit("doc:"), i.cast("string")).alias("memory_key"),
        _pick(i % 4, "semantic", "episodic", "procedural", "working").alias("memory_type"),
        _pick(F.floor(i / 4) % 4, "user", "project", "team", "global").alias("scope"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"),
        _pick(F.when(i % 10 == 9, 0).when(i % 10 == 8, 1).otherwise(2), "archived", "stale", "active").alias("status"),
        (1 + i % 4).alias("authority_level"),
        ((i % 101) / 100.0).alias("confidence"),
        ((i * 7 % 101) / 100.0).alias("importance_score"),
        F.lit(0.0).alias("recency_score"),
        days(start, i % 90).alias("created_at"),
        (start + F.make_dt_interval(F.lit(90), (i * 37 % 720).cast("int"))).alias("updated_at"),
        F.when(i % 5 == 0, days(F.lit("2024-01-15").cast("timestamp"), i % 60)).alias("expires_at"),
        F.when(i % 6 == 0, days(F.lit("2024-01-20").cast("timestamp"), i % 40)).alias("valid_to"),
        F.lit(1).alias("version"),
        (i % m).alias("vec_id"),
    )
    return made.join(vectors.select("vec_id", "embedding"), "vec_id", "left").drop("vec_id") if embedding else made.drop("vec_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").where(v % 7 == 0).select(v.alias("query_id"), (v % 10).alias("user_id"), F.when(v % 28 != 21, F.col("embedding")).alias("query_embedding"), F.lit(5).alias("top_k"))


def _k(events: DataFrame):
    return F.get_json_object("props", "$.k").cast("long")


def memory_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.concat(F.lit("k"), (_k(e) % 10).cast("string")).alias("memory_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"), (F.col("value") / 100).alias("importance_score"), F.col("ts").cast("timestamp").alias("written_at"))


# Link types by number.
LINK_ORDER = ("supports", "contradicts", "supersedes", "derived_from", "related_to")


def memory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n, i = docs.count(), F.col("doc_id")
    one = docs.select(i.alias("source_id"), ((i * 3 + 1) % n).alias("target_id"), _pick(i % 5, *LINK_ORDER).alias("link_type"))
    two = docs.select(i.alias("source_id"), ((i + 17) % n).alias("target_id"), _pick((i + 2) % 5, *LINK_ORDER).alias("link_type"))
    return one.unionByName(two).where("source_id <> target_id")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents").count()
    kind = F.when(F.col("event_type").isin("view", "click"), "retrieval").when(F.col("event_type") == "signup", "view").otherwise("prompt_inclusion")
    return e.select(((_k(e) * 10 + F.col("user_id") % 10) % n).alias("memory_id"), (F.col("user_id") % 10).alias("user_id"), kind.alias("access_type"), F.col("ts").cast("timestamp").alias("created_at"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user_input").when(F.col("role") == "assistant", "model_output").otherwise("system_note")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("run_id"), (F.col("conv_id") % 10).alias("user_id"), kind.alias("event_type"), F.col("text").alias("content"), F.col("turn").alias("sequence_number"))


def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id")).distinct().withColumn("state", F.lit("pending"))


def task_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    to = F.when(t == "signup", "in_progress").when(t == "click", "waiting_review").when(t == "purchase", "completed").when(t == "error", "failed").when(F.col("event_id") % 2 == 0, "pending").otherwise("cancelled")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), to.alias("to_state"), F.col("ts").cast("timestamp").alias("requested_at"))


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tens = F.floor(k / 10) % 10
    wanted = F.when(tens == 0, "*").when(tens < 5, "memory.created").otherwise("memory.updated, memory.archived")
    return table(spark, sf_dir, "customer").select(k.alias("webhook_id"), (k % 10).alias("user_id"), wanted.alias("events"), (k % 7 != 0).alias("is_active"))
