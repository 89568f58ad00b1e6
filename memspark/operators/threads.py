"""Conversation threads, chat history, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import key_prefix


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages with new ones (thread_id, ord, role, content), numbered on from the thread's last seq
    in the order of ord, from 0 for a new thread (C1)."""
    top = messages.groupBy("thread_id").agg(F.max("seq").alias("_top"))
    turn = F.row_number().over(Window.partitionBy("thread_id").orderBy("ord"))
    numbered = new.withColumn("_n", turn).join(top, "thread_id", "left").select("thread_id", (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast("long").alias("seq"), "role", "content")
    return messages.select("thread_id", "seq", "role", "content").unionByName(numbered)


def get_messages(messages: DataFrame, before: int | None = None, after: int | None = None, roles: list[str] | None = None) -> DataFrame:
    """Messages with after < seq < before and the roles, in order."""
    rows = messages if before is None else messages.where(F.col("seq") < before)
    rows = rows if after is None else rows.where(F.col("seq") > after)
    return rows if roles is None else rows.where(F.col("role").isin(*roles))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each thread."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("seq"))
    return messages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def transcripts(messages: DataFrame, separator: str = "\n") -> DataFrame:
    """Each thread as one text of `role: content` in order (C4)."""
    lines = F.sort_array(F.collect_list(F.struct("seq", F.concat_ws(": ", "role", "content").alias("line"))))
    return messages.groupBy("thread_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), separator).alias("transcript"))


def clear_threads(messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages of other threads, removed per thread)."""
    gone = messages.join(ids, "thread_id", "left_semi").groupBy("thread_id").agg(F.count("*").alias("removed"))
    return messages.join(ids, "thread_id", "left_anti"), gone


def messages_to_writes(messages: DataFrame, ttl_seconds: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Messages as writes of episodic memories with padded keys."""
    key = F.format_string("chat:%d:msg:%04d", F.col("thread_id").cast("long"), (F.col("seq") + 1).cast("long"))
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    made = messages.select(key.alias("memory_key"), F.to_json(F.struct(role.alias("role"), F.col("content"))).alias("content"), F.lit("episodic").alias("memory_type"), F.lit("session").alias("scope"), F.col("thread_id"), F.col("seq"))
    return made if ttl_seconds is None else made.withColumn("expires_at", as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))


def chat_history(mem: DataFrame) -> DataFrame:
    """Messages read back from such memories: session, memory_key, role, content; what isn't JSON is
    a human's text, as is an unknown role (C6)."""
    rows = key_prefix(mem, "chat:")
    parsed = F.from_json("content", "role string, content string")
    ok = parsed["role"].isNotNull() | parsed["content"].isNotNull()
    role = F.when(parsed["role"].isin("human", "ai", "system"), parsed["role"]).otherwise("human")
    return rows.select(F.element_at(F.split("memory_key", ":"), 2).alias("session"), "memory_key", F.when(ok, role).otherwise("human").alias("role"), F.when(ok, F.coalesce(parsed["content"], F.lit(""))).otherwise(F.col("content")).alias("content"))


def checkpoint_writes(states: DataFrame) -> DataFrame:
    """States (thread_id, checkpoint_id, state) as writes, each with the thread's latest pointer."""
    own = states.select(F.concat(F.lit("checkpoint:"), F.col("thread_id").cast("string"), F.lit(":"), F.col("checkpoint_id").cast("string")).alias("memory_key"), F.col("state").alias("content"), "thread_id", "checkpoint_id")
    last = states.groupBy("thread_id").agg(F.max_by("state", "checkpoint_id").alias("content"), F.max("checkpoint_id").alias("checkpoint_id"))
    return own.unionByName(last.select(F.concat(F.lit("checkpoint:"), F.col("thread_id").cast("string"), F.lit(":latest")).alias("memory_key"), "content", "thread_id", "checkpoint_id"))


def checkpoints(mem: DataFrame) -> DataFrame:
    """Checkpoints without the latest pointers."""
    return key_prefix(mem, "checkpoint:", ":latest")


def latest_checkpoint(mem: DataFrame) -> DataFrame:
    return checkpoints(mem).groupBy("thread_id").agg(F.max("checkpoint_id").alias("checkpoint_id"), F.max_by("content", "checkpoint_id").alias("content"))


def delete_checkpoints(mem: DataFrame, threads: DataFrame) -> DataFrame:
    """mem without all checkpoints and latest pointers of the given threads (thread_id)."""
    gone = threads.select(F.concat(F.lit("checkpoint:"), F.col("thread_id").cast("string")).alias("_prefix")).distinct()
    return mem.withColumn("_prefix", F.regexp_extract("memory_key", r"^(checkpoint:.*):[^:]*$", 1)).join(gone, "_prefix", "left_anti").select(*mem.columns)


def list_threads(messages: DataFrame) -> DataFrame:
    """Threads with their number of messages, first and last seq."""
    return messages.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
