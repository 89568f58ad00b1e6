"""Streaming forms: ingestion, access counts, sessions, the task state machine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import extract_observations, observations_to_writes
from ..operators.upsert import SIMPLE_KEY, upsert
from ..sources import kept
from ..sources.schemas import TRANSITIONS


def stream_observations(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Observations of a stream of events with created_at, each event_id once."""
    once = events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    return extract_observations(once)


OBSERVED = ("confidence", "metadata")
MEMORY_STATE = "user_id long, memory_key string, content string, content_hash string, version int, created_at timestamp, changed_at timestamp, updated_at timestamp, recency_score double, confidence double, metadata string"


def merge_memories(writes: DataFrame, path: str, batch: int, key: list[str] = SIMPLE_KEY, carry: tuple[str, ...] = OBSERVED, schema: str = MEMORY_STATE, buckets: int = 64) -> None:
    """Upsert a batch of writes into the table of memories that path/state keeps (X7): only the buckets
    of the batch's users are read and written.  Superseded versions go to path/versions/batch=n.  A
    batch that is repeated replaces what it wrote."""
    columns = key[:1]
    theirs = kept.touched(writes, columns, buckets)
    state = kept.current(writes.sparkSession, f"{path}/state", schema, batch, theirs)
    new, snapshots, _ = upsert(state, writes, key, carry)
    new = new.select(*state.columns)
    kept.replace(new, f"{path}/state", columns, buckets, batch)
    snapshots.write.mode("overwrite").parquet(f"{path}/versions/batch={batch}")


def stream_memories(observations: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """A query that upserts observations (with created_at) into a kept table of memories (X7); read it
    with kept_memories.  Identical content makes no new version."""

    def fold(batch: DataFrame, number: int) -> None:
        merge_memories(observations_to_writes(batch), path, number, buckets=buckets)

    return observations.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_memories(spark, path: str, schema: str = MEMORY_STATE) -> DataFrame:
    """The table of memories that merge_memories keeps."""
    return kept.current(spark, f"{path}/state", schema)


def stream_access_counts(log: DataFrame, window: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Accesses of each memory in sliding windows (X8); also on tables."""
    counted = log.withWatermark("created_at", delay) if log.isStreaming else log
    return counted.groupBy(F.window("created_at", window, slide), "user_id", "memory_id").agg(F.count("*").alias("n"))


def stream_event_counts(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows."""
    counted = events.withWatermark("created_at", delay) if events.isStreaming else events
    return counted.groupBy(F.window("created_at", window), "event_type").agg(F.count("*").alias("n"))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of each user: runs of events with less than the gap between them."""
    counted = events.withWatermark("created_at", delay) if events.isStreaming else events
    return counted.groupBy(F.session_window("created_at", gap), "user_id").agg(F.count("*").alias("n"))


class _Machine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        current = self.state.get()[0] if self.state.exists() else "pending"
        asked = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, to in zip(asked["seq"], asked["to_state"]):
            ok = to in TRANSITIONS.get(current, ())
            out.append((key[0], seq, current, to, ok))
            current = to if ok else current
        self.state.update((current,))
        yield pd.DataFrame(out, columns=["task_id", "seq", "from_state", "to_state", "accepted"])

    def close(self) -> None:
        pass


class _Expiry(StatefulProcessor):
    """Of each key the time at which its latest message expires, and a timer for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "written long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        written, due = self.due.get() if self.due.exists() else (-1, -1)
        asked = pd.concat(list(rows)).sort_values("created_at")
        last = asked.iloc[-1]
        micros = int(last["created_at"].value // 1000)
        if micros >= written:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if pd.isna(last["expires_at"]):
                self.due.clear()
            else:
                due = -(-last["expires_at"].value // 1_000_000)
                self.due.update((micros, due))
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        yield pd.DataFrame({"memory_key": [key[0]], "expired_at": pd.to_datetime([at], unit="ms")})

    def close(self) -> None:
        pass


def stream_expirations(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Messages (memory_key, created_at, expires_at) as they expire by event time (C7, M4): memory_key,
    expired_at.  State is one time and one timer a key, and goes when the timer fires; a later message
    of a key replaces its time, and one without expires_at stays for good.  Needs the RocksDB state
    store."""
    rows = messages.select("memory_key", "created_at", "expires_at").withWatermark("created_at", delay)
    return rows.groupBy("memory_key").transformWithStateInPandas(statefulProcessor=_Expiry(), outputStructType="memory_key string, expired_at timestamp", outputMode="Append", timeMode="EventTime")


def stream_transitions(requests: DataFrame) -> DataFrame:
    """Outcomes of a stream of requests (task_id, seq, to_state); each batch in the order of seq.
    Needs the RocksDB state store."""
    return requests.groupBy("task_id").transformWithStateInPandas(statefulProcessor=_Machine(), outputStructType="task_id long, seq long, from_state string, to_state string, accepted boolean", outputMode="Append", timeMode="None")
