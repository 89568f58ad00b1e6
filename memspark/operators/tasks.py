"""The task state machine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import TRANSITIONS


def is_valid_transition(current: Column, requested: Column) -> Column:
    """Whether a state may follow another; unknown names may not."""
    rules = F.create_map(*(x for state, to in TRANSITIONS.items() for x in (F.lit(state), F.array(*map(F.lit, to)).cast("array<string>"))))
    return F.coalesce(F.array_contains(F.element_at(rules, current), requested), F.lit(False))


def apply_transitions(tasks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks', outcomes) of requests (task_id, seq, to_state) in the order of seq (T2).  outcomes has
    each request of a known task with from_state and accepted.

    A rejected request leaves the state, so a task's requests go one after another: they are sorted by
    task and pass a task of Spark as a stream that holds one state."""
    rows = tasks.select("task_id", F.lit(None).cast("long").alias("seq"), F.col("state").alias("to_state"), F.lit(0).alias("_kind"))
    rows = rows.unionByName(requests.select("task_id", F.col("seq").cast("long").alias("seq"), "to_state", F.lit(1).alias("_kind")))
    ident = tasks.schema["task_id"].dataType.simpleString()

    def run(batches):
        current, state = None, None  # the task that has begun, and its state
        for batch in batches:
            out = []
            for task, seq, to, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    current, state = (task,), to
                    out.append((task, None, None, to, True))
                elif current == (task,):
                    ok = to in TRANSITIONS.get(state, ())
                    out.append((task, seq, state, to, ok))
                    state = to if ok else state
            columns = list(zip(*out)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["task_id", "seq", "from_state", "to_state", "accepted"])

    done = rows.repartition("task_id").sortWithinPartitions("task_id", "_kind", "seq").mapInArrow(run, f"task_id {ident}, seq long, from_state string, to_state string, accepted boolean")
    # the first row of a task is its own, without seq
    last = done.where("accepted").groupBy("task_id").agg(F.max_by("to_state", F.coalesce("seq", F.lit(-(1 << 63)))).alias("state"))
    return last, done.where("seq is not null")


def state_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("n"))
