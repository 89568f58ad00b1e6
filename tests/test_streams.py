"""Expiry by timers, masking before appends, transitions: against batches and loops."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memspark.functions import masking
from memspark.operators import events, tasks, vectors
from memspark.sources import tables, views
from memspark.sources.schemas import TRANSITIONS
from memspark.streaming import streams


def test_messages_expire_by_event_time(spark, tmp_path):
    schema = "memory_key string, created_at timestamp, expires_at timestamp"
    hour = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [
        [("a", hour(0), hour(5)), ("b", hour(1), hour(30)), ("c", hour(1), None), ("d", hour(2), hour(4))],
        [("a", hour(3), hour(20)), ("e", hour(10), hour(11))],  # a lives longer; the watermark is at hour 9
        [("d", hour(1), hour(100)), ("f", hour(26), hour(27))],  # d's row is late
        [("g", hour(50), hour(200))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = streams.stream_expirations(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.memory_key, r.expired_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # the same as a batch: of each key the row written last, if it expires before the watermark, hour 49
    last = {}
    for key, at, due in sorted((r for b in batches for r in b if r != ("d", hour(1), hour(100))), key=lambda r: r[1]):
        last[key] = due
    assert got == sorted((k, due) for k, due in last.items() if due is not None and due < hour(49))


def test_masking_equals_plain_python(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    odd = ["٣٣٣-٢٢-١١١١", "call 555\x1c123\x1c4567", "1 2 3 4 5 6 7 8 9 0 1 2 3", "A12345678", "dob: 1/2/1990", "no digits", "", None, "4111–1111–1111–1111", "x@y.org", "1.2.3.4", "(555) 123-4567", "+1-555-123-4567", "555 1234"]
    every = docs.unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(odd)], docs.schema))
    for patterns in (masking.SERVER, masking.EMBEDDED, {"tick": (r"T-\d+", "[TICK]")}):
        one = masking.masker(patterns)
        for r in masking.mask(every.withColumn("original", F.col("text")), "text", patterns).collect():
            if r.original is None:
                assert r.text is None and r.detections is None
            else:
                assert (r.text, [tuple(x) for x in r.detections]) == (lambda m: (m[0], m[1]))(one(r.original))


def test_events_are_masked_before_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "mail a.b@c.org"), (2, "plain"), (3, None)], "event_id long, content string")
    for _ in range(2):
        events.append_events(rows, str(tmp_path / "events"))
    got = sorted((r.event_id, r.content) for r in spark.read.parquet(str(tmp_path / "events")).collect())
    assert got == sorted([(1, "mail [EMAIL]"), (2, "plain"), (3, None)] * 2)


def test_transitions_of_a_hot_task(spark):
    rnd = random.Random(6)
    asked = [(rnd.choice([1, 1, 1, 2, 3, None, 9]), n, rnd.choice([*TRANSITIONS, "bogus"])) for n in range(3000)]
    state, want = {1: "pending", 2: "failed", 3: "completed", None: "pending"}, []
    start = dict(state)
    for t, n, to in asked:
        if t in state:
            ok = to in TRANSITIONS[state[t]]
            want.append((t, n, state[t], to, ok))
            state[t] = to if ok else state[t]
    new, log = tasks.apply_transitions(spark.createDataFrame(list(start.items()), "task_id long, state string"), spark.createDataFrame(asked, "task_id long, seq long, to_state string"))
    assert sorted(map(tuple, log.collect()), key=repr) == sorted(want, key=repr) and dict(map(tuple, new.collect())) == state


def test_lsh_recall_within_users(spark, sf):
    m = views.memories(spark, sf)
    pairs = lambda d: {(r.id_a, r.id_b) for r in d.collect()}
    exact = pairs(vectors.near_duplicates(m))
    assert len(pairs(vectors.near_duplicates(m, method="lsh")) & exact) >= 0.9 * len(exact) > 100
    rnd = random.Random(2)
    base = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(60)]
    rows = [(n, n % 3, "active", [x + rnd.gauss(0, 0.12) for x in base[n % 60]]) for n in range(600)]
    df = spark.createDataFrame(rows, "id long, user_id long, status string, embedding array<double>")
    exact = pairs(vectors.near_duplicates(df))
    found = pairs(vectors.near_duplicates(df, method="lsh"))
    assert found <= exact and len(found) >= 0.9 * len(exact) > 100


def test_counts_equal_plain_python(spark, sf):
    docs = tables.table(spark, sf, "documents")
    odd = ["é123-45-6789 123-45-6789é", "٣٣٣-٢٢-١١١١ 333-22-1111", "call (555) 123-4567, 5551234567 or 15551234567.", "DOB : 1/2/1990 born on 2001-02-03", None, ""]
    every = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    texts = [r.text or "" for r in every.collect()]
    for patterns in (masking.SERVER, masking.EMBEDDED):
        got = dict(map(tuple, masking.pii_counts(every, "text", patterns).collect()))
        assert got == {name: sum(len(list(re.finditer(p, t))) for t in texts) for name, (p, _) in patterns.items()}
