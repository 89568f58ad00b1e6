"""Upserts on a state that is fed back, kept tables, as-of joins: against loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memspark.operators import filters, upsert
from memspark.sources import kept, tables
from memspark.streaming import streams

KEY = ["user_id", "memory_key"]
WRITES = "user_id long, memory_key string, seq long, content string, written_at timestamp, confidence double, metadata string"


def batches(users=6, n=90):
    rnd = random.Random(5)
    rows = [(rnd.randrange(users), f"k{rnd.randrange(3)}", k, rnd.choice("abc"), datetime(2024, 1, 1) + timedelta(hours=k), k / 100, f"m{k}") for k in range(n)]
    return [rows[: n // 3], rows[n // 3 : 2 * n // 3], rows[2 * n // 3 :]]


def loop(parts):
    """(memories, superseded versions) write by write."""
    state, old = {}, []
    for user, key, _, content, at, confidence, metadata in (w for part in parts for w in part):
        known = state.get((user, key))
        if known is None:
            state[user, key] = [content, 1, at, at, at, 1.0, confidence, metadata]
        elif known[0] == content:
            known[4], known[5] = at, 1.0
        else:
            old.append((user, key, known[1], known[0], known[2], known[3], at))
            state[user, key] = [content, known[1] + 1, known[2], at, at, 1.0, confidence, metadata]
    return sorted((*k, *v) for k, v in state.items()), sorted(old)


def rows_of(state):
    return sorted(map(tuple, state.select(*KEY, "content", "version", "created_at", "changed_at", "updated_at", "recency_score", "confidence", "metadata").collect()))


def test_state_goes_back_unchanged(spark):
    parts, state, old = batches(), None, []
    for part in parts:
        state, snapshots, _ = upsert.upsert(state, spark.createDataFrame(part, WRITES), KEY, ("confidence", "metadata"))
        old += map(tuple, snapshots.select(*KEY, "version", "content", "created_at", "effective_from", "superseded_at").collect())
    assert (rows_of(state), sorted(old)) == loop(parts)
    # no writes: the same again
    again = upsert.upsert(state, spark.createDataFrame([], WRITES), KEY, ("confidence", "metadata"))[0]
    assert rows_of(again) == rows_of(state) and again.columns == state.columns


def test_created_at_and_recency_of_a_state(spark):
    state = spark.createDataFrame([(1, "a", "x", 2, datetime(2024, 1, 1), datetime(2024, 1, 2), 0.4), (1, "b", "y", 1, datetime(2024, 1, 1), datetime(2024, 1, 1), 0.3), (1, "c", "z", 1, datetime(2024, 1, 1), datetime(2024, 1, 1), 0.2)], "user_id long, memory_key string, content string, version int, created_at timestamp, updated_at timestamp, recency_score double")
    writes = spark.createDataFrame([(1, "a", 1, "new", datetime(2024, 1, 5)), (1, "b", 2, "y", datetime(2024, 1, 6))], "user_id long, memory_key string, seq long, content string, written_at timestamp")
    got = {r.memory_key: (r.content, r.version, r.created_at.day, r.updated_at.day, r.recency_score) for r in upsert.upsert(state, writes, KEY)[0].collect()}
    assert got == {"a": ("new", 3, 1, 5, 1.0), "b": ("y", 1, 1, 6, 1.0), "c": ("z", 1, 1, 1, 0.2)}
    untouched = {r.memory_key: (r.updated_at.day, r.recency_score) for r in upsert.upsert(state, writes, KEY, touch_on_skip=False)[0].collect()}
    assert untouched == {"a": (5, 1.0), "b": (1, 0.3), "c": (1, 0.2)}


def test_valid_from_is_the_creation_by_default(spark):
    writes = spark.createDataFrame([(1, "a", 1, "x", datetime(2024, 1, 5), None), (1, "b", 2, "x", datetime(2024, 1, 5), datetime(2024, 1, 1)), (1, "b", 3, "y", datetime(2024, 1, 6), None)], "user_id long, memory_key string, seq long, content string, written_at timestamp, valid_from timestamp")
    got = {r.memory_key: r.valid_from and r.valid_from.day for r in upsert.upsert(None, writes, KEY, ("valid_from",))[0].collect()}
    assert got == {"a": 5, "b": None}


def folders(path):
    return {b.name: sorted(n.name for n in b.iterdir() if n.is_dir()) for b in path.iterdir() if b.name.startswith("bucket=")}


def test_kept_table_equals_a_loop(spark, tmp_path):
    parts = batches()
    for n, part in enumerate(parts):
        for _ in range(1 + (n == 1)):  # the second batch runs twice, as after a failure
            streams.merge_memories(spark.createDataFrame(part, WRITES), str(tmp_path / "m"), n, buckets=8)
    assert rows_of(streams.kept_memories(spark, str(tmp_path / "m"))) == loop(parts)[0]
    old = spark.read.parquet(str(tmp_path / "m" / "versions"))
    assert sorted(map(tuple, old.select(*KEY, "version", "content", "created_at", "effective_from", "superseded_at").collect())) == loop(parts)[1]
    assert all(len(b) <= 2 for b in folders(tmp_path / "m" / "state").values())


def test_a_batch_of_one_user_writes_one_bucket(spark, tmp_path):
    where = str(tmp_path / "m")
    parts = batches(users=40)
    streams.merge_memories(spark.createDataFrame([w for p in parts for w in p], WRITES), where, 0, buckets=8)
    before = folders(tmp_path / "m" / "state")
    assert len(before) > 4
    write = spark.createDataFrame([(3, "k0", 1000, "new", datetime(2024, 3, 1), 0.5, "m")], WRITES)
    assert len(kept.touched(write, ["user_id"], 8)) == 1
    streams.merge_memories(write, where, 1, buckets=8)
    after = folders(tmp_path / "m" / "state")
    assert sum(before[b] != after[b] for b in before) == 1 and sum("batch=1" in b for b in after.values()) == 1
    assert streams.kept_memories(spark, where).count() == loop([[w for p in parts for w in p]])[0].__len__()
    assert kept.current(spark, str(tmp_path / "none"), "a int").count() == 0


def test_as_of_join_equals_a_loop(spark):
    rnd = random.Random(3)
    day = lambda x: datetime(2024, 1, 1) + timedelta(hours=x)
    versions, asked = [], []
    for k in [None, "a", "b", "hot"]:
        for v in range(40 if k == "hot" else 4):
            at = rnd.randrange(0, 400)
            versions.append((k, v + 1, day(at), f"{k}{v}", None if v % 3 else day(at + 20)))
        asked += [(k, day(rnd.randrange(-50, 500)), n) for n in range(60)]
    asked.append(("unknown", day(1), 99))
    df = spark.createDataFrame(versions, "k string, version int, effective_from timestamp, content string, valid_to timestamp")
    got = filters.as_of_join(df, spark.createDataFrame(asked, "k string, at timestamp, n int"), ["k"])
    want = []
    for k, at, n in asked:
        past = sorted((t, v, c, to) for kk, v, t, c, to in versions if kk == k and t <= at)
        t, v, c, to = past[-1] if past else (None,) * 4
        want.append((k, at, n, v, t, c, to, bool(past) and (to is None or to > at)))
    assert sorted(map(tuple, got.select("k", "at", "n", "version", "effective_from", "content", "valid_to", "valid").collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["k", "at", "n", "version", "effective_from", "content", "valid_to", "valid"]


def test_history_has_current_rows_and_versions(spark):
    state, old, _ = upsert.upsert(None, spark.createDataFrame([w for p in batches() for w in p], WRITES), KEY)
    both = filters.history(state, old, KEY, ["content"])
    assert both.count() == state.count() + old.count() == both.select(*KEY, "version").distinct().count()


def test_shared_path_is_in_the_shared_folder(spark):
    assert tables.shared_path(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
