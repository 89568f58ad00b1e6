"""Pairs without shuffled products, equal vectors, rounding, shapes and payloads."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from memspark.operators import events, filters, retrieval, vectors
from memspark.functions import masking
from memspark.sources import views


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fan_out_of_several_channels_without_a_distinct(spark):
    e = spark.createDataFrame([(1, 7), (2, 8), (2, 8)], "event_id long, user_id long")
    subs = spark.createDataFrame([("global", 1), ("user:7", 1), ("user:7", 1), ("user:8", 2), ("global", 3)], "channel string, subscriber long")
    got = events.fan_out(events.route(e), subs)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)]
    # nothing is grouped after the join
    assert not plan(got).lstrip().startswith(("Aggregate", "Deduplicate"))


def test_fan_out_in_blocks(spark, tmp_path):
    e = spark.createDataFrame([(k, k % 5) for k in range(40)] + [(99, None)], "event_id long, user_id long")
    rows = [("global" if k % 3 == 0 else f"user:{k % 7}", k) for k in range(50)] + [(f"user:{k % 5}", k) for k in range(0, 50, 4)] + [("user:none", 60), (None, 61)]
    subs = spark.createDataFrame(rows, "channel string, subscriber long")
    got = events.fan_out(events.route(e), subs, n_events=3, n_subscribers=4, tasks=5)
    of = lambda u: {"global", f"user:{u}"}
    want = {(k, s) for k, u in [(k, k % 5) for k in range(40)] + [(99, "x")] for c, s in rows if c in of(u)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 800
    # many events of a channel meet many subscribers: a row takes far less than a byte
    many = spark.range(4_000).select(F.col("id").alias("event_id"))
    all_ = spark.range(2_000).select(F.col("id").alias("subscriber"), F.lit("global").alias("channel"))
    events.fan_out(events.route(many), all_).write.parquet(str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 8_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "x").glob("*.parquet")) < 0.3 * 8_000_000


def test_webhooks_match_once_without_a_distinct(spark):
    e = spark.createDataFrame([(1, 7, "a"), (1, 7, "a"), (2, 8, "b")], "seq long, user_id long, event_type string")
    hooks = spark.createDataFrame([(1, 7, "*, a", True), (1, 7, "a", True), (2, 7, "a,a", True), (3, 8, "a", True), (4, 8, "b", False), (5, 8, "*", True)], "webhook_id long, user_id long, events string, is_active boolean")
    got = events.match_webhooks(e, hooks)
    assert sorted(map(tuple, got.select("seq", "event_type", "webhook_id").collect())) == [(1, "a", 1), (1, "a", 2), (2, "b", 5)]
    assert not plan(got).lstrip().startswith(("Aggregate", "Deduplicate"))


def test_webhooks_meet_in_blocks_and_are_not_broadcast(spark):
    made = [(k, k % 3, "ab"[k % 2]) for k in range(60)] + [(99, None, "a")]
    wants = ["*", "a", "b , c", "c", "a,b", "x, *", None]
    held = [(k, k % 4, wants[k % 7], k % 5 > 0) for k in range(80)] + [(100, None, "*", True)]
    e = spark.createDataFrame(made, "seq long, user_id long, event_type string")
    hooks = spark.createDataFrame(held, "webhook_id long, user_id long, events string, is_active boolean")
    got = events.match_webhooks(e, hooks, n_events=3, n_hooks=2)
    assert got.columns == ["user_id", "event_type", "seq", "webhook_id"]
    wanted = lambda w, t: w is not None and bool({t, "*"} & {x.strip() for x in w.split(",")})
    want = [(u, t, n, i) for n, u, t in made for i, v, w, on in held if on and u is not None and u == v and wanted(w, t)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 200
    # copies of webhooks by blocks are more than the estimate of their size knows of
    steps = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in steps if "BroadcastHashJoin" in x and "LeftOuter" not in x] and any("SortMergeJoin" in x for x in steps)


def test_outbox_signs_pairs_where_they_are_made(spark, sf):
    from memspark.plans import registry

    secrets = {1: "s", 2: None, 3: "é" * 40, 4: "k" * 64, 5: ""}
    e = spark.createDataFrame([(1, 7, "a"), (2, 7, 'b "ü"')], "seq long, user_id long, event_type string")
    hooks = spark.createDataFrame([(k, 7, "*", True) for k in range(1, 7)], "webhook_id long, user_id long, events string, is_active boolean")
    kept = spark.createDataFrame(list(secrets.items()), "webhook_id long, secret string")
    one = events.webhook_outbox(events.match_webhooks(e, hooks), kept)
    two = events.webhook_outbox(events.match_webhooks(e, events.with_pads(hooks, kept), events.PADS))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    for r in two.collect():
        assert r.signature == hmac.new((secrets[r.webhook_id] or "").encode(), r.body.encode(), hashlib.sha256).hexdigest()
    assert two.count() == 10
    # the last join is that of the pairs, by blocks; secrets are with the webhooks before it
    steps = registry.QUERIES["s7_webhook_outbox"](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [x for x in steps if "Join" in x]
    assert "SortMergeJoin" in joins[0] and "_r#" in joins[0]
    assert not [x for x in joins if "BroadcastHashJoin" in x and "LeftOuter" not in x]


def test_relevance_is_rounded_as_the_double(spark):
    m = spark.createDataFrame([(1, "k", "x")], "id long, memory_key string, content string")
    got = lambda x: retrieval.results_as_text(spark.createDataFrame([(1, 1, 1, x)], "query_id long, rank int, id long, final_score double"), m).first().text
    assert [got(x) for x in (0.125, 0.375, 0.615)] == [f"- [k] x (relevance={x:.2f})" for x in (0.125, 0.375, 0.615)]


def test_equal_vectors_only(spark):
    rows = [(1, k, [1.0, k // 3 * 1e-4], "active") for k in range(6)] + [(1, 9, None, "active"), (2, 10, [1.0, 0.0], "active"), (1, 11, [1.0, 0.0], "stale")]
    m = spark.createDataFrame(rows, "user_id long, id long, embedding array<double>, status string")
    assert sorted(map(tuple, vectors.equal_vectors(m).collect())) == [(1, 0, 1), (1, 0, 2), (1, 3, 4), (1, 3, 5)]


def test_sign_codes_part_vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("vec_id") * 0).alias("user_id"), F.col("vec_id").alias("_v"), F.col("embedding").alias("e"))
    codes = vectors.sign_codes(e, 0.92, 500)
    tables, n = codes.agg(F.max("_table")).first()[0] + 1, e.count()
    assert codes.count() == n * tables
    met = codes.groupBy("_table", "_code").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    # of all pairs few meet in a table
    assert met / tables < 0.02 * n * (n - 1) / 2


def test_shapes_are_read_in_one_pass(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": [1]}'), (2, "no"), (3, '{"a": 2}')], "id long, m string")
    got = filters.metadata_matches(df, "m", {"x": {"a": 1}, "y": {"b": [1]}, "z": {"a": 2}}, "shape")
    assert sorted((r.id, r["shape"]) for r in got.collect()) == [(1, "x"), (1, "y"), (3, "z")]
    assert plan(got).count("LogicalRDD") + plan(got).count("LocalRelation") == 1


def test_payloads_over_several_slices(spark):
    rows = [(k, None if k == 5 else "[1]" if k == 6 else json.dumps({"t": f"mail a{k}@b.org", "n": k})) for k in range(3 * masking.SLICE + 1)]
    got = masking.mask_payload(spark.createDataFrame(rows, "id long, p string").coalesce(1), "p").orderBy("id").collect()
    assert [r.p for r in got] == [None if k == 5 else "[1]" if k == 6 else json.dumps({"t": "mail [EMAIL]", "n": k}) for k in range(len(rows))]


def test_memories_without_vectors_join_nothing(spark, sf):
    m = views.memories(spark, sf, embedding=False)
    assert m.columns == views.memories(spark, sf).columns[:-1] and "Join" not in plan(m)
