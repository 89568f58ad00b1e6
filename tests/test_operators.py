import json
import math
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark.functions import masking, scoring
from memspark.functions.facts import extract_facts
from memspark.operators import events, graph, maintenance, retrieval, tasks, threads, upsert, vectors
from memspark.sources import portability, schemas, tables, views
from memspark.sources.schemas import TRANSITIONS
from memspark.streaming import streams


def at(text):
    return F.lit(text).cast("timestamp")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scores(spark):
    r = one(
        spark,
        scoring.recency(at("2024-01-01"), at("2024-01-04")).alias("half"),
        scoring.recency(at("2024-01-05"), at("2024-01-04")).alias("future"),
        scoring.authority(F.lit(9)).alias("high"),
        scoring.authority(F.lit(0)).alias("low"),
        scoring.final_score(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("ones"),
        scoring.final_score(F.lit(-0.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("clamped"),
        scoring.keyword_ratio(F.lit("Some Red apples"), F.lit("red green")).alias("words"),
        scoring.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        scoring.tag(F.lit("Very Long Text With Many Words")).alias("tag"),
    )
    assert r.half == pytest.approx(0.5) and r.future == 1 and r.high == 1 and r.low == 0.25
    assert r.ones == pytest.approx(1.0) and r.clamped == pytest.approx(0.1)
    assert r.words == 0.5 and r.zero == 0 and r.tag == "very_long_text_with_"


def test_upsert_equals_a_loop(spark):
    random.seed(1)
    state = [(u, f"k{k}", 0, "c0", datetime(2024, 1, 1), 3) for u in range(3) for k in range(3)]
    writes = [(random.randrange(4), f"k{random.randrange(4)}", n, random.choice(["c0", "c1", "c2"]), datetime(2024, 1, 2, n // 60, n % 60)) for n in range(200)]
    known = {(u, k): [c, v, t] for u, k, _, c, t, v in state}
    snapshots, actions = [], []
    for u, k, n, c, t in writes:
        if (u, k) not in known:
            known[u, k] = [c, 1, t]
            actions.append((n, "created"))
        elif known[u, k][0] == c:
            known[u, k][2] = t
            actions.append((n, "skip_identical"))
        else:
            snapshots.append((u, k, known[u, k][1], known[u, k][0]))
            known[u, k] = [c, known[u, k][1] + 1, t]
            actions.append((n, "updated"))
    s = spark.createDataFrame(state, "user_id long, memory_key string, seq long, content string, written_at timestamp, version int").drop("seq")
    w = spark.createDataFrame(writes, "user_id long, memory_key string, seq long, content string, written_at timestamp")
    new, old, did = upsert.upsert(s, w, ["user_id", "memory_key"])
    assert sorted((r.user_id, r.memory_key, r.content, r.version, r.updated_at) for r in new.collect()) == sorted((u, k, *v) for (u, k), v in known.items())
    assert sorted((r.user_id, r.memory_key, r.version, r.content) for r in old.collect()) == sorted(snapshots)
    assert sorted((r.seq, r.action) for r in did.collect()) == actions


def test_a_null_project_is_a_key(spark):
    w = spark.createDataFrame([(1, "k", "user", None, 1, "a"), (1, "k", "user", 5, 2, "b"), (1, "k", "user", None, 3, "a")], "user_id long, memory_key string, scope string, project_id long, seq long, content string")
    new, _, did = upsert.upsert(None, w.withColumn("written_at", at("2024-01-01")), upsert.SERVER_KEY)
    assert new.count() == 2
    assert {r.seq: r.action for r in did.collect()} == {1: "created", 2: "created", 3: "skip_identical"}


def test_transitions_equal_a_loop(spark):
    random.seed(2)
    asked = [(random.randrange(5), n, random.choice([*TRANSITIONS, "bogus"])) for n in range(300)]
    state, want = dict.fromkeys(range(5), "pending"), []
    for t, n, to in asked:
        ok = to in TRANSITIONS[state[t]]
        want.append((t, n, state[t], to, ok))
        state[t] = to if ok else state[t]
    new, log = tasks.apply_transitions(spark.createDataFrame(list(dict.fromkeys(range(5), "pending").items()), "task_id long, state string"), spark.createDataFrame(asked, "task_id long, seq long, to_state string"))
    assert sorted(map(tuple, log.select("task_id", "seq", "from_state", "to_state", "accepted").collect())) == sorted(want)
    assert dict(map(tuple, new.collect())) == state


@pytest.mark.parametrize(
    "text,masked,patterns",
    [
        ("mail a.b@c.org now", "mail [EMAIL] now", ["email"]),
        ("ssn 123-45-6789", "ssn [SSN]", ["ssn"]),
        ("card 4111 1111 1111 1111.", "card [CREDIT_CARD].", ["credit_card"]),
        ("at 10.0.0.255", "at [IP_ADDRESS]", ["ip_address"]),
        ("born on 1/2/1990", "[DOB]", ["date_of_birth"]),
        ("a@b.co,c@d.co", "[EMAIL],[EMAIL]", ["email", "email"]),
        ("é nothing", "é nothing", []),
        ("", "", []),
    ],
)
def test_masking(text, masked, patterns):
    got, found = masking.masker(masking.SERVER)(text)
    assert got == masked and [f[0] for f in found] == patterns


def test_masking_in_spark(spark):
    df = spark.createDataFrame([(1, "call (555) 123-4567"), (2, None), (3, "x")], "id long, text string")
    rows = {r.id: r for r in masking.mask(df, "text").collect()}
    assert rows[1].text == "call [PHONE]" and rows[2].text is None and rows[3].detections == []
    assert masking.custom('[{"name": "tick", "regex": "T-\\\\d+"}, {"name": "bad", "regex": "("}]') == {"tick": (r"T-\d+", "[TICK]")}
    assert masking.custom("no json") == {}
    payload = masking.mask_payload(spark.createDataFrame([('{"a": "x@y.org", "b": 1}',), ("[1]",), (None,)], "p string"), "p").collect()
    assert [r.p for r in payload] == ['{"a": "[EMAIL]", "b": 1}', "[1]", None]


def test_facts(spark):
    df = spark.createDataFrame([(1, "I like green tea. My favourite color is blue!"), (2, "I'm learning Rust, and I live in Rome."), (3, None)], "id long, content string")
    got = {(r.id, r.memory_key): r.content for r in extract_facts(df).collect()}
    assert got[1, "pref:green_tea"] == "The user likes/prefers: green tea"
    assert got[1, "pref:color"] == "The user likes/prefers: blue"
    assert got[2, "goal:learning"] == "User goal: Rust" and got[2, "identity:location"] == "User info — location: Rome"
    assert not any(i == 3 for i, _ in got)


def test_graph(spark):
    links = spark.createDataFrame([(1, 2, "supports"), (2, 3, "supports"), (5, 4, "related_to"), (3, 3, "supports")], "source_id long, target_id long, link_type string")
    mem = spark.createDataFrame([(n, "active") for n in range(1, 6)], "id long, status string")
    seeds = spark.createDataFrame([(1,)], "seed long")
    assert sorted((r.node, r.depth) for r in graph.expand(mem, links, seeds, 2).collect()) == [(2, 1), (3, 2)]
    assert [r.node for r in graph.expand(mem, links, seeds, 2, max_nodes=1).collect()] == [2]
    assert graph.expand(mem, links, seeds, 2, link_types=["related_to"]).count() == 0
    paths = graph.shortest_paths(links, spark.createDataFrame([(1, 3), (1, 5), (2, 2)], "source long, target long"), 4).collect()
    assert {(r.source, r.target): r.path for r in paths} == {(1, 3): [1, 2, 3], (2, 2): [2]}
    assert {r.node: r.component for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_ann_recall(spark, sf):
    e = tables.table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    centroids, lists = vectors.build_ivf(e, "vec_id", "embedding", 16)
    found = {(r.query_id, r.vec_id) for r in vectors.ann_search(centroids, lists, q, "vec_id", 10, 12).collect()}
    exact = {(r.query_id, r.vec_id) for r in vectors.ann_search(centroids, lists, q, "vec_id", 10, 16).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_embedding(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "text string")
    v = df.select(scoring.hash_embedding(F.col("text"), 8).alias("v")).where("text is not null").collect()
    assert all(math.isclose(sum(x * x for x in r.v), 1, rel_tol=1e-5) for r in v)
    got = vectors.embed(df, "text", lambda texts: [[float(len(t))] for t in texts]).collect()
    assert sum(r.embedding == [1.0] for r in got) == 3 and len(got) == 4


def test_chat_history(spark):
    rows = [("chat:9:msg:0001", '{"role": "ai", "content": "hi"}'), ("chat:9:msg:0002", "plain"), ("other", "x")]
    got = threads.chat_history(spark.createDataFrame(rows, "memory_key string, content string")).collect()
    assert sorted((r.memory_key[-1], r.role, r.content) for r in got) == [("1", "ai", "hi"), ("2", "human", "plain")]


def test_signature(spark):
    matched = spark.createDataFrame([(1, "memory.created", 7)], "webhook_id long, event_type string, id long")
    out = events.webhook_outbox(matched, spark.createDataFrame([(1, "s")], "webhook_id long, secret string")).first()
    assert re.fullmatch("[0-9a-f]{64}", out.signature) and out.body == '{"event_type":"memory.created","id":7}'


def test_outbox_has_all_changes(spark):
    from memspark.plans import registry
    from memspark.sources import views

    sf, want, last = "/root/testdata/sf0.001", [], {}
    hooks = [r for r in views.webhooks(spark, sf).collect() if r.is_active]
    for w in sorted(views.memory_writes(spark, sf).collect(), key=lambda w: w.seq):
        key = w.user_id, w.memory_key
        kind = "memory.updated" if key in last else "memory.created"
        if last.get(key) != w.content:
            for h in hooks:
                if h.user_id == w.user_id and (h.events == "*" or kind in h.events.split(", ")):
                    want.append((w.seq, kind, h.webhook_id))
        last[key] = w.content
    got = registry.QUERIES["s7_webhook_outbox"](spark, sf).collect()
    assert sorted((json.loads(r.body)["seq"], r.event_type, r.webhook_id) for r in got) == sorted(want)
    assert any(seq % 20 for seq, _, _ in want)


def test_export_round_trip(spark, tmp_path):
    cols = "id long, user_id long, memory_key string, memory_type string, scope string, content string, status string, authority_level long, confidence double, importance_score double, version int, project_id long"
    mem = spark.createDataFrame([(1, 1, "a", "semantic", "user", "x", "active", 1, 0.5, 0.5, 1, None), (2, 1, "b", "semantic", "user", "y", "active", 1, 0.5, 0.5, 1, None)], cols)
    mem = mem.withColumns({"created_at": at("2024-01-01"), "updated_at": at("2024-01-01"), "content_hash": F.sha2("content", 256)})
    links = spark.createDataFrame([(1, 2, "supports")], "source_id long, target_id long, link_type string")
    versions = spark.createDataFrame([(1, 1, "w"), (1, 2, "v")], "memory_id long, version int, content string")
    portability.write_export(portability.export_records(mem, links, at("2024-02-01"), versions), str(tmp_path / "x"))
    lines = portability.read_export(spark, str(tmp_path / "x")).unionByName(spark.createDataFrame([("no json",)], "value string"))
    back, old, edges, bad = portability.parse_records(lines)
    assert back.count() == 2 and edges.count() == 1 and bad.count() == 1
    assert [(r.memory_id, r.version, r.content) for r in old.orderBy("version").collect()] == [(1, 1, "w"), (1, 2, "v")]
    for strategy, want in (("skip_existing", (0, 2, 0)), ("upsert", (2, 0, 0)), ("overwrite", (0, 2, 0))):
        new, counts = portability.import_memories(back.select("user_id", "memory_key", "content"), mem, strategy, at("2024-02-02"))
        assert tuple(counts.first()) == want and new.count() == 2


def test_schemas_and_append(spark, tmp_path):
    df = tables.conform(spark.createDataFrame([(1,)], "task_id long"), schemas.TASKS, state="pending")
    for _ in range(2):
        tables.append(df, str(tmp_path / "t"), "state")
    got = tables.scan(spark, str(tmp_path / "t"), schemas.TASKS)
    assert got.count() == 2 and got.first().state == "pending"


def test_streams_equal_batches(spark, sf, tmp_path):
    e = tables.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"), F.lit("x").alias("content"), F.lit(1).alias("run_id"), F.lit(1).alias("sequence_number"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    counts = run(streams.stream_event_counts(stream()), "counts", "complete")
    want = streams.stream_event_counts(e)
    assert sorted(map(str, counts.collect())) == sorted(map(str, want.collect()))
    relabelled = stream().withColumn("event_type", F.lit("user_input"))
    seen = run(streams.stream_observations(relabelled), "seen", "append")
    assert seen.count() == e.count()


def test_stream_memories_upserts(spark, tmp_path):
    schema = "event_id long, run_id long, user_id long, event_type string, content string, sequence_number int, created_at timestamp"
    hour = lambda k: datetime(2024, 1, 1, k)
    batches = [
        [(1, 7, 1, "user_input", "a", 1, hour(1)), (2, 7, 1, "user_input", "b", 2, hour(2)), (3, 8, 1, "user_input", "c", 1, hour(3))],
        [(4, 7, 1, "user_input", "b", 3, hour(4)), (5, 8, 1, "user_input", "d", 2, hour(5)), (6, 9, 2, "user_input", "e", 1, hour(6))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.stream_memories(streams.stream_observations(stream), str(tmp_path / "mem"), str(tmp_path / "ck")).awaitTermination()
    got = {r.memory_key: (r.content, r.version, r.created_at.hour, r.updated_at.hour) for r in streams.kept_memories(spark, str(tmp_path / "mem")).collect()}
    assert got == {"obs:7": ("b", 2, 1, 4), "obs:8": ("d", 2, 3, 5), "obs:9": ("e", 1, 6, 6)}
    old = {(r.memory_key, r.version, r.content) for r in spark.read.parquet(str(tmp_path / "mem" / "versions")).collect()}
    assert old == {("obs:7", 1, "a"), ("obs:8", 1, "c")}


def test_maintenance_in_a_row(spark, sf):
    m = views.memories(spark, sf)
    new, log = maintenance.maintain(m, views.access_log(spark, sf), views.as_of(), 15)
    assert new.columns == m.columns and new.count() == m.count()
    assert log.count() + maintenance.run_maintenance(m, views.access_log(spark, sf), views.as_of(), 15).where("job = 'prune_access'").first().affected == views.access_log(spark, sf).count()
    active = new.where("status = 'active'")
    assert active.where(maintenance.stale_test(views.as_of(), 15) | maintenance.invalid_test(views.as_of())).count() == 0
    assert active.groupBy("user_id", "content_hash").count().where("count > 1").count() == 0


def test_search_without_results_has_a_header(spark):
    q = spark.createDataFrame([(1, 1, None), (2, 2, [0.5])], "query_id long, user_id long, query_embedding array<double>")
    found = spark.createDataFrame([(1, 1, 1, 10, 0.5, 3)], "query_id long, user_id long, rank int, id long, final_score double, candidates long")
    logs, items = retrieval.retrieval_audit(found, q)
    assert sorted(map(tuple, logs.collect())) == [(1, 1, "metadata_only", 3, 1), (2, 2, "hybrid_vector", 0, 0)] and items.count() == 1


def test_stream_transitions(spark, tmp_path):
    asked = [(1, 1, "in_progress"), (1, 2, "pending"), (1, 3, "completed"), (2, 4, "completed")]
    df = spark.createDataFrame(asked, "task_id long, seq long, to_state string")
    df.write.parquet(str(tmp_path / "in"))
    out = streams.stream_transitions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.task_id, r.seq, r.accepted) for r in spark.table("moves").collect()) == [(1, 1, True), (1, 2, False), (1, 3, True), (2, 4, False)]
