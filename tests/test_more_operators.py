"""Facts, VARIANT filters, partitioned lists, counted maintenance, sketches, paths, exports: against
plain Python or the whole tables."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark.functions import facts
from memspark.operators import access, filters, graph, maintenance, retrieval, upsert, vectors
from memspark.sources import portability, tables, views

TEXTS = [
    "My größe is big", "I like\ttea\t.", "I like  tea , and I love x !", "i'm Anna Maria and I AM learning Spark", "I live in Rome\r\nand I work at  Ö ,", "my fav color is  blue ?", "I have a dog.I have an owl!I have x",
    "I want to go\nI like this that", "İ like ſnow. I prefer \x1ccold\x1f.", "I like " + "y" * 101, None, "", "my   naïveté   is\tgreat",
    "I live in Rome, I work at  Ö&Co , I'd like to go home! I'm based in Tōkyō.",
]


def plain_facts(text):
    """The rules with Python's own regular expressions."""
    out = []
    for rule, (pattern, kind, key, confidence) in enumerate(facts.PATTERNS):
        for place, m in enumerate(re.finditer(pattern, text, re.IGNORECASE)):
            groups = m.groups()
            value = groups[-1].strip().rstrip(".,!?")
            if 2 <= len(value) <= 100:
                tag = lambda x: x.lower().replace(" ", "_")[:20]
                name = key.replace("{0}", tag(groups[0].strip())).replace("{tag}", tag(value))
                lead = facts.PREFIXES.get(kind) or f"{'User info' if kind == 'identity' else 'Professional'} — {name.split(':')[1]}: "
                out.append((rule, place, name, lead + value, confidence))
    return out


def test_facts_equal_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    got = sorted((r.id, r.rule, r.place, r.memory_key, r.content, r.confidence) for r in facts.extract_facts(df).collect())
    want = sorted((k, *f) for k, t in enumerate(TEXTS) if t for f in plain_facts(t))
    assert got == want and {r for _, r, *_ in got} >= {0, 1, 2, 4, 5, 6, 7, 8, 9}


def holds(value, wanted):
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and holds(value[k], w) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(holds(v, w) for v in value) for w in wanted)
    if isinstance(wanted, bool) or isinstance(value, bool):
        return value is wanted
    if isinstance(wanted, (int, float)):
        return isinstance(value, (int, float)) and value == wanted
    return type(value) is type(wanted) and value == wanted


def test_metadata_shapes(spark):
    rows = [{"k": 1}, {"k": "1"}, {"k": True}, {"k": 1.0}, {"k": None}, {}, {"k": [1, "a", {"b": 2, "c": [3]}]}, {"k": {"a b": {"c": False}}}, {"k": []}, [1], 1, {"k": {"a b": {"c": "false"}}}, {"k": 2**53 + 1}]
    df = spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate(rows)] + [(99, "no json"), (98, None)], "id int, m string")
    for wanted in ({"k": 1}, {"k": "1"}, {"k": True}, {"k": 1.5}, {"k": 1.0}, {"k": None}, {"k": [1]}, {"k": ["a", {"b": 2}]}, {"k": [{"c": [3]}]}, {"k": {"a b": {"c": False}}}, {"k": []}, {}, {"k": {"a b": {}}}, {"k": 2**53 + 1}):
        got = sorted(r.id for r in filters.metadata_contains(df, "m", wanted).collect())
        assert got == [n for n, r in enumerate(rows) if holds(r, wanted)], wanted


def recall(found, exact):
    return len(found & exact) / len(exact)


def test_lists_are_a_pruned_table(spark, tmp_path):
    """Vectors in clusters: under a fifth of the lists, and of the rows, hold nearly all neighbours."""
    rnd = random.Random(4)
    centers = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(n, [c + rnd.gauss(0, 0.25) for c in centers[n % 40]]) for n in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    centroids, lists = vectors.build_ivf(df, "vec_id", "embedding", 32)
    table = vectors.write_lists(lists, str(tmp_path / "lists"))
    assert table.count() == 4000
    pairs = lambda d: {(r.query_id, r.vec_id) for r in d.collect()}
    exact = pairs(vectors.ann_search(centroids, table, q, "vec_id", 10, 32))
    assert recall(pairs(vectors.ann_search(centroids, table, q, "vec_id", 10, 6)), exact) >= 0.9
    one = vectors.ann_search(centroids, table, q.where("query_id = 0"), "vec_id", 10, 3)
    plan = one._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    one.collect()
    read = re.search(r"numPartitions|number of partitions read", plan)
    assert read or "PartitionFilters: [isnotnull(list_id" in plan


def test_lists_of_vectors_without_clusters(spark, sf):
    e = tables.table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    centroids, lists = vectors.build_ivf(e, "vec_id", "embedding", 64, copies=4)
    pairs = lambda n: {(r.query_id, r.vec_id) for r in vectors.ann_search(centroids, lists, q, "vec_id", 10, n).collect()}
    assert recall(pairs(12), pairs(64)) >= 0.9


def test_fused_search_without_weight_is_hybrid(spark, sf):
    from memspark.plans import registry

    m, q = views.memories(spark, sf), registry._with_text(spark, sf)
    plain = retrieval.hybrid_search(m, q, views.as_of())
    assert sorted(map(tuple, retrieval.hybrid_search(m, q, views.as_of(), w_fulltext=0.0).collect())) == sorted(map(tuple, plain.collect()))
    fused = retrieval.hybrid_search(m, q, views.as_of(), w_fulltext=0.9)
    assert fused.join(plain, ["query_id", "id"], "left_anti").count() > 0


def test_sketches_of_days(spark):
    sf = "/root/testdata/sf0.1"
    log = views.access_log(spark, sf)
    a, b = datetime(2024, 1, 5), datetime(2024, 1, 25)
    got = {r.user_id: r for r in access.window_stats(access.access_sketches(log), F.lit(a), F.lit(b)).collect()}
    want = log.where((F.col("created_at") >= a) & (F.col("created_at") < b)).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("m")).collect()
    assert len(got) == len(want) > 5
    for r in want:
        assert got[r.user_id].total == r.n and abs(got[r.user_id].memories - r.m) <= 0.03 * r.m


def test_counted_maintenance_equals_the_chain(spark, sf, tmp_path):
    m, log = views.memories(spark, sf), views.access_log(spark, sf)
    state, kept, report = maintenance.maintain_counted(m, log, views.as_of(), str(tmp_path), 15)
    want, pruned = maintenance.maintain(m, log, views.as_of(), 15)
    rows = lambda d: sorted(map(str, d.drop("embedding").collect()))
    assert rows(state) == rows(want) and kept.count() == pruned.count() and state.columns == m.columns
    counts = dict(map(tuple, report.collect()))
    assert counts["prune_access"] == log.count() - pruned.count() and counts["recompute_recency"] == want.where("status = 'active'").count()
    assert counts["consolidate"] > 0 and counts["mark_stale"] > 0
    # on its own result the jobs find nothing but recency
    again = dict(map(tuple, maintenance.maintain_counted(state, kept, views.as_of(), str(tmp_path / "again"), 15)[2].collect()))
    assert {j for j, n in again.items() if n} == {"recompute_recency"}


def test_paths_from_both_ends_equal_a_search(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def search(a, b, most):
        level = [[a]]
        for _ in range(most + 1):
            done = [p for p in level if p[-1] == b]
            if done:
                return min(done)
            level = [[*p, x] for p in level for x in near.get(p[-1], ()) if x not in p]
        return None

    pairs = [(rnd.randrange(42), rnd.randrange(42)) for _ in range(60)]
    links = spark.createDataFrame([(a, b, "supports") for a, b in edges], "source_id long, target_id long, link_type string")
    for most in (1, 2, 5):
        got = {(r.source, r.target): r.path for r in graph.shortest_paths(links, spark.createDataFrame(pairs, "source long, target long"), most).collect()}
        assert got == {p: found for p in pairs if (found := search(*p, most))}


def test_walks_name_their_arrival(spark):
    links = spark.createDataFrame([(1, 2, "supports"), (3, 1, "contradicts"), (2, 4, "related_to"), (3, 4, "supports"), (4, 5, "supports"), (2, 3, "supports")], "source_id long, target_id long, link_type string")
    mem = spark.createDataFrame([(n, "active") for n in range(1, 6)], "id long, status string")
    got = {(r.node, r.depth, r.parent, r.link_type, r.direction) for r in graph.expand(mem, links, spark.createDataFrame([(1,)], "seed long"), 3).collect()}
    assert got == {(2, 1, 1, "supports", "outgoing"), (3, 1, 1, "contradicts", "incoming"), (4, 2, 2, "related_to", "outgoing"), (5, 3, 4, "supports", "outgoing")}


def test_export_of_a_large_user(spark, tmp_path):
    """A user of a million memories is many records of bounded size, and none has a folder."""
    n = 1_000_000
    day = F.lit("2024-01-01").cast("timestamp")
    mem = spark.range(n).select("id", F.when(F.col("id") % 1000 == 0, F.col("id")).otherwise(F.lit(1)).alias("user_id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("memory_key"), F.lit("semantic").alias("memory_type"), F.lit("user").alias("scope"), F.lit("c").alias("content"))
    mem = mem.withColumns({"content_hash": F.lit("h"), "status": F.lit("active"), "authority_level": F.lit(1), "confidence": F.lit(0.5), "importance_score": F.lit(0.5), "version": F.lit(1), "created_at": day, "updated_at": day})
    links = spark.createDataFrame([(1, 2, "supports"), (2, 1000, "supports")], "source_id long, target_id long, link_type string")
    records = portability.export_records(mem, links, views.as_of(), size=500)
    portability.write_export(records, str(tmp_path / "x"))
    lines = portability.read_export(spark, str(tmp_path / "x"))
    assert lines.agg(F.max(F.length("value"))).first()[0] < 300_000 and not any("=" in p.name for p in (tmp_path / "x").iterdir())
    back, old, edges, bad = portability.parse_records(lines.unionByName(spark.createDataFrame([("no json",), ("{}",)], "value string")))
    assert back.agg(F.count("*"), F.countDistinct("id"), F.sum("id")).first()[:] == (n, n, n * (n - 1) // 2)
    assert (old.count(), edges.count(), bad.count()) == (0, 2, 2)


@pytest.mark.parametrize("strategy", ["skip_existing", "upsert", "overwrite"])
def test_import_equals_a_loop(spark, strategy):
    at = datetime(2024, 2, 1)
    state = [(1, "a", "user", None, "x", 1, at, at, "semantic", 1, 0.9, 0.9), (1, "b", "user", 5, "y", 1, at, at, "semantic", 1, 0.9, 0.9)]
    entries = [(1, "a", "x", None), (1, "a", "new", "user"), (1, "b", "z", "user"), (1, "b", "z", "user"), (1, "b", "w", "team"), (1, None, "z", None), (2, "a", None, None), (2, "c", "q", None)]
    s = spark.createDataFrame(state, "user_id long, memory_key string, scope string, project_id long, content string, version int, created_at timestamp, updated_at timestamp, memory_type string, authority_level int, confidence double, importance_score double")
    known = {(u, k, sc, p): [c, v] for u, k, sc, p, c, v, *_ in state}
    counts = dict.fromkeys(("imported", "skipped", "errors"), 0)
    for user, key, content, scope in entries:
        full = (user, key, scope or "user", None)
        if key is None or content is None:
            counts["errors"] += 1
        elif strategy == "skip_existing" and full in known:
            counts["skipped"] += 1
        else:
            counts["imported" if strategy != "overwrite" or full not in known else "skipped"] += 1
            if full not in known:
                known[full] = [content, 1]
            elif known[full][0] != content:
                known[full] = [content, known[full][1] + 1]
    new, found = portability.import_memories(spark.createDataFrame(entries, "user_id long, memory_key string, content string, scope string").coalesce(1), s, strategy, F.lit(at))
    assert {(r.user_id, r.memory_key, r.scope, r.project_id): [r.content, r.version] for r in new.collect()} == known
    assert found.first().asDict() == counts


def test_result_records_and_context(spark):
    q = spark.createDataFrame([(1, 7), (2, 7)], "query_id long, user_id long")
    found = spark.createDataFrame([(1, 7, 1, 10, 0.5), (1, 7, 2, 11, 0.25)], "query_id long, user_id long, rank int, id long, final_score double")
    got = sorted((r.query_id, r.place, r.kind, r.memory_id, r.total) for r in retrieval.result_records(found, q).collect())
    assert got == [(1, 1, "result", 10, None), (1, 2, "result", 11, None), (1, 3, "done", None, 2), (2, 1, "done", None, 0)]
    mem = spark.createDataFrame([(10, 7, "a", "x", "semantic", "active"), (11, 7, "b", "y", "working", "stale")], "id long, user_id long, memory_key string, content string, memory_type string, status string")
    messages = spark.createDataFrame([(5, n, "user", f"m{n}") for n in range(6)] + [(6, 0, "user", "z")], "thread_id long, seq long, role string, content string")
    owners = spark.createDataFrame([(5, 7, 1), (6, 8, None)], "thread_id long, user_id long, query_id long")
    w = {r.thread_id: r for r in retrieval.context_window(messages, owners, found, mem, 2).collect()}
    assert [m.content for m in w[5].messages] == ["m4", "m5"] and [(x.rank, x.memory_key, x.score) for x in w[5].memories] == [(1, "a", 0.5), (2, "b", 0.25)]
    assert (w[5].message_count, w[5].memory_count, w[6].memories, w[6].memory_count) == (6, 1, [], 0)


def test_soft_delete_keeps_versions(spark):
    mem = spark.createDataFrame([(1, "active", datetime(2024, 1, 1)), (2, "active", datetime(2024, 1, 1))], "id long, status string, updated_at timestamp")
    versions = spark.createDataFrame([(1, 1), (2, 1)], "memory_id long, version int")
    ids = spark.createDataFrame([(1,)], "id long")
    soft, kept = upsert.delete(mem, versions, ids, True, views.as_of())
    assert {r.id: r.status for r in soft.collect()} == {1: "retracted", 2: "active"} and kept.count() == 2
    hard, left = upsert.delete(mem, versions, ids, False)
    assert hard.count() == 1 and [r.memory_id for r in left.collect()] == [2]
