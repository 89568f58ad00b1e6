"""Scoring in blocks against plain joins."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memspark.functions import scoring
from memspark.operators import blocks, retrieval
from memspark.plans import registry
from memspark.sources import views

V = [[1.0, 0.0], [0.6, 0.8], [0.6, 0.8], [0.0, 0.0], None, [1.0], [-1.0, 0.1], [None, 1.0], [float("nan"), 1.0], [1e200, 1e200], []]


def made(spark, n, name):
    rows = [(k % 2, k, V[k % len(V)] if k < 40 else [float(k % 5), float(k % 3 - 1)]) for k in range(n)]
    return spark.createDataFrame(rows, f"user_id long, {name} long, _vector array<double>")


def test_nearest_is_the_join(spark):
    rows, q = made(spark, 90, "id"), made(spark, 30, "query_id").where("_vector is not null").withColumn("_limit", (F.col("query_id") % 4 + 1).cast("int"))
    v, w = F.col("_vector"), F.col("_w")
    every = rows.join(q.withColumnRenamed("_vector", "_w"), "user_id").withColumn("score", scoring.cosine(v, w))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    plan = lambda df: [tuple(map(str, r)) for r in df.withColumn("n", F.row_number().over(order)).where("n <= _limit").select("query_id", "n", "id", "score").orderBy("query_id", "n").collect()]
    got = blocks.nearest(rows, q, "user_id", "id", n_rows=13, n_queries=4).join(q.select("query_id", "_limit"), "query_id")
    assert plan(got) == plan(every)


def test_blocks_leave_few_rows_of_each_query(spark):
    rows, q = made(spark, 90, "id"), made(spark, 30, "query_id").where("query_id < 2").withColumn("_limit", F.lit(1))
    # a pair of every row and query is never made: at most _limit rows a block
    assert blocks.nearest(rows, q, "user_id", "id").count() == 2


def test_floor_leaves_the_nearest(spark):
    random = np.random.default_rng(1)
    s = random.integers(-60, 60, (40, 3_000)).astype(np.float32)
    s[:5], s[5:9, :2_990], s[9, 256::256] = -np.inf, -np.inf, 99
    for width, n in ((3_000, 1), (3_000, 10), (3_000, 200), (2_999, 128), (600, 7), (300, 10), (5, 5)):
        bound, exact = blocks.floor(s[:, :width], n), np.sort(s[:, :width], axis=1)[:, width - n]
        assert (bound <= exact).all() and ((s[:, :width] >= bound[:, None]).sum(axis=1) >= n).all()


def test_nearest_of_wide_blocks_is_the_join(spark):
    rows = made(spark, 3_000, "id").withColumn("_vector", F.when(F.col("id") >= 40, F.array(F.sin("id"), F.cos(F.col("id") * 7))).otherwise(F.col("_vector")))
    q = made(spark, 30, "query_id").where("_vector is not null").withColumn("_limit", (F.col("query_id") % 4 + 1).cast("int"))
    every = rows.join(q.withColumnRenamed("_vector", "_w"), "user_id").withColumn("score", scoring.cosine(F.col("_vector"), F.col("_w")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    plan = lambda df: [tuple(map(str, r)) for r in df.withColumn("n", F.row_number().over(order)).where("n <= _limit").select("query_id", "n", "id", "score").orderBy("query_id", "n").collect()]
    got = blocks.nearest(rows, q, "user_id", "id").join(q.select("query_id", "_limit"), "query_id")
    assert plan(got) == plan(every)


def test_rows_are_sent_once_to_some_thousand_queries(spark):
    rows, q = spark.range(10).selectExpr("0L as k", "id"), spark.range(6_000).selectExpr("0L as k", "id as query_id")
    count = lambda left, right: pa.table({"n": pa.array([len(left)], pa.int64())})
    assert blocks.blocked(rows, q, "k", "id", "query_id", count, StructType.fromDDL("n long")).agg(F.sum("n")).first()[0] == 10


def test_similar_is_the_join(spark):
    rows = made(spark, 90, "id")
    a, b = (rows.select("user_id", F.col("id").alias(n), F.col("_vector").alias("v" + n)) for n in "ab")
    want = a.join(b, "user_id").where("a <= b").withColumn("score", scoring.cosine(F.col("va"), F.col("vb"))).where("score >= 0.9")
    keys = lambda df: sorted(tuple(map(str, r)) for r in df.select("user_id", "a", "b", "score").collect())
    assert keys(blocks.similar(rows, "user_id", "id", 0.9, n_rows=11)) == keys(want) != []


def test_worded_is_the_join(spark):
    texts = ["red apples", "green\tpear", "", "apple pie red", "größe", "red\nred green"]
    rows = spark.createDataFrame([(k % 2, k, texts[k % 6]) for k in range(40)], "user_id long, id long, _text string")
    asked = [["red", "green"], ["apple"], ["e p", "red", "red"], [], ["öß", "none"]]
    q = spark.createDataFrame([(k % 2, k, asked[k % 5]) for k in range(10)], "user_id long, query_id long, _words array<string>")
    score = F.size(F.filter("_words", lambda w: F.col("_text").contains(w))) / F.greatest(F.size("_words"), F.lit(1))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    plan = lambda df: sorted(map(tuple, df.where("score > 0").withColumn("n", F.row_number().over(order)).where("n <= 3").select("query_id", "id", "score", "n").collect()))
    assert plan(blocks.worded(rows, q, "user_id", "id", 3, n_rows=7, n_queries=2)) == plan(rows.join(q, "user_id").withColumn("score", score)) != []


def test_full_text_sends_the_words_to_the_texts(spark, sf, monkeypatch):
    m = views.memories(spark, sf, embedding=False)
    q = spark.createDataFrame([(k, k, "und der the of", [1.0] * 64, 5) for k in range(8)], "query_id long, user_id long, query_text string, query_embedding array<float>, top_k int")
    seen, settled = [], retrieval.settled
    monkeypatch.setattr(retrieval, "settled", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()) or settled(df))
    monkeypatch.setattr(registry, "_with_text", lambda s, d: q)
    monkeypatch.setattr(views, "queries", lambda s, d: q)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        registry.v9_fused_search(spark, sf)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # tokens of texts are filtered before any shuffle, and the texts aren't joined with vectors
    read = [plan for plan in seen if "Generate explode" in plan and "content" in plan]
    assert read and all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "embedding" not in plan for plan in read)
    few, many = (sorted(map(tuple, retrieval.fulltext_hits(m, q, lookup).collect())) for lookup in (0, 500_000))
    assert few == many != []


def test_memories_of_equal_words_tie(spark):
    words = [f"w{k}" for k in range(9)]
    rows = [(1, n, " ".join(words[(k + n) % 9] for k in range(9)), "active") for n in range(300)]
    rows += [(1, 1000 + k, " ".join(words[:k]), "active") for k in range(9)]
    m = spark.createDataFrame(rows, "user_id long, id long, content string, status string").repartition(7, "id")
    q = spark.createDataFrame([(1, 1, " ".join(words))], "query_id long, user_id long, query_text string")
    assert retrieval.fulltext_hits(m, q).where("id < 300").select("_text").distinct().count() == 1
