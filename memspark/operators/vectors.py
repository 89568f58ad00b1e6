"""Approximate search, near-duplicate vectors, embedding."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scoring
from .blocks import Vectors, nearest, similar


def unit(vector):
    """The vector scaled to length 1, in double; null for a vector of zeros."""
    n = scoring.norm(vector)
    return F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n))


def build_ivf(vectors: DataFrame, ident: str, column: str, n_lists: int, seed: int = 1, copies: int = 1, sample: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(centroids: list_id, centroid; lists: list_id, ident, u): a coarse quantiser of unit vectors,
    fitted on about `sample` of them, and every vector in the lists of its `copies` nearest centroids
    (V7).  More than one copy finds more where vectors have no clusters."""
    rows = vectors.select(ident, unit(F.col(column)).alias("u")).where("u is not null")
    n = rows.count()
    part = rows if n <= sample else rows.where(F.pmod(F.xxhash64(ident), F.lit(1_000_000)) < 1_000_000 * sample // n)
    model = KMeans(k=n_lists, seed=seed, maxIter=10).fit(part.select(array_to_vector("u").alias("features")))
    spark = vectors.sparkSession
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    centroids = spark.createDataFrame(list(enumerate(centers)), "list_id int, centroid array<double>")
    # n_lists centroids as one literal row, so a vector's nearest are found without a join
    every = F.array(*(F.struct(F.lit(k).alias("list_id"), F.array(*map(F.lit, c)).alias("c")) for k, c in enumerate(centers)))
    near = F.slice(F.sort_array(F.transform(every, lambda x: F.struct((-scoring.dot(F.col("u"), x["c"])).alias("d"), x["list_id"].alias("list_id")))), 1, copies)
    return centroids, rows.select(F.explode(F.transform(near, lambda x: x["list_id"])).alias("list_id"), ident, "u")


def write_lists(lists: DataFrame, path: str) -> DataFrame:
    """The lists as a table partitioned by list_id, so that a probe reads its lists' folders only (V7)."""
    lists.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)
    return lists.sparkSession.read.parquet(path)


def ann_search(centroids: DataFrame, lists: DataFrame, queries: DataFrame, ident: str, k: int, n_probe: int) -> DataFrame:
    """The k most similar of each query's n_probe nearest lists (V7): query_id, rank, ident, score.
    The centroids, and the ids of the lists that some query probes, are n_lists rows at most, a
    parameter, and are broadcast; with lists of write_lists the latter prune the folders that are read."""
    q = queries.select("query_id", unit(F.col("query_embedding")).alias("q")).where("q is not null")
    near = q.join(F.broadcast(centroids)).withColumn("_s", scoring.dot(F.col("q"), F.col("centroid")))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "list_id"))).where(F.col("_n") <= n_probe).select("query_id", "q", "list_id")
    probed = near.select(F.col("list_id").alias("_probed")).distinct()
    read = lists.join(F.broadcast(probed), F.col("list_id") == F.col("_probed"), "left_semi")
    # in blocks of a list, of which each query keeps k; copies in several lists are one
    asked = near.select("query_id", "list_id", F.col("q").alias("_vector"), F.lit(k).alias("_limit"))
    scored = nearest(read.select("list_id", ident, F.col("u").alias("_vector")), asked, "list_id", ident).select("query_id", ident, "score").distinct()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), ident))).where(F.col("rank") <= k).select("query_id", "rank", ident, "score")


def sign_codes(groups: DataFrame, threshold: float, most: int, recall: float = 0.995, seed: int = 3) -> DataFrame:
    """user_id, _v, _table, _code of vectors (e): signs of random projections, with so many bits that of
    `most` vectors few meet by chance, and so many tables that pairs at the threshold meet in one of
    them with a probability of `recall`."""
    bits = min(30, max(8, math.ceil(math.log2(most)) + 1))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    tables = 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))

    def run(batches):
        for batch in batches:
            v = Vectors(batch.column(2))
            planes = np.random.default_rng(seed).standard_normal((v.rows.shape[1], tables * bits)).astype(np.float32)
            signs = (v.unit @ planes >= 0).reshape(-1, tables, bits)
            codes = signs @ (1 << np.arange(bits, dtype=np.int64))
            take = pa.array(np.repeat(np.arange(len(codes)), tables))
            table = pa.array(np.tile(np.arange(tables, dtype=np.int32), len(codes)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), table, pa.array(codes.ravel())], ["user_id", "_v", "_table", "_code"])

    schema = StructType([groups.schema["user_id"], *StructType.fromDDL("_v long, _table int, _code long")])
    return groups.select("user_id", "_v", "e").mapInArrow(run, schema)


def equal_vectors(mem: DataFrame) -> DataFrame:
    """Pairs (user_id, id_a, id_b) that join all of a user's active memories of one vector: the least id
    with each other one."""
    rows = mem.where("status = 'active' and embedding is not null").select("user_id", "id", "embedding")
    least = rows.groupBy("user_id", "embedding").agg(F.min("id").alias("id_a"))
    return rows.withColumnRenamed("id", "id_b").join(least, ["user_id", "embedding"]).where("id_a < id_b").select("user_id", "id_a", "id_b")


def near_duplicates(mem: DataFrame, threshold: float = 0.92, method: str = "exact") -> DataFrame:
    """Pairs of one user's active memories of cosine >= threshold (V8): user_id, id_a < id_b, score.

    Memories of a user that share a vector form a group; groups are compared once, and their members
    paired afterwards, so exact work is per distinct vector.  method 'lsh': signs of random projections
    find the pairs of groups, which are verified; for large users, at a recall below one."""
    rows = mem.where("status = 'active' and embedding is not null").select("user_id", "id", "embedding", F.xxhash64("embedding").alias("_v"))
    groups = rows.groupBy("user_id", "_v").agg(F.any_value("embedding").alias("e")).withColumn("n", scoring.norm(F.col("e"))).where("n > 0")
    a, b = (groups.select("user_id", *(F.col(c).alias(f"{c}_{s}") for c in ("_v", "e", "n"))) for s in "ab")
    if method == "lsh":
        hashed = sign_codes(groups.select("user_id", "_v", "e"), threshold, groups.groupBy("user_id").count().agg(F.max("count")).first()[0] or 1)
        # the user is part of the key, so no bucket holds rows of several
        key = ["user_id", "_table", "_code"]
        met = hashed.withColumnRenamed("_v", "_v_a").join(hashed.withColumnRenamed("_v", "_v_b"), key).where("_v_a < _v_b").select("user_id", "_v_a", "_v_b").distinct()
        met = met.unionByName(groups.select("user_id", F.col("_v").alias("_v_a"), F.col("_v").alias("_v_b")))
        pairs = met.join(a, ["user_id", "_v_a"]).join(b, ["user_id", "_v_b"])
        score = scoring.cosine(F.col("e_a"), F.col("e_b"), F.col("n_a"), F.col("n_b"))
        pairs = pairs.withColumn("score", score).where(F.col("score") >= threshold - 1e-12).select("user_id", "_v_a", "_v_b", "score")
    else:
        found = similar(groups.select("user_id", F.col("_v").alias("_id"), F.col("e").alias("_vector")), "user_id", "_id", threshold - 1e-12)
        pairs = found.select("user_id", F.col("a").alias("_v_a"), F.col("b").alias("_v_b"), "score")
    ids = rows.select("user_id", "id", "_v")
    left = pairs.join(ids.select("user_id", F.col("id").alias("x"), F.col("_v").alias("_v_a")), ["user_id", "_v_a"])
    both = left.join(ids.select("user_id", F.col("id").alias("y"), F.col("_v").alias("_v_b")), ["user_id", "_v_b"]).where("x < y or (_v_a <> _v_b and x <> y)")
    return both.select("user_id", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "score")


def embed(df: DataFrame, column: str, fn: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """df with `embedding`, the vectors that fn gives for batches of texts; each distinct text is
    embedded once (E1).  Null has none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fn(texts.tolist()), dtype=object)

    texts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_t")).distinct().repartition("_t").withColumn("embedding", run("_t"))
    return df.join(texts, F.col(column) == F.col("_t"), "left").drop("_t")


