"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, texts_of, tidy

ORDERS = (1, 2, 3)
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Sparse weights (kept features x languages) of the buckets in `kept`, idf of all buckets."""

    languages: list[str]
    kept: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def ngram_counts(text: str, buckets: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed n-grams of the lower-cased characters of a whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    total = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, max(len(points), 1), block):
        for n in ORDERS:
            part = points[at : at + block + n - 1]
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
            h ^= h >> np.uint32(15)
            total += np.bincount((h * np.uint32(0x85EBCA6B)) >> shift, minlength=buckets)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(value @ value)
    return value / norm if norm else value


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, k: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
    """(weights, bias) of a softmax model by per-coordinate follow-the-regularised-leader with
    elastic-net penalties; the bias (last row) has none."""
    z, n = np.zeros((buckets + 1, k)), np.zeros((buckets + 1, k))

    def solve(zs, ns, free):
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        w[np.abs(zs) <= l1] = 0
        w[free] = -zs[free] / ((beta + np.sqrt(ns[free])) / alpha)
        return w

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, buckets), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = solve(zs, ns, -1)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(ns + g * g)
            z[at] = zs + g - (root - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
    w = solve(z, n, -1)
    return w[:-1], w[-1]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm."""

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean() + 1e-4 * t * t

    a, b, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(texts: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """(documents with each bucket, documents) over all rows of texts.text: each task sums its own
    documents, so what is collected has a fixed size."""

    def run(batches):
        total, n = np.zeros(buckets + 1, np.int64), 0
        for batch in batches:
            for text in texts_of(batch.column(0)):
                total[ngram_counts(text or "", buckets)[0]] += 1
                n += 1
        total[buckets] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "df"])

    rows = texts.select("text").mapInArrow(tidy(run), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(buckets + 1, np.int64)
    for bucket, count in rows:
        df[bucket] = count
    return df[:-1], int(df[-1])


def train(labelled: DataFrame, per_language: int = 1000, buckets: int = 1 << 16) -> LanguageModel:
    """A model from labelled (text string, lang string; other columns are ignored; rows with a null
    are left out).  Document frequencies come from all rows.  The regression is fitted on a bounded
    sample: at most per_language distinct texts of each language, those of smallest hash; a fifth
    of them fits the temperature only.  The languages are listed on the driver."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).na.drop()
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # distinct texts of each language: copies must not shrink its sample
    counts = {r["lang"]: r["n"] for r in hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(buckets), 1.0)
    df, n = document_frequencies(rows, buckets)
    idf = np.log((1 + n) / (1 + df)) + 1
    # about twice as many distinct texts as wanted by a threshold on the hash, then exactly by rank
    share = spark.createDataFrame([(k, min(1.0, 2.0 * per_language / c)) for k, c in counts.items()], "lang string, share double")
    few = hashed.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    one = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")))
    sample = ranked.where(F.col("rank") <= per_language).select("lang", "h", "text")

    def features(batches):
        for batch in batches:
            found = [ngram_counts(t, buckets) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())], ["lang", "h", "at", "n"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        made = fitted(pdf)
        give_back()
        return made

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "lang"]).reset_index(drop=True)
        data = []
        for lang, at, c in zip(pdf["lang"], pdf["at"], pdf["n"]):
            at = np.frombuffer(at, np.int32)
            data.append((at, tfidf(at, np.frombuffer(c, np.int32), idf), languages.index(lang)))
        data = [data[k] for k in np.random.default_rng(7).permutation(len(data))]
        held = data[::5] if len(data) >= 10 else data
        used = [r for k, r in enumerate(data) if k % 5] if len(data) >= 10 else data
        w, bias = fit_ftrl(used, buckets, len(languages))
        logits = np.array([x @ w[at] + bias for at, x, _ in held])
        t = fit_temperature(logits, np.array([y for _, _, y in held]))
        kept = np.flatnonzero(np.any(w, axis=1))
        return pd.DataFrame({"kept": [kept.astype("<i4").tobytes()], "w": [w[kept].astype("<f4").tobytes()], "b": [bias.astype("<f8").tobytes()], "t": [t]})

    vectors = sample.mapInArrow(tidy(features), "lang string, h long, at binary, n binary")
    made = vectors.groupBy().applyInPandas(fit, "kept binary, w binary, b binary, t double").first()
    kept = np.frombuffer(made["kept"], "<i4").astype(np.int64)
    return LanguageModel(languages, kept, np.frombuffer(made["w"], "<f4").reshape(len(kept), len(languages)).astype(float), np.frombuffer(made["b"], "<f8"), idf, float(made["t"]))


class _Judge:
    def __init__(self, model: LanguageModel):
        self.model, self.buckets = model, len(model.idf)
        self.weights = np.zeros((self.buckets, len(model.languages)))
        self.weights[model.kept] = model.weights

    def __call__(self, text: str | None) -> tuple[str, float]:
        m = self.model
        if not text or not m.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, counts = ngram_counts(text, self.buckets)
        p = softmax((tfidf(at, counts, m.idf) @ self.weights[at] + m.bias) / m.temperature)
        k = int(p.argmax())
        return m.languages[k], float(min(1.0, p[k]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text; other columns are ignored).
    A text that is null or has no letter is `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = _Judge(shared.value)
        for batch in batches:
            said = [judge(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text has a predicted language of a score of
    min_score or more; `und` goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches):
        judge = _Judge(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in map(judge, texts_of(batch.column(text_at)))], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def in_fold(modulus: int, fold: int, doc_id: str = "doc_id"):
    """Whether crc32 of the decimal text of doc_id leaves the remainder `fold`; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == fold, F.lit(False))
