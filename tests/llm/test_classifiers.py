import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import langid, queries, toxicity


def test_folds(spark):
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", langid.in_fold(3, 1).alias("in")).collect():
        assert r["in"] == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_held_out(spark, sf):
    said = queries.op10_langid(spark, sf)
    both = said.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.where("lang = lang_pred").count() >= 0.98 * both.count()
    assert said.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    rows = [("the cat and the dog are here today " * 3, "en"), ("le chat et le chien sont ici ce jour " * 3, "fr")] * 8 + [(None, "en"), ("x", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), per_language=50)
    assert model.languages == ["en", "fr"]
    odd = [(1, None), (2, ""), (3, "123 !?"), (None, "the dog and the cat"), (5, "le chien et le chat " * 100_000)]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "en" and got[5][0] == "fr"
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, 5}
    none = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_language_of_many_copies(spark):
    rng = np.random.default_rng(4)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(12))
    few = {"aa": [text("abcdefghij") for _ in range(60)], "bb": [text("klmnopqrst") for _ in range(60)]}
    rows = [(t, k) for k, found in few.items() for t in found] + [("a copy of one text", "aa")] * 20_000
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), per_language=20)
    fresh = [(k, text("abcdefghij" if k < 50 else "klmnopqrst")) for k in range(100)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert [got[k] for k in range(100)] == ["aa"] * 50 + ["bb"] * 50


def test_ngrams_of_long_texts():
    text = "Ab cde" * 400
    a, n = langid.ngram_counts(text, 1 << 12)
    b, m = langid.ngram_counts(text, 1 << 12, block=100)
    assert a.tolist() == b.tolist() and n.tolist() == m.tolist() and n.sum() == 3 * len(text) - 3


def test_temperature():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 4000)
    logits = np.eye(3)[y] * 2 + rng.gumbel(size=(4000, 3))
    t = langid.fit_temperature(logits * 5, y)
    assert 2 < t < 8


def test_toxicity_held_out(spark, sf):
    said = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    assert said.where("score < 0 or score > 1 or (score >= 0.3) <> (predicted = 1)").count() == 0
    held = said.where("held_out").toPandas()
    assert held[held.toxic == 1].predicted.mean() >= 0.4 and held[held.toxic == 0].predicted.mean() <= 0.05


def test_toxicity_held_out_of_more_labels(spark):
    where = "/root/testdata/sf0.1"
    held = queries.op2_toxicity(spark, where).join(spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    found, flagged = held[held.toxic == 1].predicted.mean(), held[held.toxic == 0].predicted.mean()
    print("toxic found", found, "others flagged", flagged)
    assert found >= 0.9 and flagged <= 0.02


def test_toxicity_of_repeated_rows(spark):
    rows = [(k % 40, "a calm text of the day" if k % 40 < 20 else "you are a wretched gurnok today") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(k, int(k >= 20)) for k in range(40)], "doc_id long, toxic int"))
    assert {(r.doc_id >= 20, r.predicted) for r in toxicity.score(docs, m).collect()} == {(False, 0), (True, 1)}


def test_toxicity_edges(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows, labels = [], []
    for k in range(400):
        text = rng.choice(words, 40).tolist()
        if k % 4 == 0:
            text[7] = ("zzworstzz", "yybadyy", "xxuglyxx")[k // 4 % 3]
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([*labels, labels[0], (None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labelled)
    fresh = [(1000 + k, " ".join([*rng.choice(words, 30), *(["yybadyy"] if k % 2 else [])])) for k in range(100)]
    odd = [(1, None), (2, ""), (3, "a" * 5000), (None, "x")]
    got = toxicity.score(spark.createDataFrame([*fresh, *odd], "doc_id long, text string"), model).toPandas()
    assert len(got) == 104 and got.score.between(0, 1).all()
    hit = got[got.doc_id >= 1000].set_index("doc_id").predicted
    assert hit[hit.index % 2 == 1].mean() >= 0.9 and hit[hit.index % 2 == 0].mean() <= 0.1
    for one in ([], [(1, 1)], [(1, 0)]):
        m = toxicity.train(docs, spark.createDataFrame(one, "doc_id long, toxic int"))
        assert toxicity.score(docs, m).where("score between 0 and 1").count() == 400


def test_windows():
    assert toxicity.windows("") == [] and toxicity.windows("A  b") == ["a", "b"]
    long = toxicity.windows("x" * 200)
    assert all(len(w) <= toxicity.LONGEST for w in long) and len(long) > 4


@pytest.mark.parametrize("n", [0, 3])
def test_empty_scores(spark, n):
    m = toxicity.fit([], [], 0, n)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), m).count() == 0


def test_gains_of_a_small_cache():
    m = toxicity.fit(["you bad thing %d" % (k % 3) for k in range(40)], ["a fine day %d" % (k % 5) for k in range(90)], 40, 90)
    large, small = (toxicity.Gains(m.ordinary, m.toxic, most=n) for n in (1000, 2))
    for text in ["you bad fine thing", "", "day bad day", "x" * 120 + " bad"] * 2:
        assert large.features(text).tolist() == small.features(text).tolist()
        assert len(small) <= 2 + len(set(toxicity.windows(text)))
