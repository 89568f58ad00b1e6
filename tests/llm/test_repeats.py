import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import repeats


def brute(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + length] = True
    return [(len(t), int(c.sum()), int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()), bytes(np.frombuffer(t, np.uint8)[~c])) for t, c in zip(texts, cover)]


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(5)
    base = [(r.doc_id, r.text[:5000]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(80).collect()]
    passage, short = base[3][1][:700], base[5][1][:230]
    for n in range(1000, 1030):
        t = random.choice(base)[1]
        j, s = random.randrange(max(1, len(t))), random.randrange(500)
        base.append((n, t[:j] + passage[s : random.randrange(s + 150, s + 600)] + t[j:]))
    base += [(1, "a" * 900), (2, "ab" * 300), (3000, ""), (3001, None), (3002, "x" * 199), (3003, "é" * 250), (3004, short + "1" + short + "2" + short)]
    return [*base, (3005, base[0][1]), (3006, base[1][1]), (3006, base[1][1]), (None, "zz" * 150), (3007, passage * 3)]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_equals_brute_force(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(repeats.find_repeats, "__defaults__", (200, hot))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("spans", F.lit(0)).repartition(5)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df).collect())
    want = sorted((-1 if d is None else d, *b) for (d, _), b in zip(rows, brute([(t or "").encode() for _, t in rows], 200)))
    assert got == want


def test_each_string_is_in_one_phrase():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 99, n, np.uint8) for n in (0, 199, 200, 201, 5000)] + [np.full(700, 97, np.uint8)]
    ends = np.cumsum([0, *map(len, texts)])
    text, _, _, at, first, last = repeats.phrases(np.concatenate(texts), ends, 200)
    for k, t in enumerate(texts):
        starts = [i for a, b in zip(first[text == k], last[text == k]) for i in range(a, b + 1)]
        assert sorted(starts) == list(range(len(t) - 199))
    assert (at >= last).all() and (at - first <= 200 - repeats.TRIGGER).all()


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
