"""Jaccard groups, line deduplication and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import components, jaccard, lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def groups(rows, k, percent):
    sets = []
    for _, t in rows:
        x = words(t)
        sets.append({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if len(x) >= k else {tuple(x)} if x else set())
    parent, index = list(range(len(rows))), {}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, s in enumerate(sets):
        met = Counter(j for g in s for j in index.get(g, ()))
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[top(n)] = top(j)
        for g in s:
            index.setdefault(g, []).append(n)
    least = {}
    for n, (d, _) in enumerate(rows):
        least[top(n)] = min(d, least.get(top(n), d))
    return sorted((d, len(sets[n]), least[top(n)]) for n, (d, _) in enumerate(rows))


def edited(rows, n, rate, seed):
    random.seed(seed)
    out = []
    for k in range(n):
        x = random.choice(rows)[1].split(" ")
        for _ in range(random.randrange(0, max(2, len(x) // rate))):
            j = random.randrange(len(x))
            o = random.random()
            if o < 0.5:
                x[j] = f"qq{random.randrange(50)}"
            elif o < 0.75 and len(x) > 1:
                del x[j]
            else:
                x.insert(j, "zz")
        out.append((2000 + k, " ".join(x)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(150).collect()]
    return base


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_groups(spark, rows, k, percent):
    data = rows + edited(rows, 250, 25, 2)
    random.seed(4)
    data += [(5000 + n, " ".join(random.choice("abc") for _ in range(random.randrange(1, 30)))) for n in range(60)]
    data += [(6000, ""), (6001, None), (6002, "  \n"), (6003, "One two"), (6004, "one TWO "), (6005, "É x y")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("a", F.lit(1)).withColumn("n", F.lit(2)).repartition(6)
    got = sorted(tuple(r) for r in jaccard.jaccard_groups(df, k, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == groups(data, k, percent)
    kept = jaccard.one_of_each_group(df, k, percent)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _, c in got if d == c}


def test_groups_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_groups(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_one_id_with_several_texts(spark, seed):
    base = " ".join(f"w{k}" for k in range(40))
    near, other = base.replace("w7 ", "zz "), " ".join(f"x{k}" for k in range(40))
    data = [(1, other), (1, base), (2, near), (3, other), (5, "p q r s t u"), (5, other + " y"), (6, ""), (6, "p q r s t u"), (7, "")]
    random.seed(seed)
    random.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_groups(df, 5, 70).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (5, 1), (6, 1), (6, 1), (7, 7)]


def test_groups_of_hot_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    data = rows[:40] + edited(rows[:3], 120, 25, 5)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in jaccard.jaccard_groups(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect())
    assert got == groups(data, 3, 90)


def test_segments_follow_the_number_of_sets():
    few, many = (sum(jaccard.plan(b, 90, n).near for b in range(8, 20)) for n in (10**4, 10**10))
    assert few < many


@pytest.mark.parametrize("percent,size", [(90, 200), (80, 60), (50, 12)])
def test_linked_sets_share_a_key(percent, size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop = rng.integers(0, max(1, size * (100 - percent) // percent // 2 + 1))
        y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        for sets in (10, 10**12):
            if len(x) == len(y) == both:
                continue
            keys, of = jaccard.keys_of(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2, percent, sets)
            assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def without_repeats(rows, percent=80, least=3):
    out, index, sets = [], {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            s = set(words(line))
            bad = False
            if len(s) >= least:
                met = Counter(j for w in s for j in index.get(w, ()))
                bad = any(100 * n >= percent * (len(s) + len(sets[j]) - n) for j, n in met.items())
                for w in s:
                    index.setdefault(w, []).append(len(sets))
                sets.append(s)
            gone += bad
            if not bad:
                kept.append(line)
        out.append((doc, "\n".join(kept), text.count("\n") + 1, gone))
    return out


def test_lines(spark, rows):
    data = rows + edited(rows, 150, 8, 3)
    random.seed(6)
    data += [(5000 + n, "\n".join(" ".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 9))) for _ in range(5))) for n in range(60)]
    data += [(6000, ""), (6001, None), (6002, "  \n"), (6003, "One two three"), (6004, "one TWO  three\n"), (6005, "É x y")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("line", F.lit(0)).repartition(6)
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=lambda r: r[0]) == without_repeats(data)


def test_lines_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c\nx"), (1, "a b c\nx"), (2, "c b a"), (None, "a b c\ny")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == [(1, "a b c\nx", 0), (1, "a b c\nx", 0), (2, "", 1), (None, "y", 1)]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_many_rows_without_id(spark):
    random.seed(5)
    base = [" ".join(f"a{random.randrange(10**6)}" for _ in range(20)) for _ in range(1000)]
    near = [x.rsplit(" ", 1)[0] + f" b{k}" for k, x in enumerate(base * 3)]
    for first in (0, None):
        df = spark.createDataFrame([(first, "\n".join(base))] + [(None if first is None else k + 1, x) for k, x in enumerate(near)], "doc_id long, text string").repartition(5)
        got = lines.dedup_lines(df, min_words=1).agg(F.sum("n_removed")).first()[0]
        assert got == 3000


def test_lines_of_hot_words(spark, rows, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 8)
    data = rows[:60] + edited(rows[:20], 80, 8, 3)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = lines.dedup_lines(df)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=lambda r: r[0]) == without_repeats(data)


def test_lines_and_clashing_names(spark, sf):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "a b c", "x", "y", 1, 2, 5), (2, "a b c\nd", "x", "y", 1, 2, 7)], "doc_id long, text string, n_removed string, n_lines string, row int, __gone int, n_chars int")
    got = lines.dedup_lines(df)
    assert sorted(got.columns) == sorted(df.columns) and {r.doc_id: (r.n_lines, r.n_removed) for r in got.collect()} == {1: (1, 0), 2: (2, 1)}
    kept = corpus_pipeline.line_dedup(spark, df, sf)
    assert kept.schema == df.schema and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", "x", "y", 1, 2, 5), (2, "d", "x", "y", 1, 2, 1)]


def test_lines_of_few_words(spark, rows):
    long = "".join(chr(0x4E00 + k * 37 % 3000) for k in range(60))
    url = "https://example.org/terms/of/use/and/licence/of/this/text?page="
    lines_of = ["hello", "Hello", "}", "}", "---", "", "", "  ", long, long[:30] + "X" + long[31:], long[::-1], url + "1", url + "2", "a b", "b A", "a c", "我们 " + long[:20], long[:20]]
    random.seed(8)
    data = rows[:300] + [(5000 + k, "\n".join(random.choice(lines_of) for _ in range(4))) for k in range(30)] + [(6000, "\n".join(lines_of))]
    index, sets, want = {}, [], []
    for doc, text in sorted(data, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            w, bad = words(line), False
            solid = "".join(w)
            both = [set(w)] + ([{(solid[k : k + 3],) for k in range(len(solid) - 2)}] if w and len(solid.encode()) >= 16 * len(w) else [])
            for s in both:
                met = Counter(j for x in s for j in index.get(x, ()))
                bad |= any(5 * n >= 4 * (len(s) + len(sets[j]) - n) for j, n in met.items())
            for s in both:
                for x in s:
                    index.setdefault(x, []).append(len(sets))
                sets.append(s)
            if not bad:
                kept.append(line)
        want.append((doc, None if text is None else "\n".join(kept)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = lines.dedup_lines(df, min_words=1, grams=16)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=lambda r: r[0]) == want
    last = dict(want)[6000].split("\n")
    assert "}" not in last and long[:30] + "X" + long[31:] not in last and last.count("") >= 2


def test_lines_query_takes_short_lines(spark, tmp_path):
    spark.createDataFrame([(1, "}\nx y"), (2, "}\nX Y\nz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from memspark.llm import queries

    assert {r.doc_id: r.text for r in queries.op9_lines(spark, str(tmp_path)).collect()} == {1: "}\nx y", 2: "z"}


def test_components(spark):
    random.seed(9)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, k) for k in range(2001, 2050)]
    parent = {}

    def top(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for a, b in edges if a != b for v in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
