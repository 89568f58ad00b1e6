import random
import re

import pytest
from pyspark.sql import functions as F

from memspark.llm import decontaminate as d


def distance(passage, text):
    """The fewest edits of the passage to a part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (y != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(12).collect()]


def test_equals_brute_force(spark, items):
    random.seed(3)
    block = d.indexes([x for i, t in items for x in d.passages_of(i, t, 400)], 0.1)
    assert [p.q for p in block] == [d.Q]
    p, scan = block[0], d.Scanner(block)
    found = 0
    for _ in range(40):
        k = random.randrange(len(p.texts))
        q = bytearray(p.texts[k])
        for _ in range(random.randrange(0, int(p.budget[k]) + 6)):
            j, o = random.randrange(len(q)), random.random()
            if o < 0.4:
                q[j] = random.choice(b"abcdefgh ")
            elif o < 0.7:
                del q[j]
            else:
                q.insert(j, random.choice(b"abcdefgh "))
        text = p.texts[(k + 1) % len(p.texts)][:150] + b" " + bytes(q) + b" the end of it"
        best = distance(p.texts[k], text)
        got = [r for r in scan.find([text]) if r[1] == p.items[k]]
        assert bool(got) == (best <= p.budget[k])
        if got:
            found += 1
            _, _, _, begin, end, edits = got[0]
            assert edits == best and distance(p.texts[k], text[begin:end]) == best
    assert found > 10


def test_tables(spark, items):
    long = " ".join(t for _, t in items) * 2
    bench = spark.createDataFrame([*items, (100, None), (101, ""), (102, "short"), (103, long), items[0]], "item_id long, text string")
    docs = [(1, None), (2, ""), (3, "nothing here"), (4, "x " + items[0][1].upper().replace(" ", "  \n") + " y"), (None, items[1][1]), (6, "a" * 100_000 + items[2][1]), (7, long[600:1500])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(df, bench).collect()}
    assert {(4, items[0][0]), (None, items[1][0]), (6, items[2][0]), (7, 103)} <= got and not {1, 2, 3} & {x for x, _ in got}
    kept = d.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3}
    assert d.find_leaks(df, bench.limit(0)).count() == 0 and d.drop_leaks(df, bench.limit(0)).count() == 7
    assert d.find_leaks(df.limit(0), bench).count() == 0


def test_blocks_give_the_same(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(d.blocks(bench, 0.1, 400, block_bytes=500))
    assert len(blocks) > 2 and sorted(i for b in blocks for p in b for i in p.items.tolist()) == [i for i, _ in items]


def test_stretches_of_items(spark, items):
    words = [w for _, t in items for w in t.split()]
    random.seed(5)
    text = lambda size: d.normal(" ".join(random.choice(words) for _ in range(size))).decode("utf-8")[:size]
    ascii_only = lambda t: t.encode("ascii", "replace").decode()
    middle, long = ascii_only(text(702)), ascii_only(text(2000))
    bench = spark.createDataFrame([(1, middle), (2, long)], "item_id long, text string")
    docs, want = [], set()
    parts = [(1, middle[:351]), (1, middle[351:]), (1, middle[:234]), (1, middle[234:468]), (1, middle[468:]), (1, middle[100:600])]
    parts += [(2, long[k : k + 300]) for k in range(0, 1701, 7)]
    for n, (item, part) in enumerate(parts):
        docs.append((n, "0 1 2 3 4 5 6 7 8 9 " * 20 + part.strip() + " 0 1 2 3 4 5 6 7 8 9" * 20))
        want.add((n, item))
    df = spark.createDataFrame([*docs, (-1, "0 1 2 3 4 5 6 7 8 9 " * 40)], "doc_id long, text string").repartition(4)
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(df, bench).collect()} == want
    assert [r.doc_id for r in d.drop_leaks(df, bench).collect()] == [-1]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "abcdefg"), (2, "the quick brown foxy"), (3, "xy"), (4, "a b c d e f")], "item_id long, text string")
    texts = ["... abcdefg ...", "abcdef", "see the quack brwn foxy run", "see the quack brxn fexy run", "xy", "so A  b\nc d e f", None, ""]
    got = d.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(0, 1, 0), (2, 2, 2), (4, 3, 0), (5, 4, 0)]


def test_an_item_with_several_texts_is_one(spark):
    rows = [(7, f"item text number {k} " + " ".join(f"w{k}x{j}" for j in range(30))) for k in range(6)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(None, "so " + rows[0][1]), (3, rows[1][1] + " and " + rows[4][1]), (3, rows[5][1])], "doc_id long, text string")
    original = d.blocks
    d.blocks = lambda *a, **k: original(*a, **{**k, "block_bytes": 100})
    try:
        got = d.find_leaks(docs, bench).collect()
    finally:
        d.blocks = original
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("3", 7), ("3", 7), ("None", 7)]


def test_items_of_few_bytes(spark):
    bench = spark.createDataFrame([(1, "xyz"), (2, " Q "), (3, "é"), (4, "xyz"), (5, ""), (6, None), (7, "a  b"), (8, "wxyz")], "item_id long, text string")
    docs = [(10, "some wXYZ here"), (11, "q"), (12, "caf\u00c9 a\tb é."), (13, "xy z"), (14, None), (15, ""), (16, "xy"), (17, "z"), (None, "abxyz (xyz) q2 xyz"), (18, "caf\u00c9 qz 4q"), (19, "ab:xyz")]
    got = sorted(((r.doc_id, r.item_id, r.begin, r.end, r.edits, r.passage_bytes) for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()), key=repr)
    want = []
    for doc, text in docs:
        data = d.normal(text or "")
        for item, passage in ((1, b"xyz"), (2, b"q"), (3, "é".encode()), (4, b"xyz"), (7, b"a b"), (8, b"wxyz")):
            found = re.search(rb"(?<![0-9a-z\x80-\xff])" + passage + rb"(?![0-9a-z\x80-\xff])" if len(passage) < 4 else passage, data)
            if found:
                want.append((doc, item, found.start(), found.end(), 0, len(passage)))
    assert got == sorted(want, key=repr) and len(got) >= 8
    kept = {r.doc_id for r in d.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert kept == {13, 14, 15, 16, 17, 18}
