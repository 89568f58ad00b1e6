"""Encoding, token files, packing, token counts: against the tokenizers library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memspark.llm import packing, token_counts, token_files
from memspark.llm.encode import UnitEncoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", "  a", " a b", "a  b", "x\n y", "<|endoftext|> hi <|endoftext|>x", "a  b", "café ́x", "a ", "\n", "I'm don't  ", "ΑΣ ΑΣ日本 語 İx", "　x", "ǅ ß ﬁ", "\ta\t b ", "0 1 22 a1"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    return [(r.doc_id, r.text) for r in docs] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, None), (None, "null id")]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("offsets", [False, True])
def test_units_equal_whole_texts(path, offsets, texts):
    whole = [t or "" for _, t in texts]
    e = UnitEncoder(path, None, offsets)
    want = Tokenizer.from_file(path).encode_batch(whole, add_special_tokens=False)
    for _ in range(2):  # the second time from the cache
        got = e.encode(whole)
        assert got[0].tolist() == [i for w in want for i in w.ids]
        assert got[1].tolist() == [len(w.ids) for w in want]
        if offsets:
            assert list(zip(got[2].tolist(), got[3].tolist())) == [o for w in want for o in w.offsets]
    small = UnitEncoder(path, 2, False, max_units=5)
    assert [small.encode([t])[0].tolist() for t in whole] == [[*w.ids, 2] for w in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .,\n\t'é日 ́<|>1S", max_size=30), max_size=6))
def test_units_equal_whole_texts_random(whole):
    for path in (BYTE, WORD):
        e = _RANDOM.setdefault(path, (UnitEncoder(path), Tokenizer.from_file(path)))
        assert e[0].encode(whole)[0].tolist() == [i for w in e[1].encode_batch(whole, add_special_tokens=False) for i in w.ids]


_RANDOM: dict = {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.booleans())
def test_planes(ids, bits):
    ids = np.array(ids, np.uint32)
    counts = np.array([len(ids)], np.int64)
    blob = token_files.write_shard(ids, np.array([7]), np.array([1]), counts, block=64, bits=bits)
    back, doc, has, n = token_files.read_shard(blob)
    assert back.tolist() == ids.tolist() and doc.tolist() == [7] and has.tolist() == [1] and n.tolist() == [len(ids)]


def test_token_files(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)
    got = token_files.read_ids(token_files.write_ids(df, BYTE, 2, shard_ids=2000, block=512)).collect()
    t, at, want = Tokenizer.from_file(BYTE), 0, []
    for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_packing(spark, texts):
    df = spark.createDataFrame(texts + [(3000, texts[0][1] * 30)], "doc_id long, text string").repartition(3)
    rows = packing.pack(df, WORD, 2, width=256).collect()
    t = Tokenizer.from_file(WORD)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in [*texts, (3000, texts[0][1] * 30)]}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.ids_crc32 == crc(ids[doc][at : at + r.length])
            at += r.length
        assert at == len(ids[doc])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        padding += 256 - at if at & (at - 1) else 0
    assert padding < 0.005 * sum(map(len, ids.values()))


def test_most_tokens_lie_where_the_rule_placed_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    rows = packing.pack(docs, WORD, 2).where("length < 4096").toPandas()
    share = rows.length[rows.placed].sum() / rows.length.sum()
    sizes = rows.groupby("sequence_id").length.sum()
    padding = (4096 - sizes)[(sizes & (sizes - 1)) > 0].sum()
    print("placed", share, "padding", padding / sizes.sum(), sizes[(sizes & (sizes - 1)) > 0].tolist())
    assert share > 0.9 and padding < 0.001 * sizes.sum()


def test_crc_of_parts():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << 32, n).astype("<u4")
        crc, marks = packing.marks_of(ids)
        assert crc == zlib.crc32(ids.tobytes())
        cuts = [*range(0, n + 1, 64), *range(n // 64 * 64, n + 1)]
        for a in cuts:
            for b in cuts:
                if a < b:
                    assert packing.part_crc(marks, n, a, b) == zlib.crc32(ids[a:b].tobytes())


def test_sum_of_squares_rule():
    p = packing.SumOfSquares(10)
    sizes = np.random.default_rng(3).integers(1, 10, 300).tolist()
    level = {}
    for s in sizes:
        # by hand: the fill level whose choice leaves the least sum of squares
        def after(h):
            new = dict(level)
            if h:
                new[h] -= 1
            if h + s < 10:
                new[h + s] = new.get(h + s, 0) + 1
            return sum(v * v for v in new.values())

        h = max((h for h in [0, *(k for k, v in level.items() if v)] if h + s <= 10), key=lambda h: (-after(h), h))
        if h:
            level[h] -= 1
        if h + s < 10:
            level[h + s] = level.get(h + s, 0) + 1
        p.place(s, s)
        assert {k: v for k, v in level.items() if v} == {k: int(v) for k, v in enumerate(p.level) if v}


def test_token_counts(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("section", F.lit(1)).repartition(4)
    t = Tokenizer.from_file(BYTE)
    want = []
    for doc, text in texts:
        text = text or ""
        e = t.encode(text, add_special_tokens=False)
        edges, at = [], 0
        for line in text.splitlines(keepends=True) if "\r" in text else [x + "\n" for x in text.split("\n")]:
            edges.append((at, min(at + len(line), len(text))))
            at += len(line)
        if len(edges) > 1 and edges[-1][0] == edges[-1][1] == len(text) and text.endswith("\n"):
            edges.pop()
        n, shared = [0] * len(edges), [0] * len(edges)
        for a, b in e.offsets:
            held = [min(b, y) - max(a, x) for x, y in edges]
            k = held.index(max(held)) if b > a else max(k for k, (x, _) in enumerate(edges) if x <= a)
            n[k] += 1
            shared[k] += sum(h > 0 for h in held) > 1
        want += [(doc, k, x, y, n[k], shared[k]) for k, (x, y) in enumerate(edges)]
    got = [tuple(r) for r in token_counts.token_counts(df, BYTE).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_ids(token_files.write_ids(none, BYTE, 2)).count() == 0
    assert packing.pack(none, WORD, 2).count() == 0
    assert token_counts.token_counts(none, BYTE).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_index_opens_only_what_is_wanted(spark, texts, bits):
    ids = np.arange(5000, dtype=np.uint32) * 7919 % 50000
    blob = bytearray(token_files.write_shard(ids, np.arange(3), np.ones(3, np.uint8), np.array([10, 4000, 990]), block=512, bits=bits))
    assert token_files.read_span(bytes(blob), 0, 5000).tolist() == ids.tolist()
    blob[token_files.HEAD.size : token_files.HEAD.size + 60] = bytes(60)  # the first block's planes can't be read any more
    assert token_files.read_span(bytes(blob), 3000, 700).tolist() == ids[3000:3700].tolist() and token_files.read_span(bytes(blob), 4999, 1).tolist() == [int(ids[-1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    files = token_files.write_ids(df, BYTE, 2, shard_ids=500, block=64, bits=bits)
    wanted = spark.createDataFrame([(1003,), (1013,), (2000,), (None,), (77777,), (1003,)], "doc_id long")
    whole = Tokenizer.from_file(BYTE)
    want = sorted([d, [*whole.encode(t or "", add_special_tokens=False).ids, 2]] for d, t in texts if d in (1003, 1013, 2000))
    assert sorted([r.doc_id, r.ids] for r in token_files.read_documents(files, wanted).collect()) == want
    assert token_files.read_documents(files, wanted.where("false")).count() == 0
