"""Alignment of two tokenizers against a plain loop over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memspark.llm import alignment, queries

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a", "a ", "a  b", "x\n y", "<|endoftext|> hi <s></s><|endoftext|>x", "a▁b c", "▁", "café ́x é", "日本 語　x", "a\x00b <0x41>", "ΑΣ 😀😀 İx", "\n", "\ta\t b ", "x" * 3000, "word " * 2000]


@pytest.fixture(scope="module")
def plain():
    tokenizer, model = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    tokenizer.encode_special_tokens = True
    letters = alignment.byte_alphabet()

    def groups(text):
        """[(first ids, second ids)] and the linked pairs of a text, by walking over its bytes."""
        if not text:
            return [], []
        whole = (" " + text).encode()
        sides = []
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids
        sides.append([(i, bytes(letters[c] for c in tokenizer.id_to_token(i))) for i in a])
        sides.append([(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]])
        if any(b"".join(x for _, x in side) != whole for side in sides):
            return [], []
        spans = []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        made = [([i for _, e, i in spans[0] if lo < e <= hi], [i for _, e, i in spans[1] if lo < e <= hi]) for lo, hi in zip([0, *common], common)] if len(whole) < 500 else None
        if made is None:  # the same in one walk
            made, lo, k, j = [], 0, 0, 0
            for hi in common:
                left, right = [], []
                while k < len(spans[0]) and spans[0][k][1] <= hi:
                    left.append(spans[0][k][2])
                    k += 1
                while j < len(spans[1]) and spans[1][j][1] <= hi:
                    right.append(spans[1][j][2])
                    j += 1
                made.append((left, right))
        links, j = [], 0
        for lo, hi, i in spans[0]:
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < hi:
                links.append((i, spans[1][k][2]))
                k += 1
        return made, links

    return groups


def expected(rows, plain):
    held = [(doc, *plain(text)) for doc, text in rows]
    count = Counter(p for _, _, links in held for p in set(links))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc, groups, links in held:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [4_000_000, 50])
def test_equals_loop(spark, plain, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_a": F.lit("clash"), "groups": F.lit(1), "row_key": F.lit(2)}).repartition(5)
    found = alignment.align(df, FIRST, SECOND, buckets=8, broadcast_pairs=most)
    got = found.select("doc_id", *alignment.NUMBERS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, plain)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, FIRST, SECOND).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align(none, FIRST, SECOND).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, plain):
    where = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_alignment(spark, where).collect()), key=repr) == expected(rows, plain)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="ab .,\n\t'é日 ́▁<|>0x1S", max_size=25), min_size=1, max_size=5))
def test_units(plain, texts):
    use = _HELD.setdefault("a", alignment.Aligner(FIRST, SECOND, groups=True, max_units=200) if "a" not in _HELD else None)
    sums, said = use.documents(texts) if use.counts else _counted(use, texts)
    for k, t in enumerate(texts):
        groups, links = plain(t)
        assert said[k] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert sums["n_links"][k] == len(links) and sums["n_groups"][k] == len(groups)


class _One:
    def lookup(self, keys):
        return np.ones(len(keys), np.int64), np.ones(len(keys), bool)


def _counted(use, texts):
    use.counts = _One()
    return use.documents(texts)


_HELD: dict = {}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=3000))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    hashed = alignment.PairHash.from_bytes(alignment.PairHash.build(keys).to_bytes())
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys))) and hashed.n == len(keys)
    assert (hashed.index(keys + 2**41) < len(keys)).all()
