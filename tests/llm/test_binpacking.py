"""Bound-certified packing: pieces against the tokenizers library, bounds against exhaustive search."""

import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memspark.llm import binpacking, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, width):
    """Every id in one piece, cut as it should be; sequences without gaps; returns their number."""
    tokenizer = Tokenizer.from_file(BYTE)
    want = defaultdict(int)
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % width or width
        edges = [0, *range(first, len(ids) + 1, width)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= width
    return len(sequences)


def fewest(sizes, width):
    """The least number of windows, by search."""

    @functools.cache
    def search(left, rooms):
        if not left:
            return len(rooms)
        size, rest = left[0], left[1:]
        found = search(rest, tuple(sorted((*rooms, width - size))))
        for r in set(rooms):
            if r >= size:
                other = list(rooms)
                other.remove(r)
                found = min(found, search(rest, tuple(sorted((*other, r - size)))))
        return found

    return search(tuple(sorted(sizes, reverse=True)), ())


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 30).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=8))))
def test_bound(case):
    width, sizes = case
    bound = binpacking.lower_bound(np.bincount(sizes, minlength=width + 1) if sizes else np.zeros(width + 1, int), width)
    windows = binpacking.best_fit_decreasing(np.array(sizes, np.int64), width)
    assert sorted(p for w in windows for p in w) == list(range(len(sizes)))
    assert all(sum(sizes[p] for p in w) <= width for w in windows)
    assert bound <= fewest(sizes, width) <= len(windows)


def test_bound_proves_more_than_the_sum():
    counts = np.zeros(101, int)
    counts[51] = counts[49] = 0
    counts[51] = 10
    assert binpacking.lower_bound(counts, 100) == 10
    counts = np.zeros(101, int)
    counts[34] = 9  # two fit
    assert binpacking.lower_bound(counts, 100) == 5


@pytest.mark.parametrize(("group", "width"), [(50_000, 2048), (40, 2048), (60, 64)])
def test_pieces(spark, group, width):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(5000, None), (5001, ""), (None, "no id"), (None, "no id"), (7, "twice"), (7, "twice"), (5002, "very long " * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"piece": F.lit("clash"), "sequence_id": F.lit(None), "g": F.lit(1)})
    out = binpacking.pack(df, BYTE, 0, width=width, group=group).collect()
    found = check(out, docs, width)
    lengths = np.array([r.length for r in out])
    bound = binpacking.lower_bound(np.bincount(lengths, minlength=width + 1), width)
    assert bound <= found <= bound + 1 + (group < 50_000) * bound // 100


def test_exchange_saves(spark):
    """Groups of few pieces leave gaps that later rounds close."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).cast("int")).alias("text"))
    once = binpacking.pack(df, BYTE, 0, group=30, rounds=1).select("sequence_id").distinct().count()
    more = binpacking.pack(df, BYTE, 0, group=30)
    least = binpacking.bound_of(more, 2048)
    found = more.select("sequence_id").distinct().count()
    assert least <= found <= 1.015 * least and found < once - 10, (least, found, once)


def test_empty(spark):
    assert binpacking.pack(spark.createDataFrame([], "doc_id long, text string"), BYTE, 0).count() == 0


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op12_bins(spark, sf).collect()
    found = check(out, docs, 2048)
    assert found == binpacking.lower_bound(np.bincount([r.length for r in out], minlength=2049), 2048)
