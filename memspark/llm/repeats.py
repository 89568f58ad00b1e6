"""Removal of repeated byte strings by prefix-free parsing and suffix order.

Every document is parsed into phrases at triggers of a rolling hash: the trigger of a string of
`length` bytes is its first place with the least hash of TRIGGER bytes, so equal strings have
equal triggers at equal places.  All strings with the same trigger form a phrase (it overlaps the
next one by length-1 bytes), hence each string of `length` bytes lies in one phrase only.  Phrases
with several occurrences are repeated whole.  What is left is to compare different phrases around
equal triggers: the dictionary's phrases are sorted by their bytes after the trigger (suffix order)
and by those before it (the same for the text read backwards), and the two orders with their common
prefix lengths tell which strings of all these phrases are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_bytes, runs_by_size, written

TRIGGER = 32
PLACE = "struct<row:bigint,at:int,first:int,last:int>"
PHRASES = f"trigger long, phrase long, places array<{PLACE}>"
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


_KNOWN: list[np.ndarray] = []  # the powers that were last needed, up to a bounded number


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k = 0..n."""
    if not _KNOWN or len(_KNOWN[0]) <= n:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16) + 1, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        if n > 1 << 21:
            return out[0][: n + 1], out[1][: n + 1]
        _KNOWN[:] = out
    return _KNOWN[0][: n + 1], _KNOWN[1][: n + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Sums:
    """Hashes of substrings of an array of bytes from one running sum."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data))
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sum[end] - self.sum[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def phrases(data: np.ndarray, ends: np.ndarray, length: int):
    """(text, trigger hash, phrase hash, trigger place, first and last start of its strings) of the
    phrases of texts data[ends[k]:ends[k+1]]; places count from the start of the text."""
    n = len(data) - length + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n <= 0:
        return none
    grams = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    wide = len(data) - TRIGGER + 1
    h = np.zeros(wide, np.uint64)
    for k in range(0, TRIGGER, 8):
        h = (h ^ grams[k : k + wide]) * np.uint64(BASE)
        h ^= h >> np.uint64(29)
    # least hash and its first place, by doubling
    least = (_mix(h) & np.uint64(0xFFFFFFFF << 32)) | np.arange(wide, dtype=np.uint64)
    window, size = length - TRIGGER + 1, 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: n], least[window - size : window - size + n])
    trigger = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # starts whose string ends in the same text
    ok = np.zeros(n + 1, bool)
    sizes = np.diff(ends)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return none
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, ends[long], 1)
    np.add.at(edge, ends[long + 1] - length + 1, -1)
    ok[:n] = np.cumsum(edge)[:n] > 0
    start = ok[:n].copy()
    start[1:] &= ~ok[: n - 1] | (trigger[1:] != trigger[:-1])
    start[ends[long]] = True
    first = np.flatnonzero(start)
    stop = ok[:n].copy()
    stop[:-1] &= ~ok[1:n] | (trigger[1:] != trigger[:-1])
    stop[ends[long + 1] - length] = True
    last = np.flatnonzero(stop)
    at = trigger[first]
    text = np.searchsorted(ends, first, "right") - 1
    hashes = _Sums(data)
    own = hashes(first, last + length) + (at - first).astype(np.uint64) * np.uint64(BASE)
    base = ends[text]
    return text, h[at].view(np.int64), _mix(own).view(np.int64), at - base, first - base, last - base


def _common(matrix: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbours in the order."""
    a, b = order[:-1], order[1:]
    differ = matrix[a] != matrix[b]
    first = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    return np.minimum(first, np.minimum(size[a], size[b]))


def repeated_in(group: np.ndarray, place: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """For phrases (bytes, the place of the trigger in them, a number of their trigger): whether the
    string that begins d bytes before the trigger is in another phrase of the group, too; an array
    of phrases by d = 0..length-TRIGGER.  Phrases are different or stand for one occurrence each."""
    n, deep = len(texts), length - TRIGGER
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, deep), np.uint8)
    r_size, l_size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, (t, p) in enumerate(zip(texts, place.tolist())):
        a = np.frombuffer(t, np.uint8)
        r_size[k], l_size[k] = len(a) - p, p
        right[k, : len(a) - p] = a[p:]
        left[k, :p] = a[:p][::-1]
    classes = []
    for matrix, size in ((right, r_size), (left, l_size)):
        keys = matrix.view(f"S{matrix.shape[1]}").ravel()
        # bytes strings in numpy drop zeros at their end, the lengths tell such apart
        order = np.lexsort((size, keys, group))
        shared = _common(matrix, size, order)
        shared[group[order[1:]] != group[order[:-1]]] = -1
        classes.append((order, shared))
    out = np.zeros((n, deep + 1), bool)
    for d in range(deep + 1):
        valid = (l_size >= d) & (r_size >= length - d)
        if np.count_nonzero(valid) < 2:
            continue
        number = []
        for (order, shared), need in zip(classes, (length - d, d)):
            c = np.zeros(n, np.int64)
            c[order[1:]] = np.cumsum(shared < need)
            number.append(c)
        at = np.flatnonzero(valid)
        key = number[0][at] * n + number[1][at]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        twice = np.zeros(len(at), bool)
        twice[by[1:]] |= same
        twice[by[:-1]] |= same
        out[at, d] = twice
    return out


def find_repeats(docs: DataFrame, length: int = 200, hot: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows is docs' (doc_id, text) with `row`, a hash of both; spans has a row for
    bytes begin..end of the text of `row` that are covered by strings of `length` bytes which also
    start elsewhere.  Spans may overlap.  Triggers with over `hot` different phrases are compared by
    128-bit hashes of their strings instead, which Spark counts evenly over all tasks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")

    def parse(batches):
        # equal phrases of a batch become one row, so that a phrase that many texts or one long
        # periodic text repeat isn't shuffled one occurrence at a time
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            parts = []
            for a, b in runs_by_size(ends, 2_000_000):
                text, *rest = phrases(np.ascontiguousarray(data[ends[a] : ends[b]]), ends[a : b + 1] - ends[a], length)
                parts.append((ids[a:b][text], *rest))
            if not parts:
                continue
            row, trigger, phrase, at, first, last = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((phrase, trigger))
            new = np.ones(len(order), bool)
            new[1:] = (trigger[order[1:]] != trigger[order[:-1]]) | (phrase[order[1:]] != phrase[order[:-1]])
            begin = np.flatnonzero(new)
            names = ["row", "at", "first", "last"]
            places = pa.StructArray.from_arrays([pa.array(row[order]), *(pa.array(x[order].astype(np.int32)) for x in (at, first, last))], names)
            # bounded rows: a very long list is cut
            begin = np.unique(np.concatenate([begin, np.arange(0, len(order), 10_000)]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), places)
            yield pa.RecordBatch.from_arrays([pa.array(trigger[order[begin]]), pa.array(phrase[order[begin]]), lists], ["trigger", "phrase", "places"])

    parsed = rows.select("row", "text").mapInArrow(parse, PHRASES)
    group, same = Window.partitionBy("trigger"), Window.partitionBy("trigger", "phrase")
    marked = (
        parsed.withColumn("n", F.sum(F.size("places")).over(same))
        .withColumn("turn", F.row_number().over(same.orderBy("places")))
        .withColumn("several", F.min("phrase").over(group) != F.max("phrase").over(group))
        .where("n > 1 or several")
    )
    places = marked.select("trigger", "n", (F.col("several") & (F.col("turn") == 1)).alias("several"), F.posexplode("places").alias("k", "p"))
    found = written(places.select("p.row", "trigger", "p.at", "p.first", "p.last", (F.col("n") > 1).alias("whole"), (F.col("several") & (F.col("k") == 0)).alias("compare")), "phrases")
    whole = found.where("whole").select("row", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))

    # the bytes of the dictionary's phrases around triggers that have several of them
    wanted = found.where("compare").select("row", F.struct("trigger", "at", "first", "last", "whole").alias("p")).groupBy("row").agg(F.collect_list("p").alias("p"))
    crowd = found.where("compare").groupBy("trigger").count().where(F.col("count") > hot).select("trigger")
    DICTIONARY = "row long, trigger long, at int, first int, whole boolean, bytes binary"

    def cut(batches):
        for batch in batches:
            out = []
            for row, text, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                out += [(row, p["trigger"], p["at"], p["first"], p["whole"], data[p["first"] : p["last"] + length]) for p in ps]
                if len(out) > 20_000:
                    yield _batch(out, DICTIONARY)
                    out = []
            if out:
                yield _batch(out, DICTIONARY)

    # equal rows have equal texts; one of them is enough
    texts = rows.select("row", "text").join(wanted, "row").dropDuplicates(["row"])
    dictionary = written(texts.select("row", "text", "p").mapInArrow(cut, DICTIONARY), "dictionary")

    def compare(batches):
        held, size = [], 0

        def done(part):
            trigger = np.concatenate([p[1] for p in part])
            group = np.cumsum(np.concatenate([[0], trigger[1:] != trigger[:-1]]))
            at, first, is_whole = (np.concatenate([p[k] for p in part]) for k in (2, 3, 4))
            row = np.concatenate([p[0] for p in part])
            twice = repeated_in(group, at - first, [t for p in part for t in p[5]], length)[:, ::-1]
            twice[is_whole] = False  # all of such a phrase is known to be repeated
            deep = length - TRIGGER
            edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            k, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            low = at[k] - deep
            return pa.RecordBatch.from_arrays([pa.array(row[k]), pa.array((low + begin).astype(np.int32)), pa.array((low + end - 1 + length).astype(np.int32))], ["row", "begin", "end"])

        for batch in batches:
            c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] + [batch.column(5).to_pylist()]
            held.append(c)
            size += len(batch)
            if size >= 20_000:
                # all but the last trigger, which may go on
                trigger = np.concatenate([p[1] for p in held])
                cut_at = int(np.searchsorted(np.cumsum(trigger[1:] != trigger[:-1]), np.count_nonzero(trigger[1:] != trigger[:-1]))) + 1 if trigger[0] != trigger[-1] else 0
                if cut_at:
                    flat = [np.concatenate([p[k] for p in held]) for k in range(5)] + [[t for p in held for t in p[5]]]
                    yield done([[x[:cut_at] for x in flat]])
                    held, size = [[x[cut_at:] for x in flat]], len(trigger) - cut_at
        if size:
            yield done(held)

    common = dictionary.join(crowd, "trigger", "left_anti")
    ordered = common.repartition("trigger").sortWithinPartitions("trigger")
    part = ordered.select("row", "trigger", "at", "first", "whole", "bytes").mapInArrow(compare, "row long, begin int, end int")

    def strings(batches):
        for batch in batches:
            for row, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a = np.frombuffer(data, np.uint8)
                begin = np.arange(len(a) - length + 1)
                one, two = _Sums(a)(begin, begin + length), _Sums(a[::-1].copy())(len(a) - begin - length, len(a) - begin)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), row)), pa.array((begin + first).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["row", "begin", "h1", "h2"])

    each = dictionary.join(crowd, "trigger", "left_semi").select("row", "first", "bytes").mapInArrow(strings, "row long, begin int, h1 long, h2 long")
    twice = each.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    crowded = each.join(twice, ["h1", "h2"], "left_semi").select("row", "begin", (F.col("begin") + length).cast("int").alias("end"))
    return rows, whole.unionByName(part).unionByName(crowded)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are ignored): doc_id, n_bytes of the
    UTF-8 of text, n_removed, n_spans and kept, the bytes left after removing every byte covered by a
    string of `length` bytes that also starts anywhere else in the input, in the same text or another.
    Null and empty texts have nothing to remove."""
    rows, spans = find_repeats(docs, length)
    merged = spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def keep(batches):
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            lists = batch.column(2)
            at = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists.to_pylist()])]) if lists.null_count < len(lists) else None
            flat = lists.flatten() if at is not None else None
            begin, end = (flat.field(0).to_numpy(), flat.field(1).to_numpy()) if at is not None else (None, None)
            n = np.diff(ends)
            removed, counts, kept = [], [], []
            for k in range(len(n)):
                text = data[ends[k] : ends[k + 1]]
                if at is None or at[k] == at[k + 1]:
                    removed.append(0)
                    counts.append(0)
                    kept.append(text.tobytes())
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, begin[at[k] : at[k + 1]], 1)
                np.add.at(edge, end[at[k] : at[k + 1]], -1)
                cover = np.cumsum(edge[:-1]) > 0
                removed.append(int(cover.sum()))
                counts.append(int(cover[0]) + int(np.count_nonzero(cover[1:] & ~cover[:-1])))
                kept.append(text[~cover].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(merged, "row", "left").select("doc_id", "text", "spans").mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
