"""Benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, tidy

Q, SHORT_Q = 8, 4  # bytes of a q-gram; of those of passages for which the lemma needs shorter ones
LEAKS = "doc_id long, item_id long, begin long, end long, edits int, passage_bytes int"
GAP = b"\0" * Q


def normal(text: str) -> bytes:
    """Lower-cased UTF-8 with each run of white space as one space; matching is on these bytes."""
    return " ".join(text.lower().replace("\0", " ").split()).encode("utf-8", "surrogatepass")


@dataclass
class Passages:
    """Benchmark passages of a block and the index of their q-grams of q bytes."""

    q: int
    items: np.ndarray  # item of each passage
    texts: list[bytes]
    budget: np.ndarray  # edits allowed
    least: np.ndarray  # counted q-grams that a region must share
    grams: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # first posting of each, and the end
    passage: np.ndarray  # postings: passage and place in it
    place: np.ndarray


def passages_of(item: int, text: str, window: int, stretch: int = 0) -> list[tuple[int, bytes]]:
    """The whole item, or from 2*window bytes on its parts of `window` bytes; if stretch > 0, also its
    parts of `stretch` bytes, so close that each verbatim stretch of 7/6 of that holds one."""
    data = normal(text)
    if not data:
        return []
    cut = lambda size, step: [(item, data[k : k + size]) for k in [*range(0, len(data) - size, step), len(data) - size]]
    found = [(item, data)] if len(data) <= 2 * window else cut(window, window // 2)
    return found + cut(stretch, max(1, stretch // 6)) if 0 < stretch < len(data) else found


def grams_of(data: np.ndarray, q: int) -> np.ndarray:
    return np.ndarray((len(data) - q + 1,), f"<u{q}", data, strides=(1,)).astype(np.uint64, copy=False) if len(data) >= q else np.zeros(0, np.uint64)


def indexes(found: list[tuple[int, bytes]], edit_share: float) -> list[Passages | list[tuple[int, bytes]]]:
    """Indexes of the passages by Q, and by SHORT_Q of those that could lose all their longer q-grams
    by the edits that are allowed; passages of under SHORT_Q bytes, of which no edit is allowed, as
    they are."""
    long = lambda n: n + 1 - Q * (int(n * edit_share) + 1) > 0
    tiny, found = [x for x in found if len(x[1]) < SHORT_Q], [x for x in found if len(x[1]) >= SHORT_Q]
    parts = [(Q, [x for x in found if long(len(x[1]))]), (SHORT_Q, [x for x in found if not long(len(x[1]))])]
    return [index(part, edit_share, q) for q, part in parts if part] + [tiny] * bool(tiny)


def index(found: list[tuple[int, bytes]], edit_share: float, q: int) -> Passages:
    """For a passage of n bytes, e edits leave n+1-q*(e+1) of its q-grams; its commonest q-grams
    (those that many passages have) may go uncounted if the bound falls with them."""
    texts = [t for _, t in found]
    size = np.array([len(t) for t in texts], np.int64)
    budget = np.minimum((size * edit_share).astype(np.int64), size // q - 1)
    bound = size + 1 - q * (budget + 1)
    every = [grams_of(np.frombuffer(t, np.uint8), q) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(g) for g in every])
    place = np.concatenate([np.arange(len(g)) for g in every])
    gram = np.concatenate(every)
    _, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
    times = times[inverse]
    # in each passage the commonest first, as many as leave half of the bound
    order = np.lexsort((place, -times, of))
    start = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])[:-1]
    rank = np.empty(len(of), np.int64)
    rank[order] = np.arange(len(of)) - start[of[order]]
    spare = bound - np.maximum(bound // 2, 1)
    skip = (rank < spare[of]) & (times > 1)
    least = bound - np.bincount(of[skip], minlength=len(texts))
    gram, of, place = gram[~skip], of[~skip], place[~skip]
    order = np.argsort(gram, kind="stable")
    gram, of, place = gram[order], of[order], place[order]
    grams, first = np.unique(gram, return_index=True)
    return Passages(q, np.array([i for i, _ in found], np.int64), texts, budget, least, grams, np.append(first, len(gram)), of, place)


def blocks(benchmark: DataFrame, edit_share: float, window: int, block_bytes: int = 1 << 22, stretch: int = 0) -> Iterator[list]:
    """The benchmark (item_id, text; null or empty: never matched) in blocks of about
    block_bytes, whole items each, one at a time on the driver: a query set that is broadcast block
    by block."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).na.drop().distinct().orderBy("item_id", "text")
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        if size >= block_bytes and item != held[-1][0]:
            yield indexes(held, edit_share)
            held, size = [], 0
        new = passages_of(item, text, window, stretch)
        held += new
        size += sum(len(t) for _, t in new)
    if held:
        yield indexes(held, edit_share)


def align(passage: bytes, region: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole passage with a part of region, where place i
    of the passage meets places i+low .. i+high of region; end is in region."""
    width = high - low + 1
    step = np.arange(width)
    far = 1 << 20
    padded = np.concatenate([np.zeros(max(-low, 0), np.uint8), region, np.zeros(len(passage) + max(high, 0) + 1, np.uint8)])
    valid = np.concatenate([np.zeros(max(-low, 0), bool), np.ones(len(region), bool), np.zeros(len(passage) + max(high, 0) + 1, bool)])
    shift = max(-low, 0) + low
    edge = step + low
    row = np.where((edge >= 0) & (edge <= len(region)), 0, far)
    for i, c in enumerate(passage):
        there = padded[shift + i : shift + i + width]
        real = valid[shift + i : shift + i + width]
        new = np.where(real, row + (there != c), far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        at = edge + i + 1
        new[(at < 0) | (at > len(region))] = far
        row = np.minimum.accumulate(new - step) + step
    k = int(row.argmin())
    return int(row[k]), k + low + len(passage)


def verify(passage: bytes, budget: int, text: np.ndarray, low: int, high: int, q: int) -> tuple[int, int, int] | None:
    """(begin, end, edits) of the passage in text around the diagonals low..high, if within budget."""
    at, to = max(0, low - budget), min(len(text), high + len(passage) + budget)
    region = text[at:to]
    exact = region.tobytes().find(passage)
    if exact >= 0:
        return at + exact, at + exact + len(passage), 0
    # the whole bound of the lemma, on this region alone
    own = grams_of(np.frombuffer(passage, np.uint8), q)
    if np.count_nonzero(np.isin(own, grams_of(np.ascontiguousarray(region), q))) < len(passage) + 1 - q * (budget + 1):
        return None
    edits, end = align(passage, region, low - budget - at, high + budget - at)
    if edits > budget or end < 0:
        return None
    # the same alignment backwards from its end tells where it begins
    back = region[:end][::-1]
    _, length = align(passage[::-1], back[: len(passage) + budget], -budget, budget)
    return at + end - length, at + end, edits


class Scanner:
    """Finds a block's passages in batches of texts."""

    def __init__(self, block: list):
        self.parts = [_Part(p) if isinstance(p, Passages) else _Tiny(p) for p in block]

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, bytes of the passage, begin, end, edits), the best region of each passage in each
        text; passages of an item of which the text holds a longer one may be left out."""
        return [x for part in self.parts for x in part.find(texts)]


class _Tiny:
    """Passages of under SHORT_Q bytes, found by a table of all strings of their length, where they stand
    as words of their own: no letter, digit or byte over 127 touches them."""

    def __init__(self, found: list[tuple[int, bytes]]):
        self.items: dict[int, dict[int, list[int]]] = {}  # length -> code of the bytes -> items
        for item, text in found:
            self.items.setdefault(len(text), {}).setdefault(int.from_bytes(text, "big"), []).append(item)
        self.tables = {n: np.zeros(1 << (8 * n), bool) for n in self.items}
        for n, codes in self.items.items():
            self.tables[n][list(codes)] = True

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        data = np.frombuffer(GAP.join(texts) + GAP, np.uint8)
        start = np.cumsum([0] + [len(t) + Q for t in texts])
        edge = np.append(~((data >= 128) | (data - ord("0") < 10) | (data - ord("a") < 26)), True)
        out = []
        for n, table in self.tables.items():
            codes = np.zeros(len(data) - n + 1, np.int64)
            for k in range(n):
                codes = codes << 8 | data[k : len(data) - n + 1 + k]
            at = np.flatnonzero(table[codes])
            at = at[edge[at - 1] & edge[at + n]]  # before the first byte stands the last, a gap's
            doc = np.searchsorted(start, at, "right") - 1
            # the first place of each string in each text
            _, first = np.unique(doc << 24 | codes[at], return_index=True)
            for k in first.tolist():
                d, begin = int(doc[k]), int(at[k] - start[doc[k]])
                out += [(d, item, n, begin, begin + n, 0) for item in self.items[n][int(codes[at[k]])]]
        return out


class _Part:
    def __init__(self, p: Passages, bits: int = 22):
        self.p, self.bits = p, np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self._slot(p.grams)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        p = self.p
        data = np.frombuffer(GAP.join(texts) + GAP, np.uint8)
        start = np.cumsum([0] + [len(t) + Q for t in texts])
        grams = grams_of(data, p.q)
        at = np.flatnonzero(self.table[self._slot(grams)])
        slot = np.searchsorted(p.grams, grams[at])
        slot[slot == len(p.grams)] = 0
        same = p.grams[slot] == grams[at]
        at, slot = at[same], slot[same]
        times = p.first[slot + 1] - p.first[slot]
        posting = np.repeat(p.first[slot] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        at = np.repeat(at, times)
        passage, place = p.passage[posting], p.place[posting]
        doc = np.searchsorted(start, at, "right") - 1
        pair = doc * len(p.texts) + passage
        # a pair of text and passage with too few hits in all has no band with enough
        _, of, times = np.unique(pair, return_inverse=True, return_counts=True)
        enough = times[of] >= p.least[passage]
        at, passage, place, doc, pair = at[enough], passage[enough], place[enough], doc[enough], pair[enough]
        if not len(at):
            return []
        step = p.budget[passage] + 1
        diagonal = at - start[doc] - place
        lead = p.texts and max(map(len, p.texts))
        band = (diagonal + lead) // step + 1
        top = int(band.max()) + 2
        keys, counts = np.unique(np.concatenate([pair * top + band, pair * top + band - 1]), return_counts=True)
        pairs, bands = keys // top, keys % top
        keep = counts >= p.least[pairs % len(p.texts)]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        longest: dict[tuple[int, int], int] = {}
        pairs, bands = pairs[keep], bands[keep]
        order = np.argsort(-np.array([len(t) for t in p.texts])[pairs % len(p.texts)], kind="stable")
        for pair_, band_ in zip(pairs[order].tolist(), bands[order].tolist()):
            d, k = divmod(pair_, len(p.texts))
            item = (d, int(p.items[k]))
            if len(p.texts[k]) < longest.get(item, 0):
                continue
            e = int(p.budget[k])
            low = (band_ - 1) * (e + 1) - lead
            found = verify(p.texts[k], e, data[start[d] : start[d + 1] - Q], low, low + 2 * (e + 1) - 1, p.q)
            if found and ((d, k) not in best or (found[2], found[0]) < (best[d, k][2], best[d, k][0])):
                best[d, k] = found
                longest.setdefault(item, len(p.texts[k]))
        return [(d, int(p.items[k]), len(p.texts[k]), *v) for (d, k), v in best.items()]


def _batches(texts: Iterable, most: int = 500_000) -> Iterator[tuple[int, list[bytes]]]:
    held, size, at = [], 0, 0
    for k, t in enumerate(texts):
        data = normal(t) if t else b""
        if held and size + len(data) > most:
            yield at, held
            held, size, at = [], 0, k
        held.append(data)
        size += len(data)
    if held:
        yield at, held


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.1, window: int = 400, stretch: int = 200) -> DataFrame:
    """One row for each document (doc_id, text) and benchmark item (item_id, text) of which it holds a
    passage with at most edit_share edits per byte: doc_id, item_id, begin, end (bytes of the normal
    form of the text, see `normal`), edits, passage_bytes; the longest passage, then the one with the
    fewest edits, then the first.  An item's passages are the whole item (over 2*window bytes:
    overlapping passages of `window` bytes) and all stretches of `stretch` bytes at a sixth of that; an
    item of under ten bytes is found where it stands as it is, and one of under four where it is a word
    of its own.  Null and empty texts hold nothing; other columns are ignored.
    Rows of docs with null or equal doc_id have rows of their own; texts with the same item_id are
    passages of one item."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for block in blocks(benchmark, edit_share, window, stretch=stretch):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            scan = Scanner(shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows: dict[tuple[int, int], tuple] = {}
                for at, texts in _batches(texts_of(batch.column(1))):
                    for d, item, size, begin, end, edits in scan.find(texts):
                        key, row = (at + d, item), (-size, edits, begin, end)
                        rows[key] = min(row, rows.get(key, row))
                if rows:
                    out = [(ids[d], item, begin, end, edits, -size) for (d, item), (size, edits, begin, end) in rows.items()]
                    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in LEAKS.split(", ")])

        found = slim.mapInArrow(tidy(run), LEAKS)
        result = found if result is None else result.unionByName(found)
    return slim.limit(0).select("doc_id", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in LEAKS.split(", ")[1:])) if result is None else result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.1, window: int = 400, stretch: int = 200) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark (see find_leaks), all columns unchanged."""
    text_at = docs.columns.index("text")
    for block in blocks(benchmark, edit_share, window, stretch=stretch):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            scan = Scanner(shared.value)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for at, texts in _batches(texts_of(batch.column(text_at))):
                    keep[[at + row[0] for row in scan.find(texts)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
