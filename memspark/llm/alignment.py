"""Alignment of two tokenizers over whole documents, and corpus-wide counts of linked id pairs
through minimal perfect hashing.

Both tokenizers encode a space and the text.  No token of either reaches over a single space that
stands between two other characters (a piece of the second has its space in front only), so a text
is cut there into units, each distinct unit is aligned once by a worker, and a document is the sum
of its units.

First pass: the documents give distinct linked pairs with their number of documents, as chunks that
are dealt into buckets by the first id.  In each bucket the distinct keys get a minimal perfect hash;
tasks add the chunks into dense count vectors indexed by it, and the vectors are summed as a tree.
Second pass: the documents are aligned again and look their pairs up, each verified by its key.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, small_batches, written
from .encode import SPLIT, UnitEncoder, _Flat, _Units, blocks

CHUNK = "bucket int, part long, keys binary, counts binary"
VECTORS = "bucket int, levels binary, keys binary, counts binary"
TABLE = "bucket int, n long, levels binary, keys binary, counts binary, best binary"
SUMS = "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


# -- minimal perfect hashing ---------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of uint64 keys (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PairHash:
    """Distinct keys -> 0..n-1 by levels of bit arrays: a key that is alone at its place of a level
    has its index from the bits before it; the others go on to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # uint64 words of each level
        self.ranks, at = [], 0
        for words in levels:
            ones = np.cumsum(np.bitwise_count(words).astype(np.int64))
            self.ranks.append(at + ones - np.bitwise_count(words))
            at += int(ones[-1])
        self.n = at

    @classmethod
    def build(cls, keys: np.ndarray) -> PairHash:
        left, levels = np.asarray(keys, np.uint64), []
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            place = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of a key that isn't in the set, any index or -1."""
        keys = np.asarray(keys, np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            place = mixed(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            found = (words[word] >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = (ranks[word] + before)[found]
            left = left[~found]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.levels)}I", len(self.levels), *map(len, self.levels)) + b"".join(w.tobytes() for w in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PairHash:
        (n,) = struct.unpack_from("<I", data)
        sizes = struct.unpack_from(f"<{n}I", data, 4)
        ends = list(itertools.accumulate(sizes, initial=0))
        words = np.frombuffer(data, "<u8", ends[-1], 4 + 4 * n)
        return cls([words[a:b] for a, b in zip(ends[:-1], ends[1:])])


def bucket_of(first: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(first, 99) % np.uint64(buckets)).astype(np.int64)


class PairCounts:
    """Counts of id pairs by bucket: lookup() of keys, each verified."""

    def __init__(self, rows: list, second: int, buckets: int):
        self.second, self.buckets = second, buckets
        self.tables = {r["bucket"]: (PairHash.from_bytes(bytes(r["levels"])), np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["best"], np.bool_)) for r in rows}

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of its first id); 0 and false of pairs of other buckets."""
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.bool_)
        where = bucket_of(keys // self.second, self.buckets)
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(self.buckets + 1))
        for b, (hashed, own, count, top) in self.tables.items():
            here = order[edges[b] : edges[b + 1]]
            if not len(here):
                continue
            at = hashed.index(keys[here])
            right = (at >= 0) & (own[at] == keys[here])
            counts[here[right]], best[here[right]] = count[at[right]], top[at[right]]
        return counts, best


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


# -- alignment of units --------------------------------------------------------------------------


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others are numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def first_vocabulary(path: str) -> tuple[UnitEncoder, list[bytes]]:
    """A byte-level tokenizer, and the bytes of each of its ids."""
    encoder, alphabet = UnitEncoder(path), byte_alphabet()
    entries = encoder.tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, number in entries.items():
        out[number] = bytes(map(alphabet.__getitem__, entry)) if all(c in alphabet for c in entry) else entry.encode()
    return encoder, out


def second_vocabulary(path: str):
    """A sentencepiece model that sets a space before a text, and the bytes of each of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    one = re.compile(r"<0x([0-9A-F]{2})>\Z")
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return model, [bytes([int(m[1], 16)]) if model.is_byte(k) and (m := one.match(p)) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]


class Aligner:
    """Aligned units of texts; the cache of units is bounded.  counts: PairCounts to look up.
    groups: keep each unit's groups as text."""

    def __init__(self, first: str, second: str, counts: PairCounts | None = None, groups: bool = False, max_units: int = 700_000, max_chars: int = 18_000_000):
        self.a, self.a_bytes = first_vocabulary(first)
        self.b, self.b_bytes = second_vocabulary(second)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.second = len(self.b_bytes)
        self.counts, self.groups = counts, groups
        self.max_units, self.max_chars = max_units, max_chars
        plain = type(self.a.tokenizer).from_file(first)
        plain.encode_special_tokens = True
        self.plain = plain
        self._reset()

    def _reset(self) -> None:
        self.units, self.seen = _Units(), 0
        self.keys, self.start, self.links = _Flat(np.int64), _Flat(np.int64), _Flat(np.int64)
        self.of_unit = {c: _Flat(np.int64) for c in NUMBERS}
        self.bad, self.loose = _Flat(np.bool_), _Flat(np.bool_)
        self.said: list[str] = []

    def _first_ids(self, bare: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each unit; special tokens' strings are plain text."""
        odd = [k for k, u in enumerate(bare) if self.a.mark[0] in u]
        if not odd:
            return self.a._by_mark(bare)
        clean = list(bare)
        for k in odd:
            clean[k] = ""
        ids, lengths = self.a._by_mark(clean)
        rows = np.split(ids, np.cumsum(lengths)[:-1])
        for k in odd:
            rows[k] = np.array(self.plain.encode(bare[k], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

    def _learn(self) -> None:
        queue, self.units.queue = self.units.queue, []
        for at in range(0, len(queue), 20_000):
            self._align(queue[at : at + 20_000])

    def _align(self, units: list[str]) -> None:
        n = len(units)
        bare = [" " + u for u in units]
        a, a_n = self._first_ids(bare)
        a = a.astype(np.int64)
        rows = self.b.encode(units, num_threads=1)
        b_n = np.fromiter(map(len, rows), np.int64, n)
        b = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(b_n.sum()))
        raw = [u.encode() for u in bare]
        size = np.fromiter(map(len, raw), np.int64, n)
        bad = np.zeros(n, np.bool_)
        for ids, count, table, sizes in ((a, a_n, self.a_bytes, self.a_size), (b, b_n, self.b_bytes, self.b_size)):
            whole = np.add.reduceat(np.append(sizes[ids], 0), np.minimum(np.cumsum(count) - count, len(ids))) * (count > 0)
            if (whole != size).any() or b"".join(map(table.__getitem__, ids.tolist())) != b"".join(raw):
                ends = np.cumsum(count).tolist()
                held = ids.tolist()
                for k, (lo, hi) in enumerate(zip([0, *ends], ends)):
                    bad[k] |= b"".join(map(table.__getitem__, held[lo:hi])) != raw[k]
        if bad.any():
            a, b = a[~np.repeat(bad, a_n)], b[~np.repeat(bad, b_n)]
            a_n, b_n, size = a_n * ~bad, b_n * ~bad, size * ~bad
        unit_ends = np.cumsum(size)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # between two neighbouring ends lies one overlap of one token of each side
        ends = distinct(np.concatenate([a_ends, b_ends]))
        i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        keys = a[i] * self.second + b[j]
        both = (a_ends[i] == ends) & (b_ends[j] == ends)
        good = np.flatnonzero(~bad)
        unit = good[np.searchsorted(unit_ends[good], ends)] if len(ends) else np.zeros(0, np.int64)
        links = np.bincount(unit, minlength=n)
        values = {"n_a": a_n, "n_b": b_n, "n_groups": np.bincount(unit[both], minlength=n), "n_links": links}
        if self.counts is not None:
            count, best = self.counts.lookup(keys)
            sums = np.zeros(n, np.int64)
            np.add.at(sums, unit, count)
            values |= {"n_best": np.bincount(unit[best], minlength=n), "count_sum": sums}
        for c, v in values.items():
            self.of_unit[c].extend(v)
        self.start.extend(self.keys.n + np.cumsum(links) - links)
        self.links.extend(links)
        self.keys.extend(keys if self.counts is None else keys[:0])
        self.bad.extend(bad)
        self.loose.extend([u == "" or u[0].isspace() or u[-1].isspace() for u in units])
        if self.groups:
            self.said += self._texts(a, b, a_ends, b_ends, ends[both], unit_ends, n)
        self.seen += sum(map(len, bare))

    def _texts(self, a, b, a_ends, b_ends, common, unit_ends, n: int) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each unit."""
        ids, ends = np.concatenate([a, b]), np.concatenate([a_ends, b_ends])
        side = np.repeat([0, 1], [len(a), len(b)])
        group = np.searchsorted(common, ends)
        order = np.lexsort((ends, side, group))
        ids, ends, side, group = ids[order], ends[order], side[order], group[order]
        last = np.append(group[1:] != group[:-1], True)
        # 0 a comma, 1 a bar, 2 a semicolon, 3 the end of a unit
        sign = np.where(last, 2 + np.isin(ends, unit_ends), np.append(side[1:] != side[:-1], False))
        parts = [""] * (2 * len(ids))
        parts[::2] = map(str, ids.tolist())
        parts[1::2] = map(",|;\n".__getitem__, sign.tolist())
        found = iter("".join(parts).split("\n"))
        empty = np.diff(unit_ends, prepend=0) == 0
        return ["" if none else next(found) for none in empty.tolist()]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers of all texts, how many each text has); an empty text has one."""
        if len(self.units) > self.max_units or self.seen > self.max_chars:
            self._reset()
        split = [t.split(" ") for t in texts]
        got = self._numbers(split)
        at = np.cumsum(got[1]) - got[1]
        loose = np.flatnonzero(np.logical_or.reduceat(self.loose.data[got[0]], at))
        if not len(loose):
            return got
        for k in loose.tolist():
            split[k] = SPLIT.split(texts[k])
        return self._numbers(split)

    def _numbers(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(self.units.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
        self._learn()
        return flat, sizes

    def valid(self, texts: list[str], flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a text has tokens: it isn't empty, and both token sequences spell it."""
        return ~np.logical_or.reduceat(self.bad.data[flat], at) & np.fromiter(map(bool, texts), np.bool_, len(texts))

    def pairs(self, texts: list[str]) -> np.ndarray:
        """The distinct linked pairs of each text, of all texts one after another."""
        flat, sizes = self.numbers(texts)
        valid = self.valid(texts, flat, np.cumsum(sizes) - sizes)
        doc = np.repeat(np.arange(len(texts)), sizes)
        keep = valid[doc]
        once = distinct(doc[keep] << 32 | flat[keep])
        doc, unit = once >> 32, once & 0xFFFFFFFF
        n = self.links.data[unit]
        source = np.repeat(self.start.data[unit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        span = len(self.a_bytes) * self.second
        return distinct(np.repeat(doc, n) * span + self.keys.data[source]) % span

    def documents(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str]]:
        """(the numbers, the groups as text) of each text."""
        flat, sizes = self.numbers(texts)
        at = np.cumsum(sizes) - sizes
        valid = self.valid(texts, flat, at)
        sums = {c: np.add.reduceat(self.of_unit[c].data[flat], at) * valid for c in NUMBERS}
        if not self.groups:
            return sums, [""] * len(texts)
        held = flat.tolist()
        return sums, [";".join(map(self.said.__getitem__, held[a : a + n])) if ok else "" for a, n, ok in zip(at.tolist(), sizes.tolist(), valid.tolist())]


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(first: str, second: str, own: object = None, **more) -> Aligner:
    """A worker's aligner for these tokenizers and this table of counts, kept for its later tasks."""
    key = (first, second, own)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        give_back()
        _ALIGNERS[key] = Aligner(first, second, **more)
    return _ALIGNERS[key]


# -- counting ------------------------------------------------------------------------------------


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def row(names: str, *values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(values, fields)], [name for name, _ in fields])


def pair_chunks(docs: DataFrame, first: str, second: str, buckets: int, most: int = 2_000_000) -> DataFrame:
    """The distinct linked pairs of documents with their number of documents: a row a bucket of each
    chunk of documents that has about `most` of them."""

    def run(batches):
        from pyspark import TaskContext

        use = aligner(first, second)
        keys, counts, held, part = [], [], 0, TaskContext.get().partitionId() << 20

        def emit():
            nonlocal keys, counts, held, part
            k, c = summed(keys, counts)
            where = bucket_of(k // use.second, buckets)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1)).tolist()
            for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                if lo < hi:
                    yield row(CHUNK, b, part, k[order[lo:hi]].tobytes(), c[order[lo:hi]].tobytes())
            keys, counts, held, part = [], [], 0, part + 1

        for batch in batches:
            for at in range(0, len(batch), 256):
                texts = [t or "" for t in batch.column(0).slice(at, 256).to_pylist()]
                for a, b in blocks(texts):
                    found = use.pairs(texts[a:b])
                    if len(found):
                        keys.append(found)
                        counts.append(np.ones(len(found), np.int64))
                        held += len(found)
                    if held >= most:
                        k, c = summed(keys, counts)
                        keys, counts, held = [k], [c], len(k)
                        if 2 * held >= most:
                            yield from emit()
        if keys:
            yield from emit()
        give_back()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK)


def by_key(batches, keys: int):
    """(key, rows) of batches that are sorted by their first `keys` columns."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    yield from itertools.groupby(rows(), key=lambda r: r[:keys])


def count_pairs(docs: DataFrame, first: str, second: str, buckets: int = 64, fan: int = 8) -> DataFrame:
    """Corpus-wide counts (in how many documents) of linked pairs, a row a bucket: its number of
    pairs, the levels of their minimal perfect hash, and vectors of keys, counts and whether a count
    is the highest of its first id, indexed by it.  All pairs of a first id share a bucket."""
    chunks = written(pair_chunks(docs, first, second, buckets), "pair-chunks")
    width = second_size(second)
    salt = F.pmod(F.xxhash64("part"), F.lit(fan)).cast("int")

    def unite(batches):
        for (b, *_), group in by_key(batches, 1):
            keys = np.zeros(0, np.int64)
            for part in group:
                keys = distinct(np.concatenate([keys, np.frombuffer(part[-1], "<i8")]))
            yield row("bucket int, keys binary", b, keys.tobytes())

    def build(batches):
        for (b, *_), group in by_key(batches, 1):
            keys = np.zeros(0, np.int64)
            for part in group:
                keys = distinct(np.concatenate([keys, np.frombuffer(part[-1], "<i8")]))
            hashed = PairHash.build(keys)
            own = np.zeros(len(keys), np.int64)
            own[hashed.index(keys)] = keys
            yield row("bucket int, levels binary, keys binary", b, hashed.to_bytes(), own.tobytes())

    keys = chunks.select((F.col("bucket") * fan + salt).alias("bucket"), "keys").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(unite, "bucket int, keys binary")
    keys = keys.select((F.col("bucket") / fan).cast("int").alias("bucket"), "keys").repartition("bucket").sortWithinPartitions("bucket")
    hashes = written(keys.mapInArrow(build, "bucket int, levels binary, keys binary"), "pair-hashes")

    def dense(batches):
        """Each bucket's hash comes first, then its chunks."""
        for (b, _), group in by_key(batches, 2):
            _, _, _, levels, own, _ = next(group)
            hashed, own = PairHash.from_bytes(levels), np.frombuffer(own, "<i8")
            vector = np.zeros(len(own), np.int64)
            for _, _, _, _, k, c in group:
                k = np.frombuffer(k, "<i8")
                at = hashed.index(k)
                if not (own[at] == k).all():
                    raise ValueError("a key isn't in its minimal perfect hash")
                vector[at] += np.frombuffer(c, "<i8")  # the keys of a chunk are distinct
            yield row("bucket int, counts binary", b, vector.tobytes())

    none = F.lit(None).cast("binary")
    heads = hashes.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("salt"), F.lit(0).alias("kind"), "levels", "keys", none.alias("counts"))
    parts = heads.unionByName(chunks.select("bucket", salt.alias("salt"), F.lit(1).alias("kind"), none.alias("levels"), "keys", "counts"))
    vectors = parts.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind").mapInArrow(dense, "bucket int, counts binary")

    def finish(batches):
        """Each bucket's hash comes first, then its vectors."""
        for (b,), group in by_key(batches, 1):
            _, _, levels, own, _ = next(group)
            keys = np.frombuffer(own, "<i8")
            counts = np.zeros(len(keys), np.int64)
            for *_, c in group:
                counts += np.frombuffer(c, "<i8")
            ids, inverse = np.unique(keys // width, return_inverse=True)
            most = np.zeros(len(ids), np.int64)
            np.maximum.at(most, inverse, counts)
            yield row(TABLE, b, len(keys), levels, own, counts.tobytes(), (counts == most[inverse]).tobytes())

    heads = hashes.select("bucket", F.lit(0).alias("kind"), "levels", "keys", none.alias("counts"))
    parts = heads.unionByName(vectors.select("bucket", F.lit(1).alias("kind"), none.alias("levels"), none.alias("keys"), "counts"))
    table = written(parts.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(finish, TABLE), "pair-counts")
    discard(chunks, hashes)
    return table


@functools.cache
def second_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def bucket_groups(table: DataFrame, most: int) -> list[list[int]]:
    """Buckets in groups of at most `most` pairs (a bucket of more is a group of its own)."""
    out: list[list[int]] = [[]]
    size = 0
    for r in table.select("bucket", "n").orderBy("bucket").collect():
        if out[-1] and size + r.n > most:
            out.append([])
            size = 0
        out[-1].append(r.bucket)
        size += r.n
    return out


def align(docs: DataFrame, first: str, second: str, buckets: int = 64, broadcast_pairs: int = 4_000_000) -> DataFrame:
    """Alignment of docs (doc_id, text; other columns are ignored) by a byte-level tokenizers file and
    a sentencepiece model that sets a space in front, one row a document: doc_id, n_a, n_b (tokens),
    n_groups (between byte offsets at which tokens of both end), n_links (pairs of tokens whose bytes
    overlap), n_best (links whose count is the highest of their first id), count_sum (of the links'
    counts), groups (a1,a2|b1;a3|b2,b3).  A pair's count is the number of documents that hold it.

    A null or empty text, and one that either token sequence doesn't spell (as U+2581 in it), has
    zeros and empty groups, and counts nowhere.  Rows with null or equal doc_id are documents of
    their own.

    The counts are broadcast where they have at most broadcast_pairs pairs (17 bytes each).  With
    more, groups of buckets of that size are looked up one after another, each by a pass over the
    documents, and a document's sums are added up."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = count_pairs(docs, first, second, buckets)
    groups = bucket_groups(table, broadcast_pairs)
    names = [c.split()[0] for c in SUMS.split(", ")]
    if len(groups) == 1:
        found = looked_up(docs.withColumn("row_key", F.lit(None).cast("long")), table, first, second, buckets, True)
    else:
        docs = written(docs.withColumn("row_key", F.monotonically_increasing_id()), "aligned-docs")
        parts = [looked_up(docs, table.where(F.col("bucket").isin(g)), first, second, buckets, k == 0) for k, g in enumerate(groups)]
        every = functools.reduce(DataFrame.unionByName, parts)
        once = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")]
        found = every.groupBy("row_key").agg(*once, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select(*names[1:])


def looked_up(docs: DataFrame, table: DataFrame, first: str, second: str, buckets: int, groups: bool) -> DataFrame:
    rows = [r.asDict() for r in table.collect()]  # at most broadcast_pairs pairs
    sent, width = docs.sparkSession.sparkContext.broadcast(rows), second_size(second)
    key = uuid.uuid4().hex

    def run(batches):
        use = aligner(first, second, key, groups=groups)
        if use.counts is None:
            use.counts = PairCounts(sent.value, width, buckets)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(2).to_pylist()]
                for a, b in blocks(texts):
                    sums, said = use.documents(texts[a:b])
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), part.column(1).slice(a, b - a), *(pa.array(sums[c]) for c in NUMBERS), pa.array(said, pa.string())], [c.split()[0] for c in SUMS.split(", ")])
        give_back()

    return docs.select("row_key", "doc_id", "text").mapInArrow(run, SUMS)
