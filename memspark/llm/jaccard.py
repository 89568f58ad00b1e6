"""Exact Jaccard join of word-shingle sets by universe partitions and the pigeonhole principle.

A set's size decides its band.  For a band, the universe of shingles is cut into m segments by a
hash.  Two linked sets differ in at most H elements, so among more than H segments one is equal;
where a segment is also indexed by its one-deletion neighbourhood, it needs two differences to be
missed.  Each set is indexed for its band and for the next lower one, so that every linked pair
meets under the band of its smaller set.  Pairs that share a key are verified exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, flat_bytes, runs_by_size, texts_of, tidy, written
from .components import components
from .repeats import _mix, _Sums

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHANCE = 1e-5  # that a set has a given shingle of an unrelated set, for the cost of segments
MEETING = 2.0  # cost of a chance meeting, where a key costs 1
HOT = 2000  # sets of a key in one task


@dataclass(frozen=True)
class Plan:
    """Of a band: sizes low..high, m segments, of which the first `near` have deletion neighbourhoods,
    and the number of empty segments up to which empty ones need no key."""

    low: int
    high: int
    m: int
    near: int
    spare: int


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, text of each) of texts in an array of bytes; A-Z counts as a-z, a word
    is a run of bytes other than space, tab, line feed, vertical tab, form feed, carriage return."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = LOWER[data]
    gap = SPACE[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    inner = ends[1:-1][ends[1:-1] < len(data)]
    begins[inner] = ~gap[inner]  # a word doesn't reach into the next text
    stops = ~gap
    stops[:-1] &= gap[1:]
    stops[inner[inner > 0] - 1] = ~gap[inner[inner > 0] - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    count = np.diff(np.searchsorted(begin, ends))
    return _Sums(data)(begin, end), np.repeat(np.arange(len(ends) - 1), count)


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each), sorted by text and hash: the distinct shingles of `words` words of each
    text; fewer words make one shingle, none make none."""
    h, text = word_hashes(data, ends)
    n = len(h)
    count = np.bincount(text, minlength=len(ends) - 1)
    first = np.cumsum(count) - count
    last = first + count
    begin = np.arange(n)
    full = begin + words <= last[text] if n else np.zeros(0, bool)
    short = (begin == first[text]) & (count[text] < words) if n else np.zeros(0, bool)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        there = begin + k < last[text]
        nxt = np.minimum(begin + k, n - 1)
        total = np.where(there, (total + h[nxt]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1), total)
    keep = full | short
    shingle, text = _mix(total[keep]), text[keep]
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    return shingle[new], text[new]


def _cost(size: int, h: int, m: int, sets: float) -> tuple[float, int, int]:
    """Cost of a set of `size` elements for m segments: its keys, each of which is shuffled, and the sets
    that it meets under them by chance; with how many near ones, and spare.  A segment has binomially
    many elements, and shares them all with a set by CHANCE for each."""
    near, spare = max(0, h + 1 - m), 0
    p = np.array([math.exp(math.lgamma(size + 1) - math.lgamma(g + 1) - math.lgamma(size - g + 1) - g * math.log(m) + ((size - g) * math.log1p(-1 / m) if m > 1 else 0.0 if g == size else -math.inf)) for g in range(min(size, 60) + 1 if m > 1 else size + 1)])
    if near == 0:
        spare = m - h - 1
        if spare < m * p[0]:
            return math.inf, 0, 0
    g = np.arange(len(p))
    alike = CHANCE ** np.minimum(g, 30)
    plain = 1 + MEETING * sets * float((p * alike)[1:].sum())
    # of a segment of one element, the neighbourhood is the empty segment, which empty ones have, too
    empty = float(p[0] + (p[1] if len(p) > 1 else 0)) ** 2
    deleted = 1 + size / m + MEETING * sets * (float((p * g * CHANCE ** np.clip(g - 1, 0, 30))[2:].sum()) + empty)
    return (m - near) * plain + near * deleted, near, spare


@lru_cache(maxsize=100_000)
def plan(band: int, percent: int, sets: int) -> Plan:
    """The cheapest segments for a band: sizes and the bound on differences follow from percent, the
    split into plain segments and segments with deletion neighbourhoods from the cost."""
    low, high = band_sizes(band, percent)
    h = high * (100 - percent) // percent
    if h == 0:
        return Plan(low, high, 1, 0, 0)
    best = min(((*_cost(low, h, m, float(sets)), m) for m in range((h + 2) // 2, h + 2 + max(2, h // 3)) if m >= 1), key=lambda x: (x[0], x[3]))
    return Plan(low, high, best[3], best[1], best[2])


@lru_cache(maxsize=100_000)
def band_sizes(band: int, percent: int) -> tuple[int, int]:
    low = 1 if band == 0 else band_sizes(band - 1, percent)[1] + 1
    return low, low * 100 // percent


def band_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    highs, top = [], int(sizes.max(initial=0))
    while not highs or highs[-1] < top:
        highs.append(band_sizes(len(highs), percent)[1])
    return np.searchsorted(highs, sizes)


def keys_of(shingle: np.ndarray, owner: np.ndarray, n_sets: int, percent: int, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set of each): the index keys of sets given by their shingles."""
    size = np.bincount(owner, minlength=n_sets)
    band = band_of(size, percent)
    where, value = _mix(shingle ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32), _mix(shingle + np.uint64(0x14057B7EF767814F))
    out, of = [], []
    for lower in (0, 1):
        b = band - lower
        plans = {int(x): plan(int(x), percent, sets) for x in np.unique(b) if x >= 0}
        table = np.zeros((max([0, *plans]) + 1, 3), np.int64)
        for x, p in plans.items():
            # a band of equal sets only needs no keys
            table[x] = (0, 0, 0) if p.high * (100 - percent) // percent == 0 else (p.m, p.near, p.spare)
        m, near, spare = table[np.maximum(b, 0)].T
        m = np.where((b >= 0) & (size > 0), m, 0)
        at = np.cumsum(m) - m
        mine = m[owner] > 0
        own, val = owner[mine], value[mine]
        segment = (where[mine] * m[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = at[own] + segment
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, slot, val)
        filled = np.bincount(slot, minlength=len(total))
        set_of = np.repeat(np.arange(n_sets), m)
        number = np.arange(len(total)) - at[set_of]
        salt = _mix((b[set_of] * 1_000_003 + number).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        empties = np.bincount(set_of[filled == 0], minlength=n_sets)
        # sets that share no filled segment share more empty ones than are spare
        keep = (filled > 0) | (near[set_of] > 0) | (empties > spare)[set_of]
        out.append(_mix(total[keep] ^ salt[keep]))
        of.append(set_of[keep])
        shorter = segment < near[own]
        s = slot[shorter]
        out.append(_mix((total[s] - val[shorter]) ^ salt[s]))
        of.append(own[shorter])
    return np.concatenate(out), np.concatenate(of)


SETS = "doc_id long, row long, n int, s1 long, s2 long, sketch binary, keys array<long>"
SKETCH_WORDS = 128  # 64-bit words of the longest sketch


def sketches(shingle: np.ndarray, owner: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity sketches: bit k tells whether an odd number of the set's elements hash to k.  Two
    sketches differ in no more bits than the sets in elements.  A sketch has at least 1.5 bits for
    each element, a power of two of words; halves can be folded onto each other."""
    words = np.minimum(SKETCH_WORDS, 2 ** np.ceil(np.log2(np.maximum(size * 1.5 / 64, 1))).astype(np.int64))
    at = np.cumsum(words) - words
    h = _mix(shingle * np.uint64(7))
    word = at[owner] + ((h >> np.uint64(6)) % words[owner].astype(np.uint64)).astype(np.int64)
    flat = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(flat, word, np.uint64(1) << (h & np.uint64(63)))
    return [flat[a : a + w].tobytes() for a, w in zip(at.tolist(), words.tolist())]


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch (or rows of them) at a smaller number of words."""
    return np.bitwise_xor.reduce(sketch.reshape(*sketch.shape[:-1], -1, words), axis=-2)


def may_link(n_a, n_b, bits, percent: int):
    """Whether sets of these sizes whose sketches differ in so many bits can link: at most
    n_a+n_b-2*both elements differ, where both is at least percent/(100+percent) of n_a+n_b."""
    total = n_a + n_b
    return bits <= total - 2 * (-(-percent * total // (100 + percent)))


def shingled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """For each row of docs (doc_id, row, text): the size of its set and a 128-bit hash of the set; also
    its keys and its sketch, but of equal sets of a batch only for the first row."""
    sets = 10 ** round(math.log10(max(1, docs.count())))  # the costs need no more than its size

    def run(batches):
        for batch in batches:
            doc, row = batch.column(0), batch.column(1).to_numpy()
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            # rows of smaller doc_id first: they stand for equal ones
            rank = np.lexsort((row, doc.fill_null(0).to_numpy()))
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            data, ends = flat_bytes(batch.column(2))
            seen: dict[tuple, int] = {}
            parts = []
            for a, b in runs_by_size(ends, 500_000):
                shingle, owner = shingle_sets(np.ascontiguousarray(data[ends[a] : ends[b]]), ends[a : b + 1] - ends[a], words)
                n = b - a
                s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(s1, owner, _mix(shingle * np.uint64(3)))
                np.add.at(s2, owner, _mix(shingle ^ np.uint64(0xA0761D6478BD642F)))
                size = np.bincount(owner, minlength=n)
                first = np.zeros(n, bool)
                for k in np.flatnonzero((size > 0) & known[a:b]).tolist():
                    mark = (int(s1[k]), int(s2[k]))
                    if mark not in seen or place[a + k] < place[seen[mark]]:
                        seen[mark] = a + k
                        first[k] = True
                keep = first[owner]
                number = np.cumsum(first) - 1
                own, of_first = shingle[keep], number[owner[keep]]
                total = int(first.sum())
                keys, of = keys_of(own, of_first, total, percent, sets)
                order = np.argsort(of, kind="stable")
                n_keys = np.zeros(n, np.int64)
                n_keys[first] = np.bincount(of, minlength=total)
                cut = np.concatenate([[0], np.cumsum(n_keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(keys[order].view(np.int64)))
                marks = iter(sketches(own, of_first, size[first]))
                mine = slice(a, b)
                parts.append(pa.RecordBatch.from_arrays([doc[mine], pa.array(row[mine]), pa.array(size.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([next(marks) if f else None for f in first], pa.binary()), lists], [c.split()[0] for c in SETS.split(", ")]))
            yield from parts

    return written(docs.select("doc_id", "row", "text").mapInArrow(tidy(run), SETS), "shingled")


def item_sets(docs: DataFrame, wanted: DataFrame, words: int, bits: int = 1 << 22) -> DataFrame:
    """(node, items): the sets, as sorted 64-bit hashes, of those rows of docs (doc_id, row, text) that
    wanted (node, doc_id, row) asks for.  A table of fixed size of their hashes lets the other rows go
    before they are shuffled."""
    slot = lambda doc, row: (_mix((doc ^ (row << 1)).view(np.uint64)) % np.uint64(bits)).view(np.int64)

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slot(*(c.to_numpy() for c in batch.columns))).astype(np.int32))], ["slot"])

    table = np.zeros(bits, bool)
    table[wanted.select("doc_id", "row").mapInArrow(tidy(mark), "slot int").distinct().toArrow()["slot"].to_numpy()] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def sets(batches):
        known = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(known[slot(batch.column(0).to_numpy(), batch.column(1).to_numpy())]))
            data, ends = flat_bytes(batch.column(2))
            for a, b in runs_by_size(ends, 500_000):
                shingle, owner = shingle_sets(np.ascontiguousarray(data[ends[a] : ends[b]]), ends[a : b + 1] - ends[a], words)
                cut = np.searchsorted(owner, np.arange(b - a + 1)) * 8
                if cut[-1] >> 31:
                    raise ValueError("a text of over 2**28 distinct shingles")
                items = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(shingle)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], items], ["doc_id", "row", "items"])

    found = docs.select("doc_id", "row", "text").where("doc_id is not null").mapInArrow(tidy(sets), "doc_id long, row long, items binary")
    # equal rows of docs have equal sets; they meet by the keys of the join, so sets are shuffled once
    return written(found.dropDuplicates(["doc_id", "row"]).join(wanted, ["doc_id", "row"]).select("node", "items"), "items")


def verified(items: DataFrame, pairs: DataFrame, percent: int, block: int = 128) -> DataFrame:
    """Those pairs (a, b: nodes) whose sets have 100*intersection >= percent*union.  The set of `a` meets
    its partners in blocks of about `block`, so that a set with very many is spread over tasks."""
    pairs = pairs.select("a", "b")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    named = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("part"))
    roles = named.select(F.col("b").alias("node"), "a", "part", F.lit(1).alias("role")).unionByName(
        blocks.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(0).alias("role"))
    )

    def check(batches):
        current, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            ids = [c.to_pylist() for c in batch.columns[:4]]
            for a, part, role, node, data in zip(*ids, texts_of(batch.column(4))):
                own = np.frombuffer(data, np.uint64)
                if role == 0:
                    current, held = (a, part), own
                    continue
                assert current == (a, part)
                both = np.count_nonzero(held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own) if len(held) else 0
                if both and 100 * both >= percent * (len(own) + len(held) - both):
                    out_a.append(a)
                    out_b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    met = roles.join(items, "node").select("a", "part", "role", "node", "items").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return written(met.mapInArrow(tidy(check), "a long, b long"), "links")


PAIRS = "a long, b long"


def plausible(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sketches don't exclude a link.  own: node, n, sketch."""

    def run(batches):
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            bits = np.zeros(len(batch), np.int64)
            for k, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(x), len(y))
                bits[k] = np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()
            out = batch.filter(pa.array(may_link(n_a, n_b, bits, percent)))
            yield pa.RecordBatch.from_arrays(out.columns[:2], ["a", "b"])

    side = lambda s: own.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(tidy(run), PAIRS)


def candidates(members: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Pairs of sets under a key (key, part, node, n, c, sketch) that are of different components c and
    of different parts or part -1, and whose sizes and sketches don't exclude a link; of each set at
    most `nearest`, those of the most similar sketches, or all."""

    def run(batches):
        held: list = []

        def done(rows):
            key, part, node, n, c = (np.array(x, np.int64) for x in list(zip(*rows))[:5])
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            out: list[np.ndarray] = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                marks = [np.frombuffer(r[5], np.uint64) for r in rows[lo:hi]]
                w = min(map(len, marks))
                bank = np.stack([fold(m, w) for m in marks])
                p, r, size, comp = part[lo:hi], node[lo:hi], n[lo:hi], c[lo:hi]
                step = max(1, 1_000_000 // (len(r) * w))
                for k in range(0, len(r), step):
                    mine = slice(k, k + step)
                    bits = np.bitwise_count(bank[mine, None] ^ bank[None]).sum(2, dtype=np.int64)
                    ok = may_link(size[mine, None], size[None], bits, percent) & (comp[mine, None] != comp[None]) & ((p[mine, None] < 0) | (p[mine, None] != p[None]))
                    low, high = np.minimum(size[mine, None], size[None]), np.maximum(size[mine, None], size[None])
                    ok &= high * percent <= low * 100
                    if nearest is not None and len(r) > nearest:
                        bits = np.where(ok, bits, 1 << 40)
                        best = np.argpartition(bits, nearest - 1, axis=1)[:, :nearest]
                        chosen = np.zeros_like(ok)
                        np.put_along_axis(chosen, best, True, axis=1)
                        ok &= chosen
                    x, y = np.nonzero(ok)
                    out.append(np.stack([np.minimum(r[x + k], r[y]), np.maximum(r[x + k], r[y])], 1))
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        for batch in batches:
            held += zip(*(col.to_pylist() for col in batch.columns))
            if len(held) >= 20_000 and held[0][0] != held[-1][0]:
                cut = len(held)
                while held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                yield done(held[:cut])
                held = held[cut:]
        if held:
            yield done(held)

    ordered = members.repartition("key").sortWithinPartitions("key", "n")
    return ordered.select("key", "part", "node", "n", "c", "sketch").mapInArrow(tidy(run), PAIRS).distinct()


def in_parts(members: DataFrame) -> DataFrame:
    """members (key, node, size: how many the key has, ...) with `part`: keys of over HOT sets are cut
    into parts by a hash of the node, and each two parts get a key of their own, in which only sets of
    different parts meet; each part meets itself in one more (part -1)."""
    parts = F.ceil(F.col("size") / HOT).cast("int")
    hot = members.where(F.col("size") > HOT).withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    blocks = hot.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = blocks.withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    blocks = blocks.withColumn("part", F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part"))).drop("other")
    return members.where(F.col("size") <= HOT).withColumn("part", F.lit(-1)).unionByName(blocks)


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are ignored): doc_id, n_shingles and
    component_id, the smallest doc_id that it reaches over links, itself included.

    Two documents link when their sets of `words`-word shingles have 100*intersection >=
    percent*union.  A text without words has an empty set and links with nothing; equal sets link.
    Rows with a null doc_id are returned with a null component and link with nothing; of rows with
    the same doc_id, each is a row of the result, they share one component and all their links.

    Equal sets are one class, a node of the graph.  Pairs under a key go in rounds: the smallest set
    with each other, then each set with its nearest of other components, then all that are left, so
    that a large group of near copies is joined by few links; a pair is left out only if its sets are
    joined already or a bound excludes the link."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    table = shingled(slim, words, percent)
    set_of = ["n", "s1", "s2"]
    found = table.where("sketch is not null").repartition("s1").groupBy(*set_of).agg(F.min(F.struct("doc_id", "row")).alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys"))
    classes = written(found.select(F.monotonically_increasing_id().alias("node"), *set_of, "first.*", "sketch", "keys"), "classes")
    # what the result needs, without the keys, which are most of it
    whole, table = table, written(table.select("doc_id", *set_of), "sets")
    discard(whole)
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))

    # under each key: the first of the smallest sets and its partners
    by_key = Window.partitionBy("key")
    rows = keyed.withColumn("first", F.first(F.struct("n", "node")).over(by_key.orderBy("n", "node"))).withColumn("sets", F.count("*").over(by_key))
    rows = written(rows.where("sets > 1").select("key", "node", "n", "first"), "meetings")
    involved = written(classes.drop("keys").join(rows.select("node").distinct(), "node", "left_semi"), "involved")
    whole, classes = classes, written(classes.select("node", *set_of, "doc_id"), "class-sets")
    discard(whole)
    marks = involved.select("node", "n", "sketch")
    stars = rows.where((F.col("first.node") != F.col("node")) & (F.col("n") * percent <= F.col("first.n") * 100)).select(F.least("first.node", "node").alias("a"), F.greatest("first.node", "node").alias("b")).distinct()
    tried = written(plausible(stars, marks, percent), "pairs")
    items = item_sets(slim, involved.select("node", "doc_id", "row"), words)
    # rows of the same doc_id are one document, whatever their texts
    again = written(table.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    repeated = not again.isEmpty()
    links = verified(items, tried, percent)
    if repeated:
        of_doc = table.join(again, "doc_id", "left_semi").join(classes.select("node", *set_of), set_of).select("doc_id", "node").distinct()
        least = of_doc.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.unionByName(written(least.join(of_doc, "doc_id").where("a <> node").select("a", F.col("node").alias("b")), "links"))
    label = components(links)
    for nearest in (2, 8, None):
        named = rows.join(label.withColumnRenamed("v", "node"), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
        # keys whose sets aren't all in one component yet, one of those with the same sets
        split = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members")).where("x <> y")
        once = split.groupBy("size", "members").agg(F.min("key").alias("key")).select("key", "size")
        members = in_parts(named.join(once, "key").join(marks.select("node", "sketch"), "node"))
        new = written(candidates(members, percent, nearest).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = None if new.isEmpty() else verified(items, new, percent)
        if found is None:
            continue
        tried = tried.unionByName(new)
        if not found.isEmpty():
            links = links.unionByName(found)
            label = components(links)
    named = classes.select("node", *set_of, "doc_id").join(label.withColumnRenamed("v", "node"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.where("component is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    known = named.join(least, "c", "left").select(*set_of, F.coalesce("least", "doc_id").alias("least"))
    result = table.select("doc_id", *set_of).join(known, set_of, "left").withColumn("c", F.when(F.col("doc_id").isNotNull(), F.least("doc_id", "least")))
    if repeated:
        of_doc = result.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("c").alias("least_of_doc"))
        result = result.join(of_doc, "doc_id", "left").withColumn("c", F.coalesce("least_of_doc", "c"))
    result = written(result.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("c").alias("component_id")), "groups")
    discard(table, classes, rows, involved, items)
    return result


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns unchanged, whose doc_id is the smallest of its group; rows with a
    null doc_id stay, and rows of equal doc_id, which are one document."""
    groups = jaccard_groups(docs, words, percent)
    gone = written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    if gone.count() <= 1_000_000:  # of 8 bytes each; more are shuffled, and docs with them
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
