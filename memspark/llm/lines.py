"""Line deduplication: an exact set-similarity self-join of lines with prefix filtering.

A line's set is its distinct words.  Words are ordered by rarity (a table of hashed counts over all
lines, of fixed size, then the hash); the first n-ceil(t*n)+1 words of a line of n words are its
prefix, and lines of similarity t or more share a word of both prefixes (kept as 31 bits of its hash:
words that collide only make more pairs to look at; words that the corpus has once are left out).
Equal sets are one class, with the place of its first line.  Under a word, pairs of
classes pass the length and positional filters and a bound from 128-bit parity sketches of the sets
(a sketch differs in no more bits than the sets do in words); what passes is verified on the whole
sets, read again from the texts.

A line of few words but many characters (scripts without spaces, URLs, rules) may have a second set,
of the 3-grams of its characters, which goes through the same join as a record of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flat_bytes, runs_by_size, tidy, written
from .jaccard import LOWER, SPACE, word_hashes
from .repeats import _mix, _Sums

LINES = "doc long, row long, line int, gram boolean, n int, h long, p1 long, p2 long, times int, prefix array<int>"
LAST = (1 << 63) - 1
GRAM = 3  # characters
BLOCK_BYTES, BLOCK_LINES = 500_000, 4096  # of texts, worked on at a time
CHUNK = 1 << 14  # buckets in a row of a table of counts
HASH_BITS, LEVEL_BITS = 44, 7  # of a word's code in a set


def line_ends(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of lines, number of lines of each text); a line feed ends its line, and what follows the
    last one (maybe nothing) is a line, too."""
    feeds = np.flatnonzero(data == 10) + 1
    inside = np.searchsorted(feeds, ends[1:], "right") - np.searchsorted(feeds, ends[:-1], "right")
    # a text's lines begin at its start and after each of its line feeds
    return np.append(np.sort(np.concatenate([ends[:-1], feeds])), ends[-1]), inside + 1


def line_blocks(data: np.ndarray, edges: np.ndarray):
    """(bytes, ends, first line) of blocks of whole lines."""
    for a, b in runs_by_size(edges, BLOCK_BYTES):
        for k in range(a, b, BLOCK_LINES):
            to = min(b, k + BLOCK_LINES)
            yield np.ascontiguousarray(data[edges[k] : edges[to]]), edges[k : to + 1] - edges[k], k


def gram_hashes(data: np.ndarray, ends: np.ndarray, words: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, line of each): the 3-grams of the characters other than white space (A-Z as a-z) of the
    lines that have `grams` or more bytes of them for each of their words (words: how many each has)."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not grams or not np.any((np.diff(ends) >= grams * words) & (words > 0)):
        return none
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    size = solid[ends[1:]] - solid[ends[:-1]]
    use = (size >= grams * words) & (words > 0)
    if not use.any():
        return none
    line = np.repeat(np.arange(len(size)), np.diff(ends))
    keep = use[line] & ~SPACE[data]
    data, line = LOWER[data[keep]], line[keep]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) < GRAM:
        return none
    stop = np.append(lead, len(data))[GRAM:]
    begin = lead[: len(stop)]
    inside = line[begin] == line[stop - 1]
    begin, stop = begin[inside], stop[inside]
    return _mix(_Sums(data)(begin, stop) ^ np.uint64(0xA5A5A5A5A5A5A5A5)), line[begin]


def record_hashes(data: np.ndarray, ends: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, record of each, line of each record): the words of the lines, which are the first
    records in their order, and the 3-grams of those lines that have such a set."""
    h, line = word_hashes(data, ends)
    of = np.arange(len(ends) - 1)
    g, of_gram = gram_hashes(data, ends, np.bincount(line, minlength=len(of)), grams)
    if not len(g):
        return h, line, of
    more, record = np.unique(of_gram, return_inverse=True)
    return np.concatenate([h, g]), np.concatenate([line, len(of) + record]), np.concatenate([of, more])


def word_counts(texts: DataFrame, buckets: int, grams: int = 0) -> np.ndarray:
    """How many words of all texts, and 3-grams of lines that have such a set, fall into each hash
    bucket.  Tasks send their tables in rows of CHUNK buckets, which are summed by row."""
    chunk = min(CHUNK, buckets)

    def rows(total):
        for k in range(0, buckets, chunk):
            part = total[k : k + chunk]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<i8" if part.max() >> 31 else "<i4").tobytes()], pa.binary())], ["at", "counts"])

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, ends = flat_bytes(batch.column(0))
            for part, edges, _ in line_blocks(data, line_ends(data, ends)[0]):
                h, _, _ = record_hashes(part, edges, grams)
                np.add.at(total, (h & np.uint64(buckets - 1)).view(np.int64), 1)
        yield from rows(total)

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[at : at + chunk] += np.frombuffer(counts, "<i4" if len(counts) == 4 * chunk else "<i8")
        yield from rows(total)

    schema = "at int, counts binary"
    total = np.zeros(buckets, np.int64)
    # a row for each chunk: a table of fixed size
    for at, counts in texts.select("text").mapInArrow(tidy(count), schema).repartition("at").mapInArrow(tidy(add), schema).collect():
        total[at : at + chunk] = np.frombuffer(counts, "<i4" if len(counts) == 4 * chunk else "<i8")
    return total


def levels(counts: np.ndarray) -> np.ndarray:
    """Four levels for each doubling of a count; 0 for words that the corpus has once."""
    return np.minimum((1 << LEVEL_BITS) - 1, np.round(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def line_sets(data: np.ndarray, ends: np.ndarray, level: np.ndarray, grams: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, record of each, line of each record): the distinct words of each record (see
    record_hashes), rarest first; a code is the level of the word's count and bits of its hash."""
    h, record, of = record_hashes(data, ends, grams)
    code = (level[(h & np.uint64(len(level) - 1)).view(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)) | (_mix(h) >> np.uint64(64 - HASH_BITS))
    bits = np.uint64(HASH_BITS + LEVEL_BITS)  # what is left has room for 2 * BLOCK_LINES records
    both = np.sort((record.astype(np.uint64) << bits) | code)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return both & ((np.uint64(1) << bits) - np.uint64(1)), (both >> bits).view(np.int64), of


PREFIXES = "key long, id long, doc long, row long, at long, p1 long, p2 long, part int, seek boolean"
PAIRS = "x long, y long, more boolean"
FEW = 2
HOT = 20_000  # rows of a word in one task
PLACE_BITS = 30


class _Nearest:
    """Of each later row y its FEW earlier rows x of the most similar sketches, and how many it met."""

    def __init__(self, size: int):
        self.bits, self.x, self.met = np.full((FEW, size), 1 << 30), np.full((FEW, size), -1), np.zeros(size, np.int64)

    def add(self, x, y, bits) -> None:  # every y at most once
        self.met[y] += 1
        better = bits < self.bits[-1, y]
        x, y, bits = x[better], y[better], bits[better]
        for k in range(FEW):
            old_bits, old_x = self.bits[k, y], self.x[k, y]
            take = bits < old_bits
            self.bits[k, y], self.x[k, y] = np.where(take, bits, old_bits), np.where(take, x, old_x)
            bits, x = np.where(take, old_bits, bits), np.where(take, old_x, x)

    def result(self):
        k, y = np.nonzero(self.x >= 0)
        return self.x[k, y], y, self.met[y] > FEW


class _All:
    """All pairs."""

    def __init__(self, size: int):
        self.x, self.y = [], []

    def add(self, x, y, bits) -> None:
        self.x.append(x)
        self.y.append(y)

    def result(self):
        x, y = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (self.x, self.y))
        return x, y, np.zeros(len(x), bool)


def _meet(into, key, doc, row, at, p1, p2, part, seek, percent) -> None:
    """Gives `into` the pairs of rows under one key (see candidates) that pass the filters, as (earlier,
    later) indexes with the bits in which their sketches differ; rows are sorted.  Step k compares each
    row with the k-th after it.  Rows of the same part don't meet, but for part -1; the later row must
    be one that seeks."""
    token, n = key >> 32, key & 0xFFFFFFFF
    line, place = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
    alive, k = np.arange(len(key)), 0
    while len(alive):
        k += 1
        alive = alive[alive + k < len(key)]
        other = alive + k
        # sizes are sorted: once a partner is too long or of another word, later ones are, too
        go = (token[other] == token[alive]) & (n[other] * percent <= n[alive] * 100)
        alive, other = alive[go], other[go]
        if not len(alive):
            break
        both = n[alive] + n[other]
        need = -(-percent * both // (100 + percent))
        left = np.minimum(n[alive] - place[alive], n[other] - place[other])
        bits = np.bitwise_count(p1[alive] ^ p1[other]).astype(np.int64) + np.bitwise_count(p2[alive] ^ p2[other])
        ok = (left >= need) & (bits <= both - 2 * need) & ((part[alive] < 0) | (part[alive] != part[other]))
        x, y, bits = alive[ok], other[ok], bits[ok]
        before, same = doc[x] < doc[y], doc[x] == doc[y]
        before |= same & (row[x] < row[y])
        same &= row[x] == row[y]
        before |= same & (line[x] < line[y])
        same &= line[x] == line[y]
        here = before & seek[y]
        into.add(x[here], y[here], bits[here])
        here = ~before & ~same & seek[x]
        into.add(y[here], x[here], bits[here])


def candidates(classes: DataFrame, percent: int, failed: DataFrame | None = None) -> DataFrame:
    """Pairs of classes (x before y) that may match, with `more`.  Of each y under a word only the FEW x
    of the most similar sketches, and then `more` tells whether there are others; if failed (id) is
    given, all x of these y.

    A row's key is its word's token and its size.  A word with over HOT rows is cut into parts by a
    hash of the rows, and each two parts meet in a task of their own, so that no task has more than
    about 2*HOT rows of a word.  Only words that the corpus has more often than that can be such;
    their tokens are negative."""

    def run(batches):
        held: list = []

        def done(columns):
            key, ids, *rest = columns
            into = (_All if failed_given else _Nearest)(len(key))
            doc, row, at, p1, p2, part, seek = rest
            _meet(into, key, doc, row, at, p1.view(np.uint64), p2.view(np.uint64), part, seek > 0, percent)
            x, y, more = into.result()
            return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(more)], ["x", "y", "more"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = [np.concatenate(p) for p in zip(held, new)] if held else new
            token = held[0] >> 32
            if len(token) >= 2 * HOT and token[0] != token[-1]:
                cut = int(np.argmax(token == token[-1]))
                yield done([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held:
            yield done(held)

    failed_given = failed is not None
    at = F.shiftleft(F.col("line").cast("long") * 2 + F.col("gram").cast("long"), PLACE_BITS)
    exploded = classes.select("id", "doc", "row", at.alias("at"), "n", "p1", "p2", F.posexplode("prefix").alias("place", "token")).where("token <> 0")
    rows = exploded.select("token", "id", "doc", "row", (F.col("at") + F.col("place")).alias("at"), "p1", "p2", "n")
    seek = F.lit(True)
    if failed_given:
        rows = rows.join(failed.withColumn("seek", F.lit(True)), "id", "left")
        words = written(rows.where("seek").select("token").distinct(), "words")
        # broadcast where they are few, by their count
        rows = rows.join(F.broadcast(words) if words.count() <= 200_000 else words, "token", "left_semi")
        seek = F.col("seek").isNotNull()
    heavy = rows.where("token < 0")
    hot = written(heavy.groupBy("token").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1"), "hot-words")
    names = [c.split()[0] for c in PREFIXES.split(", ")]
    keyed = lambda df, token: df.withColumn("key", F.shiftleft(token.cast("long"), 32) + F.col("n"))
    plain = keyed(rows, F.col("token"))
    if hot.isEmpty():
        plain = plain.repartition(F.shiftright("key", 32)).sortWithinPartitions("key").withColumns({"part": F.lit(-1), "seek": seek})
    else:
        cut = heavy.join(hot, "token").withColumns({"seek": seek, "part": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")})
        blocks = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # a block has a token of its own; all rows of a part meet in the block of it with itself
        blocks = keyed(blocks, F.hash("token", F.least("part", "q"), F.greatest("part", "q"))).withColumn("part", F.when(F.col("part") == F.col("q"), -1).otherwise(F.col("part")))
        rest = keyed(rows.join(hot, "token", "left_anti"), F.col("token")).withColumns({"part": F.lit(-1), "seek": seek})
        plain = rest.select(*names).unionByName(blocks.select(*names)).repartition(F.shiftright("key", 32)).sortWithinPartitions("key")
    return plain.select(*names).mapInArrow(tidy(run), PAIRS).groupBy("x", "y").agg(F.max("more").alias("more"))


def find_repeated_lines(docs: DataFrame, percent: int = 80, min_words: int = 3, buckets: int = 1 << 20, grams: int = 0) -> DataFrame:
    """(doc, row, line) of each line of docs (doc_id, text) that goes, where doc is doc_id (null: LAST)
    and row a hash of doc_id and text: a line of min_words distinct words or more (A-Z as a-z) that
    has 100*intersection >= percent*union with an earlier line of the input, by doc, row and place in
    the text.  Lines with fewer words stay; with min_words=1 these are those without a word.  If
    grams > 0, a line of `grams` or more bytes a word, white space left out, also goes if the same
    holds for its set of 3-grams of characters and that of such an earlier line."""
    slim = docs.select(*_identity(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = word_counts(slim, buckets, grams)
    # one byte a bucket, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast(levels(counts))
    heavy = int(levels(np.array([HOT]))[0])

    def sets(batches):
        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, ends = flat_bytes(batch.column(2))
            edges, lines = line_ends(data, ends)
            text = np.repeat(np.arange(len(ends) - 1), lines)
            number = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
            held: list[tuple] = []
            for part, part_edges, first_line in line_blocks(data, edges):
                code, record, of = line_sets(part, part_edges, shared.value, grams)
                total = len(of)
                n = np.bincount(record, minlength=total)
                gram = np.arange(total) >= len(part_edges) - 1
                use = np.flatnonzero((n >= min_words) | gram)
                if not len(use):
                    continue
                first = np.cumsum(n) - n
                h, p1, p2 = (np.zeros(total, np.uint64) for _ in range(3))
                filled = np.flatnonzero(n)
                mixed = _mix(code * np.uint64(5))
                h[filled] = np.add.reduceat(mixed, first[filled])
                bit = np.uint64(1) << (mixed & np.uint64(63))
                second = (mixed >> np.uint64(6)) & np.uint64(1) > 0
                p1[filled] = np.bitwise_xor.reduceat(np.where(second, np.uint64(0), bit), first[filled])
                p2[filled] = np.bitwise_xor.reduceat(np.where(second, bit, np.uint64(0)), first[filled])
                held.append((of[use] + first_line, gram[use], n[use], h[use], p1[use], p2[use], *_prefixes(code, first[use], n[use], percent, heavy)))
            if not held:
                continue
            line, gram, n, h, p1, p2, size, prefix = (np.concatenate(c) for c in zip(*held))
            # of equal sets of a batch the first line has the prefix and says how many there are
            rank = np.empty(len(doc), np.int64)
            rank[np.lexsort((row, doc))] = np.arange(len(doc))
            order = np.lexsort((rank[text[line]] * len(text) + line, h))
            begin = np.flatnonzero(np.concatenate([[True], *([np.any([x[order[1:]] != x[order[:-1]] for x in (h, n, p1, p2)], axis=0)] if len(order) > 1 else [])]))
            times = np.zeros(len(order), np.int32)
            times[order[begin]] = np.diff(np.append(begin, len(order)))
            take = np.repeat(times > 0, size)
            edges_of = np.concatenate([[0], np.cumsum(np.where(times > 0, size, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges_of), pa.array(prefix[take]))
            for k in range(0, len(line), 20_000):
                s = slice(k, k + 20_000)
                t = text[line[s]]
                columns = doc[t], row[t], number[line[s]].astype(np.int32), gram[s], n[s].astype(np.int32), h[s].view(np.int64), p1[s].view(np.int64), p2[s].view(np.int64), times[s]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists.slice(k, 20_000)], [c.split()[0] for c in LINES.split(", ")])

    table = written(slim.mapInArrow(tidy(sets), LINES), "lines")

    # equal sets are one class, its place is that of its first line
    set_of = ["h", "n", "p1", "p2"]
    first = F.min(F.struct("doc", "row", "line", "gram")).alias("first")
    found = table.where("times > 0").repartition("h").groupBy(*set_of).agg(first, F.sum("times").alias("lines"), F.any_value("prefix").alias("prefix"))
    classes = written(found.select(*set_of, "first.*", "lines", "prefix", F.monotonically_increasing_id().alias("id")), "classes")
    pairs = written(candidates(classes, percent), "pairs")
    matches = [verified(slim, classes, pairs, percent, grams)]
    matched = matches[0].select(F.col("y").alias("id")).distinct()
    # lines of which the likeliest partners failed, and which have others: all of these
    failed = pairs.groupBy(F.col("y").alias("id")).agg(F.max("more").alias("more")).where("more").select("id")
    failed = written(failed.join(matched, "id", "left_anti"), "failed")
    if not failed.isEmpty():
        rest = written(candidates(classes, percent, failed).join(pairs, ["x", "y"], "left_anti"), "more-pairs")
        matches.append(verified(slim, classes, rest, percent, grams))
        matched = matched.unionByName(matches[1].select(F.col("y").alias("id"))).distinct()
        discard(rest)
    bad = classes.drop("prefix").join(matched.withColumn("near", F.lit(True)), "id", "left").where("lines > 1 or near")
    bad = bad.select(*set_of, *(F.col(c).alias(f"{c}_1") for c in ("doc", "row", "line")), F.coalesce("near", F.lit(False)).alias("near"))
    other = F.col("near") | (F.col("doc") != F.col("doc_1")) | (F.col("row") != F.col("row_1")) | (F.col("line") != F.col("line_1"))
    gone = written(table.drop("prefix", "times").join(bad, set_of).where(other).select("doc", "row", "line").distinct(), "gone")
    discard(table, classes, pairs, failed, *matches)
    return gone


def _identity() -> tuple:
    """The columns that tell rows of docs apart; rows with equal doc_id and text are the same."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return doc.alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row")


def _prefixes(code: np.ndarray, first: np.ndarray, n: np.ndarray, percent: int, heavy: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, tokens) of the prefixes of sets of n words that begin at `first`.  A token is 0 for a
    word that the corpus has once, which no other line can share."""
    size = n + (-percent * n // 100) + 1
    # sets that only equal ones can match have none
    size[(n * percent > (n - 1) * 100) & (n * 100 // percent == n)] = 0
    pick = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    level = code[pick] >> np.uint64(HASH_BITS)
    token = (_mix(code[pick]) >> np.uint64(34)).astype(np.int64) + 1
    token = np.where(level >= heavy, -token, token)
    return size, np.where(level == 0, 0, token).astype(np.int32)


def verified(slim: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, grams: int, bits: int = 1 << 22) -> DataFrame:
    """The pairs (x, y) of classes whose word sets have 100*intersection >= percent*union, on whole sets
    of 64-bit hashes, read again.  A table of fixed size of the hashes of the lines in question lets
    the others go before they are hashed and shuffled."""
    at = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    asked = written(classes.select("id", "doc", "row", "line", "gram").join(at, "id", "left_semi"), "asked")
    slot = lambda doc, row, line: (_mix((doc ^ (row << 1)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) % np.uint64(bits)).view(np.int64)

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slot(*(c.to_numpy() for c in batch.columns))).astype(np.int32))], ["slot"])

    table = np.zeros(bits, bool)
    table[asked.select("doc", "row", "line").mapInArrow(tidy(mark), "slot int").distinct().toArrow()["slot"].to_numpy()] = True
    packed = slim.sparkSession.sparkContext.broadcast(np.packbits(table))

    def read_sets(batches):
        known = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, ends = flat_bytes(batch.column(2))
            edges, lines = line_ends(data, ends)
            text = np.repeat(np.arange(len(ends) - 1), lines)
            number = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
            wanted = known[slot(doc[text], row[text], number)]
            for part, part_edges, first in line_blocks(data, edges):
                here = wanted[first : first + len(part_edges) - 1]
                if not here.any():
                    continue
                size = np.diff(part_edges)
                own = np.concatenate([[0], np.cumsum(size[here])])
                h, record, of = record_hashes(part[np.repeat(here, size)], own, grams)
                order = np.lexsort((h, record))
                h, record = h[order], record[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (record[1:] != record[:-1])
                h, record = h[new], record[new]
                cut = np.searchsorted(record, np.arange(len(of) + 1)) * 8
                words = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(h)])
                at = first + np.flatnonzero(here)[of]
                yield pa.RecordBatch.from_arrays([pa.array(doc[text[at]]), pa.array(row[text[at]]), pa.array(number[at].astype(np.int32)), pa.array(np.arange(len(of)) >= len(own) - 1), words], ["doc", "row", "line", "gram", "words"])

    found = slim.mapInArrow(tidy(read_sets), "doc long, row long, line int, gram boolean, words binary")
    # equal rows of docs have equal sets
    sets = written(found.join(asked, ["doc", "row", "line", "gram"]).select("id", "words").dropDuplicates(["id"]), "line-sets")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: sets.select(F.col("id").alias(s), F.col("words").alias(f"words_{s}"))
    joined = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")
    matches = written(joined.select("x", "y", "words_x", "words_y").mapInArrow(tidy(check), "x long, y long"), "matches")
    discard(sets, asked)
    return matches


def _unused(columns: list[str], name: str) -> str:
    while name.lower() in [c.lower() for c in columns]:
        name += "_"
    return name


def rewritten(docs: DataFrame, percent: int = 80, min_words: int = 3, grams: int = 0) -> tuple[DataFrame, str, str]:
    """(docs without their repeated lines, name of a column with the number of lines of each text, name
    of one with how many of them went); see find_repeated_lines.  All rows and columns of docs stay."""
    lists = written(find_repeated_lines(docs, percent, min_words, grams=grams).groupBy("doc", "row").agg(F.collect_list("line").alias("gone")), "lists")
    rows, numbers = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    # by their size; more are shuffled, and docs with them
    few = 64 * rows + 4 * numbers <= 32_000_000
    doc, row, gone, n_lines, n_removed = (_unused(docs.columns, f"__{c}") for c in ("doc", "row", "gone", "n_lines", "n_removed"))
    key = [c.alias(n) for c, n in zip(_identity(), (doc, row))]
    lists = lists.toDF(doc, row, gone)
    joined = docs.select("*", *key).join(F.broadcast(lists) if few else lists, [doc, row], "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    numbered = F.filter(F.transform(lines, lambda x, k: F.when(~F.array_contains(F.col(gone), k), x)), lambda x: x.isNotNull())
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(numbered, "\n"))
    out = joined.select(
        *(text.alias(c) if c == "text" else F.col(c) for c in docs.columns),
        F.coalesce(F.size(lines).cast("long"), F.lit(0).cast("long")).alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed),
    )
    return out, n_lines, n_removed


def dedup_lines(docs: DataFrame, percent: int = 80, min_words: int = 3, grams: int = 0) -> DataFrame:
    """docs (doc_id, text and any others) without their repeated lines (see find_repeated_lines); all
    rows and columns stay, plus n_lines and n_removed, the lines of the text and those that went, in
    place of columns of these names.  Null and empty texts stay as they are.  Rows with equal doc_id
    and text are one document: a line of one of them isn't later than the same line of the other.
    Rows with a null doc_id come last, in the order of a hash of their texts."""
    out, n_lines, n_removed = rewritten(docs, percent, min_words, grams)
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"))
