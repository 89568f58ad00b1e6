"""Best-fit decreasing packing of documents into windows, with lower bounds from dual feasible
functions that certify the number of windows of each partition and of all."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, tidy, written
from .encode import blocks, encoder

CUT = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = CUT + ", sequence_id long, offset long, certified boolean, released boolean"
KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def lower_bound(counts: np.ndarray, width: int) -> int:
    """No packing of counts[x] pieces of size x (0 < x <= width) has fewer windows.  A dual feasible
    function maps sizes so that what fits into a window still does; the mapped total over the mapped
    width is a bound.  Used: the identity; sizes over width-e count as whole windows and those under e
    as nothing, for every e; rounding to k-ths of a window; and halves-symmetric rounding to multiples."""
    counts = np.asarray(counts, np.int64)[: width + 1]
    size = np.arange(width + 1)
    bounds = [-(-int(counts @ size) // width)]
    # for every e: counts above width-e, sizes between
    many, total = np.cumsum(counts), np.cumsum(counts * size)
    e = np.arange(1, width // 2 + 1)
    bounds.append(int(np.max(many[-1] - many[width - e] - -(total[width - e] - total[e - 1]) // width, initial=0)))
    for k in range(1, 41):
        scaled = size * (k + 1)
        value = np.where(scaled % width == 0, size * k, scaled // width * width)
        bounds.append(-(-int(counts @ value) // (width * k)))
    for unit in sorted({width // j for j in range(2, 65)} - {0}):
        most = width // unit
        value = np.where(2 * size > width, 2 * (most - (width - size) // unit), np.where(2 * size == width, most, 2 * (size // unit)))
        bounds.append(-(-int(counts @ value) // (2 * most)))
    return max(bounds)


def best_fit_decreasing(length: np.ndarray, width: int) -> list[list[int]]:
    """Windows as lists of pieces: each piece, longest first, goes into the fullest window that has
    room.  Windows stand in stacks by their room, and a bit for each stack finds the best one."""
    room: list[list[int]] = [[] for _ in range(width + 1)]
    bits, windows = 0, []
    for p in np.argsort(-length, kind="stable").tolist():
        size = int(length[p])
        fits = bits >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            w = room[r].pop()
            if not room[r]:
                bits &= ~(1 << r)
            windows[w].append(p)
        else:
            r, w = width, len(windows)
            windows.append([p])
        if r > size:
            room[r - size].append(w)
            bits |= 1 << (r - size)
    return windows


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """The pieces of each document: it as a whole, or pieces of `width` after a first one of what
    is left over."""

    def run(batches):
        use = encoder(tokenizer, end_id)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(batch), 256):
                ids_of, part = doc_ids.slice(at, 256).to_pylist(), [t or "" for t in texts.slice(at, 256).to_pylist()]
                rows: list[tuple] = []
                for a, b in blocks(part):
                    flat, counts = use.encode(part[a:b])
                    data = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                    k = 0
                    for doc, n in zip(ids_of[a:b], counts.tolist()):
                        first = n % width or width
                        edges = [0, *range(first, n + 1, width)]
                        rows += [(doc, i, s, e - s, zlib.crc32(data[4 * (k + s) : 4 * (k + e)])) for i, (s, e) in enumerate(zip(edges[:-1], edges[1:]))]
                        k += n
                yield batch_of(CUT, *zip(*rows))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), CUT)


def batch_of(names: str, *columns) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def packed_groups(pieces: DataFrame, width: int, groups: int, turn: int) -> DataFrame:
    """Each of `groups` random groups of pieces, packed: with each piece whether its group has as few
    windows as its lower bound, and whether its window is to be repacked with those of other groups:
    all that aren't full of a group with a gap, the emptiest of a certified one."""

    def pack_one(g: int, held: list):
        part = pa.Table.from_batches(held).combine_chunks()
        length = part.column(3).to_numpy()
        windows = best_fit_decreasing(length, width)
        certified = len(windows) == lower_bound(np.bincount(length, minlength=width + 1), width)
        fills = [int(length[w].sum()) for w in windows]
        emptiest = int(np.argmin(fills))
        order = np.concatenate([np.array(w) for w in windows])
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        released = np.array([f < width and (not certified or k == emptiest) for k, f in enumerate(fills)])
        sequence = ((turn << 36) + g) * (1 << 22) + 2 * np.arange(len(windows)) + 1
        ends = np.cumsum(length[order])
        start = ends - length[order]
        offset = start - np.repeat(start[np.cumsum(sizes) - sizes], sizes)
        taken = [part.column(k).combine_chunks().take(pa.array(order)) for k in range(5)]
        whole = batch_of(PACKED, *taken, pa.array(np.repeat(sequence, sizes)), pa.array(offset), pa.array(np.full(len(order), certified)), pa.array(np.repeat(released, sizes)))
        for k in range(0, len(whole), 10_000):
            yield whole.slice(k, 10_000)

    def run(batches):
        held: list = []
        current = None
        for batch in batches:
            g = batch.column(5).to_numpy()
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and g[lo] != current:
                    yield from pack_one(current, held)
                    held = []
                current = int(g[lo]) if hi > lo else current
                held += [batch.slice(lo, hi - lo)] * (hi > lo)
        if held:
            yield from pack_one(current, held)

    names = [c.split()[0] for c in CUT.split(", ")]
    mixed = F.xxhash64(F.lit(turn), *names, "sequence_id")
    dealt = pieces.select(*names, F.pmod(mixed, F.lit(groups)).alias("g"), mixed.alias("mixed")).repartition(groups, "g").sortWithinPartitions("g", "mixed")
    return dealt.select(*names, "g").mapInArrow(tidy(run), PACKED)


def bound_of(pieces: DataFrame, width: int) -> int:
    """lower_bound of a table with a length column, from its counts by length."""
    counts = np.zeros(width + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # `width` rows at most
        counts[r["length"]] = r["count"]
    return lower_bound(counts, width)


def pack(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2048, group: int = 50_000, rounds: int = 8) -> DataFrame:
    """Pieces of docs (doc_id, text; other columns are ignored) in sequences of at most `width`
    tokens, one row a piece: doc_id, piece (from 0), start (in its document), length, ids_crc32,
    sequence_id, offset (in its sequence), certified (whether a lower bound proves that the group in
    which the piece was packed has as few sequences as it can).

    Null text counts as empty; every document has its end id, so at least one piece.  Rows with null
    or equal doc_id are documents of their own.  Only documents of over `width` tokens are cut.

    Full pieces are sequences.  The others are dealt at random into groups of about `group`, each of
    which a task packs by best-fit decreasing and holds against lower_bound.  As long as all groups
    together have more sequences than the bound of all their pieces, groups with a gap exchange the
    documents of their sequences that aren't full, together with the emptiest sequence of each
    certified group, and pack them again in new groups; a round that saves nothing is dropped and is
    the last, as is one in a single group."""
    if group > 1 << 20:
        raise ValueError("a group has at most 2**20 pieces")
    small_batches(docs.sparkSession)
    table = written(cut_documents(docs, tokenizer, end_id, width), "bin-pieces").withColumn("sequence_id", F.monotonically_increasing_id() * 2)
    names = [c.split()[0] for c in PACKED.split(", ")][:-1]
    none = F.lit(0).cast("long").alias("offset")
    done = [table.where(F.col("length") == width).withColumns({"offset": none, "certified": F.lit(True)}).select(*names)]
    pool, before = table.where(F.col("length") < width), None
    for turn in range(rounds):
        many = pool.count()
        if not many:
            break
        groups = -(-many // group)
        packed = written(packed_groups(pool, width, groups, turn), "bins")
        windows = F.count_if(F.col("offset") == 0)
        total, released = packed.agg(windows, F.count_if((F.col("offset") == 0) & F.col("released"))).first()
        if before is not None and total >= before:
            discard(packed)
            break
        if groups == 1 or total == bound_of(packed, width):
            pool = packed.select(*names)
            break
        done.append(packed.where(~F.col("released")).select(*names))
        pool, before = packed.where("released"), released
        if before == bound_of(pool, width):
            break
    done.append(pool.select(*names) if "offset" in pool.columns else pool.withColumns({"offset": none, "certified": F.lit(True)}).select(*names))
    return functools.reduce(DataFrame.unionByName, done)
