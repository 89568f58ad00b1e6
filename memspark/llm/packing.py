"""Packing of token ids into windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written
from .encode import blocks, encoder, forget

CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, marks binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed boolean"
MARK = 64  # tokens


class SumOfSquares:
    """Online packing of sizes below `width` into windows of `width`.  level[h] is the number of
    windows that are filled to h, 0 < h < width; a size s goes to the fill level, or to a new
    window, for which the sum of level[h]**2 afterwards is least (ties: the fullest)."""

    def __init__(self, width: int):
        self.width = width
        self.level = np.zeros(width + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # fill -> windows, each a list of pieces

    def place(self, size: int, piece: int) -> list | None:
        """Put a piece; a window that it fills is given back."""
        w, level = self.width, self.level
        # from h to h+s: 2*(level[h+s] - level[h] + 1); a filled window leaves; a new one comes to level s
        gain = 2 * (level[size : w + 1] - level[: w + 1 - size] + 1)
        gain[w - size] = 1 - 2 * level[w - size]
        gain[0] = 1 + 2 * level[size]
        gain[1:][level[1 : w + 1 - size] == 0] = np.iinfo(np.int64).max
        h = len(gain) - 1 - int(np.argmin(gain[::-1]))
        window = self.open[h].pop() if h else []
        level[h] -= h > 0
        window.append(piece)
        if h + size == w:
            return window
        level[h + size] += 1
        self.open.setdefault(h + size, []).append(window)
        return None

    def rest(self) -> list[tuple[int, list]]:
        """(fill, pieces) of the open windows, fullest first."""
        return [(h, window) for h in sorted(self.open, reverse=True) for window in self.open[h]]


def marks_of(ids: np.ndarray) -> tuple[int, bytes]:
    """(crc32 of the ids, marks): the crc32 after each MARK ids, then the ids after the last of them."""
    data, crc, out = memoryview(ids.tobytes()), 0, []
    full = len(ids) // MARK
    for k in range(full):
        crc = zlib.crc32(data[4 * MARK * k : 4 * MARK * (k + 1)], crc)
        out.append(crc)
    tail = data[4 * MARK * full :]
    return zlib.crc32(tail, crc), np.array(out, "<u4").tobytes() + tail.tobytes()


def part_crc(marks: bytes, length: int, a: int, b: int) -> int:
    """crc32 of the ids a..b of a piece, each of which is a multiple of MARK or lies in what follows the
    last mark."""
    full = length // MARK
    tail = marks[4 * full :]

    def until(k: int) -> int:
        at = min(k // MARK, full)
        crc = int.from_bytes(marks[4 * at - 4 : 4 * at], "little") if at else 0
        return zlib.crc32(tail[: 4 * (k - at * MARK)], crc)

    if a == 0:
        return until(b)
    # crc32(x, c) ^ crc32(x, 0) depends on c and the length of x only
    zeros = bytes(4 * (b - a))
    return until(b) ^ zlib.crc32(zeros, until(a)) ^ zlib.crc32(zeros)


def fill_up(windows: list[tuple[int, list]], length: np.ndarray, width: int):
    """The windows that are open at the end, as lists of (piece, from, to, whether it stays where it was
    placed): the fullest are filled up with what the emptiest hold, and the last tokens become
    sequences of powers of two.  Pieces are cut only where part_crc can follow."""
    total = sum(f for f, _ in windows)
    keep = min(len(windows), total // width)
    # parts of the pieces of the emptiest windows: long ones, and those that may be cut anywhere
    long: list[tuple[int, int, int]] = []
    short: list[tuple[int, int, int]] = []

    def put(p: int, a: int, b: int) -> None:
        if a < b:
            (long if a // MARK < min(b, length[p] // MARK * MARK) // MARK else short).append((p, a, b))

    for _, window in windows[keep:]:
        for p in window:
            put(p, 0, int(length[p]))
    long.sort(key=lambda x: x[2] - x[1])

    def take(gap: int) -> list[tuple[int, int, int, bool]]:
        out = []
        while gap >= MARK and long:
            p, a, b = long.pop()
            t = min((b - a) // MARK * MARK, gap // MARK * MARK)
            out.append((p, a, a + t, False))
            put(p, a + t, b)
            gap -= t
        while gap and (short or long):
            if not short:
                # the ids after a long part's last mark may be cut anywhere
                k = next((k for k in range(len(long) - 1, -1, -1) if long[k][2] % MARK), None)
                if k is None:
                    break
                p, a, b = long.pop(k)
                put(p, a, b // MARK * MARK)
                put(p, b // MARK * MARK, b)
            p, a, b = short.pop()
            t = min(b - a, gap)
            out.append((p, a, a + t, False))
            put(p, a + t, b)
            gap -= t
        return out

    for filled, window in windows[:keep]:
        yield [(p, 0, int(length[p]), True) for p in window] + take(width - filled)
    # what can be cut at marks first, then what can be cut anywhere: both come out even
    while long or short:
        left = sum((b - a) // MARK * MARK for _, a, b in long) or sum(b - a for _, a, b in short)
        yield take(min(width, 1 << (left.bit_length() - 1)))


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, width: int, keep_encoder: bool) -> DataFrame:
    """The ids of each document as pieces: full windows, and a remainder with its marks."""

    def run(batches):
        use = encoder(tokenizer, end_id)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(batch), 256):
                ids_of, part = doc_ids.slice(at, 256).to_pylist(), [t or "" for t in texts.slice(at, 256).to_pylist()]
                rows: list[tuple] = []
                for a, b in blocks(part):
                    flat, counts = use.encode(part[a:b])
                    flat = flat.astype("<u4", copy=False)
                    k = 0
                    for doc, n in zip(ids_of[a:b], counts.tolist()):
                        ids = flat[k : k + n]
                        k += n
                        full = n // width * width
                        rows += [(doc, s, width, zlib.crc32(ids[s : s + width].tobytes()), n, None) for s in range(0, full, width)]
                        if n > full:
                            crc, marks = marks_of(ids[full:])
                            rows.append((doc, full, n - full, crc, n, marks))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(zip(*rows))], [c.split()[0] for c in CUT.split(", ")])
        if not keep_encoder:
            del use
            forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), CUT)


def pack(docs: DataFrame, tokenizer: str, end_id: int, width: int = 4096, group: int = 200_000, keep_encoder: bool = True) -> DataFrame:
    """Pieces of docs (doc_id, text; other columns are ignored) in sequences of at most `width`
    tokens, one row a piece: doc_id, start (in its document), length, ids_crc32, doc_tokens,
    sequence_id, offset (in its sequence), placed (whether it lies where the rule placed it, or is a
    full window; false for parts that filled up others).

    Null text counts as empty; every document has its end id, so at least one piece.  Rows with null
    or equal doc_id are documents of their own.  Longer documents are cut into full windows and a
    remainder.  The remainders are dealt at random into groups of about `group`, which SumOfSquares
    packs one by one in their random order.  Of the windows that are open at a group's end, the
    fullest are filled up with parts of the emptiest (see fill_up), which are few, as a group is
    large.  So next to no sequence needs padding: under MARK tokens of one for which no piece is left
    that can be cut at such a place.

    A worker keeps its encoder for later tasks unless keep_encoder is false."""
    table = written(cut_documents(docs, tokenizer, end_id, width, keep_encoder), "pieces")
    names = [c.split()[0] for c in PIECES.split(", ")]
    numbered = table.withColumn("number", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == width).withColumns({"sequence_id": F.col("number") * 2, "offset": F.lit(0).cast("long"), "placed": F.lit(True)})
    rest = numbered.where(F.col("length") < width).withColumn("turn", F.xxhash64("number"))
    groups = max(1, -(-rest.count() // group))

    def run(batches):
        held: list = []

        def done():
            part = pa.Table.from_batches(held).combine_chunks()
            doc, start, length, crc, total = (part.column(k) for k in range(5))
            length, marks = length.to_numpy(), part.column(5)
            packer = SumOfSquares(width)
            out, sequence, offset, a_of, b_of, kept, sums = [], [], [], [], [], [], []
            n = int(part.column(6)[0].as_py()) << 33

            def close(pieces):
                nonlocal n
                at = 0
                for p, a, b, stays in pieces:
                    out.append(p)
                    a_of.append(a)
                    b_of.append(b)
                    kept.append(stays)
                    sums.append(None if b - a == length[p] else part_crc(marks[p].as_py(), int(length[p]), a, b))
                    sequence.append(2 * n + 1)
                    offset.append(at)
                    at += b - a
                n += 1

            for p, size in enumerate(length.tolist()):
                window = packer.place(size, p)
                if window:
                    close([(q, 0, int(length[q]), True) for q in window])
            for window in fill_up(packer.rest(), length, width):
                close(window)
            out, a_of, b_of = np.array(out), np.array(a_of, np.int64), np.array(b_of, np.int64)
            doc, start, crc, total = (c.take(pa.array(out)).combine_chunks() for c in (doc, start, crc, total))
            crc = pa.array([c if s is None else s for c, s in zip(crc.to_pylist(), sums)], pa.int64())
            found = [doc, pa.array(start.to_numpy() + a_of), pa.array(b_of - a_of), crc, total, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(kept, pa.bool_())]
            whole = pa.RecordBatch.from_arrays(found, names)
            return [whole.slice(k, 10_000) for k in range(0, len(whole), 10_000)]

        current = None
        for batch in batches:
            g = batch.column(6).to_numpy()
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if held and g[lo] != current:
                    yield from done()
                    held = []
                current = g[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    dealt = rest.withColumn("g", F.pmod("turn", F.lit(groups))).repartition(groups, "g").sortWithinPartitions("g", "turn")
    packed = dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks", "g").mapInArrow(tidy(run), PIECES)
    return full.select(*names).unionByName(packed)
