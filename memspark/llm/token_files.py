"""Token-id output: ids of whole documents in bit-plane shuffled files with a chunk index."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .encode import blocks, encoder

MAGIC = b"PLN1"
HEAD = struct.Struct("<4sBBHIIQ")  # magic, 1 for bit planes, planes of a block, 0, ids of a block, documents, ids
SHARD = "part int, shard int, n_ids long, n_docs long, blob binary"
SPANS = "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of uint32 ids: plane k of bit planes holds bit k of every id, eight
    ids a byte; plane k of byte planes holds byte k of every id."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits:
        return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(32)]
    return [ids.view(np.uint8)[k::4].tobytes() for k in range(4)]


def from_planes(planes: list[bytes | None], n: int, bits: bool) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        if plane is None:
            continue
        if bits:
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
        else:
            ids.view(np.uint8)[k::4] = np.frombuffer(plane, np.uint8)
    return ids


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, counts: np.ndarray, block: int = 65536, bits: bool = False, level: int = 1) -> bytes:
    """A file: head; compressed planes, block after block; the chunk index (for each plane of each
    block the position and length of its bytes, length 0 for a plane of zeros); documents (id,
    whether it isn't null, number of ids); the positions of index and documents."""
    squeeze = zstandard.ZstdCompressor(level=level)
    n_planes = 32 if bits else 4
    body, index, at = [], [], HEAD.size
    for k in range(0, len(ids), block):
        for plane in to_planes(ids[k : k + block], bits):
            data = squeeze.compress(plane) if plane.strip(b"\0") else b""
            index.append((at, len(data)))
            body.append(data)
            at += len(data)
    docs = squeeze.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(has_id, np.uint8).tobytes() + np.asarray(counts, "<i8").tobytes())
    chunks = np.array(index, "<u8").tobytes()
    head = HEAD.pack(MAGIC, bits, n_planes, 0, block, len(counts), len(ids))
    return b"".join([head, *body, chunks, docs, struct.pack("<QQ", at, at + len(chunks))])


def read_shard(blob: bytes):
    """(ids, doc_ids, has_id, counts) of a file."""
    magic, bits, n_planes, _, block, n_docs, n = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a plane file")
    at, docs_at = struct.unpack("<QQ", blob[-16:])
    index = np.frombuffer(blob, "<u8", (docs_at - at) // 8, at).reshape(-1, n_planes, 2)
    open_ = zstandard.ZstdDecompressor()
    parts = [np.zeros(0, "<u4")]
    for k, row in enumerate(index.tolist()):
        planes = [open_.decompress(blob[a : a + size]) if size else None for a, size in row]
        parts.append(from_planes(planes, min(block, n - k * block), bool(bits)))
    docs = open_.decompress(blob[docs_at:-16])
    return np.concatenate(parts), np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs), np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)


def documents_of(blob: bytes):
    """(doc_ids, has_id, counts) of a file, without its ids."""
    _, _, _, _, _, n_docs, _ = HEAD.unpack_from(blob)
    _, docs_at = struct.unpack("<QQ", blob[-16:])
    docs = zstandard.ZstdDecompressor().decompress(blob[docs_at:-16])
    return np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs), np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)


def read_span(blob: bytes, start: int, n: int) -> np.ndarray:
    """The ids start .. start+n of a file: by the chunk index, only the blocks that hold them are opened."""
    magic, bits, n_planes, _, block, _, total = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a plane file")
    at, docs_at = struct.unpack("<QQ", blob[-16:])
    index = np.frombuffer(blob, "<u8", (docs_at - at) // 8, at).reshape(-1, n_planes, 2)
    open_ = zstandard.ZstdDecompressor()
    first, last = start // block, -(-(start + n) // block)
    parts = [np.zeros(0, "<u4")]
    for k in range(first, last):
        planes = [open_.decompress(blob[a : a + size]) if size else None for a, size in index[k].tolist()]
        parts.append(from_planes(planes, min(block, total - k * block), bool(bits)))
    return np.concatenate(parts)[start - first * block :][:n]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = 1 << 19, block: int = 65536, bits: bool = False) -> DataFrame:
    """Encode docs (doc_id long, text string; other columns are ignored) and write the ids in
    ascending doc_id order (null first; equal doc_ids by text) as files of about shard_ids ids
    each, rows of a Parquet table in the shared folder: part, shard, n_ids, n_docs, blob.  Null
    text counts as empty and has the end id only.  A document never spans two files."""

    def encode(batches):
        part = TaskContext.get().partitionId()
        use = encoder(tokenizer, end_id)
        held, number, total = [], 0, 0

        def flush():
            nonlocal held, number, total
            ids, doc, has, counts = (np.concatenate(x) for x in zip(*held))
            blob = write_shard(ids, doc, has, counts, block, bits)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)]), pa.array([len(counts)]), pa.array([blob], pa.binary())], ["part", "shard", "n_ids", "n_docs", "blob"])
            held, number, total = [], number + 1, 0
            return row

        for batch in batches:
            doc = batch.column(0)
            has = doc.is_valid().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids, counts = use.encode(texts[a:b])
                held.append((ids, doc[a:b], has[a:b], counts))
                total += len(ids)
                if total >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(encode, SHARD), "token-files")


def read_ids(files: DataFrame) -> DataFrame:
    """Documents of the files that write_ids wrote, from their bytes: doc_id, start (ids of all
    documents before), n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def decode(batches):
        for batch in batches:
            for part, shard, blob in zip(*(c.to_pylist() for c in batch.columns)):
                ids, doc, has, counts = read_shard(blob)
                begin = np.cumsum(counts) - counts
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), counts.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(doc, pa.int64(), mask=has == 0), pa.array(begin), pa.array(counts), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    index = files.select("part", "shard", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row a partition of the write, not one a document
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = index.withColumn("in_part", earlier).join(parts, "part").select("part", "shard", (F.col("in_part") + F.col("part_start")).alias("file_start"))
    spans = files.select("part", "shard", "blob").mapInArrow(decode, SPANS)
    return spans.join(starts, ["part", "shard"]).select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the documents of wanted (doc_id): doc_id, ids.  Of each file the table of documents is
    read, and of its ids only the blocks that hold wanted documents.  Documents with a null id aren't
    found; equal doc_ids are documents of their own, each a row."""

    def spans(batches):
        for batch in batches:
            for part, shard, blob in zip(*(c.to_pylist() for c in batch.columns)):
                doc, has, counts = documents_of(blob)
                n = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(doc, pa.int64(), mask=has == 0), pa.array(np.cumsum(counts) - counts), pa.array(counts)], ["part", "shard", "doc_id", "begin", "n"])

    def decode(batches):
        for batch in batches:
            for blob, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(x["doc_id"], read_span(blob, x["begin"], x["n"]).astype(np.int64).tolist()) for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    found = files.select("part", "shard", "blob").mapInArrow(spans, "part int, shard int, doc_id long, begin long, n long")
    found = found.join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # at most the documents of one file
    asked = found.groupBy("part", "shard").agg(F.collect_list(F.struct("doc_id", "begin", "n")).alias("asked"))
    return files.join(asked, ["part", "shard"]).select("blob", "asked").mapInArrow(decode, "doc_id long, ids array<long>")
