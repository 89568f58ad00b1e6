"""Telephony audio columns: G.711 and ADPCM in WAVE files, decoded to resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, runs_by_size

# WAVE format tags, and the step sizes and index moves of IMA ADPCM.
A_LAW, MU_LAW, IMA = 6, 7, 17
IMA_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)

UNIT = 576  # bytes of a stored unit: 576 samples of G.711, the nibbles of one ADPCM block
BLOCK_HEAD = 4  # bytes before the nibbles of an ADPCM block: first sample, step index, 0
MEDIA = "doc_id long, n_bytes long, codec int, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string, pcm binary"


def mu_law_table() -> np.ndarray:
    x = ~np.arange(256, dtype=np.int32) & 255
    size = ((((x & 15) << 3) + 132) << ((x & 112) >> 4)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    x = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (x & 112) >> 4, (x & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of IMA ADPCM blocks (rows of bytes: head and nibbles, low nibble first), one
    step at a time over all blocks at once.  A block has one sample more than nibbles."""
    head = np.ascontiguousarray(blocks[:, :BLOCK_HEAD])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, 88)
    data = np.ascontiguousarray(blocks[:, BLOCK_HEAD:].T)
    out = np.empty((2 * data.shape[0] + 1, len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * data.shape[0]):
        nibble = (data[k >> 1] >> 4 if k & 1 else data[k >> 1] & 15).astype(np.int32)
        step = IMA_STEPS[index]
        move = (step >> 3) + step * (nibble >> 2 & 1) + (step >> 1) * (nibble >> 1 & 1) + (step >> 2) * (nibble & 1)
        value = np.clip(np.where(nibble & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[nibble], 0, 88)
        out[k + 1] = value
    return out.T


def wave(codec: int, data: bytes, samples: int, rate: int = 8000) -> bytes:
    """A mono WAVE file with data of the codec."""
    if codec == IMA:
        block = UNIT + BLOCK_HEAD
        form = struct.pack("<HHIIHHHH", IMA, 1, rate, rate * block // (2 * UNIT + 1), block, 4, 2, 2 * UNIT + 1)
    else:
        form = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0)
    parts = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def read_wave(media: bytes) -> tuple[int, int, memoryview]:
    """(codec, block size, data) of a WAVE file."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, align = 12, 0, 1
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            codec, _, _, _, align = struct.unpack_from("<HHIIH", view, at + 8)
        elif kind == b"data":
            return codec, align, view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in a WAVE file")


def encode_payload(payload: bytes) -> tuple[int, bytes]:
    """A payload (a positive multiple of UNIT bytes) kept whole in a WAVE file: its CRC-32 chooses
    mu-law or A-law, whose samples are its bytes, or ADPCM, whose nibbles they are."""
    codec = (MU_LAW, A_LAW, IMA)[zlib.crc32(payload) % 3]
    if codec != IMA:
        return codec, wave(codec, payload, len(payload))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    blocks = np.zeros((len(rows), BLOCK_HEAD + UNIT), np.uint8)
    blocks[:, BLOCK_HEAD:] = rows
    return codec, wave(codec, blocks.tobytes(), len(rows) * (2 * UNIT + 1))


def upsample(x: np.ndarray) -> np.ndarray:
    """int16 PCM at twice the rate: samples in between by a four-point filter (-1, 9, 9, -1)/16."""
    n = len(x)
    wide = np.pad(x.astype(np.int32), 2, mode="edge" if n else "constant")
    out = np.empty(2 * n, np.int16)
    out[::2] = x
    out[1::2] = np.clip((9 * (wide[2 : n + 2] + wide[3 : n + 3]) - wide[1 : n + 1] - wide[4 : n + 4] + 8) >> 4, -32768, 32767) if n else 0
    return out


def _pcm(found: list[tuple[int, int, memoryview]], most: int = 8192) -> list[np.ndarray]:
    """Samples of several files; the ADPCM blocks of all files are decoded together."""
    rows = [np.frombuffer(data, np.uint8).reshape(-1, align) for codec, align, data in found if codec == IMA]
    decoded: list[np.ndarray] = []
    if rows:
        every = np.concatenate(rows)
        samples = np.concatenate([decode_ima(every[k : k + most]) for k in range(0, len(every), most)])
        at = 0
        for r in rows:
            decoded.append(samples[at : at + len(r)].ravel())
            at += len(r)
    turn = iter(decoded)
    return [next(turn) if codec == IMA else TABLES[codec][np.frombuffer(data, np.uint8)] for codec, _, data in found]


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, codec and media: the UTF-8 of text (null: empty), padded with bytes 255 to a
    positive multiple of UNIT, as a WAVE file.  Other columns are ignored."""

    def run(batches):
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            for a, b in runs_by_size(ends):
                size = np.diff(ends[a : b + 1])
                codecs, media = [], []
                for at, n in zip(ends[a:b].tolist(), size.tolist()):
                    payload = data[at : at + n].tobytes() + b"\xff" * ((UNIT if n == 0 else -n % UNIT))
                    codec, wav = encode_payload(payload)
                    codecs.append(codec)
                    media.append(wav)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(codecs, pa.int32()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "codec", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MEDIA)


def decode_media(media: DataFrame) -> DataFrame:
    """media with a column pcm: little-endian int16 samples at twice the stored rate."""

    def run(batches):
        for batch in batches:
            waves = batch.column(3).to_pylist()
            pcm = [upsample(x).astype("<i2").tobytes() for x in _pcm([read_wave(w) for w in waves])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pcm, pa.large_binary()).cast(pa.binary())], [*batch.schema.names, "pcm"])

    return media.select("doc_id", "n_bytes", "codec", "media").mapInArrow(run, MEDIA + ", pcm binary")


def media_features(media: DataFrame) -> DataFrame:
    """The digest of stored media, all of it from the stored bytes: the payload read back and its
    hashes, those of the file, a feature string (codec, sample count, peak, mean square in integer
    arithmetic, zero crossings, after decoding and resampling), and the PCM that it is of, as
    decode_media gives it: little-endian int16 samples at twice the stored rate."""
    names = {MU_LAW: "mulaw", A_LAW: "alaw", IMA: "ima"}

    def run(batches):
        for batch in batches:
            doc, n_bytes = batch.column(0), batch.column(1)
            held = batch.column(3)
            _, ends = flat_bytes(held)
            for a, b in runs_by_size(ends, 2_000_000):
                waves = held.slice(a, b - a).to_pylist()
                found = [read_wave(w) for w in waves]
                rows = []
                for w, (codec, align, data), samples in zip(waves, found, _pcm(found)):
                    payload = np.frombuffer(data, np.uint8).reshape(-1, align)[:, BLOCK_HEAD:].tobytes() if codec == IMA else bytes(data)
                    pcm = upsample(samples)
                    wide = pcm.astype(np.int64)
                    mean_square = int(wide @ wide) // max(1, len(pcm))
                    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
                    feature = f"{names[codec]};n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};ms={mean_square};zc={crossings}"
                    raw = pcm.astype("<i2").tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(w), hashlib.sha256(w).hexdigest(), feature, len(raw), hashlib.sha256(raw).hexdigest(), raw))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), n_bytes.slice(a, b - a), *(pa.array(c, k) for c, k in zip(columns, kinds))], [x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "codec", "media").mapInArrow(run, FEATURES)
