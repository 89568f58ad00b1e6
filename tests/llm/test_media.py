import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from memspark.llm import media


def test_round_trip(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "é" * 1000), (5, "x" * 576), (6, "abc"), (None, "q"), (7, "\0" * 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).repartition(3)
    got = media.media_features(media.store_media(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (576 if not data else -len(data) % 576)
        r = by[doc]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes > r.payload_bytes
    assert by[1][1:] == by[6][1:] and by[2][1:] == by[3][1:]
    stored = media.decode_media(media.store_media(df)).collect()
    assert all(hashlib.sha256(r.media).hexdigest() == by[r.doc_id].media_sha256 and hashlib.sha256(r.pcm).hexdigest() == by[r.doc_id].pcm_sha256 for r in stored)


def test_features_come_with_their_pcm(spark):
    df = spark.createDataFrame([(k, "x" * (k * 300) + "é") for k in range(9)], "doc_id long, text string")
    stored = media.store_media(df)
    pcm = {r.doc_id: bytes(r.pcm) for r in media.decode_media(stored).collect()}
    got = media.media_features(stored).collect()
    assert {r.doc_id: bytes(r.pcm) for r in got} == pcm and len({r.feature.split(";")[0] for r in got}) > 1
    assert all(r.pcm_bytes == len(r.pcm) and f"n={len(r.pcm) // 2};" in r.feature for r in got)


def test_tables():
    mu, a = media.TABLES[media.MU_LAW], media.TABLES[media.A_LAW]
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)


def test_adpcm_equals_a_loop():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 40), np.uint8)
    blocks[:, 2] %= 89
    got = media.decode_ima(blocks)
    for b, row in zip(blocks, got):
        value, index = int(np.uint16(int(b[0]) | int(b[1]) << 8).view(np.int16)), int(b[2])
        want = [value]
        for byte in b[4:].tolist():
            for nibble in (byte & 15, byte >> 4):
                step = int(media.IMA_STEPS[index])
                d = step >> 3
                d += step if nibble & 4 else 0
                d += step >> 1 if nibble & 2 else 0
                d += step >> 2 if nibble & 1 else 0
                value = max(-32768, min(32767, value - d if nibble & 8 else value + d))
                index = max(0, min(88, index + int(media.IMA_MOVES[nibble])))
                want.append(value)
        assert row.tolist() == want


def test_upsample():
    assert media.upsample(np.array([], np.int16)).tolist() == []
    x = media.upsample(np.full(9, 100, np.int16))
    assert len(x) == 18 and set(x.tolist()) == {100}


def test_empty_table(spark):
    assert media.media_features(media.store_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
