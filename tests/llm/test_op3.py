import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import op3_telephony as op
from tests.llm.common import clashing, documents


def scalar_ima(block):
    level = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [level]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(op.STEPS[index])
            diff = step >> 3
            diff += step if nibble & 4 else 0
            diff += step >> 1 if nibble & 2 else 0
            diff += step >> 2 if nibble & 1 else 0
            level = max(-32768, min(32767, level - diff if nibble & 8 else level + diff))
            index = max(0, min(88, index + int(op.INDEX_CHANGE[nibble & 7])))
            out.append(level)
    return out


def test_tables():
    assert [int(op.MU[c]) for c in (0x00, 0x7F, 0x80, 0xFF, 0x8F)] == [-32124, 0, 32124, 0, 16764]
    assert [int(op.A[c]) for c in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    assert len(set(op.A.tolist())) == 256 and len(op.STEPS) == 89


def test_adpcm_like_a_scalar_decoder():
    rng = random.Random(2)
    blocks = [bytes(rng.randrange(256) for _ in range(64)) for _ in range(20)]
    got = op.decode_ima(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 64))
    assert got.tolist() == [scalar_ima(b) for b in blocks]


def test_resampling():
    x = np.array([0, 100, -100], np.int16)
    assert op.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert op.resample(x, 8000, 8000).tolist() == x.tolist() and len(op.resample(np.arange(160, dtype=np.int16), 16000, 8000)) == 80


def scalar_law(code, a_law):
    """G.711 from its definition: sign, segment, step."""
    code = code ^ 0x55 if a_law else ~code & 0xFF
    segment, step = code >> 4 & 7, code & 15
    if a_law:
        size = (step * 2 + 1 if not segment else (step * 2 + 33) << segment - 1) << 3
        return size if code & 128 else -size
    size = (((step * 2 + 33) << segment) - 33) << 2
    return -size if code & 128 else size


def scalar_resample(x, rate, to):
    out = []
    for k in range(max(1, len(x) * to // rate)):
        left, part = divmod(k * rate, to)
        left = min(left, len(x) - 1)
        out.append(x[left] + (x[min(left + 1, len(x) - 1)] - x[left]) * part // to)
    return out


def packed(x):
    return b"".join(int(v).to_bytes(2, "little", signed=True) for v in x)


def scalar_feature(payload):
    said = []
    for name in ("mu", "a"):
        x = scalar_resample([scalar_law(c, name == "a") for c in payload], 8000, 16000)
        crossings = sum((u < 0) != (v < 0) for u, v in zip(x, x[1:], strict=False))
        said.append(f"{name}:{len(x)},{min(x)},{max(x)},{sum(map(abs, x)) // len(x)},{crossings},{zlib.crc32(packed(x)):08x}")
    x = scalar_resample([v for k in range(0, len(payload), 64) for v in scalar_ima(payload[k : k + 64])], 8000, 16000)
    said.append(f"adpcm:{len(x)},{min(x)},{max(x)},{zlib.crc32(packed(x)):08x}")
    x = scalar_resample([scalar_law(c, False) for c in payload], 8000, op.STORED_RATE)
    return ";".join([*said, f"pcm:{op.STORED_RATE},{len(x)},{zlib.crc32(packed(x)):08x}"])


def test_round_trip(spark):
    docs = clashing(documents(spark))
    table = op.stored(docs)
    assert len(table.inputFiles()) > 0 and table.columns == ["doc_id", "n_bytes", "media", "pcm"]
    got = op.decode_media(table).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = op.wave(op.MU_LAW, op.RATE, 8, 1, payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == scalar_feature(payload)
    one = {r.doc_id: r.feature for r in op.decode_media(table, batch_bytes=1).collect()}
    assert all(one[r.doc_id] == r.feature for r in got)
    assert op.decode_media(op.stored(docs.where(F.lit(False)))).count() == 0


def test_long_text(spark):
    text = "a long téxt of many blocks " * 12_000
    r = op.decode_media(op.stored(documents(spark, [(1, text, "en", "s", 1)]))).first()
    raw = text.encode()
    payload = raw + bytes(-len(raw) % 64)
    assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.feature.split(";")[0].startswith(f"mu:{2 * len(payload)},")


def test_null_and_foreign_media(spark):
    good = op.wave(op.MU_LAW, 8000, 8, 1, bytes(64))
    media = [None, b"no wave", b"", op.wave(op.PCM, 8000, 16, 2, bytes(64)), op.wave(op.MU_LAW, 8000, 8, 1, b""), good]
    frame = spark.createDataFrame([(k, 1, m, None) for k, m in enumerate(media)], "doc_id int, n_bytes long, media binary, pcm binary")
    by = {r.doc_id: r for r in op.decode_media(frame).collect()}
    assert all(by[k].feature is None and by[k].payload_sha256 is None and by[k].media_bytes is None for k in range(5))
    assert by[5].payload_bytes == 64 and by[5].feature.endswith("pcm:none")


def test_pcm_of_all_codecs(spark):
    body = bytes(range(128))
    media = [op.wave(op.MU_LAW, 8000, 8, 1, body), op.wave(op.A_LAW, 8000, 8, 1, body), op.wave(op.IMA_ADPCM, 8000, 4, 64, body), op.wave(op.PCM, 8000, 16, 2, body), b"no wave", None]
    frame = spark.createDataFrame(list(enumerate(media)), "id long, media binary")
    got = {r.id: r.pcm for r in op.to_pcm(frame, key="id").collect()}
    assert got[4] is None and got[5] is None
    for k, samples in ((0, op.MU[: 128]), (1, op.A[:128]), (2, op.decode_ima(np.frombuffer(body, np.uint8).reshape(-1, 64)).ravel())):
        tag, rate, align, pcm = op.parse_wave(bytes(got[k]))
        assert (tag, rate, align) == (op.PCM, 16000, 2) and np.frombuffer(pcm, "<i2").tolist() == op.resample(samples, 8000, 16000).tolist()
