"""Telephony audio columns: G.711 mu-law and A-law by lookup tables, IMA ADPCM blocks decoded with numpy
across blocks, and resampled PCM in WAVE containers.

``encode_media`` makes payload bytes the 8-bit mu-law samples of a WAVE file and ``to_pcm`` turns a media column
of any of the three codecs into 16-bit linear PCM at another rate. The query writes both columns to a table in
the shared folder, and ``decode_media`` computes digests and features from what it reads back. All arithmetic is
on integers, so equal media give equal results on any machine. The query's PCM is stored at ``STORED_RATE``, a
byte for each byte of media before compression; ``PCM_RATE``, at which features are taken, would store four.

Defined cases: a null or empty text has the payload of 64 zero bytes. Payloads of any length are taken
whole. Media that are no WAVE file of a known codec, and null media, give null PCM, digests and features, as do
samples of other codecs than 8-bit ones in ``decode_media``. Repeated rows are treated each on its
own, alike; null ids are carried; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import textvec as tv
from siftline.llm.storage import written

RATE, PCM_RATE, STORED_RATE, UNIT = 8000, 16000, 4000, 64
#: WAVE format tags.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17


def mu_law_table() -> np.ndarray:
    """Linear value of each mu-law code (G.711): inverted bits, sign, 3-bit segment, 4-bit step, bias 33."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 1) + 33) << ((code >> 4) & 7)) - 33
    return (np.where(code & 128, -size, size) << 2).astype(np.int16)


def a_law_table() -> np.ndarray:
    """Linear value of each A-law code (G.711): even bits inverted, sign, 3-bit segment, 4-bit step."""
    code = np.arange(256) ^ 0x55
    part, step = (code >> 4) & 7, ((code & 15) << 1) + 1
    size = np.where(part == 0, step, (step + 32) << np.maximum(part - 1, 0))
    return (np.where(code & 128, size, -size) << 3).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM."""
    # fixed values of the format
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int32,
    )


MU, A = mu_law_table(), a_law_table()
STEPS = ima_steps()
#: The change of the step index by the three low bits of a nibble.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """(difference, next index) by 16 * index + nibble."""
    step, nibble = STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    after = np.clip(np.arange(89, dtype=np.int32)[:, None] + INDEX_CHANGE[nibble & 7], 0, 88)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


DIFFERENCE, NEXT_INDEX = _ima_tables()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: (n, size) bytes to (n, 2 * size - 7) samples. One step over all blocks per nibble."""
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), dtype=np.int16)
    level = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out[0] = level
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(size - 4):
        for half, nibble in enumerate((body[k] & 15, body[k] >> 4)):
            at = index + nibble
            level = np.clip(level + DIFFERENCE[at], -32768, 32767)
            index = NEXT_INDEX[at]
            out[1 + 2 * k + half] = level
    return out.T


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at exact rational positions, rounded down, in integers."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    n = max(1, len(samples) * to // rate)
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, at % to
    left = np.minimum(left, len(samples) - 1)
    right = np.minimum(left + 1, len(samples) - 1)
    wide = samples.astype(np.int64)
    return (wide[left] + (wide[right] - wide[left]) * part // to).astype(np.int16)


def wave(tag: int, rate: int, bits: int, align: int, body: bytes) -> bytes:
    """A mono RIFF WAVE file."""
    samples = 2 * (align - 4) + 1 if tag == IMA_ADPCM else 1  # in a block
    extra = {PCM: b"", IMA_ADPCM: struct.pack("<HH", 2, samples)}.get(tag, struct.pack("<H", 0))
    per_second = rate * align // samples
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    pad = b"\0" if len(body) & 1 else b""
    riff = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body + pad
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


def parse_wave(media: bytes | None) -> tuple[int, int, int, memoryview] | None:
    """(tag, rate, align, body), or None if media is no WAVE file."""
    if media is None or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    view, at, form = memoryview(media), 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and form:
            return form[0], form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None


def linear(tag: int, align: int, body: memoryview) -> np.ndarray | None:
    """16-bit samples of a WAVE body."""
    raw = np.frombuffer(body, np.uint8)
    if tag == MU_LAW:
        return MU[raw]
    if tag == A_LAW:
        return A[raw]
    if tag == PCM and align == 2:
        return raw[: len(raw) // 2 * 2].view("<i2").astype(np.int16)
    if tag == IMA_ADPCM and align > 4:
        return decode_ima(raw[: len(raw) // align * align].reshape(-1, align)).ravel()
    return None


def encode_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """(key, n_bytes, media): each text's payload as mu-law samples in a WAVE file."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(1)):
                raw, sizes, media = data.tobytes(), np.diff(offsets), []
                for k in range(b - a):
                    n = int(sizes[k])
                    media.append(wave(MU_LAW, RATE, 8, 1, raw[offsets[k] : offsets[k + 1]] + bytes(-n % unit if n else unit)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, n_bytes long, media binary")


def to_pcm(table: DataFrame, *, key: str = "doc_id", media: str = "media", rate: int = PCM_RATE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, pcm): each row's audio as a WAVE file of 16-bit PCM at the rate."""
    names = [key, *carry]
    slim = table.select(*names, F.col(media).alias("_media"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tv.buffers(batch.column(len(names)))
            for a, b in tv.blocks(offsets, 4 * tv.BLOCK):
                found = []
                for one in batch.column(len(names)).slice(a, b - a).to_pylist():
                    parsed = parse_wave(one)
                    samples = linear(parsed[0], parsed[2], parsed[3]) if parsed else None
                    found.append(None if samples is None else wave(PCM, rate, 16, 2, resample(samples, parsed[1], rate).astype("<i2").tobytes()))
                yield pa.record_batch([*(batch.column(i).slice(a, b - a) for i in range(len(names))), pa.array(found, pa.binary())], names=[*names, "pcm"])

    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in names)
    return slim.mapInArrow(convert, f"{schema}, pcm binary")


def _features(payload: np.ndarray, rate: int) -> str:
    """What the payload sounds like, read as mu-law, A-law and 64-byte ADPCM blocks; each as resampled PCM."""
    said = []
    for name, samples in (("mu", MU[payload]), ("a", A[payload])):
        pcm = resample(samples, rate, PCM_RATE)
        crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
        said.append(f"{name}:{len(pcm)},{int(pcm.min())},{int(pcm.max())},{int(np.abs(pcm.astype(np.int64)).sum()) // len(pcm)},{crossings},{zlib.crc32(pcm.astype('<i2').tobytes()):08x}")
    return ";".join(said)


def _adpcm(samples: np.ndarray, rate: int) -> str:
    pcm = resample(samples, rate, PCM_RATE)
    return f"adpcm:{len(pcm)},{int(pcm.min())},{int(pcm.max())},{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def decode_media(table: DataFrame, *, key: str = "doc_id", unit: int = UNIT, batch_bytes: int = 1 << 20) -> DataFrame:
    """From stored media and PCM: the payload's digests and the features of its audio."""
    kind = table.schema[key].dataType.simpleString()
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def described(payload: np.ndarray, media: bytes, pcm: bytes | None, rate: int, adpcm: np.ndarray) -> dict:
        body = parse_wave(pcm)
        feature = [_features(payload, rate), *([_adpcm(adpcm, rate)] if len(adpcm) else []), f"pcm:{body[1]},{len(body[3]) // 2},{zlib.crc32(body[3]):08x}" if body else "pcm:none"]
        return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-unit:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": ";".join(feature)}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tv.buffers(batch.column(2))
            for a, b in tv.blocks(offsets, batch_bytes):
                stored, pcm = (batch.column(c).slice(a, b - a).to_pylist() for c in (2, 3))
                parsed = [p if (p := parse_wave(m)) and p[0] in (MU_LAW, A_LAW) and len(p[3]) else None for m in stored]
                payloads = [np.frombuffer(p[3], np.uint8) if p else np.empty(0, np.uint8) for p in parsed]
                # ADPCM of all payloads of the block at once, in units of 64 bytes
                decoded = decode_ima(np.concatenate([p[: len(p) // unit * unit] for p in payloads]).reshape(-1, unit))
                cuts = np.cumsum([0, *(len(p) // unit for p in payloads)])
                found = [described(p, stored[k], pcm[k], parsed[k][1], decoded[cuts[k] : cuts[k + 1]].ravel()) if parsed[k] else dict.fromkeys(kinds) for k, p in enumerate(payloads)]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array([f[c] for f in found], t) for c, t in kinds.items())]
                yield pa.record_batch(columns, names=[key, "n_bytes", *kinds])

    return table.select(key, "n_bytes", "media", "pcm").mapInArrow(decode, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rate: int = STORED_RATE) -> DataFrame:
    """(key, n_bytes, media, pcm), written to the shared folder and read back."""
    return written(to_pcm(encode_media(docs, key=key, text=text), key=key, rate=rate, carry=("n_bytes", "media")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))
