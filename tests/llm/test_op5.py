import base64
import hashlib
import struct

import zstandard
from pyspark.sql import functions as F

from siftline.llm import op5_warc as op

SCHEMA = "page_id long, url string, html string"
PAGES = [(5, "http://a/5", "same"), (3, "http://a/3\r\nX: y", "same"), (9, None, "same"), (1, "http://a/1", ""), (2, "u", None), (7, "u", "own é\r\n\r\nWARC/1.1"), (7, "u", "other"), (8, "u", "x" * 700_000), (None, "u", "same"), (None, "u", "lonely"), (3, "http://a/3", "same"), (11, "u", "twice"), (11, "u", "twice")]


def expected(pages, least=0):
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "").encode() == raw and p is not None]
        first = min(ids) if ids and len(raw) >= least else None
        revisit = first is not None and page_id != first
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1, 2) for p in PAGES], SCHEMA + ", sha int, payload int")
    for least in (0, 3, 5):
        bundles = op.write(pages, min_payload=least, bundle_bytes=1 << 19)
        got = sorted((tuple(r) for r in op.read(bundles).collect()), key=str)
        assert got == expected(PAGES, least)
    assert bundles.count() >= 2
    empty = op.write(pages.where(F.lit(False)))
    assert empty.count() == 0 and op.read(empty).count() == 0


def test_index_leads_to_single_frames(spark, tmp_path):
    bundles = op.write(spark.createDataFrame([(i, f"u{i}", f"page {i} " * 9000) for i in range(40)], SCHEMA))
    row = bundles.first()
    content = bytes(row.content)
    seek = op.Seekable(content)
    assert len(seek.places) > 5 and len({f for f in row.frames}) == len(seek.places)
    for page_id, frame, offset in list(zip(row.ids, row.frames, row.offsets, strict=True))[::7]:
        fields, block = op.fetch(content, frame, offset)
        assert fields["warc-record-id"] == f"<urn:page:{page_id}.>" and block.endswith(f"page {page_id} ".encode() * 9000)
    # any Zstandard reader reads the whole, and the table ends in the format's magic number
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(row.ids) and struct.unpack("<I", content[-4:])[0] == 0x8F92EAB1
    names = op.export(bundles, str(tmp_path))
    assert (tmp_path / names[0]).read_bytes()[:4] == b"\x28\xb5\x2f\xfd"


def test_damage_is_noticed():
    b = op.Bundle()
    frame, at = b.add(op.record(1, "u", b"payload", None))
    data = b.finish()
    assert op.fetch(data, frame, at)[0]["warc-type"] == "response"
    for bad in (data[:-1], data[:-9] + bytes(9)):
        try:
            op.Seekable(bad)
        except ValueError:
            continue
        raise AssertionError


def test_query(spark, sf):
    got = op.query(spark, sf)
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(pages)
