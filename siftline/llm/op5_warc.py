"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames of whole WARC records, closed by a seek table in a
skippable frame (the public seekable format), with an index from record to frame and offset in the frame;
any record is read by decompressing its frame alone. Bundles are rows of a table in the shared folder: a
name, the file's bytes and its index. ``export`` hands them out as files.

Equal payloads are found by SHA-1 and length. Only ids and digests are grouped and joined, so a payload
that a third of all pages share costs partial minima, not a group; the revisits are joined by id and digest.

Defined cases: a null payload is empty, and empty payloads equal each other; a null url has no target
line, line breaks in urls are percent-encoded. Rows with equal id and payload are each a record of the same
type; equal ids with different payloads are different records. A null id is never the smallest: with equal
payloads it revisits, alone it is a response. An empty table gives no bundles and no rows. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.storage import written

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 16 << 20, 3
MIN_PAYLOAD = 0
#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}.>"


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A WARC 1.1 response, or a revisit of another record if refers_to is given."""
    head = _HTTP % len(payload)
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """(named fields in lower case, block) of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(fields["content-length"])
    block = data[stop + 4 : stop + 4 + n]
    if len(block) < n or data[stop + 4 + n : stop + 8 + n] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return fields, block


class Bundle:
    """Writes frames of whole records and the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.out, self.open, self.size = bytearray(), bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self._close()
        place = len(self.frames), len(self.open)
        self.open += data
        self.size += len(data)
        return place

    def _close(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.frames.append((len(packed), len(self.open)))
        self.out += packed
        self.open = bytearray()

    def finish(self) -> bytes:
        if self.open:
            self._close()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class Seekable:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        at = len(data) - 9 - n * width
        if struct.unpack_from("<I", data, at - 8)[0] != SKIPPABLE:
            raise ValueError("no skippable frame before the seek table")
        self.places, begin = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", data, at + k * width)
            self.places.append((begin, packed, plain))
            begin += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        begin, packed, plain = self.places[k]
        return self.unpacker.decompress(self.data[begin : begin + packed], max_output_size=max(plain, 1))


def revisits(slim: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, sha, refers_to) of the records that repeat a smaller id's payload; slim: page_id, sha, payload_bytes."""
    again = slim.where(F.col("payload_bytes") >= min_payload).groupBy("sha", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    again = written(again.where("n > 1 and refers_to is not null").drop("n"))  # so that the join below is one of plain shuffles, which can be split
    same = slim.join(again.hint("merge"), ["sha", "payload_bytes"])
    return same.where("page_id is null or page_id <> refers_to").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to").distinct()


BUNDLE_COLUMNS = "bundle string, content binary, ids array<{kind}>, frames array<int>, offsets array<long>"


def write(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = MIN_PAYLOAD, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of all pages, as written to the shared folder: (bundle, content, ids, frames, offsets)."""
    kind = pages.schema[key].dataType.simpleString()
    full = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    slim = full.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    again = revisits(slim, min_payload)
    all_records = full.withColumn("sha", F.sha1("payload"))
    linked = all_records.hint("merge").join(again, all_records.page_id.eqNullSafe(again._id) & (all_records.sha == again._sha), "left")
    linked = linked.select("page_id", "url", "payload", "sha", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index, first = Bundle(), ([], [], []), None
        names = ["bundle", "content", "ids", "frames", "offsets"]

        def close() -> pa.RecordBatch:
            content = bundle.finish()
            name = f"{hashlib.sha256(content).hexdigest()[:32]}.warc.zst"
            lists = [pa.array([index[0]], pa.list_(first)), pa.array([index[1]], pa.list_(pa.int32())), pa.array([index[2]], pa.list_(pa.int64()))]
            return pa.record_batch([pa.array([name]), pa.array([content], pa.binary()), *lists], names=names)

        for batch in batches:
            first = batch.column(0).type
            for page_id, target, body, refers_to in zip(*(batch.column(i) for i in (0, 1, 2, 4)), strict=True):
                place = bundle.add(record(page_id.as_py(), target.as_py(), body.as_py(), refers_to.as_py()))
                index[0].append(page_id.as_py())
                index[1].append(place[0])
                index[2].append(place[1])
                if bundle.size >= bundle_bytes:
                    yield close()
                    bundle, index = Bundle(), ([], [], [])
        if index[0]:
            yield close()

    return written(linked.mapInArrow(run, BUNDLE_COLUMNS.format(kind=kind)))


def read(bundles: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Every record of the bundles, found by the index: (key, payload_bytes, payload_digest, record_type, refers_to)."""
    kind = bundles.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                seek, rows = Seekable(batch.column(1)[row].as_py()), ([], [], [], [])
                ids, frames, offsets = (batch.column(i)[row] for i in (2, 3, 4))
                current, data = -1, b""
                for page_id, frame, at in zip(ids.as_py(), frames.as_py(), offsets.as_py(), strict=True):
                    if frame != current:
                        current, data = frame, seek.frame(frame)
                    fields, block = parse_record(data, at)
                    if fields["warc-record-id"] != _urn(page_id):
                        raise ValueError(f"the index leads to {fields['warc-record-id']} instead of {_urn(page_id)}")
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size, said = int(head.rpartition(b"Content-Length: ")[2]), fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != said):
                        raise ValueError(f"the payload of {_urn(page_id)} is damaged")
                    rows[0].append(size)
                    rows[1].append(said)
                    rows[2].append(fields["warc-type"])
                    to = fields.get("warc-refers-to")
                    rows[3].append(to and unquote(to[len("<urn:page:") : -2]))
                columns = [ids.values, pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3], pa.string())]
                yield pa.record_batch(columns, names=[key, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = bundles.mapInArrow(run, f"`{key}` {kind}, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumn("refers_to", F.col("refers_to").cast(kind))


def fetch(content: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle, by its frame and the offset in it."""
    return parse_record(Seekable(content).frame(frame), offset)


def export(bundles: DataFrame, folder: str) -> list[str]:
    """Writes the bundles as files into a folder of the driver, one at a time, and returns their names."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for name, content in bundles.select("bundle", "content").toLocalIterator():
        Path(folder, name).write_bytes(content)
        names.append(name)
    return sorted(names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")))
