"""WARC archives as seekable Zstandard bundles: independent frames, a footer seek table, and an index of the records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .base import settle, table

# Fixed values of the seekable format: a skippable frame at the end holds sizes of all frames and ends with this footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1

FRAME_BYTES = 1 << 20     # records of a frame, about (a larger record has a frame of its own)
BUNDLE_BYTES = 64 << 20   # records of a bundle before compression, about
READ_FRAMES = 16          # frames that one task reads back, about
LEVEL = 3
INDEX = "page_id {}, path string, frame int, offset long, length long"
RECORD = "page_id {}, payload_bytes long, payload_digest string, record_type string, refers_to {}"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line (control characters are percent-encoded)."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the digest and size of its payload, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    start, size = end + 4, int(head["Content-Length"])
    if data[start + size:start + size + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    return head, data[start:start + size], start + size + 4


class Bundle:
    """Writer of one bundle: records gather in frames, ``close`` appends the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.waiting, self.held, self.sizes, self.total = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and frame-relative offset of the record."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self._flush()
        place = (len(self.sizes), self.held)
        self.waiting.append(data)
        self.held += len(data)
        self.total += len(data)
        return place

    def _flush(self) -> None:
        frame = self.press.compress(b"".join(self.waiting))
        self.out.write(frame)
        self.sizes.append((len(frame), self.held))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()


class BundleReader:
    """Frames of a bundle through its seek table."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != FOOTER:
            raise ValueError("no seek table")
        entries = source.read_at(8 * frames, size - 9 - 8 * frames)
        self.frames, at = [], 0
        for k in range(frames):
            packed, plain = struct.unpack_from("<II", entries, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=max(plain, 1))

    def record(self, frame: int, offset: int) -> tuple[dict, bytes]:
        return parse(self.frame(frame), offset)[:2]


def opened(path: str) -> BundleReader:
    files, name = pafs.FileSystem.from_uri(path)
    return BundleReader(files.open_input_file(name))


def with_types(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with is_revisit and refers_to: of equal payloads the largest page_id is the response."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # Only payloads that occur more than once are joined back; a frequent one is counted before the shuffle.
    twice = p.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1").select("sha", "top")
    j = p.join(twice, "sha", "left")
    revisit = F.coalesce(F.col("top").isNotNull() & ((F.col("page_id") < F.col("top")) | F.col("page_id").isNull()), F.lit(False))
    return j.select("page_id", "url", "html", revisit.alias("is_revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes the pages as bundles in a folder that all executors share; returns the stored index of the records.

    page_id, path, frame, offset (inside the frame's plain bytes), length. A task names its bundles anew at every attempt, so a
    repeated or speculative attempt never touches a finished one; only bundles named in the index count.

    Null html is an empty payload, a null url gives no target header, a null page_id an empty record id. Repeated rows with the
    largest page_id of their payload are all responses. Texts are encoded in UTF-8. An empty table gives an empty index.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    arrow_id = pages.select("page_id").limit(0).toArrow().schema.field(0).type

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base)
        bundle, path, index = None, "", []

        def done() -> pa.RecordBatch:
            bundle.close()
            cols = list(zip(*index))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_id), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()),
                                               pa.array(cols[4], pa.int64())], ["page_id", "path", "frame", "offset", "length"])

        for b in batches:
            for page_id, url, html, is_revisit, refers_to in zip(*[c for c in b.columns]):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    path, bundle, index = f"{folder}/{name}", Bundle(files.open_output_stream(f"{base}/{name}", compression=None), frame_bytes), []
                data = record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py(), is_revisit.as_py())
                index.append((page_id.as_py(), path, *bundle.add(data), len(data)))
                if bundle.total >= bundle_bytes:
                    yield done()
                    bundle = None
        if bundle is not None:
            yield done()

    typed = with_types(pages).withColumn("html", F.encode("html", "UTF-8"))
    return settle(typed.mapInArrow(write, INDEX.format(id_type)), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests of responses are computed from the payload that was read; a record whose header says otherwise is an error.
    """
    id_type = index.schema["page_id"].dataType.simpleString()
    arrow_id = index.select("page_id").limit(0).toArrow().schema.field(0).type
    convert = str if pa.types.is_string(arrow_id) else int

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, bundle = None, None
        for b in batches:
            for name, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != path:
                    path, bundle = name, opened(name)
                data, at, out = bundle.frame(k), 0, []
                while at < len(data):
                    head, block, at = parse(data, at)
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        if (len(payload), payload_digest(payload)) != (size, digest):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} in {path} is damaged")
                    own, other = (head.get(x, "<urn:page:>")[len("<urn:page:"):-1] for x in ("WARC-Record-ID", "WARC-Refers-To"))
                    out.append((convert(own) if own else None, size, digest, head["WARC-Type"], convert(other) if other else None))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (arrow_id, pa.int64(), pa.string(), pa.string(), arrow_id))],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return dealt_frames(index).mapInArrow(read, RECORD.format(id_type, id_type))


def dealt_frames(index: DataFrame) -> DataFrame:
    """path, frame of every frame, in ranges of about READ_FRAMES frames a task: a large bundle is read by several tasks.

    By range and not by hash: a hash of the path would deal few bundles unevenly, and Spark leaves it out where distinct has
    already dealt the rows over as many partitions, which adaptive execution then joins to one.
    """
    frames = index.select("path", "frame").distinct()
    n = max(1, -(-frames.count() // READ_FRAMES))
    return frames.repartitionByRange(n, "path", "frame").sortWithinPartitions("path", "frame")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), new_path(spark, "warc")))


OP6_SQL = """WITH P AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    B AS (SELECT page_id, strlen(html) AS n, h, list_reduce(list_prepend('', list_transform(range(40),
        lambda i: lpad(bin(('0x' || h[i + 1])::INTEGER), 4, '0'))), lambda a, b: a || b) AS bits FROM P),
    T AS (SELECT h, max(page_id) AS top FROM P GROUP BY h)
    SELECT page_id, n::BIGINT AS payload_bytes, list_reduce(list_prepend('', list_transform(range(32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j: bits[5 * i + j + 1]::INTEGER * (16 >> j::INTEGER)))::INTEGER])),
        lambda a, b: a || b) AS payload_digest,
      CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
    FROM B JOIN T USING (h)"""
