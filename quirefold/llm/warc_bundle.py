"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES`` that are compressed independently. A bundle ends in a seek
table in the public seekable format: a skippable frame with the compressed and decompressed size of every frame,
the number of frames and a magic number. The index maps each record to its bundle, frame and offset inside the
decompressed frame, so one record is read by decompressing one frame.

Of the pages with equal payloads of at least ``LEAST_SHARED`` bytes, the one with the largest page_id is written in
full and the others as revisit records that refer to it. Which pages those are is found on digests alone.

Tasks write bundles into the shared folder under names of their own; the stored index names the bundles that count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_sst import file_of

FRAME_BYTES = 1 << 20
LEAST_SHARED = 1000
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: The table has no time of capture.
NO_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, path string, frame int, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    rest = identifier.rsplit(":", 1)[1].rstrip(">")
    return None if rest == "none" else int(rest)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block is the response head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {''.join((url or 'about:blank').split())}",
        f"WARC-Date: {NO_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record starts) of the record at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, raw[start:stop], stop + 4


class BundleWriter:
    def __init__(self, sink):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held, self.size = [], 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Append a record; its frame and its offset there."""
        if self.size >= FRAME_BYTES:
            self._flush()
        place = (len(self.frames), self.size)
        self.held.append(raw)
        self.size += len(raw)
        return place

    def _flush(self) -> None:
        if self.held:
            packed = self.pack.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Bundle:
    """Reads one bundle through its seek table."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        raw = self._read(end - 9 - n * entry, n * entry)
        self.places, at = [], 0
        for i in range(n):
            packed, size = struct.unpack_from("<II", raw, i * entry)
            self.places.append((at, packed, size))
            at += packed

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def frame(self, i: int) -> bytes:
        at, packed, size = self.places[i]
        return zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=size)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        headers, block, _ = parse(self.frame(frame), offset)
        return headers, block

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.places)):
            raw, at = self.frame(i), 0
            while at < len(raw):
                headers, block, at = parse(raw, at)
                yield headers, block


def _write_bundle(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sink, writer = f"{folder}/{uuid.uuid4().hex}.warc.zst", None, None
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    fs, name = file_of(path)
                    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(name, compression=None)
                    writer = BundleWriter(sink)
                raw = record(page_id, url, html.encode(), refers_to)
                rows.append((page_id, path, *writer.add(raw), len(raw)))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                names = ["page_id", "path", "frame", "offset", "length"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if writer:
            writer.close()
            sink.close()

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page with a larger id has too."""
    narrow = common.stored(
        pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= LEAST_SHARED).drop("n"),
        "digests",
    )
    shared = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = common.stored(shared.where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n"), "shared-digests")
    found = narrow.join(common.maybe_broadcast(shared, shared.count()), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return common.stored(found.select("page_id", "digest", "refers_to").distinct(), "revisits")


def write_bundles(pages: DataFrame) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); the index, one row per record.

    Null html is an empty payload, a null url becomes about:blank. Rows that repeat a page_id get records of their
    own under the same identifier; those that repeat the largest page_id of a payload are all responses. Rows with a
    null page_id can be revisits, but nothing refers to them. An empty table writes nothing. A payload of any length is
    a record and a frame of its own. Columns besides the three are left out, whatever their names.
    """
    spark = pages.sparkSession
    common.small_batches(spark, 500)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    again = revisits(pages).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.sha1("html") == F.col("_digest"))
    rows = pages.join(common.maybe_broadcast(again, again.count()), same, "left").select("page_id", "url", "html", "refers_to")
    return common.stored(rows.mapInArrow(_write_bundle(common.fresh_path(spark, "warc")), INDEX), "warc-index")


def _read_bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, name = file_of(path)
            with fs.open_input_file(name) as source:
                rows = []
                for headers, block in Bundle(source):
                    revisit = headers["WARC-Type"] == "revisit"
                    http, _, payload = block.partition(b"\r\n\r\n")
                    told = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if not revisit and (len(payload) != told or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {path}")
                    refers_to = page_of(headers["WARC-Refers-To"]) if revisit else None
                    rows.append((page_of(headers["WARC-Record-ID"]), told, digest, headers["WARC-Type"], refers_to))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, with sizes and digests checked against the payloads."""
    paths = common.stored(index.select("path").distinct(), "warc-paths")
    return paths.repartition(max(1, paths.count())).mapInArrow(_read_bundle, RECORD)


def fetch(index: DataFrame, page_id: int) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of one record, from one frame of its bundle."""
    row = index.where(F.col("page_id") == page_id).first()
    if row is None:
        return None
    fs, name = file_of(row["path"])
    with fs.open_input_file(name) as source:
        return Bundle(io.BufferedReader(source)).record(row["frame"], row["offset"])
