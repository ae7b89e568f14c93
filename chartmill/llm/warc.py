"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of whole records, followed by the seek
table of the seekable format in a skippable frame; the index maps a record's identifier to its
frame and its offset there, and records are read by it alone. Bundles are rows of a table, so any
store that Spark writes will do.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

#: Bytes of records in a frame, and of frames in a bundle; a larger record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 23
#: Payloads shorter than this are stored again rather than referred to.
LEAST_REVISIT = 1000
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


class Place(NamedTuple):
    record_id: str
    frame: int
    offset: int
    length: int


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """(identifier, bytes) of a response record, or of a revisit record without the payload.

    A null url has no target; one that a header can't hold as it is stands in a header of its own too.
    """
    name = f"urn:page:{'' if page_id is None else page_id}"
    body = b"" if refers_to is not None else payload
    plain = " ".join("".join(c if c.isprintable() else " " for c in url or "").split())
    target = [] if url is None else [f"WARC-Target-URI: {plain}", *([] if plain == url else [f"X-Target-URI-JSON: {json.dumps(url)}"])]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        *target,
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


class BundleWriter:
    """Collects records into frames; `close` gives the bundle and its index."""

    def __init__(self, level: int = 1):
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[Place] = []
        self.open: list[bytes] = []
        self.fill = self.size = 0

    def add(self, name: str, data: bytes) -> None:
        if self.fill and self.fill + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append(Place(name, len(self.frames), self.fill, len(data)))
        self.open.append(data)
        self.fill += len(data)

    def flush(self) -> None:
        if self.open:
            frame = self.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.fill))
            self.size += len(frame)
            self.open, self.fill = [], 0

    def close(self) -> tuple[bytes, list[Place]]:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + table, self.index


class BundleReader:
    """Random access by the seek table at a bundle's end."""

    def __init__(self, bundle: bytes):
        count, flags, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        table = bundle[len(bundle) - 9 - count * entry : -9]
        self.bundle, self.spans, at, self.last = bundle, [], 0, (-1, b"")
        for i in range(count):
            packed, size = struct.unpack_from("<II", table, i * entry)
            self.spans.append((at, packed, size))
            at += packed

    def frame(self, i: int) -> bytes:
        """One frame's bytes; the last one asked for is kept."""
        if self.last[0] != i:
            at, packed, size = self.spans[i]
            self.last = i, zstandard.ZstdDecompressor().decompress(self.bundle[at : at + packed], max_output_size=size)
        return self.last[1]

    def record(self, place: Place) -> tuple[dict[str, str], bytes]:
        """One record, reading its frame alone."""
        return next(parse_records(self.frame(place.frame)[place.offset : place.offset + place.length]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = [(h or "").encode() for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([len(h) for h in html], pa.int64()), pa.array([hashlib.sha1(h).digest() for h in html], pa.binary())], ["page_id", "n", "digest"])


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of larger page_id stores."""
    small = pages.select("page_id", "html").mapInArrow(_digest, "page_id long, n long, digest binary").filter(f"n >= {LEAST_REVISIT} and page_id is not null").drop("n")
    small = materialise(small, "payload-digests")
    last = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to").drop("least")
    return small.join(last, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, count, writer = TaskContext.get().partitionId(), 0, BundleWriter()

    def out() -> pa.RecordBatch:
        bundle, index = writer.close()
        fields = [("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{count:06d}"]), pa.array([bundle], pa.binary()), pa.array([[p._asdict() for p in index]], pa.list_(pa.struct(fields)))], ["bundle_id", "bundle", "record_index"])

    for batch in batches:
        for page_id, url, html, refers, want in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "digest")), strict=True):
            payload = (html or "").encode()
            sha = hashlib.sha1(payload)
            if want != sha.digest():  # another row of this page_id is the copy
                refers = None
            writer.add(*record(page_id, url, payload, sha.hexdigest(), refers))
            if writer.size + writer.fill // 4 >= BUNDLE_BYTES:
                yield out()
                count, writer = count + 1, BundleWriter()
    if writer.index:
        yield out()


def write_bundles(pages: DataFrame) -> DataFrame:
    """A row per bundle: bundle_id, bundle and record_index (record_id, frame, offset, length).

    One record per row of pages; null html is an empty payload, a null url an empty target. Rows
    that repeat are stored again; rows of one page_id refer to others only by equal payload.
    """
    prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = materialise(revisits(pages), "revisits").dropDuplicates(["page_id", "digest"])
    # A page_id has several rows here only if its rows have several payloads.
    once = known.groupBy("page_id").agg(F.collect_list(F.struct("digest", "refers_to")).alias("known"))
    own = F.expr("filter(known, k -> k.digest = unhex(sha1(encode(coalesce(html, ''), 'utf-8'))))[0]")
    joined = pages.join(once, "page_id", "left").withColumn("own", F.when(F.col("known").isNotNull(), own))
    rows = joined.select("page_id", "url", "html", F.col("own.refers_to").alias("refers_to"), F.col("own.digest").alias("digest"))
    return rows.mapInArrow(_write, "bundle_id string, bundle binary, record_index array<struct<record_id: string, frame: int, offset: long, length: long>>")


def url_of(headers: dict[str, str]) -> str | None:
    """The url that record was given."""
    return json.loads(headers["x-target-uri-json"]) if "x-target-uri-json" in headers else headers.get("warc-target-uri")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    number = lambda x: int(x) if (x := x.strip("<>").rpartition(":")[2]) else None
    for batch in batches:
        for bundle, places in zip(batch.column("bundle"), batch.column("places"), strict=True):
            reader, out = BundleReader(bundle.as_py()), []
            for place in sorted((Place(**p) for p in places.as_py()), key=lambda p: (p.frame, p.offset)):
                headers, block = reader.record(place)
                told, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                size = int(headers["warc-payload-length"])
                if headers["warc-record-id"] != f"<{place.record_id}>" or kind == "response" and (hashlib.sha1(block).hexdigest() != told or len(block) != size):
                    raise ValueError(f"a damaged record: {place.record_id}")
                refers = headers.get("warc-refers-to")
                out.append((number(place.record_id), size, told, kind, number(refers) if refers else None, url_of(headers)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def read_bundles(bundles: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Records are found by the index, each in its own frame, and responses are checked against their
    digests. With wanted, a table of record_id, only those are read, and only from bundles and frames
    that hold them; identifiers that no bundle has give nothing.
    """
    prepare(bundles.sparkSession)
    if wanted is None:
        held = bundles.select("bundle", F.col("record_index").alias("places"))
    else:
        index = bundles.select("bundle_id", F.explode("record_index").alias("p")).select("bundle_id", "p", F.col("p.record_id").alias("record_id"))
        places = index.join(wanted.select("record_id").distinct(), "record_id").groupBy("bundle_id").agg(F.collect_list("p").alias("places"))
        held = bundles.select("bundle_id", "bundle").join(places, "bundle_id").select("bundle", "places")
    return held.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles in the shared folder and read them back by their identifiers."""
    return read_bundles(materialise(write_bundles(pages), "warc"))
