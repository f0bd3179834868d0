"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with a few whole WARC records, then a skippable
frame with the map from record ids to (frame, offset in the unpacked frame), then the seek table of the
seekable format: a skippable frame with the packed and unpacked size of every frame before it, that ends
in the number of frames, a descriptor and SEEKABLE. Any Zstandard reader unpacks a bundle whole;
`fetch` unpacks just the frames that hold the records asked for.

Spark writes bundles through its own committer, so lost tasks leave nothing behind, in whatever store the
folder is: each bundle is a row of the text writer in a folder of its own, and the line separator
after it is the magic number that ends the seek table.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from lacuna.llm.common import BROADCAST_ROWS, content_key, new_path, ship, staged

#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE_MAP, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY = struct.Struct("<16sIQ")
EPOCH = "1970-01-01T00:00:00Z"


def record(kind: str, name: uuid.UUID, uri: str | None, date: str, digest: str, payload: bytes, size: int, extra: dict[str, str]) -> bytes:
    """One WARC/1.1 record: of kind response an HTTP message with the payload, of kind revisit its head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{name.urn}>", "WARC-Date": date, "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)), "WARC-Payload-Digest": f"sha256:{digest}", **extra,
    }
    if uri:
        head["WARC-Target-URI"] = uri.replace("\r", "%0D").replace("\n", "%0A")
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(named fields, payload after the HTTP head, where the next record begins) of the record at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("this is no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    begin = stop + 4
    end = begin + int(fields["Content-Length"])
    return fields, data[data.index(b"\r\n\r\n", begin) + 4 : end], end + 4


class Bundle:
    """Collects records; `close` gives the bundle's bytes without the final magic number."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[bytes] = []
        self.open: list[bytes] = []
        self.held = self.packed = 0

    def add(self, name: uuid.UUID, data: bytes) -> None:
        if self.held and self.held + len(data) > self.frame_bytes:
            self._end_frame()
        self.entries.append(ENTRY.pack(name.bytes, len(self.frames), self.held))
        self.open.append(data)
        self.held += len(data)

    def _end_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.packed += len(frame)
            self.open, self.held = [], 0

    def close(self) -> bytes:
        self._end_frame()
        index = self.packer.compress(b"".join(self.entries))
        frames = [*self.frames, struct.pack("<II", SKIPPABLE_MAP, len(index)) + index]
        sizes = [*self.sizes, (len(frames[-1]), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IB", len(sizes), 0)
        return b"".join(frames) + struct.pack("<II", SKIPPABLE_TABLE, len(table) + 4) + table


class Reader:
    """A bundle's seek table and record map; frames are unpacked when asked for."""

    def __init__(self, data: bytes):
        self.data, self.unpacker = memoryview(data), zstandard.ZstdDecompressor()
        n, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEKABLE:
            raise ValueError("this is no seekable bundle")
        sizes = list(struct.iter_unpack("<II", self.data[len(data) - 9 - 8 * n : len(data) - 9]))
        self.places, at = [], 0
        for packed, size in sizes:
            self.places.append((at, packed, size))
            at += packed
        at, packed, _ = self.places.pop()
        self.index = self.unpacker.decompress(self.data[at + 8 : at + packed])

    def frame(self, k: int) -> bytes:
        at, packed, size = self.places[k]
        return self.unpacker.decompress(self.data[at : at + packed], max_output_size=size)

    def entries(self) -> Iterator[tuple[bytes, int, int]]:
        """(record id, frame, offset in it)"""
        return ENTRY.iter_unpack(self.index)


def name_of(page_id: object, k1: int, k2: int) -> uuid.UUID:
    """The record id of a row, from its page id and content, so that a task run twice names it the same."""
    return uuid.UUID(bytes=hashlib.sha256(f"{page_id}/{k1}/{k2}".encode()).digest()[:16], version=5)


def revisits(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """(digest, first): the smallest page id of every payload of at least least_bytes that several rows have."""
    rows = pages.select(pages[id_col].alias("id"), F.octet_length(pages[body_col]).alias("n"), F.sha2(pages[body_col].cast("binary"), 256).alias("digest"))
    return rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 100, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 25, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Writes a record per row. Of rows with equal payloads of at least least_bytes those with the smallest
    id are responses and the others revisit it; smaller payloads, and rows with a null id, are responses.

    Rows are read where they lie; payloads are not shuffled unless more than broadcast_rows of them are
    repeated. Then only (id, digest) rows meet the repeated digests, and what they find is joined back by a hash
    of id, url and digest. A null payload is empty. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    same = staged(revisits(pages, id_col, body_col, least_bytes), "repeated-payloads")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.encode(F.coalesce(pages[body_col].cast("string"), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumns({"digest": F.sha2("body", 256)})
    if same.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.join(F.broadcast(same), "digest", "left")
    else:
        k1, k2 = content_key("id", "url", "digest")
        rows = rows.withColumns({"_k1": k1, "_k2": k2})
        found = staged(rows.select("_k1", "_k2", "digest").join(same.hint("merge"), "digest").select("_k1", "_k2", "first").distinct(), "revisits")
        rows = rows.join(found, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    target = F.when((F.octet_length("body") >= least_bytes) & (F.col("first") < F.col("id")), F.col("first"))
    rows = rows.select("id", "url", "body", "digest", target.alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        bundle = Bundle(frame_bytes)
        seen = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}"]), pa.array([bundle.close()], pa.binary())], names=["bundle", "value"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, body, digest, first = (batch.column(k)[i].as_py() for k in range(5))
                extra = {"X-Page-ID": "" if page is None else str(page), "X-Payload-Length": str(len(body))}
                kind = "response" if first is None else "revisit"
                if first is not None:
                    extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{name_of(first, 0, 0).urn}>", "X-Refers-To-Page": str(first)}
                # page ids name records; rows without one are named by where they stand
                name = name_of(page, 0, 0) if page is not None else name_of(None, part, seen)
                seen += 1
                bundle.add(name, record(kind, name, url, EPOCH, digest, body, len(body), extra))
                if bundle.packed + bundle.held >= bundle_bytes:
                    yield close()
                    bundle, number = Bundle(frame_bytes), number + 1
        if bundle.entries:
            yield close()

    made = rows.mapInArrow(run, "bundle string, value binary").select("bundle", F.col("value").cast("string").alias("value"))
    made.write.partitionBy("bundle").options(lineSep=struct.pack("<I", SEEKABLE).decode("latin-1"), encoding="ISO-8859-1").text(path)


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)


def read(spark: SparkSession, path: str, id_col: str = "page_id", kind: str | DataType = "bigint", payload: bool = False) -> DataFrame:
    """Per record: id_col, payload_bytes, payload_digest, record_type, refers_to, and with payload the bytes
    themselves (null for a revisit). A response's length and digest are those of the payload read and must
    equal the record's own; a revisit has no payload, so its record tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                bundle = Reader(content.as_buffer())
                for k in range(len(bundle.places)):
                    data, at, out = bundle.frame(k), 0, []
                    while at < len(data):
                        fields, body, at = parse(data, at)
                        full = fields["WARC-Type"] == "response"
                        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if full and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                        out.append((fields["X-Page-ID"] or None, size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Page"), body if full and payload else None))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    found = _bundles(spark, path).select("content").mapInArrow(run, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")
    return found.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), *["payload"] * payload)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, bundle, frame, offset): the record maps of all bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                got = list(Reader(content.as_buffer()).entries())
                yield pa.RecordBatch.from_arrays([pa.array([str(uuid.UUID(bytes=x[0])) for x in got]), pa.array([name.as_py()] * len(got)), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], names=["record_id", "bundle", "frame", "offset"])

    return _bundles(spark, path).select("path", "content").mapInArrow(run, "record_id string, bundle string, frame bigint, offset bigint")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(record_id, payload) of the rows of `wanted` (record_id, bundle, frame, offset: from `index`). Only
    bundles asked for are opened, and of those only the frames asked for are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, asked in zip(batch.column(0), batch.column(1)):
                bundle, frames, out = Reader(content.as_buffer()), {}, []
                for x in asked.as_py():
                    if x["frame"] not in frames:
                        frames = {x["frame"]: bundle.frame(x["frame"])}
                    out.append((x["record_id"], parse(frames[x["frame"]], x["offset"])[1]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], names=["record_id", "payload"])

    asked = wanted.groupBy(F.col("bundle").alias("path")).agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "record_id"))).alias("asked"))
    return _bundles(spark, path).join(asked, "path").select("content", "asked").mapInArrow(run, "record_id string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", **options: int) -> DataFrame:
    """Writes the bundles in the shared folder and returns what `read` finds in them."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, body_col, **options)
    return read(pages.sparkSession, path, id_col, pages.schema[id_col].dataType)
