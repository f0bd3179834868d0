"""Token-id files: patched frame-of-reference blocks.

A file is a list of segments, each ended by END; a segment is

    header   MAGIC, then 8 little-endian uint64: segment's place among the files' segments (partition,
             number in it), documents, ids, blocks, exceptions, payload bytes, all bytes before END
    doc ids  int64 each; a validity byte each (0: the id is null)
    lengths  uint32 each: ids per document
    minima   uint32 per block
    widths   uint8 per block
    starts   uint64 per block: where its packed ids begin in the payload
    firsts   uint64 per block: where its exceptions begin
    places   uint16 per exception: place in its block
    values   uint32 per exception: what to add to the minimum
    payload  per block its ids less the minimum, packed in `width` bits each, low bits first: a width of up to
             16 is even and one above a multiple of 4, so that four ids, or two, fill whole bytes

Blocks hold BLOCK ids (the last one fewer). The width of a block is that of the PERCENTILE-th of its
differences; larger ones are exceptions, packed as zero. Ids stand in ascending order of documents. The
index of block starts lets a reader unpack any block alone (`read_ids`).

Spark writes the files through its own committer, so lost tasks leave nothing behind, in whatever store
the shared folder is: each segment is a row of the text writer, END its line separator.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from lacuna.llm import pretokens
from lacuna.llm.chunk_store import ChunkStore
from lacuna.llm.common import BROADCAST_ROWS, new_path, ship, small_batches, staged, text_slices
from lacuna.llm.vocabulary import byte_letters

MAGIC, END = b"IDBLOCK1", "END1KDI\n"
BLOCK, PERCENTILE = 128, 90
HEAD = struct.Struct("<8s8Q")


def _widths(blocks: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Per row the bits of the PERCENTILE-th of its differences, rounded up; rows are padded at the end."""
    if not len(blocks):
        return np.zeros(0, np.uint8)
    place = np.maximum(0, -(-full * PERCENTILE // 100) - 1)
    ordered = np.sort(np.where(np.arange(BLOCK) < full[:, None], blocks, np.uint32(2**32 - 1)), axis=1)
    at = ordered[np.arange(len(blocks)), place].astype(np.float64)
    bits = np.where(at > 0, np.floor(np.log2(np.maximum(at, 1))) + 1, 0).astype(np.int64)
    return np.where(bits <= 16, bits + bits % 2, bits + -bits % 4).astype(np.uint8)


def _shifts(width: int) -> np.ndarray:
    """Where the four ids, or two, of a word of whole bytes begin in it."""
    return np.arange(4 if width <= 16 else 2, dtype=np.uint64) * np.uint64(width)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(minima, widths, starts, firsts, places, values, payload) of uint32 ids."""
    n = -(-len(ids) // BLOCK)
    full = np.full(n, BLOCK)
    if len(ids) % BLOCK:
        full[-1] = len(ids) % BLOCK
    padded = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).reshape(n, BLOCK)
    minima = padded.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = padded - minima[:, None]
    widths = _widths(rest, full)
    high = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64) != 0) & (np.arange(BLOCK) < full[:, None])
    rows, places = np.nonzero(high)
    values = rest[rows, places]
    firsts = np.searchsorted(rows, np.arange(n)).astype(np.uint64)
    small = np.where(high, np.uint32(0), rest)
    sizes = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for width in np.unique(widths).tolist():
        if width:
            which = np.flatnonzero(widths == width)
            shifts = _shifts(width)
            words = np.bitwise_or.reduce(small[which].reshape(-1, len(shifts)).astype(np.uint64) << shifts, axis=1)
            packed = words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width * len(shifts) // 8].reshape(len(which), -1)
            payload[starts[which, None] + np.arange(packed.shape[1])] = packed
    return minima, widths, starts.astype(np.uint64), firsts, places.astype(np.uint16), values, payload.tobytes()


def unpack(n_ids: int, minima: np.ndarray, widths: np.ndarray, starts: np.ndarray, firsts: np.ndarray, places: np.ndarray, values: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; starts and firsts as in the file."""
    n = len(minima)
    out = np.zeros((n, BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        if width:
            which = np.flatnonzero(widths == width)
            packed = payload[starts[which, None].astype(np.int64) + np.arange(width * BLOCK // 8)]
            shifts = _shifts(width)
            size = width * len(shifts) // 8
            words = np.zeros((packed.size // size, 8), np.uint8)
            words[:, :size] = packed.reshape(-1, size)
            ids = words.view("<u8") >> shifts & np.uint64((1 << width) - 1)
            out[which] = ids.reshape(len(which), BLOCK)
    counts = np.diff(np.append(firsts.astype(np.int64), len(places) + (firsts[0] if n else 0)).astype(np.int64))
    out[np.repeat(np.arange(n), counts), places] = values
    return (out + minima[:, None]).reshape(-1)[:n_ids]


def segment(place: tuple[int, int], docs: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    minima, widths, starts, firsts, places, values, payload = pack(ids)
    arrays = [docs.astype("<i8"), valid.astype(np.uint8), lengths.astype("<u4"), minima.astype("<u4"), widths, starts.astype("<u8"), firsts.astype("<u8"), places.astype("<u2"), values.astype("<u4")]
    body = b"".join(a.tobytes() for a in arrays)
    size = HEAD.size + len(body) + len(payload)
    return HEAD.pack(MAGIC, *place, len(docs), len(ids), len(minima), len(places), len(payload), size) + body + payload


class Segment:
    """A segment in a file's bytes, read where it lies."""

    def __init__(self, data: memoryview, at: int):
        magic, self.part, self.number, docs, self.n_ids, blocks, exceptions, payload, size = HEAD.unpack_from(data, at)
        self.end = at + size + len(END)
        if magic != MAGIC or bytes(data[self.end - len(END) : self.end]) != END.encode():
            raise ValueError("this is no token-id segment")
        where = at + HEAD.size
        found = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", blocks), ("u1", blocks), ("<u8", blocks), ("<u8", blocks), ("<u2", exceptions), ("<u4", exceptions), ("u1", payload)):
            found.append(np.frombuffer(data, kind, n, where))
            where += n * np.dtype(kind).itemsize
        self.docs, self.valid, self.lengths, self.minima, self.widths, self.starts, self.firsts, self.places, self.values, self.payload = found

    def read_ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at [start, stop) of the segment; only the blocks that hold them are unpacked."""
        a, b = start // BLOCK, min(-(-stop // BLOCK), len(self.minima))
        if stop <= start:
            return np.zeros(0, np.uint32)
        low = int(self.firsts[a])
        high = int(self.firsts[b]) if b < len(self.firsts) else len(self.places)
        ids = unpack((b - a) * BLOCK, self.minima[a:b], self.widths[a:b], self.starts[a:b], self.firsts[a:b], self.places[low:high], self.values[low:high], self.payload)
        return ids[start - a * BLOCK : stop - a * BLOCK]


def segments(data: bytes) -> Iterator[Segment]:
    view, at = memoryview(data), 0
    while at < len(view):
        yield (s := Segment(view, at))
        at = s.end


class Encoder:
    """Encodes with the tokenizers library. Texts are cut as its pre-tokenizer cuts them, and only pre-tokens of chunks not
    met before are given to its model, in the letters that stand for their bytes."""

    def __init__(self, path: str, known: pretokens.Classes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.model = library.model
        self.sizes = np.array([len(self.model.id_to_token(i) or "") for i in range(library.get_vocab_size())], np.int64)
        self.letters = np.zeros(256, "<u2")
        for c, b in byte_letters().items():
            self.letters[b] = ord(c)
        self.parted = self.letters.copy()
        self.parted[0] = 0
        self.encode = ChunkStore(pretokens.Splitter(known), self._words).encode

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelt = self._spelt("\0".join(words), self.parted).split("\0")
        if len(spelt) != len(words):  # some have this character themselves
            spelt = [self._spelt(w, self.letters) for w in words]
        # the library's objects go as soon as their ids are taken; where a word ends shows in the letters that its tokens have
        ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(map(self.model.tokenize, spelt))), np.int32)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))) + 1
        return ids, np.diff(ends, prepend=0)

    def _spelt(self, text: str, letters: np.ndarray) -> str:
        return letters[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().decode("utf-16-le")


_encoders: dict[str, Encoder] = {}


def by_range(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    """docs in at most `parts` partitions of rising ids, each sorted by id; nulls first.

    The bounds are quantiles of the id column alone, so texts are not read for them. An id that fills several
    partitions by itself is dealt out to them by a hash of the row's text.
    """
    shares = [k / parts for k in range(1, parts)]
    bounds = docs.select(F.percentile_approx("id", shares, 100 * parts)).first()[0] if shares else None
    if not bounds:
        return docs.repartition(1).sortWithinPartitions("id")
    edges = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    low = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda b: b < F.col("id"))))
    high = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("id"))))
    place = low + F.pmod(F.xxhash64("text"), high - low + 1)
    return docs.repartitionById(parts, place.cast("int")).sortWithinPartitions("id")


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, segment_ids: int = 1_000_000, segments_a_file: int = 64) -> None:
    """Writes the ids of every row's whole text, followed by end_id, in ascending order of id_col (an
    integer; nulls first; rows of equal id in any order next to each other).

    One range shuffle deals out the rows; a task holds the ids of one segment at a time, and begins a new file after
    segments_a_file segments. A null or empty text has end_id alone. Other columns are not read; an empty table
    gives no segment.
    """
    ship(docs.sparkSession)
    known = pretokens.classes(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        enc = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer, known))
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            names = pa.concat_arrays([d for d, _, _ in held])
            counts, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            row = segment((part, number), names.fill_null(0).to_numpy(zero_copy_only=False), names.is_valid().to_numpy(zero_copy_only=False), counts, ids)
            return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["value"])

        for batch in batches:
            for start, texts in text_slices(batch, 1):
                ids, counts = enc.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
                held.append((batch.column(0).slice(start, len(texts)), counts + 1, ids))
                size += len(ids)
                if size >= segment_ids:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = by_range(rows, "id", parts).mapInArrow(run, "value binary")
    with small_batches(docs.sparkSession):
        rows.select(F.col("value").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", segments_a_file).text(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", kind: str | DataType = "bigint", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document in the files: id_col, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are read once: what is found in their segments is staged, and the segments' sizes are sums over it. Where a
    segment starts is a running sum: of the partitions' totals, one row each, and of the segments within each partition.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                for s in segments(x.as_buffer()):
                    ends = np.cumsum(s.lengths, dtype=np.int64)
                    starts = ends - s.lengths
                    ids = s.read_ids(0, s.n_ids).astype("<u4")
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    n = len(s.docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, s.part), pa.int64()), pa.array(np.full(n, s.number), pa.int64()), pa.array(s.docs, pa.int64(), mask=s.valid == 0), pa.array(starts, pa.int64()), pa.array(s.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                        names=["part", "number", "id", "at", "n_tokens", "ids_crc32"],
                    )

    found = staged(files.mapInArrow(rows, "part bigint, number bigint, id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"), "segment-rows")
    index = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n_ids"))
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    index = index.select("part", "number", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("within")).join(parts, "part")
    index = staged(index.select("part", "number", (F.col("before") + F.col("within")).alias("before")), "segment-index")
    index = F.broadcast(index) if index.limit(broadcast_rows + 1).count() <= broadcast_rows else index.hint("merge")
    return found.join(index, ["part", "number"]).select(F.col("id").cast(kind).alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Writes token-id files in the shared folder and returns what `read` finds in them."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write(docs, tokenizer, path, id_col, text_col, end_id)
    return read(spark, path, id_col, docs.schema[id_col].dataType)
