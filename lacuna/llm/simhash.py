"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by tiled exact comparison.

Distinct fingerprints are compared, not documents. Two that differ in at most `radius` bits agree in at
least one of radius + 1 bands, so each fingerprint is put in one block per band and only blocks are compared.
A block is cut into tiles of at most TILE fingerprints by population count; two tiles meet unless
their population counts differ by more than the radius. Tiles that meet are compared whole, by exclusive-or
and bit counts. Each comparison returns the forest of its links, never all pairs: a fingerprint and
the first of its local component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import BROADCAST_ROWS, content_key, few, maybe_in, settled, ship, staged
from lacuna.llm.graph import components

BITS, TILE, STEP = 64, 1024, 256


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half the shingles' XXH64; A-Z are lower-cased, words are split at
    ASCII white space, a text of fewer words is one shingle, one of none has fingerprint 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), seed)]
    else:
        line = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = (ends - [len(p) + 1 for p in parts])[: len(parts) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp bigint: the 64 bits as signed) per row of docs. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            got = np.array([fingerprint(values[i].as_py(), words) for i in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i] in root, which leads every member to its component's first."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(step := root[root], root):
            root[:] = step


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, local root) of those that are linked within the tile `left`, or between left and right.

    Both are cut in steps by population count; pairs of steps whose counts lie further apart than the radius
    are passed over."""
    same = right is None
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = left if same else right[np.argsort(np.bitwise_count(right), kind="stable")]
    cl, cr = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    everything = left if same else np.concatenate([left, right])
    root, shift = np.arange(len(everything)), 0 if same else len(left)
    for i in range(0, len(left), STEP):
        a, low, high = left[i : i + STEP, None], cl[i], cl[min(i + STEP, len(left)) - 1]
        for j in range(i if same else 0, len(right), STEP):
            if cr[j] > high + radius or cr[min(j + STEP, len(right)) - 1] < low - radius:
                continue
            x, y = np.nonzero(np.bitwise_count(a ^ right[j : j + STEP]) <= radius)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                _hook(root, x + i, y + j + shift)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return everything[moved], everything[root[moved]]


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links.

    fps: column fp, distinct. A block is (band, its bits). One of more than `tile` fingerprints is cut by the
    population count of all bits, and counts of still more than `tile` by a hash; a
    fingerprint then goes to one task for each tile that its own tile meets, so no task holds more than two.
    """
    ship(fps.sparkSession)
    bands = radius + 1
    width = -(-BITS // bands)
    cut = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << min(width, BITS - k * width)) - 1)).alias("bits")) for k in range(bands)]
    rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*cut)).alias("x")).select("fp", "pop", "x.band", "x.bits")
    # Only blocks that are too large for one tile need to know how their population counts are spread.
    sizes = rows.groupBy("band", "bits", "pop").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.groupBy("band", "bits").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int")))).alias("slots")).where(F.col("n") > tile).drop("n")
    large = staged(large, "large-blocks")
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    rows = rows.join(large, ["band", "bits"], "left")
    slot = F.when(F.col("slots").isNotNull(), F.pmod(F.xxhash64("fp"), F.element_at("slots", F.col("pop"))).cast("int")).otherwise(0)
    rows = rows.withColumns({"slot": slot, "pop": F.when(F.col("slots").isNotNull(), F.col("pop")).otherwise(-1)})
    # the tiles that this one meets, each pair named by its lower tile first
    near = F.flatten(F.transform(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda p: F.when(F.element_at("slots", p).isNull(), F.array().cast("array<struct<p:int,s:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.element_at("slots", p) - 1), lambda s: F.struct(p.alias("p"), s.alias("s"))))))
    own = F.struct(F.col("pop").alias("p"), F.col("slot").alias("s"))
    met = F.when(F.col("slots").isNull(), F.array(own)).otherwise(near)
    rows = rows.select("fp", "band", "bits", own.alias("own"), F.explode(met).alias("other"))
    pair = rows.select("band", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own") == F.greatest("own", "other"), "fp").toDF("band", "bits", "lo", "hi", "upper", "fp")
    tiles = pair.groupBy("band", "bits", "lo", "hi").agg(F.collect_list(F.when(~F.col("upper") | (F.col("lo") == F.col("hi")), F.col("fp"))).alias("l"), F.collect_list(F.when(F.col("upper") & (F.col("lo") != F.col("hi")), F.col("fp"))).alias("r"))
    tiles = tiles.select("l", F.when(F.col("lo") != F.col("hi"), F.col("r")).alias("r")).where("size(l) > 1 or size(r) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for k in range(batch.num_rows):
                l, r = (None if (v := batch.column(i)[k].values) is None else v.to_numpy().view(np.uint64) for i in (0, 1))
                x, y = link_tiles(l, r, radius)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return tiles.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, words: int = 3, tile: int = TILE) -> DataFrame:
    """Per row of docs: id_col, fingerprint (16 hex digits), component_id: the smallest id among the rows
    that links of at most `radius` differing bits reach, itself included.

    A null or empty text, or one of white space only, has fingerprint zero, linked like any other. Repeated
    rows are repeated in the result. Null ids come last: a component's id is null only if all its ids are.
    Other columns are not read. Empty tables give none.
    """
    docs_fp = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    roots = settled(docs.sparkSession, "fingerprint-roots", lambda: components(links(staged(docs_fp.select("fp").distinct(), "fingerprints-once"), radius, tile)))
    return labelled(docs_fp, roots, id_col)


def labelled(docs_fp: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """(id_col, fingerprint, component_id) per row of docs_fp (id, fp). roots: components() of fingerprints."""
    distinct = staged(docs_fp.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    n = roots.count()
    joined = distinct.join(few(roots.select(F.col("node").alias("fp"), "root"), n), "fp", "left")
    grouped = staged(joined.where("root is not null").groupBy("root").agg(F.min("first").alias("least")), "components")
    joined = staged(joined.join(few(grouped, n), "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), "fingerprint-components")
    out = docs_fp.join(few(joined, joined.count()), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped: Callable[..., DataFrame] = near_duplicates, **options: int) -> DataFrame:
    """One row of docs, with all columns, for each component of `grouped`: the one of the smallest id, null ids last.
    Where several rows have that id, the first of them by a hash of all columns stays; rows that are equal in all columns
    count as one.

    Rows are grouped by id and hash alone. Texts stay where they lie, but for the rows that go or are repeated: if those are
    few, their hashes are broadcast; else a filter of bounded size picks the rows that meet them in a shuffle.
    """
    spark = docs.sparkSession
    k1, k2 = content_key(*docs.columns)
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), k1, k2)
    named = docs.select(name.alias("_name"), F.col(text_col).alias("_text"))

    def build() -> DataFrame:
        groups = grouped(named, "_name", "_text", **options)
        rows = groups.groupBy("_name").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("_name") == F.col("component_id")).alias("first"))
        return rows.where("n > 1 or not first").select("_name._k1", "_name._k2", F.col("first").alias("_stays"))

    doubtful = settled(spark, "doubtful", build)
    n = doubtful.count()
    if not n:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("row"), k1, k2)
    if n > BROADCAST_ROWS:
        suspect = maybe_in(doubtful.select("_k1"), n, F.col("_k1"))
        met = rows.where(suspect).join(doubtful.hint("merge"), ["_k1", "_k2"], "left")
        clean = rows.where(~suspect).select("row.*").unionAll(met.where("_stays is null").select("row.*"))
    else:
        met = rows.join(F.broadcast(doubtful), ["_k1", "_k2"], "left")
        clean = met.where("_stays is null").select("row.*")
    if doubtful.where("_stays").isEmpty():
        return clean
    return clean.unionAll(met.where("_stays").dropDuplicates(["_k1", "_k2"]).select("row.*"))
