"""Near copies: documents whose word 5-grams have a Jaccard similarity of at least 0.8.

MinHash bands propose, the exact similarity of the sets of shingles decides. Two texts of similarity s share one of the
BANDS bands of ROWS minima with probability 1 - (1 - s ** ROWS) ** BANDS: all but 3 in a million at 0.8.

Equal sets are one node. Of a bucket (nodes with an equal band) in several components, first only the pairs with
one leader are compared, in rounds with other leaders as long as many links are found, so that a large group
costs a comparison per member. Then every bucket that is still in several components is cut into tiles; each set goes once to
each pair of tiles that its own is in, where those of different components are compared by looking up their shingles, and only
a forest of the links leaves the task. Buckets of the same nodes are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import common
from lacuna.llm.common import few, maybe_in, settled, ship, staged, text_slices
from lacuna.llm.graph import components
from lacuna.llm.simhash import fingerprint, labelled, links

WORDS, BANDS, ROWS = 5, 32, 5
#: Similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: A tile has about so many sets, and so many shingles, at most.
TILE, TILE_SHINGLES = 1024, 1 << 21
#: Another round of leaders follows one that found so many links.
MANY_LINKS = 1000
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct XXH64 of all five words in a row, in order; A-Z are lower-cased, words are split at ASCII white
    space, a text of fewer words is one shingle, one of none has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= WORDS:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts])[: len(parts) - WORDS + 1].tolist()
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist())], np.uint64))


def node(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes())


def bands(found: np.ndarray) -> list[int]:
    """A hash of each band's minima and number; none of an empty set."""
    if not len(found):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(least, (found[at : at + 2048] * _FACTORS[:, None]).min(1), out=least)
    return [xxhash.xxh3_64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bands: bool = False, with_fingerprint: bool = False) -> DataFrame:
    """(id, fp bigint: the node), with_bands (n: how many shingles, key: a hash of the text, bands), and with_fingerprint
    (sim: the SimHash as in simhash.py), per row of docs. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, 1):
                fps, sizes, made, sims = [], [], [], []
                for text in texts:
                    found = shingles(text)
                    fps.append(node(found))
                    sizes.append(len(found))
                    if with_bands:
                        made.append(np.array(bands(found), np.uint64).view(np.int64))
                    if with_fingerprint:
                        sims.append(fingerprint(text))
                columns, names = [batch.column(0).slice(start, len(texts)), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"]
                if with_bands:
                    columns += [pa.array(sizes, pa.int32()), batch.column(2).slice(start, len(texts)), pa.array(made, pa.list_(pa.int64()))]
                    names += ["n", "key", "bands"]
                if with_fingerprint:
                    columns.append(pa.array(np.array(sims, np.uint64).view(np.int64)))
                    names.append("sim")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = (", n int, key bigint, bands array<bigint>" if with_bands else "") + (", sim bigint" if with_fingerprint else "")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("key")).mapInArrow(run, f"id {kind}, fp bigint{more}")


def _sets(docs: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """(fp, shingles as bytes) of the texts that keys (fp, key) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, 1, 1_000_000):
                made = [shingles(x).tobytes() for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(made, pa.binary())], names=["fp", "found"])

    texts, n = docs.select(F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text")), keys.count()
    if n > common.BROADCAST_ROWS:
        texts = texts.where(maybe_in(keys.select("key"), n, F.col("key")))
    return texts.join(few(keys, n), "key").select("fp", "text").mapInArrow(run, "fp bigint, found binary").dropDuplicates(["fp"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(*(np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(sets.select(F.col("fp").alias("a"), F.col("found").alias("x")).hint("merge"), "a")
    two = one.join(sets.select(F.col("fp").alias("b"), F.col("found").alias("y")).hint("merge"), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _hits(one: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of the values of `one` each of n sets holds. ids: all their values in order, owner: whose each is."""
    first, last = np.searchsorted(ids, one, "left"), np.searchsorted(ids, one, "right")
    many = last - first
    total = int(many.sum())
    if not total:
        return np.zeros(n, np.int64)
    return np.bincount(owner[np.arange(total) + np.repeat(first - np.cumsum(many) + many, many)], minlength=n)


def forest(nodes: list[int], roots: list[int], sets: list[np.ndarray], upper: list[bool]) -> list[tuple[int, int]]:
    """Links (a, b) that join the components (by roots) of the nodes of one tile, or of a lower and an upper one, as all
    links of similarity between them would."""
    lead = {x: x for x in roots}

    def top(x: int) -> int:
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    sides = [[k for k, u in enumerate(upper) if not u], [k for k, u in enumerate(upper) if u]]
    both = sides if sides[0] and sides[1] else [sides[0] or sides[1]] * 2
    # members of the most frequent component are only looked at by those of others
    names, counts = np.unique(np.array(roots, np.int64), return_counts=True)
    most = int(names[counts.argmax()])
    out: list[tuple[int, int]] = []
    for asked, against in ((both[0], both[1]), (both[1], both[0])):
        asked = [k for k in asked if roots[k] != most]
        if both[0] is not both[1] and against is both[0]:
            against = [k for k in against if roots[k] == most]
        if asked and against:
            sizes = np.array([len(sets[k]) for k in against])
            values = np.concatenate([sets[k] for k in against])
            order = np.argsort(values, kind="stable")
            ids, owner = values[order], np.repeat(np.arange(len(against)), sizes)[order]
            for k in asked:
                held = _hits(sets[k], ids, owner, len(against))
                for j in np.flatnonzero(LEAST[1] * held >= LEAST[0] * (len(sets[k]) + sizes - held)).tolist():
                    x, y = top(roots[k]), top(roots[against[j]])
                    if x != y:
                        lead[x] = y
                        out.append((nodes[k], nodes[against[j]]))
        if both[0] is both[1]:
            break
    return out


def _tiled(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that join the components of members (bucket, fp, n: shingles, root) of each bucket as all their links would."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("volume"))
    tiles = staged(sizes.select("bucket", F.greatest(F.ceil(F.col("many") / TILE), F.ceil(F.col("volume") / TILE_SHINGLES)).cast("int").alias("tiles")), "bucket-tiles")
    placed = members.join(few(tiles, tiles.count()), "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    met = placed.select("bucket", "fp", "root", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("upper"), "fp", "root")
    rows = met.join(sets.hint("merge"), "fp").select("bucket", "lo", "hi", "fp", "root", "upper", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                plain = [batch.column(k).to_pylist() for k in range(6)]
                for i, row in enumerate(zip(*plain)):
                    # a copy, so that a group does not hold the batches that it comes from
                    yield (*row, np.frombuffer(batch.column(6)[i].as_buffer(), np.uint64).copy())

        for _, group in groupby(each(), key=lambda x: x[:3]):
            group = list(group)
            made = forest([x[3] for x in group], [x[4] for x in group], [x[6] for x in group], [x[5] for x in group]) if len(group) > 1 else []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(run, "a bigint, b bigint")


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (node, root) with the components that edges (a, b) join: only the roots that they connect are gone through."""
    n = roots.count()
    one, two = (few(roots.toDF(c, f"_{c}"), n) for c in ("a", "b"))
    drawn = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    made = staged(components(drawn), "joined-roots")
    size = made.count()
    moved = roots.join(few(made.toDF("root", "_to"), size), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return moved.unionAll(made.join(few(roots.select("node"), n), "node", "left_anti"))


def roots_of(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(node, root) of the nodes that have near copies. rows: nodes() of docs with bands."""
    banded = rows.select("fp", "n", F.explode("bands").alias("bucket"))
    shared = staged(banded.groupBy("bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("bucket"), "buckets")
    members = staged(banded.join(few(shared, shared.count()), "bucket").distinct(), "bucket-members")
    wanted = members.select("fp").distinct()
    keys = staged(rows.select("fp", "key").join(wanted, "fp").groupBy("fp").agg(F.min("key").alias("key")), "candidates")
    sets = staged(_sets(docs, text_col, keys), "candidate-sets")
    spark = docs.sparkSession
    none = spark.createDataFrame([], "a bigint, b bigint")
    tested = none
    roots = none.toDF("node", "root")
    seed, again = 0, True
    while True:
        placed = members.join(few(roots.select(F.col("node").alias("fp"), "root"), roots.count()), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        if not again:
            break
        open_ = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64(F.lit(seed), "fp").alias("h"), "fp", "n", "root")).alias("m")).where("lo <> hi")
        open_ = staged(open_.select("bucket", F.col("m.fp").alias("_fp"), F.col("m.n").alias("_n"), F.col("m.root").alias("_root")), "open-buckets")
        n = open_.count()
        if not n:
            return roots
        # sets whose sizes differ by more cannot be similar
        met = placed.join(few(open_, n), "bucket").where(f"root <> _root and {LEAST[1]} * least(n, _n) >= {LEAST[0]} * greatest(n, _n)")
        pairs = met.select(F.least("fp", "_fp").alias("a"), F.greatest("fp", "_fp").alias("b")).distinct()
        pairs = staged(pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        found = staged(_confirmed(pairs, sets), "near-pairs")
        many = found.count()
        tested = tested.unionAll(pairs)
        if many:
            roots = settled(spark, "roots", lambda: _joined(roots, found))
        again, seed = many >= MANY_LINKS, seed + 1
    # of two members each has met the other as leader; buckets of the same nodes find the same
    code = [F.sum(F.xxhash64(F.lit(k), "fp").cast("decimal(38,0)")).alias(f"_c{k}") for k in (1, 2)]
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("many"), *code).where("lo <> hi and many > 2")
    open_ = staged(open_.groupBy("many", "_c1", "_c2").agg(F.min("bucket").alias("bucket")).select("bucket"), "open-buckets")
    n = open_.count()
    if n:
        found = staged(_tiled(placed.join(few(open_, n), "bucket"), sets), "near-pairs")
        if not found.isEmpty():
            roots = settled(spark, "roots", lambda: _joined(roots, found))
    return roots


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, fingerprint (16 hex digits of the node), component_id: the smallest id among the rows
    that links of similarity 0.8 or more reach, itself included.

    Texts without a word are copies of each other. Ids and tables as in simhash.near_duplicates.
    """
    rows = staged(nodes(docs, id_col, text_col, with_bands=True), "nodes")
    return labelled(rows.select("id", "fp"), settled(docs.sparkSession, "node-roots", lambda: roots_of(docs, rows, text_col)), id_col)


def _same_fingerprints(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between the nodes that SimHash joins: each node of a component of fingerprints and its least one.
    rows: nodes() with fingerprints."""
    both = staged(rows.select("fp", "sim").distinct(), "node-fingerprints")
    roots = settled(rows.sparkSession, "fingerprint-roots", lambda: components(links(staged(both.select("sim").distinct().toDF("fp"), "fingerprints-once"), radius)))
    rooted = staged(both.join(few(roots.toDF("sim", "root"), roots.count()), "sim", "left").select("fp", F.coalesce("root", "sim").alias("root")), "node-components")
    shared = staged(rooted.groupBy("root").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).where("b <> hi").select("root", "b"), "shared-components")
    return rooted.join(few(shared, shared.count()), "root").where("fp <> b").select(F.col("fp").alias("a"), "b")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """As near_copies, but SimHash links count as well: op8's fingerprints that differ in at most `radius` bits. A component
    is what links of both kinds reach."""
    rows = staged(nodes(docs, id_col, text_col, with_bands=True, with_fingerprint=True), "nodes")

    def build() -> DataFrame:
        edges = staged(_same_fingerprints(rows, radius), "fingerprint-edges")
        roots = roots_of(docs, rows, text_col)
        return roots if edges.isEmpty() else _joined(roots, edges)

    return labelled(rows.select("id", "fp"), settled(docs.sparkSession, "node-roots", build), id_col)
