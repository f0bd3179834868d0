"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. How many documents hold each word n-gram of the test items is counted over all documents.
2. Each item's rarest three quarters of n-grams (ties included) are its seeds. The cut is relative to the
   item, so an item that a third of all documents copy keeps its seeds, and a copy that has over a quarter of
   the item's n-grams unbroken holds a seed.
3. Where a document holds a seed, the passage around it is aligned with the item. The local alignment score
   (a match 1, a mismatch or a gap of one word -1/2) over the item's length is the similarity.

An item of fewer than N words has one n-gram, itself, and documents are looked through for n-grams of its length too.

Items are a stated query set: they go to the tasks in blocks of bounded size, and each block is held
against all documents where they lie, so documents are never shuffled. Counts are always those of all documents, whatever
other blocks hold, so the blocks' size changes nothing but the number of passes: one for each block's counts, and
one for the matches of all blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import ship, text_slices

N, KEEP_SHARE = 3, 0.75
#: A block of items is broadcast; it holds at most so many characters and items, or one item.
BLOCK_CHARS, BLOCK_ITEMS = 8_000_000, 50_000
#: ASCII letters, digits and all bytes of other characters make words; the rest separates them.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def grams_of(words: list[bytes], n: int = N) -> Iterator[bytes]:
    """Word n-grams, in order; none of a shorter text."""
    return map(b" ".join, zip(*(words[k:] for k in range(n))))


def item_grams(words: list[bytes]) -> list[bytes]:
    """An item's n-grams; of a shorter one the whole."""
    return list(grams_of(words, min(N, len(words)))) if words else []


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """(best local alignment score, where in the passage it ends) of two arrays of word numbers."""
    place = np.arange(len(passage) + 1, dtype=np.float32) / 2
    row = np.zeros(len(passage) + 1, np.float32)
    best, end = 0.0, 0
    for word in item:
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, np.float32(1), np.float32(-0.5)), row[1:] - np.float32(0.5))
        # a gap in the item costs 1/2 per word of the passage: a running maximum of score + place / 2
        row = np.maximum(np.maximum.accumulate(step + place) - place, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
    return best, end


class Items:
    """A block of test items: their words, and where each seed stands in which item. Items are numbered by
    their place in the block; ids, which may be null or repeated, are labels."""

    def __init__(self, items: list[tuple[int | None, str]], counts: dict[bytes, int]):
        self.label = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.words: dict[int, np.ndarray] = {}
        self.bag: dict[int, Counter[int]] = {}
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        sizes = set()
        for item, (_, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            self.words[item] = np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32)
            self.bag[item] = Counter(self.words[item].tolist())
            grams = item_grams(words)
            sizes.add(min(N, len(words)))
            often = sorted(counts.get(g, 0) for g in grams)
            most = often[max(0, int(np.ceil(len(often) * KEEP_SHARE)) - 1)]
            for k, g in enumerate(grams):
                if counts.get(g, 0) <= most:
                    self.seeds.setdefault(g, []).append((item, k))
        self.sizes = sorted(sizes)

    def passages(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, first word, end) of the passages around seeds; overlapping ones of an item are one."""
        around: dict[int, list[tuple[int, int]]] = {}
        for size in self.sizes:
            if self.seeds.keys().isdisjoint(grams_of(words, size)):
                continue
            for at, gram in enumerate(grams_of(words, size)):
                for item, k in self.seeds.get(gram, ()):
                    n = len(self.words[item])
                    slack = 4 + n // 2
                    around.setdefault(item, []).append((max(0, at - k - slack), min(len(words), at - k + n + slack)))
        out = []
        for item, found in around.items():
            found.sort()
            a, b = found[0]
            for x, y in found[1:]:
                if x > b:
                    out.append((item, a, b))
                    a = x
                b = max(b, y)
            out.append((item, a, b))
        return out

    def matches(self, text: str, least: float) -> list[tuple[int | None, float, int]]:
        """(item's id, similarity, number of the word after the match) of each item that some passage reaches
        `least` with; the best passage of each."""
        words = words_of(text)
        best: dict[int, tuple[float, int]] = {}
        for item, a, b in self.passages(words):
            own, bag = self.words[item], self.bag[item]
            passage = np.array([self.number.get(w, -1) for w in words[a:b]], np.int32)
            seen = Counter(passage.tolist())
            # no alignment can match more words than both have
            if sum(min(n, seen[w]) for w, n in bag.items()) < least * len(own):
                continue
            score, end = align(own, passage)
            if score >= least * len(own) and score / len(own) > best.get(item, (0.0, 0))[0]:
                best[item] = (score / len(own), a + end)
        return [(self.label[i], s, e) for i, (s, e) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("bigint"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if held and (size + len(row[1]) > BLOCK_CHARS or len(held) >= BLOCK_ITEMS):
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def _gram_counts(docs: DataFrame, text_col: str, items: list[tuple[int | None, str]]) -> dict[bytes, int]:
    """In how many documents each n-gram of the items stands."""
    sc = docs.sparkSession.sparkContext
    split = [w for _, t in items if (w := words_of(t))]
    sizes = sorted({min(N, len(w)) for w in split})
    wanted = sc.broadcast(frozenset(g for w in split for g in item_grams(w)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for _, texts in text_slices(batch, 0):
                for text in texts:
                    words = words_of(text)
                    for size in sizes:
                        found.update(wanted.value.intersection(grams_of(words, size)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

    rows = docs.select(text_col).mapInArrow(run, "gram binary, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {bytes(r.gram): r.n for r in rows.collect()}  # at most one row per n-gram of the block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id_col, item_id, similarity, end_word: the number of the word after the match) for each row of docs
    and each item with an alignment of at least `least`; the best passage of the two. Rows that match
    nothing give no row.

    Null texts and texts without a word match nothing; neither do items whose text is null or without a
    word. Each row of benchmark is an item, also where ids are null or repeated, and is reported with its id.
    Repeated rows are each reported. Items of equal text are each reported. Empty tables give none.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"id {kind}, item_id bigint, similarity double, end_word bigint")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    for items in _blocks(benchmark, item_col, item_text_col):
        out = out.unionAll(rows.mapInArrow(_matcher(docs, text_col, items, least, 1), f"id {kind}, item_id bigint, similarity double, end_word bigint"))
    return out.withColumnRenamed("id", id_col)


def _matcher(docs: DataFrame, text_col: str, items: list[tuple[int | None, str]], least: float, column: int):
    block = docs.sparkSession.sparkContext.broadcast(Items(items, _gram_counts(docs, text_col, items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, column):
                found = [(start + i, *m) for i, t in enumerate(texts) for m in block.value.matches(t, least)]
                take = pa.array([f[0] for f in found], pa.int64())
                columns = [batch.column(0).take(take), *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item_id", "similarity", "end_word"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that `contaminated` reports with no item, with all their columns. No shuffle."""
    ship(docs.sparkSession)
    every, at = docs, docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col):
        block = docs.sparkSession.sparkContext.broadcast(Items(items, _gram_counts(every, text_col, items)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not block.value.matches(t, least) for _, texts in text_slices(batch, at) for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
