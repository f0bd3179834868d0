"""Token counts by rank-synchronous array merging.

Pre-tokens that were not met before are held together as one ragged numpy array of symbols. In each
round every sequence's lowest-rank pair is merged, everywhere in it, in all sequences at once; sequences
without a pair drop out. What a sequence has left in the end is its token count.

Long pre-tokens (an unbroken line of letters) would be gone through anew for each of their many ranks. They are
linked lists instead, and the places of pairs are kept by rank: a round takes the lowest rank of all, merges its places in
all sequences, and looks only at the pairs beside them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import pretokens, vocabulary
from lacuna.llm.common import ship, text_slices

NONE = np.int32(2**31 - 1)


class Ranks:
    """The rank and result of a pair of symbols: a hash table of slots, and for the few pairs whose slot
    another pair holds a sorted list."""

    LONG = 512

    def __init__(self, vocab: vocabulary.Vocabulary):
        merges = np.array(vocab.merges, np.int64).reshape(-1, 3)
        self.first = np.array(vocab.first, np.int32)
        self.size = len(vocab.labels)
        order = np.argsort(merges[:, 0] * self.size + merges[:, 1], kind="stable")
        self.keys = (merges[:, 0] * self.size + merges[:, 1])[order]
        self.rank = np.append(order.astype(np.int32), NONE)
        self.result = merges[:, 2].astype(np.int32)
        self.pairs = merges[:, :2].tolist()
        self.bits = 19
        slot = self._slot(self.keys)
        self.table = np.full(1 << self.bits, -1, np.int32)
        taken, at = np.unique(slot, return_index=True)
        self.table[taken] = at
        rest = np.setdiff1d(np.arange(len(self.keys)), at)
        self.spill_keys, self.spill_at = self.keys[rest], rest.astype(np.int32)
        self.padded = np.append(self.keys, -1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = self.table[self._slot(keys)]
        ok = self.padded[at] == keys
        out = np.where(ok, self.rank[at], NONE)
        if len(self.spill_keys):
            # pairs whose slot another pair holds
            other = np.flatnonzero(~ok & (at >= 0))
            if len(other):
                k = np.minimum(np.searchsorted(self.spill_keys, keys[other]), len(self.spill_keys) - 1)
                hit = self.spill_keys[k] == keys[other]
                out[other[hit]] = self.rank[self.spill_at[k[hit]]]
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word."""
        long = [k for k, w in enumerate(words) if len(w) > self.LONG]
        out = self._count_short([b"" if len(w) > self.LONG else w for w in words] if long else words)
        if long:
            out[long] = self._count_long([words[k] for k in long])
        return out

    def _count_long(self, words: list[bytes]) -> np.ndarray:
        """Symbols are linked; -1 stands behind each word and where a symbol has gone."""
        sizes = np.array([len(w) + 1 for w in words])
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(sizes) - 1
        symbol = self.first[text]
        symbol[ends] = -1
        after = np.arange(1, len(text) + 1)
        before = np.arange(-1, len(text) - 1)
        alive = np.ones(len(text), bool)
        alive[ends] = False
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(at: np.ndarray) -> None:
            """Puts down the pairs that begin at these places by their rank."""
            at = at[(at >= 0) & (symbol[at] >= 0)]
            at = at[symbol[after[at]] >= 0]
            rank = self.of(symbol[at], symbol[after[at]])
            at, rank = at[rank != NONE], rank[rank != NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else (), np.split(at, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        offer(np.flatnonzero(alive))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            left, right = self.pairs[r]
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if left == right and len(at) > 1:  # of overlapping pairs (aaa) every other one from the left
                new_run = np.append(True, after[at[:-1]] != at[1:])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone], alive[gone] = self.result[r], -1, False
            after[at] = after[gone]
            before[after[at]] = at
            offer(np.unique(np.concatenate([before[at], at])))
        return np.add.reduceat(alive, ends - sizes + 1, dtype=np.int64)

    def _count_short(self, words: list[bytes]) -> np.ndarray:
        done = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        index = np.flatnonzero(lengths)
        lengths = lengths[index]
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        while len(index):
            starts = np.cumsum(lengths) - lengths
            inner = np.ones(len(symbols), bool)  # a pair begins at each symbol but a sequence's last
            inner[starts + lengths - 1] = False
            ranks = np.full(len(symbols), NONE)
            at = np.flatnonzero(inner)
            ranks[at] = self.of(symbols[at], symbols[at + 1])
            lowest = np.minimum.reduceat(ranks, starts)
            ended = lowest == NONE
            if ended.any():
                done[index[ended]] = lengths[ended]
                stay = np.repeat(~ended, lengths)
                symbols, ranks = symbols[stay], ranks[stay]
                index, lengths, lowest = index[~ended], lengths[~ended], lowest[~ended]
                if not len(index):
                    break
            owner = np.repeat(np.arange(len(index)), lengths)
            hit = np.flatnonzero(ranks == lowest[owner])
            if len(hit) > 1:  # of overlapping pairs (aaa) every other one from the left
                new_run = np.diff(hit, prepend=-2) > 1
                run_start = np.maximum.accumulate(np.where(new_run, hit, -1))
                hit = hit[(hit - run_start) % 2 == 0]
            symbols[hit] = self.result[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            lengths = lengths - np.bincount(owner[hit], minlength=len(index))
            symbols = symbols[keep]
        return done


class Counter:
    """Counts the tokens of whole texts, with a bounded memory of chunks met before."""

    KEEP, BYTES = 400_000, 4_000_000

    def __init__(self, path: str, known: pretokens.Classes):
        self.ranks = Ranks(vocabulary.load(path))
        self.splitter = pretokens.Splitter(known)
        self.rest: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        counts, heads, tails = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            for plain, special in self.splitter.parts(text):
                counts[i] += special is not None
                if plain:
                    head, *rest = self.splitter.chunks(plain)
                    heads.append((i, head))
                    tails.append((i, rest))
        fresh = set().union(*(x for _, x in tails)) - self.rest.keys()
        first = {h: self.splitter.pieces(h) for h in {h for _, h in heads}}
        split = {c: self.splitter.pieces(" " + c) for c in fresh}
        self._words({p for x in (first, split) for found in x.values() for p in found})
        size = self.words.__getitem__
        new = {c: sum(map(size, p)) for c, p in split.items()}
        self.rest |= new
        for i, h in heads:
            counts[i] += sum(map(size, first[h]))
        known = self.rest.__getitem__
        for i, rest in tails:
            counts[i] += sum(map(known, rest))
        if len(self.rest) > self.KEEP:
            self.rest = {}
        if len(self.words) > self.KEEP:
            self.words = {}
        return counts

    def _words(self, words: set[str]) -> None:
        group, held = [], 0
        for w in words - self.words.keys():
            group.append(w)
            held += len(w)
            if held > self.BYTES:
                self._merge(group)
                group, held = [], 0
        if group:
            self._merge(group)

    def _merge(self, group: list[str]) -> None:
        self.words |= zip(group, self.ranks.count([w.encode("utf-8", "surrogatepass") for w in group]).tolist())


_counters: dict[str, Counter] = {}


def counter(path: str, known: pretokens.Classes | None = None) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, known or pretokens.classes(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row of docs: id_col, n_bytes (of the UTF-8 text), n_tokens and over_limit (n_tokens > limit).

    No shuffle. A null or empty text has no bytes and no tokens; special strings within texts count as
    their one id. Null or repeated ids pass through row by row; other columns are not read. An empty table gives none.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    known = pretokens.classes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, known)
        for batch in batches:
            for start, texts in text_slices(batch, 1):
                sizes = batch.column(2).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), sizes, pa.array(c.count(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
