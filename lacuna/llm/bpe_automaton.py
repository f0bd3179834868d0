"""BPE encoding and decoding by a deterministic tokenization automaton.

`Automaton` is compiled from the merge list by one gadget per merge, in rank order (Berglund, Martens
and van der Merwe, "Constructing a BPE tokenization DFA", 2024). Its arcs are labelled with tokens and
it accepts exactly the correct tokenizations. It starts as one state with a loop for each byte. The
gadget of a merge (u, v) -> w takes the state q that all u-arcs lead to; if q has a v-arc,
a copy q' of q without its v-arc becomes the new target of u-arcs (v may no longer follow u), and every
state with a u-arc gets a w-arc to where q's v-arc led. All arcs of a label lead to one state, so a
state is named by that label.

The arc table is stored by what a state lacks. A gadget that takes the v-arc from a state takes with it the arcs of all
tokens that begin with v and come later, for they would have been made beside it. Tokens are numbered so that
those are neighbours, so each loss is one interval of numbers, and a state, which begins as a copy of another with its
losses up to then, is a short sorted row of intervals: all rows in one array, one binary search for each transition.

Just one tokenization of any string, and of any prefix, is correct. Words are therefore encoded from left to right
without ever going back: at each byte a second table (the tokens that end here, longest first) proposes arcs, and the
one that leaves the state at its own beginning is the last of the path so far. All words of a batch take each step
together, as numpy arrays. Decoding emits the labels of the path.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm import pretokens, vocabulary
from lacuna.llm.chunk_store import ChunkStore, gather
from lacuna.llm.common import ship, text_slices

WIDE = 17  # bits of a token's number


class Automaton:
    """left, right, born: of a token, the parts that it was merged from and the merge (-1 for bytes, -2 for tokens that no
    merge ever makes). A state is named by the token whose arcs lead to it, the start state by `start`."""

    LONG = 256

    def __init__(self, vocab: vocabulary.Vocabulary):
        size = self.start = len(vocab.labels)
        self.left, self.right, self.born = list(range(size)), list(range(size)), [-2] * size
        self.cut: dict[int, int] = {}
        for t in vocab.first:
            self.born[t] = -1
        for k, (u, v, w) in enumerate(vocab.merges):
            if self.born[u] < -1 or self.born[v] < -1 or not self.has_arc(u, v):
                continue  # v never follows u, so this merge never happens
            self.cut[u << 20 | v] = k
            self.left[w], self.right[w], self.born[w] = u, v, k
        self._arcs()
        self._scanner(vocab.labels)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the gadgets so far leave the state an arc of this label. A state began as a copy of its right part's
        state of that time; an arc began beside its left part's arc, in all states that had one then."""
        born, cut = self.born, self.cut
        until = self.start
        while True:
            if cut.get(state << 20 | token, until) < until:
                return False
            if born[state] < 0 and born[token] < 0:
                return True
            if born[token] >= born[state]:
                until, token = born[token] + 1, self.left[token]
            else:
                until, state = born[state], self.right[state]

    def _arcs(self) -> None:
        """lack: state and first number of each interval of arcs that a state lacks, in order; lack_end: where it ends."""
        left, right, born = self.left, self.right, self.born
        alive = sorted((t for t in range(self.start) if born[t] >= -1), key=born.__getitem__)
        sizes, offset = [1] * self.start, [1] * self.start
        after: dict[int, tuple[list[int], list[int]]] = {}  # of a token: births (negated) of those that begin with it, and room up to each
        place = [0] * self.start
        for t in reversed(alive):
            if born[t] >= 0:
                sizes[left[t]] += sizes[t]
        for t in reversed(alive):  # those born last stand next to what they begin with
            if born[t] >= 0:
                births, room = after.setdefault(left[t], ([], [1]))
                place[t] = offset[left[t]]
                offset[left[t]] += sizes[t]
                births.append(-born[t])
                room.append(offset[left[t]])
        number, at = [0] * self.start, 0
        for t in alive:
            if born[t] < 0:
                number[t], at = at, at + sizes[t]
            else:
                number[t] = number[left[t]] + place[t]
        own: dict[int, list[int]] = {}
        begin, end, when = [], [], []
        for key, k in self.cut.items():  # in order of k
            u, v = key >> 20, key & (1 << 20) - 1
            births, room = after.get(v, ([], [1]))
            own.setdefault(u, []).append(len(when))
            begin.append(number[v])
            end.append(number[v] + room[bisect_left(births, -k + 1)])  # those born at k or later
            when.append(k)
        rows: dict[int, list[int]] = {}
        flat: list[int] = []
        states: list[int] = []
        for t in alive:
            kept: list[int] = []
            if born[t] >= 0:
                before = rows[right[t]]
                kept = before[: bisect_left(before, born[t], key=when.__getitem__)]
            rows[t] = kept + own.get(t, [])
            flat += rows[t]
            states += [t] * len(rows[t])
        which = np.array(flat, np.int64)
        lack = np.array(states, np.int64) << WIDE | np.array(begin, np.int64)[which]
        order = np.argsort(lack)
        self.lack = np.concatenate([[-1], lack[order]])
        self.lack_end = np.concatenate([[0], np.array(end, np.int64)[which][order]]).astype(np.int32)
        self.number = np.array(number, np.int32)

    def _scanner(self, labels: list[bytes]) -> None:
        """page, step: the next node of a trie of the tokens by a node's row and a byte, with its rows of longest ends (Aho and Corasick). A row
        is 16 pages of 16 bytes each; it shares all pages with the row of its longest end but those where it has children
        of its own, so the table takes an eighth of one of whole rows. row: the row of a node; found: the longest token that ends at a node; shorter: of a token, the next one that ends with it."""
        token = {labels[t]: t for t in range(self.start) if self.born[t] >= -1}
        names = sorted({x[:k] for x in token for k in range(1, len(x) + 1)}, key=lambda x: (len(x), x))
        node = {x: i + 1 for i, x in enumerate(names)}
        node[b""] = 0
        n = len(names) + 1
        parent = np.array([0] + [node[x[:-1]] for x in names])
        byte = np.array([0] + [x[-1] for x in names])
        own = np.array([-1] + [token.get(x, -1) for x in names], np.int32)
        depth = np.array([0] + [len(x) for x in names])
        inner = np.unique(parent)
        self.row = np.zeros(n, np.int64)
        self.row[inner] = np.arange(len(inner))
        self.page = np.zeros((len(inner), 16), np.int32)  # page 0 leads back to the root
        pages, n_pages = [np.zeros((1, 16), np.int32)], 1
        self.found, fail = own.copy(), np.zeros(n, np.int64)
        leaf = np.ones(n, bool)
        leaf[inner] = False
        bounds = np.searchsorted(depth, np.arange(depth[-1] + 2))
        for d in range(depth[-1] + 1):
            level = np.arange(bounds[d], bounds[d + 1])
            if d > 1:
                fail[level] = self._next(fail[parent[level]], byte[level])
            if d:
                self.found[level] = np.where(own[level] >= 0, own[level], self.found[fail[level]])
                end = level[leaf[level]]
                self.row[end] = self.row[fail[end]]
                rest = level[~leaf[level]]
                self.page[self.row[rest]] = self.page[self.row[fail[rest]]]
            below = np.arange(bounds[d + 1], bounds[d + 2]) if d < depth[-1] else np.zeros(0, np.int64)
            if len(below):
                at, which = np.unique(self.row[parent[below]] * 16 + (byte[below] >> 4), return_inverse=True)
                made = self.step[self.page.reshape(-1)[at]] if d else np.zeros((len(at), 16), np.int32)
                made[which, byte[below] & 15] = below
                self.page.reshape(-1)[at] = np.arange(n_pages, n_pages + len(at))
                pages, n_pages = [*pages, made], n_pages + len(at)
                self.step = np.concatenate(pages)
        self.shorter = np.full(self.start, -1, np.int32)
        ends = np.flatnonzero(own >= 0)
        self.shorter[own[ends]] = self.found[fail[ends]]
        self.size = np.array([len(x) for x in labels], np.int64)

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        page = self.page.reshape(-1)[self.row[node] * 16 + (byte >> 4)]
        return self.step.reshape(-1)[page * 16 + (byte & 15)]

    def follows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has the arc of the token beside it."""
        number = self.number[token]
        at = np.searchsorted(self.lack, state.astype(np.int64) << WIDE | number, side="right") - 1
        return (self.lack[at] >> WIDE != state) | (self.lack_end[at] <= number)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words one after the other, how many each has)."""
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(sizes) - sizes
        last, rank = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)  # of the prefix that ends here: its last token, how many it has
        short = np.flatnonzero(sizes <= self.LONG)
        order = short[np.argsort(-sizes[short], kind="stable")]
        start, left = begins[order], sizes[order]
        left = left[::-1]
        node = np.zeros(len(order), np.int32)
        for i in range(int(left[-1]) if len(left) else 0):
            n = len(order) - int(np.searchsorted(left, i, side="right"))  # words of more than i bytes
            at = start[:n] + i
            node = self._next(node[:n], text[at])
            token = self.found[node]
            back = at - self.size[token]
            while True:
                first = back < at - i
                state = np.where(first, self.start, last[back])
                ok = first | self.follows(state, token)
                good = at[ok]
                last[good] = token[ok]
                rank[good] = np.where(first, 1, rank[back] + 1)[ok]
                if len(good) == len(at):
                    break
                bad = ~ok
                at, token = at[bad], self.shorter[token[bad]]
                back = at - self.size[token]
        for w in np.flatnonzero(sizes > self.LONG).tolist():
            self._encode_long(text, int(begins[w]), int(sizes[w]), last, rank)
        full = np.flatnonzero(sizes)
        counts = np.zeros(len(words), np.int64)
        counts[full] = rank[begins[full] + sizes[full] - 1]
        out = np.zeros(int(counts.sum()), np.int32)
        slot = (np.cumsum(counts) - 1)[full]  # where a word's last token goes
        at, first = (begins + sizes - 1)[full], begins[full]
        while len(at):
            token = last[at]
            out[slot] = token
            at = at - self.size[token]
            more = at >= first
            at, first, slot = at[more], first[more], slot[more] - 1
        return out, counts

    def _encode_long(self, text: np.ndarray, begin: int, size: int, last: np.ndarray, rank: np.ndarray) -> None:
        """The same steps for one long word, byte by byte."""
        page, step, row, found, shorter, length = memoryview(self.page.reshape(-1)), memoryview(self.step.reshape(-1)), memoryview(self.row), memoryview(self.found), memoryview(self.shorter), memoryview(self.size)
        arcs: dict[int, bool] = {}
        node, path, count = 0, [0] * size, [0] * size
        for i, b in enumerate(text[begin : begin + size].tobytes()):
            node = step[page[row[node] * 16 + (b >> 4)] * 16 + (b & 15)]
            token = found[node]
            while True:
                back = i - length[token]
                if back < 0:
                    path[i], count[i] = token, 1
                    break
                key = path[back] << 20 | token
                ok = arcs.get(key)
                if ok is None:
                    ok = arcs[key] = self.has_arc(path[back], token)
                if ok:
                    path[i], count[i] = token, count[back] + 1
                    break
                token = shorter[token]
        last[begin : begin + size], rank[begin : begin + size] = path, count


class Encoder:
    """Encodes whole texts and decodes ids."""

    def __init__(self, path: str, known: pretokens.Classes):
        vocab = vocabulary.load.__wrapped__(path)  # not kept: a worker needs only the tables made of it
        self.automaton = Automaton(vocab)
        self.store = ChunkStore(pretokens.Splitter(known), lambda words: self.automaton.encode([w.encode("utf-8", "surrogatepass") for w in words]))
        self.encode = self.store.encode
        self.labels = np.frombuffer(b"".join(vocab.labels), np.uint8)
        self.sizes = np.array([len(x) for x in vocab.labels], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        digits = [f"{i},".encode() for i in range(len(vocab.labels))]
        wide = max(map(len, digits))
        self.decimals = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in digits), np.uint8).reshape(-1, wide)
        self.decimal_sizes = np.array(list(map(len, digits)), np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.labels, self.starts[ids], self.sizes[ids]).tobytes().decode("utf-8", "replace")

    def written(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Of each text the decimal ids, joined by commas."""
        padded = self.decimals[ids].reshape(-1)
        flat = padded[padded != 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.decimal_sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Of each text what its ids decode to, in UTF-8."""
        sizes = self.sizes[ids]
        flat = gather(self.labels, self.starts[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, known: pretokens.Classes | None = None) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, known or pretokens.classes(path))
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row of docs: id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the text decoded from the ids), and, with ids, `ids array<int>` itself.

    No shuffle: rows keep their partitions. A null or empty text has no ids and both hashes are of the
    empty string. Null or repeated ids are passed through row by row; other columns are not read. An empty table gives
    none. path must exist on every executor.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    known = pretokens.classes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sha = encoder(path, known), hashlib.sha256
        for batch in batches:
            for start, texts in text_slices(batch, 1, 500_000):
                got, counts = enc.encode(texts)
                a = [sha(x).hexdigest() for x in enc.written(got, counts)]
                b = [sha(x).hexdigest() for x in enc.decoded(got, counts)]
                columns = [batch.column(0).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(got, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
