"""Token ids of whole texts from the ids of their pre-tokens, in numpy arrays.

Texts are cut into chunks, and each distinct chunk of a batch into pre-tokens once. Pre-tokens (words) get numbers as they are met;
their ids lie one after the other in one array. A chunk is then a list of numbers, a text a list of chunks, and ids are
gathered from arrays at once. Only words that were not met before are encoded.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lacuna.llm.pretokens import Splitter


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(total)
    return flat[at]


def _distinct(values: pa.Array) -> tuple[list[str], np.ndarray]:
    """(distinct strings, which of them each is)."""
    coded = values.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


class _Room:
    """An array that grows at its end; `n` of it are kept, what is put behind them is overwritten next time."""

    def __init__(self, kind: type):
        self.all, self.n = np.zeros(1024, kind), 0

    def put(self, at: int, values: np.ndarray) -> int:
        """Where the values end."""
        end = at + len(values)
        if end > len(self.all):
            self.all = np.concatenate([self.all[:at], np.zeros(end + end // 4 - at, self.all.dtype)])
        self.all[at:end] = values
        return end


class ChunkStore:
    """encode_words takes distinct pre-tokens and returns their ids one after the other, and how many each has.

    Beyond KEEP words those that were met in but one batch, and then the rarest, are forgotten. A larger store finds few words more
    and each look into it is slower, as it leaves the processor's cache. Words of more than LONGEST characters are not kept."""

    KEEP, LONGEST = 150_000, 64

    def __init__(self, splitter: Splitter, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.splitter, self.encode_words = splitter, encode_words
        self.numbers: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.met = _Room(np.int32), _Room(np.int64), _Room(np.int32), _Room(np.int32)

    def _pieces(self, chunks: list[str], heads: list[str]) -> tuple[list[str], np.ndarray]:
        """(pieces of all, up to which each goes). Chunks with the space before them fall into the same pieces when they stand
        one after the other, so one search goes through all of them."""
        pieces = self.splitter.pieces("".join([" ", " ".join(chunks)])) if chunks else []
        reach = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ends = np.searchsorted(reach, np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)) + 1
        more = []
        for head in heads:
            pieces += self.splitter.pieces(head)
            more.append(len(pieces))
        return pieces, np.concatenate([[0], ends, more]).astype(np.int64)

    def _numbered(self, words: list[str]) -> np.ndarray:
        """Where starts and sizes have each of the distinct words. Those that are not kept stand behind what is."""
        number = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        unmet = np.flatnonzero(number < 0)
        fresh = list(map(words.__getitem__, unmet.tolist()))
        long = np.fromiter(map(len, fresh), np.int64, len(fresh)) > self.LONGEST
        n = len(fresh) - int(long.sum())
        if n < len(fresh):
            unmet = np.concatenate([unmet[~long], unmet[long]])
            fresh = list(map(words.__getitem__, unmet.tolist()))
        flat, sizes = self.encode_words(fresh)
        kept, begin = self.sizes.n, self.flat.n
        number[unmet] = np.arange(kept, kept + len(fresh))
        self.numbers.update(zip(fresh[:n], range(kept, kept + n)))
        self.flat.put(begin, flat)
        self.flat.n = begin + int(sizes[:n].sum())
        self.sizes.put(kept, sizes)
        self.starts.put(kept, begin + np.cumsum(sizes) - sizes)
        self.sizes.n = self.starts.n = kept + n
        self.met.n = self.met.put(kept, np.zeros(n, np.int32))
        self.met.all[number[number < kept + n]] += 1
        return number

    def _encoded(self, chunks: list[str], heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, sizes) of chunks, which have lost the space before them, and of heads, which had none."""
        pieces, ends = self._pieces(chunks, heads)
        words, index = _distinct(pa.array(pieces, pa.large_string()))
        del pieces
        piece = self._numbered(words)[index]
        sizes = self.sizes.all[piece].astype(np.int64)
        ids = gather(self.flat.all, self.starts.all[piece], sizes)
        if self.sizes.n > self.KEEP:
            self._forget()
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends])

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str | int], np.ndarray, pa.Array]:
        """Of each run, a part of a text up to a special string or that string, in order: its text and how many chunks it has. Then
        what each run begins with, without a space before it; how the runs stand in the array of all other chunks, and that array."""
        splitter, order = self.splitter, []
        even: list[str] = []  # cut at every space, all at once
        odd: list[list[str]] = []
        special: list[int] = []
        for i, text in enumerate(texts):
            for plain, mark in splitter.parts(text):
                if plain and splitter.has_wide_space(plain):
                    order.append((i, 1, len(odd)))
                    odd.append(splitter.chunks(plain))
                elif plain:
                    order.append((i, 0, len(even)))
                    even.append(plain)
                if mark is not None:
                    order.append((i, 2, len(special)))
                    special.append(mark)
        cut = pc.split_pattern(pa.array(even, pa.large_string()), " ")
        flat, begins = cut.flatten(), cut.offsets.to_numpy()
        first = np.zeros(len(flat), bool)
        first[begins[:-1]] = True
        rest = pa.concat_arrays([flat.filter(pa.array(~first)), pa.array([c for chunks in odd for c in chunks[1:]], pa.large_string())])
        heads = flat.filter(pa.array(first)).to_pylist() + [chunks[0] for chunks in odd] + special
        sizes = np.concatenate([np.diff(begins), list(map(len, odd)), np.ones(len(special))]).astype(np.int64)
        text, kind, at = np.array(order, np.int64).reshape(-1, 3).T
        return text, sizes, heads, np.array([0, len(even), len(even) + len(odd)])[kind] + at, rest

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has)."""
        text, run_sizes, heads, order, rest = self._runs(texts)
        if not heads:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        distinct, index = _distinct(rest)
        special = [x for x in heads if isinstance(x, int)]  # behind all others
        flat, sizes = self._encoded(distinct, heads[: len(heads) - len(special)])
        flat, sizes = np.concatenate([flat, np.array(special, flat.dtype)]), np.concatenate([sizes, np.ones(len(special), np.int64)])
        starts = np.cumsum(sizes) - sizes
        begins = np.cumsum(run_sizes) - run_sizes
        chunks = np.empty(run_sizes.sum(), np.int64)
        first = np.zeros(len(chunks), bool)
        first[begins] = True
        chunks[~first] = index
        chunks[begins] = np.arange(len(distinct), len(sizes))
        row = gather(chunks, begins[order], run_sizes[order])
        counts = np.bincount(np.repeat(text, run_sizes[order]), sizes[row], len(texts)).astype(np.int64)
        return gather(flat, starts[row], sizes[row]), counts

    def _forget(self) -> None:
        met, sizes = self.met.all[: self.met.n], self.sizes.all
        often = np.flatnonzero(met > 1)
        if len(often) > self.KEEP // 2:
            often = np.sort(often[np.argsort(met[often], kind="stable")[-(self.KEEP // 2) :]])
        names = list(self.numbers)
        self.numbers = dict(zip(map(names.__getitem__, often.tolist()), range(len(often))))
        sizes, met = sizes[often], met[often] // 2
        flat = gather(self.flat.all, self.starts.all[often], sizes.astype(np.int64))
        self.flat.n = self.flat.put(0, flat)
        self.starts.n = self.starts.put(0, np.cumsum(sizes, dtype=np.int64) - sizes)
        self.sizes.n, self.met.n = self.sizes.put(0, sizes), self.met.put(0, met)
