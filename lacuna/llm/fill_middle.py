"""Fill-in-middle transformation: texts cut between words, with the middle moved to the end.

One table of byte transitions recognises UTF-8 continuation bytes, the starts of units (leading white space and a
word, or white space at the end) and sentinels. Its first scan counts what the transitions emit, for pieces of all texts
of a batch at once: the state depends on the last few bytes alone, so a piece is entered after reading as many before it.
A second scan, of the pieces that hold cuts, finds the cuts' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import WHITE, ship

SENTINELS = ("<P>", "<S>", "<M>")
PIECE = 128
#: Texts of about so many bytes are scanned at once; one text is never cut.
SLICE_BYTES = 1 << 22
#: What a transition emits, in one number: a unit's start, a code point, a sentinel's end.
UNIT, POINT, FOUND = 1, 1 << 10, 1 << 20
START, SPACE, WORD = 0, 1, 2


class Table:
    """Bytes are classes, (state, class) are transitions. States: before the text, in white space, and in a word for
    each beginning of a sentinel that its last bytes may be (WORD: none)."""

    def __init__(self, sentinels: Sequence[str] = SENTINELS):
        marks = [x.encode("ascii") for x in sentinels]
        if len({*marks}) < 3 or any(not x or set(x) & set(WHITE.encode()) for x in marks):
            raise ValueError("three different sentinels of visible ASCII characters are needed")
        if any(a != b and b in a or any(b.startswith(a[k:]) for k in range(1, len(a))) for a in marks for b in marks):
            raise ValueError("sentinels must not overlap")
        letters = sorted({c for x in marks for c in x})
        begun = [b""] + sorted({x[:k] for x in marks for k in range(1, len(x))})
        self.memory = max(1, *map(len, begun))
        space, more, other, beyond = range(len(letters), len(letters) + 4)
        self.beyond, self.width = beyond, len(letters) + 4
        self.classes = np.full(256, other, np.int16)
        self.classes[0x80:0xC0] = more
        self.classes[list(WHITE.encode())] = space
        self.classes[letters] = range(len(letters))
        states = 2 + len(begun)
        self.next = np.zeros((states, self.width), np.int16)
        self.emit = np.zeros((states, self.width), np.int32)
        for state in range(states):
            held = begun[state - WORD] if state >= WORD else b""
            self.next[state, beyond] = state
            self.next[state, space] = SPACE
            self.emit[state, space] = POINT + UNIT * (state != SPACE)
            for c in (more, other, *range(len(letters))):
                tail = held + bytes([letters[c]]) if c < len(letters) else b""
                self.emit[state, c] = POINT * (c != more) + UNIT * (state == START) + FOUND * any(tail.endswith(x) for x in marks)
                self.next[state, c] = WORD + begun.index(next((tail[k:] for k in range(len(tail)) if tail[k:] in begun), b""))
        self.next = (self.next * self.width).ravel()
        self.emit = self.emit.ravel()

    def pieces(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes by step and piece, the state at each piece's first byte)"""
        steps = at + np.arange(PIECE)[:, None]
        inside = steps < end
        steps[~inside] = 0
        seen = self.classes[data[steps]] if len(data) else np.zeros(steps.shape, np.int16)
        seen[~inside] = self.beyond
        state = np.zeros(len(at), np.int16)
        for back in range(self.memory, 0, -1):
            state = self.next[state + self.classes[data[np.maximum(at - back, 0)]]]
        return seen, np.where(first, START * self.width, state)

    def count(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(3, pieces): the units, code points and sentinels of each piece."""
        seen, state = self.pieces(data, at, end, first)
        total = np.zeros(len(at), np.int32)
        for row in seen:
            step = state + row
            total += self.emit[step]
            state = self.next[step]
        return np.stack([total & 1023, total >> 10 & 1023, total >> 20]).astype(np.int64)

    def locate(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, first: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code points before it in the piece) of the nth unit (from 0) that starts in each piece."""
        seen, state = self.pieces(data, at, end, first)
        total, place, points = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k, row in enumerate(seen):
            step = state + row
            out = self.emit[step]
            hit = (out & 1023 > 0) & (total & 1023 == nth)
            place[hit], points[hit] = k, total[hit] >> 10 & 1023
            total += out
            state = self.next[step]
        return at + place, points


@lru_cache
def table_of(sentinels: tuple[str, ...]) -> Table:
    return Table(sentinels)


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def arranged(data: np.ndarray, bounds: np.ndarray, ids: list, seed: int, rate: int, spm: int, sentinels: tuple[str, ...]) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output as bytes) of the texts data[bounds[i]:bounds[i + 1]]."""
    table, sizes = table_of(sentinels), np.diff(bounds)
    many = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at, end, first = bounds[owner] + place * PIECE, bounds[owner + 1], place == 0
    sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(table.count(data, at, end, first), 1)], 1)
    opens = np.concatenate([np.cumsum(many) - many, [len(owner)]])
    n, _, marks = np.diff(sums[:, opens], axis=1)
    forms, asked = [], []
    for i, doc_id in enumerate(ids):
        h1, h2, h3, h4 = draws(seed, doc_id)
        form = "plain" if not sizes[i] or marks[i] or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
        forms.append(form)
        if form != "plain":
            asked += [(i, unit) for unit in sorted((h1 % (int(n[i]) + 1), h2 % (int(n[i]) + 1)))]
    text, unit = np.array(asked, np.int64).reshape(-1, 2).T
    # the cut before a unit lies in the piece where it starts; the one after all units is the text's end
    held = np.searchsorted(sums[0], sums[0][opens[text]] + unit, "right") - 1
    last = unit == n[text]
    held[last] = opens[text[last]]
    byte, points = table.locate(data, at[held], end[held], first[held], sums[0][opens[text]] + unit - sums[0][held])
    points = points + sums[1][held] - sums[1][opens[text]]
    byte, points = np.where(last, bounds[text + 1], byte), np.where(last, sums[1][opens[text + 1]] - sums[1][opens[text]], points)
    cuts = iter(zip(byte.reshape(-1, 2).tolist(), points.reshape(-1, 2).tolist()))
    p, s, m = (x.encode() for x in sentinels)
    raw, out = data.tobytes(), []
    for i, form in enumerate(forms):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if form == "plain":
            out.append((int(n[i]), form, None, None, raw[a:b]))
            continue
        (x, y), (before, upto) = next(cuts)
        prefix, middle, suffix = raw[a:x], raw[x:y], raw[y:b]
        made = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
        out.append((int(n[i]), form, before, upto - before, b"".join(made)))
    return out


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row of docs: id_col, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    The id and seed draw both cuts, whether the text is rearranged (`rate` percent) and whether its suffix comes first
    (`spm` percent of those). A null text is empty; an empty text and one that holds a sentinel stay plain. Repeated rows and
    ids are cut alike; a null id draws as an empty one does. Other columns are not read. No shuffle. Empty tables give none.
    """
    ship(docs.sparkSession)
    table_of(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            where, body = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
            data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(where, where[i] + SLICE_BYTES, "right")) - 1)
                rows = batch.column(0).slice(i, j - i)
                made = arranged(data[where[i] : where[j]], where[i : j + 1] - where[i], rows.to_pylist(), seed, rate, spm, sentinels)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([rows, *columns[:4], columns[4].cast(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                i = j

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("id", id_col)


def restored(form: Column | str = "form", output: Column | str = "output", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transform() made `output` of."""
    form, output = (F.col(x) if isinstance(x, str) else x for x in (form, output))
    p, s, m = sentinels

    def between(after: str, before: str | None) -> Column:
        at = F.locate(after, output) + len(after)
        return F.substring(output, at, F.length(output) if before is None else F.locate(before, output) - at)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **options) -> DataFrame:
    """transform() with hashes in place of the texts, and of those that `restored` gives."""
    made = transform(docs, **options)
    return made.select(*[c for c in made.columns if c != "output"], F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
