"""Reads the byte-level BPE vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in such files: printable Latin-1 bytes stand for
    themselves, the others take code points from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """labels: each id's bytes. first: the ids of the 256 bytes. merges: (left, right, result) in rank
    order. special: special strings and their ids."""

    labels: list[bytes]
    first: list[int]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]


@lru_cache(4)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters, ids = byte_letters(), data["model"]["vocab"]
    special = {x["content"]: x["id"] for x in data["added_tokens"]}
    labels = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        labels[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        labels[i] = token.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    by_byte = {v: k for k, v in letters.items()}
    return Vocabulary(labels, [ids[by_byte[b]] for b in range(256)], [(ids[a], ids[b], ids[a + b]) for a, b in pairs], special)
