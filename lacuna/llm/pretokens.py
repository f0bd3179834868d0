"""Pre-splitting of texts for the byte-level BPE vocabulary, as its pre-tokenizer does it.

The pattern's pieces never cross a space that stands between two other characters: such a space
always begins a piece. Texts are therefore cut there first (`Splitter.chunks`), cheaply, and only chunks
that were not met before go through the pattern (`Splitter.pieces`).

Which characters are letters and numbers is asked of the library itself (`classes`), on the driver, and goes to
the tasks with the job: results depend neither on Python's Unicode tables nor on where a task runs.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

#: White space of the pattern's \s. Fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
#: Planes that have assigned characters other than private ones; in all others nothing is a letter or a number.
PLANES = (range(0x0, 0xD800), range(0xE000, 0x40000), range(0xE0000, 0xF0000))


class Classes(NamedTuple):
    """Letters and numbers, each as the inside of a character class, and special strings with their ids."""

    letters: str
    numbers: str
    special: tuple[tuple[str, int], ...]


@lru_cache(4)
def classes(path: str) -> Classes:
    """Asks the library's pre-tokenizer. A text of all characters in order falls into its runs of one class; what
    class a run is shows in whether its first character joins a letter or a digit before it."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    split = library.pre_tokenizer.pre_tokenize_str
    found: dict[str, list[str]] = {"A": [], "1": []}
    for plane in PLANES:
        text = "".join(map(chr, plane))
        for _, (a, b) in split(text):
            a += text[a] == " " and b > a + 1  # a space joins what follows it
            for like, out in found.items():
                if len(split(like + text[a])) == 1:
                    out.append(f"\\U{ord(text[a]):08x}-\\U{ord(text[b - 1]):08x}")
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    return Classes("".join(found["A"]), "".join(found["1"]), tuple(special.items()))


_OTHERS = [c for c in map(chr, range(0x3001)) if c != " " and re.match(f"[{SPACE}]", c)]
_BETWEEN = re.compile(f" (?<=[^{SPACE}] )(?=[^{SPACE}])")


def _up_to(ranges: str, last: int) -> str:
    """Those ranges, or parts of them, that are not beyond a character."""
    pairs = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})", ranges)]
    return "".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in pairs if a <= last)


def _pattern(letter: str, number: str) -> re.Pattern[str]:
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Splitter:
    def __init__(self, known: Classes):
        # a class with characters beyond 16 bits is slow for all texts, so only texts with such characters go through it
        self._every = _pattern(known.letters, known.numbers)
        self._narrow = _pattern(_up_to(known.letters, 0xFFFF), _up_to(known.numbers, 0xFFFF))
        self._ascii = _pattern(_up_to(known.letters, 0x7F), _up_to(known.numbers, 0x7F))
        self.special = dict(known.special)
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii.findall(text)
        wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        return (self._every if wide else self._narrow).findall(text)

    def chunks(self, text: str) -> list[str]:
        """The text cut at every space between two other characters; all chunks but the first have lost
        the space before them."""
        return _BETWEEN.split(text) if self.has_wide_space(text) else text.split(" ")

    def has_wide_space(self, text: str) -> bool:
        """Whether a space stands at an end of the text or beside other white space."""
        return text[:1] == " " or text[-1:] == " " or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in _OTHERS)

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """(plain text, id of the special string after it or None) in order."""
        if not self._special or not any(s in text for s in self.special):
            return [(text, None)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out.append((text[at : m.start()], self.special[m[0]]))
            at = m.end()
        return [*out, (text[at:], None)]
