"""Personal data: detected entities are replaced by keyed surrogates.

A surrogate is drawn from a keyed hash of (kind, normal form, attempt) in the entity's own format: letters
become letters of the same script and case, digits digits, a card number that passes its check keeps
passing it, an address stays an address, and a given name that a title shows to be a man's or a woman's keeps its
gender. Equal
entities get equal surrogates everywhere (coreference); the gender of a given name is settled once, over all its titles.

Distinctness is checked over the whole corpus: no two entities may share a surrogate, and none may be an
entity that the corpus has. Those that clash draw again with the next attempt, in rounds, as joins and
groupings of the distinct entities; attempts late in the row are longer by a character, so that rounds end also where
all values of a format are taken. Documents are read twice where they lie and never shuffled: attempts
other than 0 are few, and go to the tasks if their number is within a bound; beyond it they are joined to
the entities of each document.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import BROADCAST_ROWS, content_key, settled, ship, staged, text_slices

#: Titles before names, by the gender that they tell. Fixed values.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Госпожа", "Κυρία")
EITHER = ("Dr", "Prof", "Professor", "Доктор")

_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
_IP = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)", re.ASCII)
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)", re.ASCII)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII)
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", re.ASCII)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}(?:[ .-]\d{2,4}){1,3}(?![\w-])|(?<![\w+])\+\d{9,14}(?!\w)", re.ASCII)
#: Words before short telephone numbers, which alone look like any two numbers. Fixed values.
CUES = ("tel", "telephone", "phone", "call", "fax", "mobile", "cell")
_SHORT_PHONE = re.compile(rf"(?<!\w)(?:{'|'.join(CUES)})(?:\.|:|\.:)? ?(\d{{3}}[ .-]\d{{4}})(?![\w-])", re.ASCII | re.IGNORECASE)
_TITLES = tuple(sorted({*MALE, *FEMALE, *EITHER}, key=len, reverse=True))
_TITLE = re.compile(rf"(?<!\w)({'|'.join(_TITLES)})\.? (?=\w)")
_NAME = re.compile(r"[^\W\d_](?:(?!['’]s\b)[\w'’-])*")


_BARE = re.compile(rf"(?<!\w){_NAME.pattern}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ip6(text: str) -> bool:
    """Whether it is an address: valid, with three groups and a decimal digit at least, so that times and names with
    double colons are none."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return len([g for g in text.split(":") if g]) > 2 and any(c.isdigit() for c in text)


class _Spans:
    """Spans without overlaps, in order; a look takes logarithmic time."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def add(self, start: int, end: int, kind: str) -> bool:
        k = bisect_left(self.starts, end)
        if k and self.spans[k - 1][1] > start:
            return False
        self.starts.insert(k, start)
        self.spans.insert(k, (start, end, kind))
        return True


def _capital(word: str) -> bool:
    return word[0].isupper()


def _caseless(word: str) -> bool:
    return word[0].lower() == word[0].upper()


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlaps; the earlier kind wins.

    Names are all capitalised words after a title, or the one word right after it in a script without case, and the
    same words wherever else the text has them so."""
    out = _Spans()

    def add(pattern: re.Pattern[str], kind: str, ok=lambda m: True, group: int = 0) -> None:
        for m in pattern.finditer(text):
            if ok(m):
                out.add(m.start(group), m.end(group), kind)

    if "@" in text:
        add(_EMAIL, "email")
    if any(c in text for c in "0123456789"):
        add(_IBAN, "iban", lambda m: iban_ok(m[0]))
        add(_IP, "ip")
        if ":" in text:
            add(_IP6, "ip6", lambda m: _ip6(m[0]))
        add(_SSN, "ssn")
        add(_CARD, "card", lambda m: (d := re.sub("[ -]", "", m[0]))[0] != "0" and (luhn(d) or len(d) == 16))
        add(_PHONE, "phone", lambda m: 7 <= sum(c.isdigit() for c in m[0]) <= 15 and ("+" in m[0] or "(" in m[0] or len(re.findall("[ .-]", m[0])) >= 2))
        add(_SHORT_PHONE, "phone", group=1)
    if any(t in text for t in _TITLES):
        named: dict[str, str] = {}
        for m in _TITLE.finditer(text):
            words, at = [], m.end()
            while (w := _NAME.match(text, at)) and w[0] not in _TITLES and (_capital(w[0]) or not words and _caseless(w[0])):
                words.append(w)
                at = w.end() + 1
                if text[w.end() : at] != " " or _caseless(w[0]):
                    break
            given = "name_m" if m[1] in MALE else "name_f" if m[1] in FEMALE else "name"
            for k, w in enumerate(words):
                kind = given if k < len(words) - 1 else "surname"
                if out.add(w.start(), w.end(), kind):
                    named.setdefault(normal("name", w[0]), kind)
        if named:  # mentions without a title
            for w in _BARE.finditer(text):
                if (_capital(w[0]) or _caseless(w[0])) and (kind := named.get(normal("name", w[0]))):
                    out.add(w.start(), w.end(), kind)
    return out.spans


def normal(kind: str, text: str) -> str:
    """Spellings of one entity share it: case, and the separators of numbers, tell nothing."""
    if kind in ("card", "phone", "iban", "ssn"):
        return re.sub(r"[ .()\-]", "", text).upper()
    return unicodedata.normalize("NFC", text).lower()


class _Draw:
    """A stream of numbers below a bound, from a keyed hash."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.block, self.rest = key, "\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.rest) < 8:
            self.rest = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.rest = int.from_bytes(self.rest[:8], "big"), self.rest[8:]
        return x % n


#: Letters to draw from, by the start of their Unicode name: consonants, vowels, endings of a woman's and a man's name.
SCRIPTS = {
    "LATIN": ("bdfgklmnprstv", "aeiou", "a", "nrs"),
    "CYRILLIC": ("бвгдклмнпрст", "аеиоу", "а", "нрв"),
    "GREEK": ("βγδκλμνπρστ", "αεηιου", "α", "ς"),
}


def _script(letter: str) -> str:
    return unicodedata.name(letter, "LATIN").split(" ")[0]


@lru_cache(4096)
def _alike(letter: str) -> str:
    """The letters of any other script: those of the same kind in the same 64 code points."""
    first = ord(letter) & ~63
    return "".join(c for c in map(chr, range(first, first + 64)) if unicodedata.category(c) == unicodedata.category(letter))


def _letter(draw: _Draw, like: str) -> str:
    hard, soft, *_ = SCRIPTS.get(_script(like), ("", ""))
    letters = hard + soft or _alike(like)
    x = letters[draw.below(len(letters))]
    return x.upper() if like.isupper() else x


_JOINTS = re.compile("([-'’]+)")


def _name(draw: _Draw, kind: str, norm: str, more: int) -> str:
    """A name of as many parts, joined as they were; the last one has the ending of its gender."""
    parts = _JOINTS.split(norm)
    words = [k for k in range(0, len(parts), 2) if parts[k]]
    for k in words:
        last, part = k == words[-1], parts[k]
        script = _script(part[0])
        if script not in SCRIPTS:
            parts[k] = "".join(_letter(draw, c) if c.isalpha() else c for c in part + part[-1] * more * last)
            continue
        hard, soft, woman, man = SCRIPTS[script]
        n = max(3, len(part)) + more * last
        body = "".join((hard if j % 2 == 0 else soft)[draw.below(len(hard if j % 2 == 0 else soft))] for j in range(n - 1))
        ends = woman if kind == "name_f" and last else man if kind == "name_m" and last else soft + hard
        parts[k] = body + ends[draw.below(len(ends))]
    return "".join(parts)


def _digits(draw: _Draw, text: str, skip: int = 0) -> str:
    """Digits for digits from the skip-th on; the first drawn is never 0."""
    out, seen = [], 0
    for c in text:
        if c.isdigit():
            out.append(c if seen < skip else str(1 + draw.below(9)) if seen == skip else str(draw.below(10)))
            seen += 1
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The surrogate's normal form, of the length and make of the entity's. Every 20 attempts (in formats of fixed length
    every 20 after the first 40) it is one character longer, so that a full space can grow."""
    draw, more = _Draw(key, kind, norm, attempt), attempt // 20
    if _kind_of(kind) == "name":
        return _name(draw, kind, norm, more)
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        local = "".join(_letter(draw, c) if c.isalpha() else str(draw.below(10)) if c.isdigit() else c for c in local + "x" * more)
        # a host's name is drawn from the host alone: addresses of one host keep sharing one
        host = _Draw(key, "host", domain)
        labels[:-1] = ["".join(_letter(host, c) if c.isalpha() else str(host.below(10)) if c.isdigit() else c for c in x) for x in labels[:-1]]
        return f"{local}@{'.'.join(labels)}"
    extra = "".join(str(draw.below(10)) for _ in range(max(0, more - 2)))
    return _fixed(draw, kind, norm) + extra


def _fixed(draw: _Draw, kind: str, norm: str) -> str:
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ip6":
        groups = norm.split(":")
        return ":".join("".join("123456789abcdef"[draw.below(15)] if k == 0 else "0123456789abcdef"[draw.below(16)] for k in range(len(g))) for g in groups)
    if kind == "card":
        body = _digits(draw, norm, 1)[:-1]
        right = next(c for c in "0123456789" if luhn(body + c))
        return body + (right if luhn(norm) else str((int(right) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else "ABCDEFGHJKLMNPRSTUVWXYZ"[draw.below(23)] for c in norm[4:])
        rest = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return f"{norm[:2]}{98 - rest:02d}{body}"
    if kind == "phone" and norm.startswith("+"):
        return _digits(draw, norm, max(1, len(norm) - 1 - 10))  # the country stays
    return _digits(draw, norm)


def dressed(kind: str, text: str, norm: str) -> str:
    """The surrogate's normal form in the spelling of the text that it replaces."""
    if kind in ("card", "phone", "iban", "ssn"):
        rest = iter(norm)
        return "".join(c if c in " .()-" else next(rest) for c in text) + "".join(rest)
    if kind == "ip":
        return norm
    if _kind_of(kind) == "name" and _JOINTS.search(text):
        old, new = _JOINTS.split(text), _JOINTS.split(norm)
        return "".join(dressed(kind, a, b) if k % 2 == 0 and a else b for k, (a, b) in enumerate(zip(old, new))) if len(old) == len(new) else norm
    if text.isupper() and len(text) > 1:
        return norm.upper()
    if kind == "email":
        return "".join(x.upper() if k < len(text) and text[k].isupper() else x for k, x in enumerate(norm))
    return norm[:1].upper() + norm[1:] if text[:1].isupper() else norm


def _kind_of(kind: str) -> str:
    """Surrogates are distinct within it: given names of any gender and surnames are one."""
    return "name" if kind in ("name", "name_m", "name_f", "surname") else kind


def entities(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, norm), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for _, texts in text_slices(batch, 0):
                for t in texts:
                    found.update((k, normal(k, t[a:b])) for a, b, k in find(t))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["kind", "norm"])

    return docs.select(text_col).mapInArrow(run, "kind string, norm string").distinct()


def attempts(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt) of the entities that may not use attempt 0. found: (kind, norm), distinct.

    In each round the open entities draw. A draw that is an entity of the corpus or was settled before is
    lost; of those that drew the same the first by (kind, norm) wins. Losers draw again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, norms, tries = (batch.column(k).to_pylist() for k in range(3))
            made = [surrogate(key, *x) for x in zip(kinds, norms, tries)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_kind_of, kinds), pa.string()), pa.array(made, pa.string())], names=["kind", "norm", "attempt", "group", "made"])

    schema = "kind string, norm string, attempt int, group string, made string"
    group = F.when(F.col("kind").isin("name", "name_m", "name_f", "surname"), "name").otherwise(F.col("kind"))
    taken = found.select(group.alias("group"), F.col("norm").alias("made")).distinct()
    todo, late = found.withColumn("attempt", F.lit(0)), []
    while not todo.isEmpty():
        drawn = staged(todo.mapInArrow(run, schema), "draws")
        free = drawn.join(taken, ["group", "made"], "left_anti")
        best = free.groupBy("group", "made").agg(F.min(F.struct("kind", "norm")).alias("w"))
        won = staged(best.select("group", "made", "w.kind", "w.norm"), "settled")
        late.append(won.select("kind", "norm", F.lit(len(late)).alias("attempt")))
        taken = taken.unionAll(won.select("group", "made"))
        todo = staged(drawn.join(won, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "open")
    out = found.select("kind", "norm", F.lit(0).alias("attempt")).limit(0)
    for x in late[1:]:
        out = out.unionAll(x)
    return out


def gendered(found: DataFrame) -> DataFrame:
    """(kind, norm, as_kind) of found: a given name that titles show to be of one gender only is of that gender
    everywhere, one that they show to be of both, or of none, of no gender."""
    shown = [F.max(F.col("kind") == k) for k in ("name_m", "name_f")]
    given = found.where(F.col("kind").isin("name", "name_m", "name_f")).groupBy("norm").agg(*[x.alias(c) for x, c in zip(shown, ("m", "f"))])
    one = given.select("norm", F.when(F.col("m") & ~F.col("f"), "name_m").when(F.col("f") & ~F.col("m"), "name_f").otherwise("name").alias("one"))
    joined = found.join(one, "norm", "left")
    return joined.select("kind", "norm", F.when(F.col("kind").isin("name", "name_m", "name_f"), F.col("one")).otherwise(F.col("kind")).alias("as_kind"))


def _replaced(text: str, key: bytes, tries: dict[tuple[str, str], tuple[str, int]], known: dict[tuple[str, str], str]) -> tuple[str, int]:
    out, at = [], 0
    spans = find(text)
    for a, b, kind in spans:
        name = (kind, normal(kind, text[a:b]))
        if name not in known:
            if len(known) > 200_000:
                known.clear()
            drawn_as, attempt = tries.get(name, (kind, 0))
            known[name] = surrogate(key, drawn_as, name[1], attempt)
        out += [text[at:a], dressed(kind, text[a:b], known[name])]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def replace(docs: DataFrame, key: bytes, text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with text_col's entities replaced, and n_entities (bigint).

    A null text stays null, with no entity; a text without entities stays as it is. Null or repeated ids and
    all other columns pass through; one named n_entities is replaced. An empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)

    def build() -> DataFrame:
        found = staged(gendered(staged(entities(docs, text_col), "found")), "entities")
        again = attempts(found.select(F.col("as_kind").alias("kind"), "norm").distinct(), key).withColumnRenamed("kind", "as_kind")
        rows = found.join(again, ["as_kind", "norm"], "left").where("as_kind <> kind or attempt is not null")
        return rows.select("kind", "norm", "as_kind", F.coalesce("attempt", F.lit(0)).alias("attempt"))

    late = settled(spark, "later-attempts", build)
    own = [c for c in docs.columns if c.lower() != "n_entities"]
    if late.limit(broadcast_rows + 1).count() <= broadcast_rows:
        few = spark.sparkContext.broadcast({(r.kind, r.norm): (r.as_kind, r.attempt) for r in late.collect()})
        rows = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c] for c in own if c != text_col]).alias("row"), docs[text_col].alias("text"), F.lit(None).cast("array<struct<kind:string,norm:string,as_kind:string,attempt:int>>").alias("tries"))
    else:
        few = None
        k1, k2 = content_key(text_col)
        keyed = docs.select("*", k1, k2)

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, texts in text_slices(batch, 2):
                    got = [(start + i, k, n) for i, t in enumerate(texts) for k, n in {(k, normal(k, t[a:b])) for a, b, k in find(t)}]
                    take = pa.array([g[0] for g in got], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], names=["_k1", "_k2", "kind", "norm"])

        named = staged(keyed.select("_k1", "_k2", text_col).mapInArrow(mentions, "_k1 bigint, _k2 bigint, kind string, norm string").distinct(), "mentions")
        met = staged(named.join(late.hint("merge"), ["kind", "norm"]), "mentions-later")
        by_text = met.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("kind", "norm", "as_kind", "attempt")).alias("_tries"))
        joined = keyed.join(by_text, ["_k1", "_k2"], "left")
        rows = joined.select(F.struct(F.lit(0).alias("_"), *[joined[c] for c in own if c != text_col]).alias("row"), joined[text_col].alias("text"), F.col("_tries").alias("tries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            for start, texts in text_slices(batch, 1):
                part = batch.slice(start, len(texts))
                made = []
                for i, t in enumerate(texts):
                    tries = few.value if few is not None else {(x["kind"], x["norm"]): (x["as_kind"], x["attempt"]) for x in part.column(2)[i].as_py() or ()}
                    made.append(_replaced(t, key, tries, known if few is not None else {}))
                new = pa.array([m[0] if part.column(1)[i].is_valid else None for i, m in enumerate(made)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), new, pa.array([m[1] for m in made], pa.int64())], names=["row", "text", "n_entities"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_entities bigint"
    out = rows.mapInArrow(run, schema)
    return out.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in own], "n_entities")
