"""The fill-in-middle transformation against a plain version in regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest

from lacuna.llm import fill_middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    r = random.Random(3)
    out = [None, "", " ", "\n\t ", "a", " a ", "<", "<P", "<P>", "<<P>>", "x<S>y", "<M", "é", " \u0085  x", "\x00 a\x1f", "< P>", "<S><P>"]
    parts = ["a", " ", "\n", "  ", "<", "<P", "<S", "M>", ">", "é", "漢字", "😀", "\u0085", "\x0b", "word", "é"]
    for n in [3] * 300 + [20] * 100 + [300] * 60 + [20_000] * 2:
        out.append("".join(r.choice(parts) for _ in range(n)))
    return out + [" " * 5000, "x" * 5000, "é" * 3000, " a" * 64 + "<P" + ">" * 200, "b" * 127 + "<P>", "b" * 126 + "<P>", "b" * 125 + "<P> c"]


def test_against_plain(spark):
    rows = [(i, t, "n", "form") for i, t in enumerate(texts())] + [(None, "one two three", "x", "y")] * 2 + [(7, "again and again", "x", "y")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string, output string").repartition(3)
    made = fill_middle.transform(docs)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.t) for r in made.withColumn("t", fill_middle.restored()).collect()), key=repr)
    assert got == sorted(((i, *plain(i, t), t or "") for i, t, *_ in rows), key=repr)
    forms = [x[2] for x in got]
    assert min(forms.count(x) for x in ("plain", "spm", "psm")) > 20
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_query_on_the_table(spark):
    from lacuna.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in QUERIES["op12_fill_middle"](spark, sf).collect():
        n, form, a, b, out = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(docs[r.doc_id] or ""))


def test_slices(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, "".join(r.choice([" ", "é", "<", "ab"]) for _ in range(r.randrange(400)))) for i in range(200)]
    bodies = [t.encode() for _, t in rows]
    bounds = np.cumsum([0] + [len(b) for b in bodies])
    made = fill_middle.arranged(np.frombuffer(b"".join(bodies), np.uint8), bounds, [i for i, _ in rows], 42, 50, 80, fill_middle.SENTINELS)
    assert [(*x[:4], x[4].decode()) for x in made] == [plain(i, t) for i, t in rows]


def test_the_table_forgets_all_but_its_last_bytes():
    table = fill_middle.Table(("[pre]", "[suf]", "[mid]"))
    r, width = random.Random(1), table.width
    for _ in range(500):
        tail = [r.choice(b"[presufmid] x\xc3\xa9") for _ in range(table.memory)]
        ends = set()
        for state in range(len(table.next) // width):
            at = state * width
            for c in tail:
                at = int(table.next[at + table.classes[c]])
            ends.add(at)
        assert len(ends) == 1


def test_other_sentinels_and_refusals(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, f"<P> one two [pr e] {i} [" + "[mid" * (i % 2)) for i in range(60)], "doc_id bigint, text string")
    made = fill_middle.transform(docs, rate=100, sentinels=marks)
    assert made.where("form = 'plain'").count() == 0
    both = made.withColumn("t", fill_middle.restored(sentinels=marks)).join(docs, "doc_id")
    assert both.where("t <> text").count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("a b", "c", "d"), ("ab", "bc", "cd"), ("xyz", "y", "w"), ("axa", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.Table(bad)
