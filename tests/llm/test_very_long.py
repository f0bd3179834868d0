"""One very long text must not cost the square of its length."""

import random
import time

from lacuna.llm import decontamination, line_dedup, pii, quality, secrets


def took(f):
    began = time.process_time()
    out = f()
    return out, time.process_time() - began


def test_secrets():
    for text in ("eyJ" * 1_700_000, "eyJ." * 1_250_000, "-----BEGIN PRIVATE KEY-----" * 180_000, "password" * 600_000):
        _, seconds = took(lambda: secrets.scan(text))
        assert seconds < 15, text[:30]


def test_addresses():
    text = " ".join(f"user{k}@mail{k % 7}.example.com" for k in range(100_000))
    found, seconds = took(lambda: pii.find(text))
    assert len(found) == 100_000 and seconds < 30


def test_lines(spark):
    r = random.Random(1)
    lines = [f"line {r.randrange(10**9)} of many words" for _ in range(150_000)]
    for k in range(0, 150_000, 3):
        lines[k] = f"menu {k % 400}"
    text = "\n".join(lines)
    assert len(text) > 3_000_000
    short = "\n".join(f"menu {k}" for k in range(0, 400))
    rows = [(0, text, "h")] + [(k, f"{short}\nown {k}", "h") for k in range(1, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(2)
    began = time.time()
    got = {x.doc_id: x for x in line_dedup.drop_boilerplate(df).collect()}
    assert got[0].n_dropped == 50_000 and got[0].text == "\n".join(x for x in lines if not x.startswith("menu")) and got[1].text == "own 1"
    assert {x.doc_id: x.n_removed_chars > 0 for x in quality.judge(df, least_docs=5).collect()} == {k: True for k in range(8)}
    assert time.time() - began < 120


def test_passages(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(50_000)}" for _ in range(500_000)]
    item = " ".join(words[250_000:250_040])
    block = decontamination.Items([(1, item)], {})
    found, seconds = took(lambda: block.matches(" ".join(words), 0.5))
    assert [x[:2] for x in found] == [(1, 1.0)] and seconds < 30
