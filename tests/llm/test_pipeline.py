"""Each stage and the whole pipeline against plain Python on small documents."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lacuna.llm import bpe_automaton, decontamination, line_dedup, quality, simhash, token_counts
from tests.llm.test_near_copies import plain_roots

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(400)]

    def text(n):
        return "".join(r.choice(words) + (".\n" if r.random() < 0.1 else " ") for _ in range(n)).strip()

    items = [(i, text(r.randrange(12, 40)).replace("\n", " ")) for i in range(10)]
    footer = "All rights reserved, see the terms"
    rows = []
    for i in range(160):
        body = text(r.choice([20, 80, 120, 200]))
        if i % 3 == 0:
            body += "\n" + footer
        if i % 11 == 0 and rows:
            body = rows[-1][1] or body
        if i % 13 == 0:
            w = items[i % 10][1].split()
            for k in range(0, len(w), 7):
                w[k] = r.choice(words)
            body += "\n" + " ".join(w) + "\n" + text(30)
        if i % 17 == 0:
            body = (text(4) + " ") * 30
        rows.append((i, body, "en", f"src{i % 2}", len(body)))
    rows += [(500, None, None, None, None), (501, "", "en", "src0", 0), (502, " \n\t", "en", "src0", 3), (503, "é漢 " * 5000, "x", "src1", 15000)]
    return rows, items


def split_words(text):
    return (text or "").encode().split()


def plain_quality(rows):
    hosts = Counter(r[3] for r in rows)

    def lines(t):
        return [" ".join(x.lower().split(" ")) for x in ("\n".join(" ".join(y.split()) for y in (t or "").split("\n"))).split("\n")]

    held = Counter((r[3], x) for r in rows for x in {x for x in lines(r[1]) if x})
    out = {}
    for i, t, _, host, _ in rows:
        w = split_words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        chars = sum(len(x.decode()) for x in w)
        removed = sum(len(x.replace(" ", "")) for x in lines(t) if x and held[host, x] > 10 and held[host, x] > 0.05 * hosts[host])
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out[i] = (len(w), chars, len(covered), failed, not failed and removed <= 0.5 * chars)
    return out


def plain_dedup(rows):
    hosts = Counter(r[3] for r in rows)

    def norm(x):
        return " ".join(x.lower().split())

    held = Counter((r[3], x) for r in rows for x in {norm(x) for x in (r[1] or "").split("\n")} - {""})
    out = []
    for i, t, lang, host, n in rows:
        new = t if t is None else "\n".join(x for x in t.split("\n") if not (held[host, norm(x)] >= 5 and held[host, norm(x)] > 0.06 * hosts[host]))
        out.append((i, new, lang, host, n if new == t else len(new)))
    return out


def plain_align(a, b):
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for k, y in enumerate(b):
            new.append(max(0.0, row[k] + (1 if x == y else -0.5), row[k + 1] - 0.5, new[k] - 0.5))
        row, best = new, max(best, *new)
    return best


def plain_leaks(rows, items, least=0.5):
    return {(i, k) for i, t, *_ in rows for k, x in items if (a := decontamination.words_of(x)) and plain_align(a, decontamination.words_of(t)) >= least * len(a)}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_quality(spark, broadcast_rows):
    rows, _ = documents()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(frame(spark, rows), broadcast_rows=broadcast_rows).collect()}
    want = plain_quality(rows)
    assert got == want and 20 < sum(x[4] for x in want.values()) < 150


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_line_dedup(spark, broadcast_rows):
    rows, _ = documents()
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(frame(spark, rows), broadcast_rows=broadcast_rows).collect()}
    want = {r[0]: r[1] for r in plain_dedup(rows)}
    assert got == want and sum(want[r[0]] != r[1] for r in rows) > 30


def test_edges_of_native_operators(spark):
    kind = "doc_id bigint, text string, source string, _text string, n_lines int, kept string, _row int"
    rows = [(None, "a\nb", None, "k", 1, "x", 2)] * 7 + [(1, "A \n c", None, "k", 1, "x", 2)]
    df = spark.createDataFrame(rows, kind)
    for broadcast_rows in (0, 100):
        got = Counter(r.text for r in line_dedup.drop_boilerplate(df, broadcast_rows=broadcast_rows).collect())
        assert got == {"": 7, " c": 1}
        assert [r.n_words for r in quality.judge(df, broadcast_rows=broadcast_rows).collect()] == [2] * 8
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0 and quality.judge(df.limit(0)).count() == 0
    assert line_dedup.drop_boilerplate(df).first()["_text"] == "k" and quality.judge(df).first()["_row"] == 2


def test_decontamination(spark):
    rows, items = documents()
    bench = spark.createDataFrame([*items, (90, None), (None, "x"), (91, " ")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    want = plain_leaks(rows, items)
    assert got == want and len(want) >= 12
    clean = decontamination.drop_contaminated(frame(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in want}
    assert decontamination.contaminated(frame(spark, rows).limit(0), bench).count() == 0
    assert decontamination.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_encoding_and_counts(spark):
    rows, _ = documents()
    rows.append((600, "<|endoftext|> don't  stop\n\n 12²\r\n" + "a" * 5000 + " =" * 300, "en", "s", 1))
    library = Tokenizer.from_file(PATH)
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for x in bpe_automaton.encode(frame(spark, rows), PATH).collect():
        assert x.ids == ids[x.doc_id] and x.n_tokens == len(x.ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, x.ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(library.decode(x.ids, skip_special_tokens=False).encode()).hexdigest()
    for x in token_counts.count_tokens(frame(spark, rows), PATH).collect():
        assert x.n_tokens == len(ids[x.doc_id]) and x.over_limit == (x.n_tokens > 1024)


def test_run(spark, tmp_path):
    """The stages one after the other against their plain versions, near copies by plain sets of words."""
    rows, items = documents(7)
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    near = [w if k not in (20, 80, 140) else "edit" for k, w in enumerate(base)]
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(near))).bit_count() > 3
    rows += [(600 + k, " ".join(w), "en", "far", 1) for k, w in enumerate((base, near))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = plain_quality(rows)
    docs = plain_dedup([r for r in rows if kept[r[0]][4]])
    docs = [d for i, (d, root) in enumerate(zip(docs, plain_roots([d[1] for d in docs]))) if i == root]
    assert 600 in {d[0] for d in docs} and 601 not in {d[0] for d in docs}
    leaks = {i for i, _ in plain_leaks(docs, items)}
    docs = [d for d in docs if d[0] not in leaks]
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d[0]: library.encode(d[1], add_special_tokens=False).ids for d in docs} and len(docs) > 20 and leaks


@pytest.mark.parametrize("stage", ["simhash", "decontamination", "bpe_encoding"])
def test_batches_of_a_stage_are_bounded(spark, tmp_path, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    spark.createDataFrame([(1, "some words of one item")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a b c", "en", "h", 5)], SCHEMA)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own in (None, "100000"):
        try:
            if own:
                spark.conf.set(name, own)
            dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
            long = spark.range(0, 1000, 1, 1).selectExpr("repeat('abcdefgh ', 2000) as text").mapInArrow(sizes, "n bigint")
            assert max(r.n for r in long.collect()) < (200_000 if own else 6_000_000)
        finally:
            spark.conf.unset(name)
