import random
import re

import numpy as np
import pytest
import xxhash

from lacuna.llm import common, graph, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    """{row number: smallest row number reachable}"""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    r = random.Random(3)
    for k in range(300):
        text = "".join(r.choice(["Ab", "c", " ", "\n", "é", "Ö", "\x1f", "\x0b", " ", "word "]) for _ in range(k % 40))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    long = " ".join(r.choice("abcdefgh") for _ in range(200_000))
    assert simhash.fingerprint(long) == plain_fingerprint(long)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("tile, broadcast_rows", [(3, 200_000), (1024, 200_000), (3, 0)])
def test_near_duplicates(spark, monkeypatch, tile, broadcast_rows):
    for module in (common, simhash, graph):
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast_rows)
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    texts = [None, "", " \t\n", "one", "One"]
    for _ in range(40):
        base = [r.choice(words) + str(r.randrange(9)) for _ in range(r.choice([3, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = base[:]
            copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int").repartition(3)
    got = {x.doc_id: x for x in simhash.near_duplicates(df, tile=tile).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    want = plain_components(fps)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert len(set(want)) < len(want) - 3


def test_long_chain(spark):
    fps = [0]
    for k in range(60):
        fps.append(fps[-1] | 1 << k)
    edges = spark.createDataFrame([(a, b) for a, b in zip(fps, fps[1:])] + [(100 + 2**62, 7 + 2**61)] * 2, "a bigint, b bigint")
    from lacuna.llm.graph import components

    roots = {x.node: x.root for x in components(edges).collect()}
    assert len({roots[f] for f in fps}) == 1 and len(set(roots.values())) == 2 and len(roots) == 63


def test_link_tiles_is_exact():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << r.integers(0, 64, 100).astype(np.uint64))
    fps = np.concatenate([base, near])
    a, b = simhash.link_tiles(fps, None, 3)
    root = dict(zip(a.tolist(), b.tolist()))
    plain = plain_components(fps.tolist())
    groups = {}
    for f, k in zip(fps.tolist(), plain):
        groups.setdefault(k, set()).add(root.get(f, f))
    assert len(a) >= 100 and all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id bigint, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q r s t u v")], schema)
    got = sorted((str(x.doc_id), str(x.component_id)) for x in simhash.near_duplicates(df).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_keep_first(spark, monkeypatch, broadcast_rows):
    for module in (common, simhash, graph):
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast_rows)
    schema = "doc_id bigint, text string, _id string"
    rows = [(3, "a b c d e", "x"), (1, "a b c d e", "x"), (1, "a b c d e", "x"), (1, "a b c d e", "y"), (9, "totally other words stand here", "z"), (None, "quite some more other things", "n"), (None, "quite some more other things", "n"), (None, "a b c d e", "n")]
    got = sorted((str(x.doc_id), x.text) for x in simhash.keep_first(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "a b c d e"), ("9", "totally other words stand here"), ("None", "quite some more other things")]
    unique = spark.createDataFrame([rows[0], rows[1], rows[4]], schema)
    assert sorted(x.doc_id for x in simhash.keep_first(unique).collect()) == [1, 9]
    assert simhash.keep_first(unique.limit(0)).count() == 0


def test_keep_first_of_an_id_in_two_components(spark):
    rows = [(3, "a b c d e"), (7, "totally other words stand here"), (7, "a b c d e")]
    got = {(x.doc_id, x.text) for x in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == set(rows[:2])


def test_filter_misses_no_key(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as k")
    all_rows = spark.range(100_000).selectExpr("id", "xxhash64(id) as k")
    for words in (64, 1 << 22):  # too small, and large enough
        passed = all_rows.where(common.maybe_in(keys, 5000, all_rows.k, words))
        assert passed.where("id < 5000").count() == 5000
    assert passed.where("id >= 5000").count() < 95_000 / 30


def test_texts_stay_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    rows = spark.range(2000).selectExpr("id as doc_id", "if(id % 100 = 1, 'one text that is here often', sha2(cast(id as string), 512) || ' x y ' || id) as text")
    kept = simhash.keep_first(rows)
    assert kept.count() == 1981
    moved = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in moved and {r.doc_id for r in kept.where("doc_id % 100 = 1").collect()} == {1}
