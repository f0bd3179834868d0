import random

import pytest

from lacuna.llm import common, graph, near_copies, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 5 else {tuple(words)} - {()}


def plain_roots(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return root


@pytest.mark.parametrize("broadcast_rows, many, tile", [(200_000, 1000, 1024), (0, 1, 2)])
def test_against_plain(spark, monkeypatch, broadcast_rows, many, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    for module in (common, simhash):
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(near_copies, "MANY_LINKS", many)
    r = random.Random(5)
    texts = [None, "", " \t\n", "one", "One"]
    for _ in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([4, 60, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(5)):
            copy = base[:]
            for _ in range(r.randrange(1, 2 + len(base) // 40)):
                copy[r.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(df).collect()}
    want = plain_roots(texts)
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < len(want) - 20
    kept = simhash.keep_first(df, grouped=near_copies.near_copies)
    assert {x.doc_id for x in kept.collect()} == set(want)
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    copy = base[:]
    for k in (20, 80, 140):
        copy[k] = "edit"
    a, b = " ".join(base), " ".join(copy)
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert [x.doc_id for x in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()] == [1]


def overlapping(r, n, shared):
    """Texts around one passage, from much to little of it: some alike, most not, many in one bucket."""
    passage, out = [f"p{k}" for k in range(shared)], []
    for k in range(n):
        own = [f"o{k}_{j}" for j in range(r.randrange(1, shared // 2))]
        out.append(" ".join(passage + own if k % 3 else passage[: shared - k % 7] + own[:3]))
    return out


def test_forest_against_plain():
    r = random.Random(8)
    for case in range(60):
        texts = overlapping(r, r.randrange(2, 40), 60)
        sets = [near_copies.shingles(t) for t in texts]
        roots = [r.randrange(len(texts)) if r.random() < 0.3 else k for k in range(len(texts))]
        one_tile = case % 2
        upper = [not one_tile and r.random() < 0.4 for _ in texts]

        def joined(edges):
            root = list(range(len(texts)))
            for a, b in [*edges, *((k, x) for k, x in enumerate(roots))]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if x == hi else x for x in root]
            return root

        both = any(upper) and not all(upper)
        every = [(a, b) for a in range(len(texts)) for b in range(a) if (not both or upper[a] != upper[b]) and near_copies.similar(sets[a], sets[b])]
        found = near_copies.forest(list(range(len(texts))), roots, sets, upper)
        assert joined(found) == joined(every)
        assert all(near_copies.similar(sets[a], sets[b]) for a, b in found) and len(found) < len(texts)


def test_recall_on_hard_groups(spark):
    """Texts that share a passage, so that buckets hold many that are not alike: nothing is lost, and rows do not grow with pairs."""
    r = random.Random(2)
    texts = [t for k in range(6) for t in overlapping(r, 40, 60 + 20 * k)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(df).collect()}
    want = plain_roots(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs) > 100
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if got[i] == got[j])


def test_fingerprints_link_too(spark):
    """The pipeline's stage joins what op8's fingerprints link, and what only word 5-grams do; a chain may take both."""
    import corpus_pipeline

    r = random.Random(9)
    new = [" ".join(f"w{r.randrange(9000)}" for _ in range(40)) for _ in range(3)]
    far = [f"v{r.randrange(5000)}" for _ in range(200)]
    edit = [w if k not in (20, 80, 140) else "edit" for k, w in enumerate(far)]
    texts = [*("a b c d e f g " * 200 + x for x in new[:2]), " ".join(far), " ".join(edit), new[2]]
    bits = [simhash.fingerprint(t) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= 3 < (bits[2] ^ bits[3]).bit_count() and plain_roots(texts) == [0, 1, 2, 2, 4]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(x.doc_id for x in corpus_pipeline.keep_one_of_each(spark, df, "").collect()) == [0, 2, 4]
    assert corpus_pipeline.keep_one_of_each(spark, df.limit(0), "").count() == 0
