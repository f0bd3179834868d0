"""The Merkle manifest against a plain version."""

import random
import zlib
from hashlib import sha256

import pytest

from lacuna.llm import common, manifest
from lacuna.operators import ranks

LOWER = {k: k + 32 for k in range(65, 91)}


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The root of nodes, and for each the (left, right) siblings by level."""
    sides, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k in range(len(nodes)):
            lo = at[k] // 16 * 16
            run = level[lo : lo + 16]
            sides[k].append(("".join(run[: at[k] - lo]), "".join(run[at[k] - lo + 1 :])))
            at[k] //= 16
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], sides


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    subs, trees = [], []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *tree([leaf(r) for r in mine])))
        subs.append(trees[-1][1])
    root, above = tree(subs)
    out = []
    for (mine, sub, sides), upper in zip(trees, above):
        for r, side in zip(mine, sides):
            proof = side + upper
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].translate(LOWER))) if change else leaf(r)
            for left, right in proof:
                node = h(left, node, right)
            out.append((r[0], leaf(r), sub, root, h(*(a + b for a, b in proof)), node, node == root))
    return out


def rows_of(n, sources, seed=1):
    r = random.Random(seed)
    out = [(i, r.choice(sources), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "Ab é", "low", f"T {i}"])) for i in range(n)]
    return out + [(None, "a", None, None, "N")] * 2 + [(3, "a", "en", 1, "Same")] * 40 + [(10**6, "lone", None, None, "X"), (5, "é", None, None, "Y"), (6, "z", "x", 0, None)]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_against_plain(spark, monkeypatch, broadcast_rows):
    for module in (common, ranks):
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast_rows)
    rows = rows_of(900, ["a"] * 8 + [None, "b", "B", "ö"] + [f"s{k}" for k in range(20)])
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, node string").repartition(5)
    got = manifest.audit(docs, manifest.lowered_in_fifths(docs)).collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert 20 < sum(not x[-1] for x in want) < 500


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(i, f"s{i}", "l", i, "t") for i in range(17)], [(i, "s", "l", i, "T") for i in range(16)], [(i, "s", "l", i, "T") for i in range(257)]])
def test_shapes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = manifest.audit(docs, manifest.lowered_in_fifths(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows) if rows else [], key=repr)


def test_any_change_is_found(spark):
    rows = rows_of(100, ["a", "b"])
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    from pyspark.sql import functions as F

    for column, change in (("lang", F.lit("other")), ("source", F.lit("other")), ("n_chars", F.lit(77)), ("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" ")))):
        assert manifest.audit(docs, {column: change}).where("verified").count() == 0
    assert manifest.audit(docs, {}).where("not verified").count() == 0
