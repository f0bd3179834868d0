"""Spatial joins against all pairs, in plain Python."""

import random

import pytest

from lacuna.operators import geo, spatial

KIND = f"k bigint, g {geo.TYPE}"


def edges(g):
    return [(*a, *b) for polygon in g for ring in polygon for a, b in zip(ring, ring[1:]) if a != b]


def side(e, x, y):
    d = (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])
    return (d > 0) - (d < 0)


def touch(e, f):
    if any(min(e[c], e[c + 2]) > max(f[c], f[c + 2]) or min(f[c], f[c + 2]) > max(e[c], e[c + 2]) for c in (0, 1)):
        return False
    return side(f, *e[:2]) * side(f, *e[2:]) <= 0 and side(e, *f[:2]) * side(e, *f[2:]) <= 0


def inside(g, x, y):
    return sum((e[1] <= y) != (e[3] <= y) and e[0] + (y - e[1]) / (e[3] - e[1]) * (e[2] - e[0]) < x for e in edges(g)) % 2 == 1


def meet(a, b):
    if any(touch(e, f) for e in edges(a) for f in edges(b)):
        return True
    return any(inside(b, *p[0][0]) for p in a) or any(inside(a, *p[0][0]) for p in b)


def star(r, x, y, size, n):
    import math

    turns = sorted(r.random() * 2 * math.pi for _ in range(n))
    ring = [[x + size * (0.3 + 0.7 * r.random()) * math.cos(t), y + size * (0.3 + 0.7 * r.random()) * math.sin(t)] for t in turns]
    return [[*ring, ring[0]]]


def box(x, y, w, h):
    return [[[float(u), float(v)] for u, v in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]]


def shapes(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y, size = r.uniform(-10, 10), r.uniform(-10, 10), r.choice([0.01, 0.3, 1.0, 5.0])
        kind = r.randrange(5)
        if kind == 0:
            g = [box(round(x), round(y), r.randrange(1, 4), r.randrange(1, 4))]
        elif kind == 1:
            g = [[*box(x, y, size, size), box(x + size / 4, y + size / 4, size / 2, size / 2)[0]]]
        elif kind == 2:
            g = [star(r, x, y, size, 5), star(r, x + 3 * size, y, size, 7)]
        else:
            g = [star(r, x, y, size, r.choice([3, 12, 200]))]
        out.append((k, g))
    return out


def test_pairs_against_all_pairs(spark):
    rows = shapes(1, 120)
    df = spark.createDataFrame([*rows, (500, None), (501, [])], KIND).repartition(3)
    got = [tuple(x) for x in spatial.intersecting(df, None, "k", "g").collect()]
    want = [(a, b) for a, g in rows for b, h in rows if a < b and meet(g, h)]
    assert sorted(got) == want and 100 < len(want) < 5000


def test_two_tables_boxes_and_points(spark):
    rows, others = shapes(2, 60), shapes(3, 50)
    left, right = (spark.createDataFrame(x, KIND) for x in (rows, others))
    got = sorted(tuple(x) for x in spatial.intersecting(left, right, "k", "g").collect())
    assert got == [(a, b) for a, g in rows for b, h in others if meet(g, h)]
    for b in ((-3.0, -2.0, 4.0, 1.5), (0.0, 0.0, 0.0, 0.0), (-100.0, -100.0, 100.0, 100.0), (1.0, 1.0, 1.01, 1.02)):
        wall = [box(b[0], b[1], b[2] - b[0], b[3] - b[1])]
        want = [k for k, g in rows if meet(g, wall) or b[0] <= g[0][0][0][0] <= b[2] and b[1] <= g[0][0][0][1] <= b[3] or inside(g, b[0], b[1])]
        assert sorted(x.k for x in geo.in_box(left, "g", b).select("k").collect()) == want
    r = random.Random(5)
    points = [(k, r.uniform(-10, 10), r.uniform(-10, 10)) for k in range(300)] + [(400, None, 1.0)] + [(401 + k, *rows[k][1][0][0][0]) for k in range(20)]
    got = sorted(tuple(x) for x in spatial.holding(spark.createDataFrame(points, "p bigint, x double, y double"), left, "p", "x", "y", "k", "g").collect())
    assert got == [(p, k) for p, x, y in points if x is not None for k, g in rows if inside(g, x, y) or any(touch(e, (x, y, x, y)) for e in edges(g))]


@pytest.mark.parametrize("a, b, want", [
    (box(0, 0, 1, 1), box(1, 0, 1, 1), True),  # a side in common
    (box(0, 0, 1, 1), box(1, 1, 1, 1), True),  # a corner
    (box(0, 0, 4, 4), box(1, 1, 1, 1), True),  # within
    ([box(0, 0, 4, 4)[0], box(1, 1, 2, 2)[0]], box(1.5, 1.5, 1, 1), False),  # in the hole
    (box(0, 0, 1, 1), box(0, 0, 1, 1), True),  # equal
    ([[[0, 0], [4, 0], [0, 4], [0, 0]]], [[[4, 4], [4, 3], [3, 4], [4, 4]]], False),  # envelopes alone
])
def test_known_pairs(spark, a, b, want):
    as_float = lambda g: [[[[float(v) for v in p] for p in ring] for ring in g]]
    df = spark.createDataFrame([(1, as_float(a)), (2, as_float(b))], KIND)
    assert spatial.intersecting(df, None, "k", "g").count() == want


def test_a_large_geometry_is_cut(spark):
    r = random.Random(4)
    rows = [(0, [star(r, 0.0, 0.0, 50.0, 6000)]), *((k, [star(r, r.uniform(-60, 60), r.uniform(-60, 60), 0.2, 6)]) for k in range(1, 150))]
    df = spark.createDataFrame(rows, KIND)
    sized = spatial._levelled(df.where("k = 0"), "k", "g")
    cells = spatial.cover(sized, [sized.first().own])
    most = max(len(x.edges) for x in cells.collect())
    assert cells.count() > 5000 and most < 600
    got = {x.b for x in spatial.intersecting(df, None, "k", "g").where("a = 0").collect()}
    assert got == {k for k, g in rows[1:] if meet(rows[0][1], g)} and 20 < len(got) < 140


def parity_area(ring, n=400):
    """The area of what a closed ring holds by parity, counted on a fine raster of scan lines."""
    ys = [p[1] for p in ring]
    lo, hi = min(ys), max(ys)
    area = 0.0
    for k in range(n):
        y = lo + (hi - lo) * (k + 0.5) / n
        xs = sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:]) if (a[1] <= y) != (b[1] <= y))
        area += sum(b - a for a, b in zip(xs[::2], xs[1::2])) * (hi - lo) / n
    return area


def flat_area(g):
    def ring(r):
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2

    return sum(ring(p[0]) - sum(map(ring, p[1:])) for p in g)


def crossed(ring):
    n = len(ring) - 1
    pairs = [(ring[i], ring[i + 1], ring[j], ring[j + 1]) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1)]
    return any(touch((*a, *b), (*c, *d)) for a, b, c, d in pairs)


def test_repair_against_brute_force(spark):
    r = random.Random(6)
    rings = []
    for k in range(60):
        ring = [[r.uniform(0, 1), r.uniform(0, 1)] for _ in range(r.choice([4, 5, 6, 9, 15]))]
        rings.append([*ring, ring[0]])
    whole = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    rings += [whole, [[0, 0], [2, 0], [1, 1], [2, 2], [0, 2], [1, 1], [0, 0]], [[0, 0], [2, 0], [2, 2], [1, 0], [0, 2], [0, 0]], [[0, 0], [2, 0], [3, 0], [2, 0], [2, 2], [0, 0]], [[0, 0], [1, 1], [2, 2], [1, 1], [0, 0]]]
    rings = [[[float(v) for v in p] for p in ring] for ring in rings]
    df = spark.createDataFrame([(k, [[ring]]) for k, ring in enumerate(rings)], KIND).repartition(2)
    got = {x.k: x.geometry for x in geo.repaired(df, "k", "g").collect()}
    assert sorted(got) == [k for k, ring in enumerate(rings) if crossed(ring) or k == 63]
    assert got[64] is None and flat_area(got[63]) == 2.0 and len(got[61]) == 2
    for k, g in got.items():
        if g is not None:
            assert flat_area(g) == pytest.approx(parity_area(rings[k]), rel=0.02, abs=1e-3), k
            again = spark.createDataFrame([(0, [p]) for p in g], KIND) if k < 12 else None
            if again is not None:  # no ring of the result crosses itself or another one
                assert all(len({tuple(q) for q in ring}) == len(ring) - 1 for p in g for ring in p)
                left = geo.crossings(again.withColumn("k", again.k + 0), "k", "g").where("r = s").collect()
                assert not [x for x in left if min(abs(x.x - q[0]) + abs(x.y - q[1]) for p in g for ring in p for q in ring) > 1e-9]


def test_rings_that_cross_are_refused(spark):
    hole = box(0.5, 0.5, 2.0, 0.2)[0]
    text = '{"type":"Polygon","coordinates":%s}'
    import json

    shapes_ = [[box(0, 0, 0.01, 0.01)[0], box(0.002, 0.002, 0.004, 0.004)[0]], [box(0, 0, 0.01, 0.01)[0], box(0.005, 0.005, 0.02, 0.002)[0]], [box(0, 0, 1, 1)[0], hole]]
    got = geo.checked(spark.createDataFrame([(k, text % json.dumps(g)) for k, g in enumerate(shapes_)], "k int, g string"), "g").orderBy("k").collect()
    assert [x.code for x in got] == [None, "INVALID_GEOMETRY", "INVALID_GEOMETRY"] and [x.repaired for x in got] == [False, True, True]


def test_many_vertices_take_little_time(spark):
    import json
    import math
    import time

    turns = [2 * math.pi * k / 9000 for k in range(9000)]
    ring = [[10 + (0.1 + 0.01 * math.sin(40 * t)) * math.cos(t), 10 + (0.1 + 0.01 * math.sin(40 * t)) * math.sin(t)] for t in turns]
    ring[100], ring[103] = ring[103], ring[100]
    df = spark.createDataFrame([(0, json.dumps({"type": "Polygon", "coordinates": [[*ring, ring[0]]]}))], "k int, g string")
    start = time.time()
    x = geo.checked(df, "g").first()
    assert x.repaired and x.code is None and time.time() - start < 60


def test_small_geometries_need_no_grid(spark, monkeypatch):
    """Crossings of small geometries are made in their own rows, and are those of the grid; areas compute no step of the projection twice."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = [(k, [[[*(p := [[r.randrange(6) / 2, r.randrange(6) / 2] for _ in range(7)]), p[0]]]]) for k in range(60)]
    rows = [(k, [[[q for i, q in enumerate(g[0][0]) if not i or q != g[0][0][i - 1]]]]) for k, g in rows]
    df = spark.createDataFrame(rows, KIND)
    cells = []
    kept = geo.staged
    monkeypatch.setattr(geo, "staged", lambda d, name: (cells.append((x := kept(d, name)).count()), x)[1])
    found = []
    for small in (geo.SMALL, 0):
        monkeypatch.setattr(geo, "SMALL", small)
        found.append({tuple(x) for x in geo.crossings(df, "k", "g").collect()})
    assert found[0] == found[1] and len(found[0]) > 100 and cells[0] == 0 < cells[1]
    plan = df.select(geo.area_hectares(F.col("g"), F.lit(31)).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("ATANH") <= 3


@pytest.mark.parametrize("chunk", [1, 1024])
def test_copies_are_compared_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(spatial, "CHUNK", chunk)
    base = [(k, g) for k, g in shapes(4, 12) if g]
    rows = [(100 * c + k, g) for c in range(4) for k, g in base] + [(1000, None), (1001, [])]
    cells = []
    kept = spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda d, name: (cells.append((name, (x := kept(d, name)).count())), x)[1])
    got = sorted(map(tuple, spatial.intersecting(spark.createDataFrame(rows, KIND), None, "k", "g").collect()))
    assert got == sorted((a, b) for a, g in rows for b, h in rows if a < b and g and h and meet(g, h))
    assert dict(cells)["shapes"] <= len(base)
    two = sorted(map(tuple, spatial.intersecting(spark.createDataFrame(base, KIND), spark.createDataFrame(rows, KIND), "k", "g").collect()))
    assert two == sorted((a, b) for a, g in base for b, h in rows if h and meet(g, h))
