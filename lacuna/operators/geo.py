"""Polygons as nested arrays of [lon, lat]: checks, areas, hashes and box tests as column expressions.

A geometry is array<array<array<array<double>>>>: polygons, rings (the first is the outer one), points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.ranks import few
from lacuna.operators.spatial import edge_cells, edges_of, level_of, meets_box, side, touch
from lacuna.shipping import ship
from lacuna.staging import staged

TYPE = "array<array<array<array<double>>>>"
MOST_VERTICES, LEAST_HA, MOST_HA = 10_000, 0.1, 50_000.0
#: A geometry of at most so many edges is tested for crossings edge by edge, without a grid.
SMALL = 16
#: WGS 84 and UTM. Fixed values.
SEMI_MAJOR, FLATTENING, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def from_geojson(text: Column) -> Column:
    """struct(type, coordinates): a Polygon is read as a MultiPolygon of one."""
    kind = F.get_json_object(text, "$.type")
    coords = F.get_json_object(text, "$.coordinates")
    many = F.from_json(coords, TYPE)
    one = F.array(F.from_json(coords, "array<array<array<double>>>"))
    return F.struct(kind.alias("type"), F.when(kind == "MultiPolygon", many).when(kind == "Polygon", one).alias("coordinates"))


def points(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def bounds(geometry: Column) -> Column:
    xs, ys = F.transform(points(geometry), lambda p: F.get(p, 0)), F.transform(points(geometry), lambda p: F.get(p, 1))
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def vertices(geometry: Column) -> Column:
    """All ring points, closing ones too."""
    return F.size(points(geometry))


def _shoelace(ring: Column) -> Column:
    """Twice the signed area of a closed ring of struct(x, y), in one pass: the ring is an argument, not read point by point."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("sum"), none.alias("x"), none.alias("y"))
    walked = F.aggregate(ring, start, lambda s, p: F.struct((s["sum"] + F.coalesce(s["x"] * p["y"] - p["x"] * s["y"], F.lit(0.0))).alias("sum"), p["x"].alias("x"), p["y"].alias("y")))
    return walked["sum"]


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _projected(ring: Column, zone: Column) -> Column:
    """Eastings and northings (x, y) of a ring's points without false offsets, by Krueger's series to the fourth order of the third
    flattening. Lambdas compute what they name twice, twice; so each step's numbers are elements of the next one's array."""
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)
    steps = F.transform(ring, lambda p: F.struct(F.radians(F.get(p, 0) - (zone * 6 - 183)).alias("lon"), F.sin(F.radians(F.get(p, 1))).alias("sin")))
    steps = F.transform(steps, lambda p: F.struct(p["lon"].alias("lon"), F.sinh(F.atanh(p["sin"]) - e * F.atanh(e * p["sin"])).alias("t")))
    steps = F.transform(steps, lambda p: F.struct(F.atan2(p["t"], F.cos(p["lon"])).alias("xi"), F.atanh(F.sin(p["lon"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta")))

    def place(p: Column) -> Column:
        x, y = p["eta"], p["xi"]
        for j, c in enumerate(alpha, 1):
            x = x + c * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
            y = y + c * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        return F.struct((UTM_SCALE * a * x).alias("x"), (UTM_SCALE * a * y).alias("y"))

    return F.transform(steps, place)


def area_hectares(geometry: Column, zone: Column) -> Column:
    """Outer rings less holes, in the UTM zone's plane."""

    def polygon(areas: Column) -> Column:
        return F.aggregate(areas, F.lit(0.0), lambda s, x: s - x) + 2 * F.get(areas, 0)

    areas = F.transform(geometry, lambda p: F.transform(p, lambda r: F.abs(_shoelace(_projected(r, zone))) / 2))
    return F.aggregate(F.transform(areas, polygon), F.lit(0.0), lambda s, x: s + x) / 10_000


def geometry_hash(geometry: Column) -> Column:
    """SHA-256 of the coordinates at seven decimals."""
    text = F.transform(geometry, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.transform(c, lambda v: F.format_number(v, 7)))))
    return F.sha2(F.to_json(text), 256)


def _rings(geometry: Column) -> Column:
    """All rings with the number of their polygon."""
    return F.flatten(F.transform(geometry, lambda p, k: F.transform(p, lambda r: F.struct(k.alias("polygon"), r.alias("points")))))


def crossings(rows: DataFrame, key: str, geometry: str) -> DataFrame:
    """key, r, i, s, j, x, y: points where edge i of ring r meets edge j of ring s (r, i before s, j) other than at an end that they
    share as neighbours. Rings and edges are numbered from 0 through the whole geometry; rings are closed, no point follows itself.

    A geometry of at most SMALL edges has its pairs made in its own row, without a shuffle. The edges of others are joined by the cells
    of a grid of the geometry's own size, about a dozen in each.
    """
    rings = rows.select(F.col(key).alias("key"), F.col(geometry).alias("g")).withColumn("all", edges_of(F.col("g"))).where("size(all) > 0")
    large = rings.where(F.size("all") > SMALL).withColumn("size", F.pow(F.lit(2.0), level_of("all"))).select("key", "size", F.posexplode(F.flatten("g")).alias("r", "ring"))
    edges = large.select("key", "size", "r", (F.size("ring") - 1).alias("n"), F.posexplode(edges_of(F.array(F.array("ring")))).alias("i", "e"))
    placed = staged(edge_cells(edges).select("key", "cx", "cy", "r", "i", "n", "e"), "edge-cells")
    one, two = placed.toDF("key", "cx", "cy", "r", "i", "n", "e"), placed.toDF("key", "cx", "cy", "s", "j", "_n", "f")
    names = ["key", "r", "i", "n", "e", "s", "j", "f"]
    both = one.join(two, ["key", "cx", "cy"]).where((F.col("r") < F.col("s")) | (F.col("r") == F.col("s")) & (F.col("i") < F.col("j"))).select(names)

    def numbered(ring: Column, r: Column) -> Column:
        return F.transform(edges_of(F.array(F.array(ring))), lambda e, i: F.struct(r.alias("r"), i.alias("i"), (F.size(ring) - 1).alias("n"), e.alias("e")))

    small = rings.where(F.size("all") <= SMALL).select("key", F.flatten(F.transform(F.flatten("g"), numbered)).alias("edges"))
    firsts = small.select("key", "edges", F.posexplode("edges").alias("k", "a"))
    pairs = firsts.select("key", "a", F.explode(F.slice("edges", F.col("k") + 2, F.size("edges"))).alias("b"))
    both = both.unionAll(pairs.select("key", "a.r", "a.i", "a.n", "a.e", F.col("b.r").alias("s"), F.col("b.i").alias("j"), F.col("b.e").alias("f")))
    e, f = F.col("e"), F.col("f")
    after, before = F.col("j") == F.col("i") + 1, (F.col("i") == 0) & (F.col("j") == F.col("n") - 1)
    same = F.col("r") == F.col("s")
    after, before = same & after, same & before

    def end(g: Column, k: int) -> Column:
        return F.struct(g[f"x{k}"].alias("x"), g[f"y{k}"].alias("y"))

    def on(g: Column, p: Column) -> Column:
        dot = F.struct(p["x"].alias("x1"), p["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2"))
        return F.when(touch(g, dot), p)

    # of neighbours only the ends that they do not share count
    ends = F.array(F.when(~after, on(f, end(e, 2))), F.when(~before, on(f, end(e, 1))), F.when(~after, on(e, end(f, 1))), F.when(~before, on(e, end(f, 2))))
    d = [F.signum(side(g, h[f"x{k}"], h[f"y{k}"])) for g, h in ((f, e), (e, f)) for k in (1, 2)]
    proper = (d[0] * d[1] < 0) & (d[2] * d[3] < 0)
    a, b = side(f, e["x1"], e["y1"]), side(f, e["x2"], e["y2"])
    t = a / (a - b)
    cross = F.when(proper, F.struct((e["x1"] + t * (e["x2"] - e["x1"])).alias("x"), (e["y1"] + t * (e["y2"] - e["y1"])).alias("y")))
    met = both.where(touch(e, f)).select("key", "r", "i", "s", "j", F.explode(F.array_distinct(F.array_compact(F.concat(ends, F.array(cross))))).alias("p"))
    return met.select("key", "r", "i", "s", "j", "p.x", "p.y").distinct()


def _smoothed(walk: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The closed walk as walks that do not cross themselves or each other: where it comes by again, the ways in are joined to
    the ways out so that no two of them cross. How often they go round a point is together what it was."""
    n = len(walk)
    visits: dict[tuple[float, float], list[int]] = {}
    for t, p in enumerate(walk):
        visits.setdefault(p, []).append(t)
    out = list(range(n))
    for (x, y), times in visits.items():
        if len(times) > 1:
            ways = [(math.atan2(q[1] - y, q[0] - x), way, t) for t in times for way, q in ((0, walk[t - 1]), (1, walk[(t + 1) % n]))]
            open_: list[tuple[int, int]] = []
            for _, way, t in sorted(ways):
                if open_ and open_[-1][0] != way:
                    _, other = open_.pop()
                    out[other if way else t] = t if way else other
                else:
                    open_.append((way, t))
    made, seen = [], [False] * n
    for t in range(n):
        part = []
        while not seen[t]:
            seen[t] = True
            part.append(walk[t])
            t = (out[t] + 1) % n
        if part:
            made.append(part)
    return made


def loops(walk: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The closed walk as loops that do not cross and visit no point twice; those without area are left out."""
    found = []

    def done(loop: list) -> None:
        if len(loop) > 2 and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:] + loop[:1])):
            found.append(loop)

    for part in _smoothed(walk):
        path: list[tuple[float, float]] = []
        place: dict[tuple[float, float], int] = {}
        for p in part:
            if p in place:
                done(path[place[p] :])
                for q in path[place[p] + 1 :]:
                    del place[q]
                del path[place[p] + 1 :]
            else:
                place[p] = len(path)
                path.append(p)
        done(path)
    return found


def _within(loop: list[tuple[float, float]], x: float, y: float) -> bool:
    return sum((a[1] <= y) != (b[1] <= y) and a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) < x for a, b in zip(loop, loop[1:] + loop[:1])) % 2 == 1


def nested(found: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Loops that do not cross as polygons: those within an even number of others are outer rings, the others holes of the
    smallest loop around them."""
    boxes = [(min(p[0] for p in x), min(p[1] for p in x), max(p[0] for p in x), max(p[1] for p in x)) for x in found]
    around: list[list[int]] = []
    for k, loop in enumerate(found):
        x, y = (loop[0][0] + loop[1][0]) / 2, (loop[0][1] + loop[1][1]) / 2
        around.append([j for j, b in enumerate(boxes) if j != k and b[0] <= x <= b[2] and b[1] <= y <= b[3] and _within(found[j], x, y)])
    polygons = {k: [loop] for k, loop in enumerate(found) if len(around[k]) % 2 == 0}
    for k, outer in enumerate(around):
        if len(outer) % 2:
            polygons[max((j for j in outer if j in polygons), key=lambda j: len(around[j]))].append(found[k])
    return list(polygons.values())


def repaired(rows: DataFrame, key: str, geometry: str) -> DataFrame:
    """key, geometry (null if nothing of it has an area, or different rings cross or touch along edges), for the rows of which a ring
    meets itself: it is cut where it does into loops, which by parity are outer rings and holes. Other rows have none."""
    ship(rows.sparkSession)
    met = staged(crossings(rows, key, geometry), "crossings")
    apart = (F.col("r") != F.col("s")).alias("apart")
    one = met.select("key", apart, F.struct("r", "i", "x", "y").alias("p")).unionAll(met.select("key", apart, F.struct(F.col("s").alias("r"), F.col("j").alias("i"), "x", "y").alias("p")))
    # a geometry's crossings are one row, as its points are
    cuts = one.groupBy("key").agg(F.collect_set("p").alias("cuts"), F.max("apart").alias("mixed"))
    wanted = rows.select(F.col(key).alias("key"), _rings(F.col(geometry)).alias("rings")).join(cuts, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rings, found, crossed in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                at: dict[tuple[int, int], list[tuple[float, float]]] = {}
                for c in found:
                    at.setdefault((c["r"], c["i"]), []).append((c["x"], c["y"]))
                parts: dict[int, list] = {}
                for r, ring in enumerate(rings):
                    walk: list[tuple[float, float]] = []
                    points = [tuple(p[:2]) for p in ring["points"]]
                    for i, (a, b) in enumerate(zip(points, points[1:])):
                        for p in (a, *sorted(at.get((r, i), ()), key=lambda p: (p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2)):
                            if not walk or walk[-1] != p:
                                walk.append(p)
                    if len(walk) > 1 and walk[0] == walk[-1]:
                        walk.pop()
                    parts.setdefault(ring["polygon"], []).extend(loops(walk))
                shape = [[[list(p) for p in [*loop, loop[0]]] for loop in polygon] for part in parts.values() for polygon in nested(part)]
                made.append(shape if shape and not crossed else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))], names=["key", "geometry"])

    kind = rows.schema[key].dataType.simpleString()
    return wanted.mapInArrow(run, f"key {kind}, geometry {TYPE}").withColumnRenamed("key", key)


def checked(rows: DataFrame, geojson: str) -> DataFrame:
    """rows with geometry, code (null if good), repaired, vertices, area_ha and geometry_hash. Checks run in order, cheap ones first.

    A ring that meets itself is cut into loops (repaired is true then, and vertices, area and hash are those of what
    was made of it); different rings that cross have the code INVALID_GEOMETRY, as has what keeps no area.
    """
    # parsing and areas are far more work than reading: a few large parts of a table would leave cores idle
    rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    df = rows.withColumn("_g", from_geojson(F.col(geojson))).withColumns({"_t": F.col("_g.type"), "geometry": F.col("_g.coordinates")})
    # a point that follows itself adds nothing
    once = F.transform("geometry", lambda p: F.transform(p, lambda r: F.filter(r, lambda q, k: (k == 0) | (q != F.coalesce(F.get(r, k - 1), q)) | F.get(r, k - 1).isNull())))
    df = df.withColumn("geometry", once).withColumns({"_b": bounds(F.col("geometry")), "_row": F.monotonically_increasing_id()})
    open_ring = F.exists(F.flatten("geometry"), lambda r: (F.size(r) < 4) | (F.get(r, 0) != F.element_at(r, -1)))
    early = (
        F.when(F.col("_t").isNull(), "INVALID_GEOMETRY").when(~F.col("_t").isin("Polygon", "MultiPolygon"), "INVALID_GEOMETRY_TYPE")
        .when(F.col("geometry").isNull(), "INVALID_GEOMETRY").when(vertices(F.col("geometry")) <= 0, "EMPTY_GEOMETRY")
        .when((F.col("_b.minx") < -180) | (F.col("_b.maxx") > 180) | (F.col("_b.miny") < -90) | (F.col("_b.maxy") > 90), "COORDINATES_OUT_OF_RANGE")
        .when(F.col("_b.maxx") - F.col("_b.minx") > 180, "ANTIMERIDIAN_NOT_SUPPORTED").when(open_ring, "INVALID_GEOMETRY")
    )
    df = staged(df.withColumn("code", early), "geometries")
    mended = staged(repaired(df.where("code is null"), "_row", "geometry").select("_row", F.col("geometry").alias("_mended"), F.lit(True).alias("_was")), "repaired")
    n = mended.count()
    df = df.join(few(mended, n), "_row", "left").withColumn("repaired", F.coalesce("_was", F.lit(False)))
    df = df.withColumn("geometry", F.when(F.col("repaired"), F.col("_mended")).otherwise(F.col("geometry"))).withColumn("vertices", vertices(F.col("geometry")))
    late = F.when(F.col("repaired") & F.col("_mended").isNull(), "INVALID_GEOMETRY").when(F.col("vertices") > MOST_VERTICES, "TOO_MANY_VERTICES")
    df = df.withColumn("code", F.coalesce("code", late))
    zone = utm_zone((F.col("_b.minx") + F.col("_b.maxx")) / 2)
    df = df.withColumn("area_ha", F.when(F.col("code").isNull(), area_hectares(F.col("geometry"), zone)))
    size = F.when(F.col("area_ha") < LEAST_HA, "AREA_TOO_SMALL").when(F.col("area_ha") > MOST_HA, "AREA_TOO_LARGE")
    df = df.withColumn("code", F.coalesce("code", size))
    return df.withColumn("geometry_hash", F.when(F.col("code").isNull(), geometry_hash(F.col("geometry")))).drop("_g", "_t", "_b", "_row", "_mended", "_was")


def in_box(rows: DataFrame, geometry: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose geometry has a point in common with the box (minx, miny, maxx, maxy); envelopes are tried first."""
    minx, miny, maxx, maxy = box
    meets = meets_box(F.col(geometry), box)
    b = bounds(F.col(geometry))
    near = (b["minx"] <= maxx) & (b["maxx"] >= minx) & (b["miny"] <= maxy) & (b["maxy"] >= miny)
    return rows.where(F.when(near, meets).otherwise(False))
