"""Spatial queries over fields made of the customers' keys: triangles, kites, frames with a hole, and pairs of triangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import geo, spatial
from lacuna.plans.queries import query
from lacuna.sources import panel as P

#: Corner points of each kind of field, in thousandths: ring by ring, as (times the width, times the height).
SHAPES = {
    0: [[[(0, 0), (1, 0), (0, 1)]]],
    1: [[[(0, 0.25), (0.5, 0), (1, 0.5), (0.5, 1)]]],
    2: [[[(0, 0), (1, 0), (1, 1), (0, 1)], [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25)]]],
    3: [[[(0, 0), (0.5, 0), (0, 0.5)]], [[(1, 1), (1, 0.5), (0.5, 1)]]],
}
#: Left, bottom, width and height by key: numbers of quarters of a thousandth degree; one field in 40 is large.
_X, _Y = "(c_custkey * 7919) % 60000", "(c_custkey * 104729) % 24000"
_W, _H = (f"4 * (40 + (c_custkey * {k}) % 300) * (CASE WHEN c_custkey % 40 = 0 THEN 12 ELSE 1 END)" for k in (31, 57))


def made_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, g: a field for each customer."""
    rows = P.read(spark, sf_dir, "customer").selectExpr("c_custkey", f"CAST({_X} AS BIGINT) AS x", f"CAST({_Y} AS BIGINT) AS y", f"CAST({_W} AS BIGINT) AS w", f"CAST({_H} AS BIGINT) AS h")

    def point(u: float, v: float) -> Column:
        return F.array((4 * F.col("x") + u * F.col("w")) / 4000.0, (4 * F.col("y") + v * F.col("h")) / 4000.0)

    g = F.lit(None).cast(geo.TYPE)
    for kind, polygons in SHAPES.items():
        shape = F.array(*[F.array(*[F.array(*[point(*c) for c in [*ring, ring[0]]]) for ring in rings]) for rings in polygons])
        g = F.when(F.col("c_custkey") % 4 == kind, shape).otherwise(g)
    return rows.select("c_custkey", g.alias("g"))




def _edge_rows() -> str:
    """(kind, part, u1, v1, u2, v2) of all edges; part numbers the first edge of each outer ring, others have 0."""
    rows = []
    for kind, polygons in SHAPES.items():
        for p, rings in enumerate(polygons):
            for r, ring in enumerate(rings):
                for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1])):
                    rows.append((kind, 0 if r or i else p + 1, *a, *b))
    return ", ".join(map(str, rows))


FIELDS_SQL = f"""
  shape(kind, part, u1, v1, u2, v2) AS (VALUES {_edge_rows()}),
  field AS (SELECT c_custkey AS k, {_X} AS x, {_Y} AS y, {_W} AS w, {_H} AS h FROM customer),
  edge AS (SELECT k, part, CAST(4 * x + u1 * w AS DOUBLE) / 4000 AS x1, CAST(4 * y + v1 * h AS DOUBLE) / 4000 AS y1, CAST(4 * x + u2 * w AS DOUBLE) / 4000 AS x2, CAST(4 * y + v2 * h AS DOUBLE) / 4000 AS y2 FROM field JOIN shape ON kind = k % 4),
  envelope AS (SELECT k, min(x1) AS ax, max(x1) AS bx, min(y1) AS ay, max(y1) AS "by" FROM edge GROUP BY k)"""


def _touch(e: str, f: str) -> str:
    def side(g: str, h: str, k: int) -> str:
        return f"sign(({g}.x2 - {g}.x1) * ({h}.y{k} - {g}.y1) - ({g}.y2 - {g}.y1) * ({h}.x{k} - {g}.x1))"

    near = " AND ".join(f"least({g}.{c}1, {g}.{c}2) <= greatest({h}.{c}1, {h}.{c}2)" for c in "xy" for g, h in ((e, f), (f, e)))
    return f"{near} AND {side(f, e, 1)} * {side(f, e, 2)} <= 0 AND {side(e, f, 1)} * {side(e, f, 2)} <= 0"


_INSIDE = "(e.y1 <= {y}) <> (e.y2 <= {y}) AND e.x1 + ({y} - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) < {x}"


@query(f"""WITH {FIELDS_SQL},
  near AS (SELECT p.k AS a, q.k AS b FROM envelope p JOIN envelope q ON p.k < q.k AND p.ax <= q.bx AND q.ax <= p.bx AND p.ay <= q."by" AND q.ay <= p."by"),
  crossing AS (SELECT DISTINCT a, b FROM near JOIN edge e ON e.k = a JOIN edge f ON f.k = b WHERE {_touch('e', 'f')}),
  held AS (SELECT a, b, v.part, v.k FROM near JOIN edge v ON v.part > 0 AND v.k IN (a, b) JOIN edge e ON e.k = CASE WHEN v.k = a THEN b ELSE a END WHERE {_INSIDE.format(x='v.x1', y='v.y1')} GROUP BY a, b, v.part, v.k HAVING count(*) % 2 = 1)
  SELECT a, b FROM crossing UNION SELECT a, b FROM held""")
def fields_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fields with a point in common."""
    return spatial.intersecting(made_fields(spark, sf_dir), None, "c_custkey", "g")


_BOX = (10.0105, 3.2, 14.7, 5.25)
_WALLS = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(*(lambda c: (c, c[1:] + c[:1]))([(_BOX[0], _BOX[1]), (_BOX[2], _BOX[1]), (_BOX[2], _BOX[3]), (_BOX[0], _BOX[3])])))


@query(f"""WITH {FIELDS_SQL}, f(x1, y1, x2, y2) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(d AS DOUBLE) FROM (VALUES {_WALLS}) t(a, b, c, d))
  SELECT DISTINCT e.k AS c_custkey FROM edge e JOIN f ON {_touch('e', 'f')}
  UNION SELECT k FROM edge WHERE part > 0 AND x1 BETWEEN {_BOX[0]} AND {_BOX[2]} AND y1 BETWEEN {_BOX[1]} AND {_BOX[3]}
  UNION SELECT k FROM edge e WHERE {_INSIDE.format(x=f'CAST({_BOX[0]} AS DOUBLE)', y=f'CAST({_BOX[1]} AS DOUBLE)')} GROUP BY k HAVING count(*) % 2 = 1""")
def fields_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that have a point in a box: none of those that only their envelope brings."""
    return geo.in_box(made_fields(spark, sf_dir), "g", _BOX).select("c_custkey")


@query(f"""WITH {FIELDS_SQL}, site AS (SELECT s_suppkey AS k, CAST((s_suppkey * 6151) % 60000 AS DOUBLE) / 1000 AS x, CAST((s_suppkey * 3571) % 24000 AS DOUBLE) / 1000 AS y FROM supplier),
  near AS (SELECT s.k AS a, e.k AS b, x, y FROM site s JOIN envelope e ON x BETWEEN ax AND bx AND y BETWEEN ay AND "by"),
  hit AS (SELECT a, b FROM near JOIN edge e ON e.k = b WHERE least(e.x1, e.x2) <= x AND x <= greatest(e.x1, e.x2) AND least(e.y1, e.y2) <= y AND y <= greatest(e.y1, e.y2) AND (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1) = 0),
  held AS (SELECT a, b FROM near JOIN edge e ON e.k = b WHERE {_INSIDE.format(x='x', y='y')} GROUP BY a, b HAVING count(*) % 2 = 1)
  SELECT a AS s_suppkey, count(*) AS n_fields FROM (SELECT * FROM hit UNION SELECT * FROM held) GROUP BY a""")
def sites_in_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields each supplier's site lies in."""
    sites = P.read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CAST((s_suppkey * 6151) % 60000 AS DOUBLE) / 1000 AS x", "CAST((s_suppkey * 3571) % 24000 AS DOUBLE) / 1000 AS y")
    return spatial.holding(sites, made_fields(spark, sf_dir), "s_suppkey", "x", "y", "c_custkey", "g").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n_fields"))
