"""Queries of made anomaly cases and of the audit of a year, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import cases, harmonize, season
from lacuna.plans.queries import _EVENTS_SQL, _IQR_SQL, _LOYO_SQL, PANEL_SQL, _panel, query, r6, rounded
from lacuna.sources import panel as P
from lacuna.staging import staged

YEAR = 2000


def _of_year(sql: str, table: str) -> str:
    """SQL of a climatology over all years, asked for one year and fed from those before it."""
    asked, fed = "target FROM panel),", "target AS v FROM panel WHERE target IS NOT NULL"
    assert asked in sql and fed in sql
    return sql.replace(asked, f"target FROM {table} WHERE y = {YEAR}),").replace(fed, f"target AS v FROM {table} WHERE target IS NOT NULL AND y < {YEAR}")


_DEPTH_SQL = f"(SELECT unnest({list(cases.DEPTHS)}) AS kind, unnest({[float(x) for x in cases.DEPTHS.values()]}) AS depth)"


def _draw_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)}, '7')), 1, 8) AS BIGINT)"


_CASES_SQL = f"""{PANEL_SQL}, {_of_year(_LOYO_SQL, "panel")},
  k0 AS (SELECT entity AS field, date, expected, scale, level, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY entity) AS n FROM loyo WHERE expected IS NOT NULL),
  k1 AS (SELECT *, least(n, 6 + {_draw_sql("field", "kind", "'length'")} % 12) AS size FROM k0, {_DEPTH_SQL}),
  k2 AS (SELECT *, {_draw_sql("field", "kind", "'start'")} % (n - size + 1) AS a FROM k1),
  k3 AS (SELECT *, place >= a AND place < a + size AS inside FROM k2),
  k4 AS (SELECT field || ':' || kind AS entity, kind, date, expected, scale, level, inside AND kind LIKE '%pulse' AS pulse, kind = 'source_switch' AND place >= a AS moved, kind = 'wide_uncertainty' AND inside AS unsure,
      expected + scale * 0.2 * (2 * CAST({_draw_sql("field", "kind", "CAST(date AS VARCHAR)")} AS DOUBLE) / 4294967296 - 1) - CASE WHEN (kind <> 'single_outlier' AND inside) OR (kind = 'single_outlier' AND place = a) THEN depth * scale ELSE 0 END AS v FROM k3),
  k5 AS (SELECT *, v - expected AS r, (v - expected) / CASE WHEN unsure THEN scale * sqrt(101) ELSE scale END AS z, coalesce(moved <> lag(moved) OVER (PARTITION BY entity ORDER BY date), false) AS sw FROM k4),
  k6 AS (SELECT *, CASE level WHEN 'polygon' THEN 1.0 WHEN 'crop' THEN 0.85 ELSE 0.5 END * CASE WHEN unsure THEN 0.5 / sqrt(101) ELSE 1 END * CASE WHEN sw AND NOT pulse THEN 0.6 ELSE 1.0 END AS conf, z < -1 AS c FROM k5),
  k7 AS (SELECT *, CASE WHEN c AND (NOT coalesce(lag(c) OVER w, false) OR date - lag(date) OVER w > 10) THEN 1 ELSE 0 END AS b FROM k6 WINDOW w AS (PARTITION BY entity ORDER BY date)),
  k8 AS (SELECT * FROM (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY date) AS i FROM k7) WHERE c),
  kev AS (SELECT entity, min(date) AS s, max(date) AS e, count(*) AS n, count(*) FILTER (NOT unsure) AS seen, quantile_cont(z, 0.5) AS zm, avg(conf) * least(1.0, count(*) / 3) AS conf FROM k8 GROUP BY entity, i HAVING count(*) >= 2 AND max(date) - min(date) + 1 >= 3),
  truth AS (SELECT entity, min(date) AS s, max(date) AS e FROM k6 WHERE pulse GROUP BY entity),
  kj AS (SELECT v.entity, CASE WHEN v.zm < -2 AND v.seen >= 2 AND v.e - v.s + 1 >= 7 AND v.conf >= 0.55 THEN 1 ELSE 0 END AS critical, CASE WHEN t.s IS NULL OR v.e < t.s OR v.s > t.e THEN 1 ELSE 0 END AS outside,
      greatest(0, least(v.e, t.e) - greatest(v.s, t.s) + 1) AS both_days, (v.e - v.s + 1) + (t.e - t.s + 1) AS sum_days FROM kev v LEFT JOIN truth t ON t.entity = v.entity),
  ke AS (SELECT entity, count(*) AS events, sum(critical) AS critical, sum(outside) AS outside, max(both_days / (sum_days - both_days)) AS iou FROM kj GROUP BY entity),
  ks AS (SELECT k.entity, k.date - t.s AS delay FROM k6 k JOIN truth t ON t.entity = k.entity WHERE k.pulse AND k.c QUALIFY row_number() OVER (PARTITION BY k.entity ORDER BY k.date) = 2),
  verdict AS (SELECT a.entity, a.kind, a.pulse AS expects_event, coalesce(ke.events, 0) AS events, CAST(coalesce(ke.critical, 0) AS BIGINT) AS critical, CAST(coalesce(ke.outside, 0) AS BIGINT) AS outside, CASE WHEN a.pulse THEN coalesce(ke.iou, 0.0) END AS iou, CAST(ks.delay AS INT) AS support_delay_days
    FROM (SELECT entity, min(kind) AS kind, bool_or(pulse) AS pulse FROM k6 GROUP BY entity) a LEFT JOIN ke ON ke.entity = a.entity LEFT JOIN ks ON ks.entity = a.entity)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, year = _panel(spark, sf_dir), F.year("date")
    rows = season.leave_one_year_out(panel.where(year == YEAR), panel.where(year < YEAR), "target")
    return cases.judged(staged(cases.synthetic(rows), "cases"))


@query(f"WITH {_CASES_SQL} SELECT entity, kind, expects_event, events, critical, outside, {r6('iou')}, support_delay_days FROM verdict")
def synthetic_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven cases on each entity's expected year: what the detector finds of what was put in."""
    return rounded(_verdicts(spark, sf_dir), "iou")


@query(f"WITH {_CASES_SQL} SELECT kind, count(*) AS cases, count(*) FILTER (events > 0) AS with_events, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(outside) AS BIGINT) AS outside, {r6('avg(iou) AS iou', 'avg(support_delay_days) AS support_delay_days')} FROM verdict GROUP BY kind")
def synthetic_case_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cases.by_kind(_verdicts(spark, sf_dir)), "iou", "support_delay_days")


_AUDIT_SQL = f"""{PANEL_SQL}, past AS (SELECT * FROM panel WHERE y < {YEAR}), {_IQR_SQL.replace("FROM panel", "FROM past")},
  hz AS (SELECT p.entity, p.category, p.date, p.y, m.slope * p.target + m."offset" AS target FROM (SELECT *, CASE WHEN s2 IS NOT NULL THEN 's2' WHEN landsat IS NOT NULL THEN 'landsat' ELSE 'modis' END AS source FROM panel WHERE target IS NOT NULL) p JOIN maps m ON m.source = p.source),
  {_of_year(_EVENTS_SQL, "hz").replace("THEN true ELSE false END AS multi", "THEN false ELSE false END AS multi")}"""


@query(f"""WITH {_AUDIT_SQL}, x AS (SELECT entity, count(*) AS events, count(*) FILTER (zm < -2 AND dur >= 7 AND conf >= 0.55) AS critical, count(*) FILTER (sw OR conf < 0.7) AS risky_events, max(area * conf) AS score, max(conf) AS max_confidence FROM ev GROUP BY entity),
  s AS (SELECT entity, n, coalesce(events, 0) AS events, coalesce(critical, 0) AS critical, coalesce(risky_events, 0) AS risky_events, round(coalesce(score, 0), 9) AS score, max_confidence FROM (SELECT entity, count(*) AS n FROM panel WHERE y = {YEAR} GROUP BY entity) LEFT JOIN x USING (entity)),
  a AS (SELECT entity, row_number() OVER (ORDER BY score DESC, entity) AS place, events FROM s), b AS (SELECT * FROM a WHERE place <= 3 AND events > 0),
  d AS (SELECT entity, row_number() OVER (ORDER BY risky_events DESC, score DESC, entity) AS place FROM s WHERE entity NOT IN (SELECT entity FROM b)),
  looked AS (SELECT entity, 'strong_candidate' AS review_group, place FROM b UNION ALL SELECT entity, 'questionable_control', place FROM d WHERE place <= 3)
  SELECT s.entity, n AS rows, n AS observed, CAST(0 AS BIGINT) AS unsupported, events, critical, risky_events, {r6("score AS max_score", "max_confidence")}, review_group, CAST(k.place AS INT) AS place FROM s LEFT JOIN looked k ON k.entity = s.entity""")
def year_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year against the years before it: sensor maps, climatology, events, and what to look at."""
    points = cases.audit_points(_panel(spark, sf_dir), YEAR, cases.affine)
    return rounded(cases.audit(points), "max_score", "max_confidence")


@query()
def year_audit_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with robust lines, pooled from all rows to the entity, which SQL cannot fit; tests hold it against the plain detector."""
    points = cases.audit_points(_panel(spark, sf_dir), YEAR)
    return rounded(cases.audit(points), "max_score", "max_confidence")


@query(f"""WITH {PANEL_SQL}, past AS (SELECT * FROM panel WHERE y < {YEAR}), {_IQR_SQL.replace("FROM panel", "FROM past")}, u AS (SELECT 'landsat' AS source, landsat AS a, s2 AS b FROM panel WHERE y = {YEAR} UNION ALL SELECT 'modis', modis, s2 FROM panel WHERE y = {YEAR}),
  e AS (SELECT u.source, a, b, slope * a + "offset" AS m FROM u JOIN maps USING (source) WHERE a IS NOT NULL AND b IS NOT NULL)
  SELECT source, count(*) AS n, {r6("avg(abs(a - b)) AS mae_raw", "sqrt(avg((a - b) ** 2)) AS rmse_raw", "quantile_cont(a - b, 0.5) AS median_bias_raw", "avg(abs(m - b)) AS mae_harmonized", "sqrt(avg((m - b) ** 2)) AS rmse_harmonized", "quantile_cont(m - b, 0.5) AS median_bias_harmonized")} FROM e GROUP BY source""")
def year_audit_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the maps of earlier years bring the year's other sensors to the reference."""
    panel, year = _panel(spark, sf_dir), F.year("date")
    out = harmonize.alignment(panel.where(year == YEAR), harmonize.iqr_affine(panel.where(year < YEAR)), P.SPEC)
    return rounded(out, *[c for c in out.columns if c not in ("source", "n")])
