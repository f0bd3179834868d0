"""Queries over the star-schema tables: one or more for each operator family, with DuckDB SQL beside each.

Derived doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import scalar
from lacuna.operators import anomaly, asof, donors, evaluate, harmonize, hygiene, mask, neighbors, reconstruct, season, windows
from lacuna.sources import panel as P
from lacuna.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PANEL_SQL = """
  li AS (SELECT n_name AS entity, r_name AS category, CAST(l_shipdate AS DATE) AS date, l_returnflag AS f, CAST(l_discount AS DECIMAL(16, 4)) AS d
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  wide AS (SELECT entity, date, category,
      CAST(sum(d) FILTER (f = 'A') AS DOUBLE) / nullif(count(*) FILTER (f = 'A'), 0) * 10 AS s2,
      CAST(sum(d) FILTER (f = 'N') AS DOUBLE) / nullif(count(*) FILTER (f = 'N'), 0) * 10 AS landsat,
      CAST(sum(d) FILTER (f = 'R') AS DOUBLE) / nullif(count(*) FILTER (f = 'R'), 0) * 10 AS modis
    FROM li GROUP BY entity, date, category),
  panel AS (SELECT *, coalesce(s2, landsat, modis) AS target, CAST(date - DATE '1970-01-01' AS BIGINT) AS day, year(date) AS y, dayofyear(date) AS doy FROM wide),
  drawn AS (SELECT *, target IS NOT NULL AND substr(md5(concat_ws('|', entity, CAST(date AS VARCHAR), '17')), 1, 2) < '26' AS hidden FROM panel),
  masked AS (SELECT entity, date, category, day, y, doy, hidden, target AS truth, CASE WHEN NOT hidden THEN target END AS target,
      CASE WHEN NOT hidden THEN s2 END AS s2, CASE WHEN NOT hidden THEN landsat END AS landsat, CASE WHEN NOT hidden THEN modis END AS modis FROM drawn),
  weather AS (SELECT n_name AS entity, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(16, 2))) AS DOUBLE) / count(*) / 10000 AS temp, CAST(count(*) AS DOUBLE) AS precip
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
"""
#: Hidden rows with neighbours and priors: what every baseline starts from.
CONTEXT_SQL = f"""{PANEL_SQL},
  near AS (SELECT *, last_value(CASE WHEN target IS NOT NULL THEN day END IGNORE NULLS) OVER b AS ld, last_value(target IGNORE NULLS) OVER b AS lv,
      first_value(CASE WHEN target IS NOT NULL THEN day END IGNORE NULLS) OVER a AS rd, first_value(target IGNORE NULLS) OVER a AS rv
    FROM masked WINDOW b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  fit AS (SELECT *, CAST((doy - 1) // 15 AS INT) AS season FROM masked WHERE target IS NOT NULL),
  p1 AS (SELECT entity, category, season, quantile_cont(target, 0.5) AS m FROM fit GROUP BY ALL),
  p2 AS (SELECT entity, category, quantile_cont(target, 0.5) AS m FROM fit GROUP BY ALL),
  p3 AS (SELECT category, season, quantile_cont(target, 0.5) AS m FROM fit GROUP BY ALL),
  p4 AS (SELECT category, quantile_cont(target, 0.5) AS m FROM fit GROUP BY ALL),
  p5 AS (SELECT season, quantile_cont(target, 0.5) AS m FROM fit GROUP BY ALL),
  p6 AS (SELECT quantile_cont(target, 0.5) AS m FROM fit),
  ctx AS (SELECT n.*, n.day - n.ld AS left_days, n.rd - n.day AS right_days,
      coalesce((lv * (rd - n.day) + rv * (n.day - ld)) / (rd - ld), lv, rv) AS linear,
      coalesce(p1.m, p2.m, p3.m, p4.m, p5.m, p6.m, 0.5) AS prior, coalesce(p3.m, p4.m, p5.m, p6.m, 0.5) AS crop_prior,
      CASE WHEN p1.m IS NOT NULL THEN 'polygon_crop_season' WHEN p2.m IS NOT NULL THEN 'polygon_crop' WHEN p3.m IS NOT NULL THEN 'crop_season' WHEN p4.m IS NOT NULL THEN 'crop'
        WHEN p5.m IS NOT NULL THEN 'global_season' WHEN p6.m IS NOT NULL THEN 'global_median' ELSE 'unfitted_default' END AS prior_level
    FROM (SELECT *, CAST((doy - 1) // 15 AS INT) AS season FROM near WHERE hidden) n LEFT JOIN p1 USING (entity, category, season) LEFT JOIN p2 USING (entity, category)
      LEFT JOIN p3 USING (category, season) LEFT JOIN p4 USING (category) LEFT JOIN p5 USING (season) CROSS JOIN p6),
  preds AS (SELECT *,
      CASE WHEN (lv IS NULL) <> (rv IS NULL) THEN (coalesce(lv, rv) + prior) / 2 ELSE coalesce(lv, prior) END AS pred_nearest_left,
      CASE WHEN (lv IS NULL) <> (rv IS NULL) THEN (coalesce(lv, rv) + prior) / 2 ELSE coalesce(rv, prior) END AS pred_nearest_right,
      CASE WHEN (lv IS NULL) <> (rv IS NULL) THEN (coalesce(lv, rv) + prior) / 2 ELSE coalesce((lv + rv) / 2, prior) END AS pred_mean_neighbors,
      CASE WHEN (lv IS NULL) <> (rv IS NULL) THEN (coalesce(lv, rv) + prior) / 2 ELSE coalesce(linear, prior) END AS pred_linear,
      crop_prior AS pred_seasonal_crop,
      CASE WHEN s2_ IS NOT NULL THEN 's2' WHEN l_ IS NOT NULL THEN 'landsat' ELSE 'modis' END AS source,
      CASE WHEN left_days IS NULL THEN 'none' WHEN left_days <= 7 THEN '0-7' WHEN left_days <= 15 THEN '8-15' WHEN left_days <= 30 THEN '16-30' ELSE '31+' END AS left_bin
    FROM ctx JOIN (SELECT entity, date, s2 AS s2_, landsat AS l_ FROM panel) USING (entity, date))
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six places. 1e-9 decides ties the same way on both sides; adding 0.0 makes a negative zero plain."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) + F.lit(0.0) for c in columns})


def r6(*columns: str) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]} + 1e-9, 6) + 0.0 AS {c.split(' AS ')[-1]}" for c in columns)


def _panel(spark: SparkSession, sf_dir: str, weather: bool = False) -> DataFrame:
    """The panel written once, for queries whose branches would each derive it anew from the tables."""
    return staged(P.nation_day(spark, sf_dir, weather), "panel")


def _masked(spark: SparkSession, sf_dir: str, weather: bool = False) -> DataFrame:
    return P.masked(P.hash_gaps(_panel(spark, sf_dir, weather)))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden rows with pred_* of five methods, their true source and distance bin."""
    panel = P.hash_gaps(_panel(spark, sf_dir))
    source = F.when(F.col("s2").isNotNull(), "s2").when(F.col("landsat").isNotNull(), "landsat").otherwise("modis")
    rows = reconstruct.all_baselines(reconstruct.context(P.masked(panel.withColumn("source", source))))
    return rows.withColumn("left_bin", scalar.distance_bin(F.col("left_days")))


# --- profiles and sets -------------------------------------------------------------------------------------


@query(f"WITH {PANEL_SQL} SELECT count(*) AS rows, count(DISTINCT entity) AS entities, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date, count(target) AS observed FROM panel")
def panel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.profile(P.nation_day(spark, sf_dir))


@query(f"""WITH {PANEL_SQL}, j AS (SELECT * FROM panel LEFT JOIN weather USING (entity, date)),
  u AS (SELECT unnest(['target', 's2', 'landsat', 'modis', 'temp', 'precip']) AS "column", unnest([count(*) - count(target), count(*) - count(s2), count(*) - count(landsat), count(*) - count(modis), count(*) - count(temp), count(*) - count(precip)]) AS n_missing, count(*) AS n FROM j)
  SELECT "column", n_missing, CAST(0 AS BIGINT) AS n_infinite, {r6("n_missing / n AS missing_rate")} FROM u""")
def panel_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hygiene.missingness(P.nation_day(spark, sf_dir, True), P.SPEC.dynamic), "missing_rate")


@query(f"WITH {PANEL_SQL} SELECT entity, count(target) AS n_observed, min(date) FILTER (target IS NOT NULL) AS first_date, max(date) FILTER (target IS NOT NULL) AS last_date, min_by(category, date) AS category FROM panel GROUP BY entity")
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.entity_profile(P.nation_day(spark, sf_dir))


@query(f"WITH {PANEL_SQL} SELECT entity, date, category, {r6('s2', 'landsat', 'modis', 'target')} FROM panel WHERE entity = 'NATION_3' AND date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'")
def series_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hygiene.load_series(P.nation_day(spark, sf_dir), "NATION_3", "1996-03-01", "1997-02-28"), "s2", "landsat", "modis", "target")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
  SELECT 'known' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'unseen', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
  UNION ALL SELECT 'distinct', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.read(spark, sf_dir, "events")
    a, b = (events.where(F.col("event_type") == kind).select("user_id").distinct() for kind in ("purchase", "error"))
    parts = {"known": a.intersect(b), "unseen": b.subtract(a), "distinct": a.union(b).distinct()}
    known, unseen, every = (x.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, x in parts.items())
    return known.unionAll(unseen).unionAll(every)


@query(f"""WITH {PANEL_SQL}, g AS (SELECT entity, date, date - CAST(row_number() OVER (PARTITION BY entity ORDER BY date) AS INT) AS i FROM drawn WHERE hidden),
  runs AS (SELECT entity, i, count(*) AS length FROM g GROUP BY entity, i)
  SELECT CASE WHEN length >= 4 THEN '4+' ELSE CAST(length AS VARCHAR) END AS bucket, count(*) AS runs, CAST(sum(length) AS BIGINT) AS rows FROM runs GROUP BY 1""")
def gap_runs_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.gap_histogram(P.hash_gaps(P.nation_day(spark, sf_dir)).where("hidden"))


@query("""SELECT unnest(['s2', 'landsat', 'modis', 'temp']) AS "column" """)
def always_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without any value on users' days that only have signups."""
    rows = P.user_day(spark, sf_dir).where("target is null and temp is null")
    return hygiene.always_missing(rows, ["s2", "landsat", "modis", "temp", "precip"])


@query("SELECT 'duplicate_key' AS rule, CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS n FROM lineitem")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("entity"), F.col("l_linenumber").alias("date"), F.col("l_returnflag").alias("category"))
    return hygiene.violations(rows)


@query(f"WITH {PANEL_SQL} SELECT count(*) AS checked, count(*) AS matching, 1.0::DOUBLE AS rate, 0.0::DOUBLE AS max_diff FROM panel WHERE target IS NOT NULL")
def hierarchy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.hierarchy_check(P.nation_day(spark, sf_dir))


@query(f"""WITH {PANEL_SQL} SELECT CASE WHEN abs(s2 - t) <= 1e-7 THEN 's2' WHEN abs(landsat - t) <= 1e-7 THEN 'landsat' WHEN abs(modis - t) <= 1e-7 THEN 'modis' ELSE 'unknown' END AS label,
  CASE WHEN s2 IS NOT NULL THEN 0 WHEN landsat IS NOT NULL THEN 1 WHEN modis IS NOT NULL THEN 2 ELSE -1 END AS first, count(*) AS n
  FROM (SELECT *, greatest(coalesce(s2, -1), coalesce(landsat, -1), coalesce(modis, -1)) AS t FROM panel) GROUP BY 1, 2""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sensor a day's largest value comes from, beside the first sensor that has one."""
    rows = P.nation_day(spark, sf_dir).withColumn("t", F.greatest("s2", "landsat", "modis"))
    label = scalar.source_label(F.col("t"), {s: F.col(s) for s in P.SPEC.sensors})
    return rows.groupBy(label.alias("label"), scalar.first_source([F.col(s) for s in P.SPEC.sensors]).alias("first")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PANEL_SQL} SELECT count(*) FILTER (s2 * 3 > 1 OR s2 * 3 < -1) AS bad_ndvi, count(*) FILTER (s2 * 3 > 2 OR s2 * 3 < -1) AS bad_evi, count(s2) - count(*) FILTER (s2 * 3 > 1 OR s2 * 3 < -1) AS kept FROM panel""")
def invalid_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("s2") * 3
    return P.nation_day(spark, sf_dir).agg(F.count(F.when(scalar.out_of_range(x, "ndvi"), 1)).alias("bad_ndvi"), F.count(F.when(scalar.out_of_range(x, "evi"), 1)).alias("bad_evi"), F.count(scalar.cleaned(x, "ndvi")).alias("kept"))


# --- masks -------------------------------------------------------------------------------------------------


@query(f"WITH {PANEL_SQL} SELECT entity, count(*) FILTER (hidden) AS gaps, count(target) AS visible, {r6('sum(target) AS total')} FROM masked GROUP BY entity")
def apply_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    out = mask.apply_mask(panel, P.hash_gaps(panel).where("hidden"), ["target", "s2", "landsat", "modis"])
    return rounded(out.groupBy("entity").agg(F.count(F.when(F.col("is_gap"), 1)).alias("gaps"), F.count("target").alias("visible"), F.sum("target").alias("total")), "total")


@query(f"WITH {PANEL_SQL} SELECT entity, date FROM drawn WHERE hidden AND (s2 IS NOT NULL OR modis IS NOT NULL)")
def censored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = P.hash_gaps(_panel(spark, sf_dir))
    return mask.censored(panel, P.masked(panel), ["s2", "modis"])


@query(f"""WITH {PANEL_SQL}, a AS (SELECT * FROM panel WHERE y < 2000), b AS (SELECT * FROM panel WHERE y > 1995),
  f AS (SELECT a.entity AS x, b.entity AS y2, a.target AS t, b.target + CASE WHEN doy = 40 THEN 1 ELSE 0 END AS u FROM a FULL JOIN (SELECT entity, date, target, doy FROM b) b USING (entity, date))
  SELECT count(*) FILTER (y2 IS NULL) AS only_left, count(*) FILTER (x IS NULL) AS only_right, CAST(0 AS BIGINT) AS repeated, count(*) FILTER (abs(t - u) > 1e-12) AS differing FROM f""".replace("CASE WHEN doy = 40", "CASE WHEN b.doy = 40"))
def key_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    shifted = panel.where(F.year("date") > 1995).withColumn("target", F.col("target") + F.when(F.dayofyear("date") == 40, 1).otherwise(0))
    return mask.key_differences(panel.where(F.year("date") < 2000), shifted, "target")


# --- as-of -------------------------------------------------------------------------------------------------


@query(f"""WITH {PANEL_SQL}, v AS (SELECT entity, day, target FROM masked WHERE target IS NOT NULL),
  q AS (SELECT entity, date, day FROM masked WHERE hidden),
  b AS (SELECT q.entity, q.date, q.day - v.day AS d, v.target AS t, row_number() OVER (PARTITION BY q.entity, q.date ORDER BY v.day DESC) AS k FROM q JOIN v ON v.entity = q.entity AND v.day < q.day),
  a AS (SELECT q.entity, q.date, v.day - q.day AS d, v.target AS t, row_number() OVER (PARTITION BY q.entity, q.date ORDER BY v.day) AS k FROM q JOIN v ON v.entity = q.entity AND v.day > q.day)
  SELECT 'left' AS side, CAST(k AS INT) AS k, count(*) AS n, CAST(sum(d) AS BIGINT) AS days, {r6("sum(t) AS total")} FROM b WHERE k <= 4 GROUP BY k UNION ALL
  SELECT 'right', CAST(k AS INT), count(*), CAST(sum(d) AS BIGINT), {r6("sum(t) AS total")} FROM a WHERE k <= 4 GROUP BY k""")
def asof_neighbors_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof.neighbors(_masked(spark, sf_dir), "target").where("hidden")
    day = F.unix_date("date")
    sides = [rows.select(F.lit(s).alias("side"), F.posexplode(s).alias("k", "x"), day.alias("day")) for s in ("left", "right")]
    flat = sides[0].unionAll(sides[1])
    return rounded(flat.groupBy("side", (F.col("k") + 1).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("day") - F.col("x.day")).cast("bigint")).alias("days"), F.sum("x.v").alias("total")), "total")


@query(f"""WITH {PANEL_SQL}, v AS (SELECT entity, y, day, target FROM masked WHERE target IS NOT NULL), q AS (SELECT entity, y, date, day FROM masked WHERE hidden),
  n AS (SELECT entity, date, lv, rv, q.day - ld AS dl, rd - q.day AS dr FROM q
    LEFT JOIN LATERAL (SELECT max(day) AS ld, max_by(target, day) AS lv FROM v WHERE v.entity = q.entity AND v.y = q.y AND v.day < q.day) ON true
    LEFT JOIN LATERAL (SELECT min(day) AS rd, min_by(target, day) AS rv FROM v WHERE v.entity = q.entity AND v.y = q.y AND v.day > q.day) ON true)
  SELECT entity, date, {r6("coalesce((lv + rv) / 2, lv, rv) AS midpoint", "coalesce(lv + (rv - lv) * dl / (dl + dr), lv, rv) AS linear", "CASE WHEN rv IS NULL OR dl <= dr THEN lv ELSE rv END AS nearest", "(rv - lv) / (dl + dr) AS slope")}, CAST(dl + dr AS INT) AS span FROM n""")
def asof_same_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof.nearest(_masked(spark, sf_dir).withColumn("year", F.year("date")), "target", by=["year"]).where("hidden")
    lv, rv, dl, dr = (F.col(c) for c in ("left_value", "right_value", "left_days", "right_days"))
    out = rows.select("entity", "date", F.coalesce((lv + rv) / 2, lv, rv).alias("midpoint"), F.coalesce(lv + (rv - lv) * dl / (dl + dr), lv, rv).alias("linear"), F.when(rv.isNull() | (dl <= dr), lv).otherwise(rv).alias("nearest"), ((rv - lv) / (dl + dr)).alias("slope"), (dl + dr).alias("span"))
    return rounded(out, "midpoint", "linear", "nearest", "slope")


@query(f"WITH {CONTEXT_SQL} SELECT left_bin, CASE WHEN right_days IS NULL THEN 'none' WHEN right_days <= 7 THEN '0-7' WHEN right_days <= 15 THEN '8-15' WHEN right_days <= 30 THEN '16-30' ELSE '31+' END AS right_bin, count(*) AS n FROM preds GROUP BY 1, 2")
def neighbor_distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof.nearest(_masked(spark, sf_dir), "target").where("hidden")
    return rows.groupBy(scalar.distance_bin(F.col("left_days")).alias("left_bin"), scalar.distance_bin(F.col("right_days")).alias("right_bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PANEL_SQL}, s AS (SELECT entity, date, y, hidden, count(*) FILTER (NOT hidden) OVER (PARTITION BY entity, y ORDER BY date) AS run FROM masked WHERE hidden OR target IS NOT NULL)
  SELECT entity, date, count(*) OVER (PARTITION BY entity, y, run) AS gap_length, row_number() OVER (PARTITION BY entity, y, run ORDER BY date) AS gap_position FROM s WHERE hidden""")
def gap_run_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.gap_runs(_masked(spark, sf_dir)).select("entity", "date", "gap_length", "gap_position")


@query(f"""WITH {PANEL_SQL}, v AS (SELECT entity, day, target AS t FROM masked WHERE target IS NOT NULL),
  q AS (SELECT entity, date, day FROM masked WHERE hidden AND entity < 'NATION_13'),
  l AS (SELECT q.entity, q.date, q.day, v.day AS d, v.t, row_number() OVER (PARTITION BY q.entity, q.date ORDER BY v.day DESC) AS k FROM q JOIN v ON v.entity = q.entity AND v.day < q.day),
  r AS (SELECT q.entity, q.date, q.day, v.day AS d, v.t, row_number() OVER (PARTITION BY q.entity, q.date ORDER BY v.day) AS k FROM q JOIN v ON v.entity = q.entity AND v.day > q.day),
  b AS (SELECT *, 1 AS s FROM l WHERE k <= 4 UNION ALL SELECT *, 2 FROM r WHERE k <= 4),
  g AS (SELECT entity, date, quantile_cont(t, 0.5) AS local_level, quantile_cont(t, 0.75) - quantile_cont(t, 0.25) AS local_iqr,
    max(t) FILTER (s = 1 AND k = 1) AS l1, max(d) FILTER (s = 1 AND k = 1) AS e1, max(t) FILTER (s = 1 AND k = 2) AS l2, max(d) FILTER (s = 1 AND k = 2) AS e2,
    max(t) FILTER (s = 2 AND k = 1) AS r1, max(d) FILTER (s = 2 AND k = 1) AS f1, max(t) FILTER (s = 2 AND k = 2) AS r2, max(d) FILTER (s = 2 AND k = 2) AS f2, max(day) AS day FROM b GROUP BY entity, date)
  SELECT entity, date, {r6("local_level", "local_iqr", "(r1 - l1) / (f1 - e1) AS local_slope", "(r2 - r1) / (f2 - f1) - (l1 - l2) / (e1 - e2) AS local_curvature", "((CASE WHEN l1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN r1 IS NULL THEN 0 ELSE 1 END)) / 2 / (1 + least(day - e1, f1 - day) / 15) AS context_quality")},
    CASE WHEN l1 IS NULL OR r1 IS NULL THEN 1 ELSE 0 END AS is_edge FROM g""")
def local_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof.local_shape(asof.neighbors(_masked(spark, sf_dir), "target").where("hidden and entity < 'NATION_13'"))
    out = rows.select("entity", "date", "local_level", "local_iqr", "local_slope", "local_curvature", "context_quality", "is_edge")
    return rounded(out, "local_level", "local_iqr", "local_slope", "local_curvature", "context_quality")


# --- range and same date -----------------------------------------------------------------------------------


@query(f"""WITH {PANEL_SQL}, s AS (SELECT q.entity, q.date, count(v.target) FILTER (abs(v.day - q.day) <= 7) AS count_7d, count(v.target) FILTER (abs(v.day - q.day) <= 15) AS count_15d, count(v.target) AS count_30d,
    quantile_cont(v.target, 0.5) AS median, quantile_cont(v.target, 0.75) - quantile_cont(v.target, 0.25) AS iqr
  FROM (SELECT * FROM masked WHERE hidden) q LEFT JOIN masked v ON v.entity = q.entity AND v.day BETWEEN q.day - 30 AND q.day + 30 AND v.day <> q.day GROUP BY q.entity, q.date)
  SELECT entity, date, count_7d, count_15d, count_30d, {r6("median", "iqr", "count_15d / 30 AS density_15d")} FROM s""")
def range_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbors.range_stats(neighbors.range_counts(_masked(spark, sf_dir), "target"), "target", "ndvi").where("hidden")
    return rounded(rows.select("entity", "date", "count_7d", "count_15d", "count_30d", "median", "iqr", "density_15d"), "median", "iqr", "density_15d")


@query(f"""WITH {PANEL_SQL}, s AS (SELECT q.entity, q.date, count(v.target) AS n, quantile_cont(v.target, 0.5) AS median, quantile_cont(v.target, 0.75) - quantile_cont(v.target, 0.25) AS iqr
  FROM (SELECT * FROM masked WHERE hidden) q LEFT JOIN masked v ON v.date = q.date AND v.entity <> q.entity GROUP BY q.entity, q.date)
  SELECT entity, date, n AS same_count, {r6("median AS same_median", "iqr AS same_iqr")} FROM s""")
def same_date_excl_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _masked(spark, sf_dir)
    out = neighbors.same_date_others(panel.where("hidden"), panel, "target", "same_")
    return rounded(out.select("entity", "date", "same_median", "same_iqr", "same_count"), "same_median", "same_iqr")


@query(f"""WITH {PANEL_SQL}, a AS (SELECT date, avg(target) AS m, stddev_samp(target) AS s, count(target) AS n, quantile_cont(target, 0.5) AS q FROM masked WHERE target IS NOT NULL GROUP BY date),
  c AS (SELECT date, category, avg(target) AS m, stddev_samp(target) AS s, count(target) AS n, quantile_cont(target, 0.5) AS q FROM masked WHERE target IS NOT NULL GROUP BY date, category)
  SELECT entity, date, {r6("a.m AS date_all_mean", "a.s AS date_all_std", "a.q AS date_all_median", "c.m AS date_crop_mean", "c.s AS date_crop_std", "c.q AS date_crop_median")}, a.n AS date_all_count, c.n AS date_crop_count
  FROM (SELECT * FROM masked WHERE hidden) LEFT JOIN a USING (date) LEFT JOIN c USING (date, category)""")
def same_date_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _masked(spark, sf_dir)
    out = neighbors.same_date(panel.where("hidden"), panel, "target")
    names = [f"date_{x}_{s}" for x in ("all", "crop") for s in ("mean", "std", "median")]
    return rounded(out.select("entity", "date", *names, "date_all_count", "date_crop_count"), *names)


@query(f"""WITH {PANEL_SQL}, l AS (SELECT *, CASE WHEN s2 IS NOT NULL THEN 's2' WHEN landsat IS NOT NULL THEN 'landsat' WHEN modis IS NOT NULL THEN 'modis' ELSE 'unknown' END AS source FROM masked),
  f AS (SELECT count(*) FILTER (source = 's2') / count(*) AS a, count(*) FILTER (source = 'landsat') / count(*) AS b, count(*) FILTER (source = 'modis') / count(*) AS c FROM l WHERE target IS NOT NULL),
  n AS (SELECT q.entity, q.date, count(*) FILTER (v.source = 's2') AS a, count(*) FILTER (v.source = 'landsat') AS b, count(*) FILTER (v.source = 'modis') AS c
    FROM l q LEFT JOIN l v ON v.entity = q.entity AND v.day BETWEEN q.day - 30 AND q.day + 30 AND v.target IS NOT NULL WHERE q.hidden GROUP BY q.entity, q.date),
  d AS (SELECT date, count(*) FILTER (source = 's2') AS a, count(*) FILTER (source = 'landsat') AS b, count(*) FILTER (source = 'modis') AS c FROM l WHERE target IS NOT NULL GROUP BY date),
  w AS (SELECT n.entity, n.date, n.a + coalesce(d.a, 0) + f.a + 0.25 AS a, n.b + coalesce(d.b, 0) + f.b + 0.25 AS b, n.c + coalesce(d.c, 0) + f.c + 0.25 AS c FROM n LEFT JOIN d ON n.date = d.date CROSS JOIN f)
  SELECT entity, date, {r6("a / (a + b + c + 0.25) AS p_s2", "b / (a + b + c + 0.25) AS p_landsat", "c / (a + b + c + 0.25) AS p_modis", "0.25 / (a + b + c + 0.25) AS p_unknown", "greatest(a, b, c) / (a + b + c + 0.25) AS source_confidence")} FROM w""")
def source_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _masked(spark, sf_dir)
    panel = panel.withColumn("source", scalar.source_label(F.col("target"), {s: F.col(s) for s in P.SPEC.sensors}))
    out = neighbors.source_probabilities(panel.where("hidden"), panel, panel.where("target is not null").select("source"))
    return rounded(out, "p_s2", "p_landsat", "p_modis", "p_unknown", "source_confidence")


@query(f"""WITH {PANEL_SQL}, j AS (SELECT m.*, CASE WHEN NOT hidden THEN temp END AS temp FROM masked m LEFT JOIN weather USING (entity, date)),
  near AS (SELECT entity, date, day, hidden, last_value(CASE WHEN temp IS NOT NULL THEN day END IGNORE NULLS) OVER b AS ld, last_value(temp IGNORE NULLS) OVER b AS lv, first_value(CASE WHEN temp IS NOT NULL THEN day END IGNORE NULLS) OVER a AS rd, first_value(temp IGNORE NULLS) OVER a AS rv
    FROM j WINDOW b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  o AS (SELECT q.entity, q.date, quantile_cont(v.temp, 0.5) AS m, count(v.temp) AS n FROM (SELECT * FROM j WHERE hidden) q LEFT JOIN j v ON v.date = q.date AND v.entity <> q.entity GROUP BY q.entity, q.date)
  SELECT entity, date, n AS temp_same_date_count, {r6("coalesce(m, (lv * (rd - day) + rv * (day - ld)) / (rd - ld), lv, rv) AS temp_reconstructed")} FROM o JOIN near USING (entity, date)""")
def regional_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = asof.nearest(_masked(spark, sf_dir, True), "temp", prefix="t_")
    own = asof.linear(*[F.col(f"t_{c}") for c in ("left_value", "left_days", "right_value", "right_days")])
    out = neighbors.regional(panel.where("hidden"), panel, "temp", own)
    return rounded(out.select("entity", "date", "temp_same_date_count", "temp_reconstructed"), "temp_reconstructed")


# --- priors and baselines ----------------------------------------------------------------------------------


@query(f"""WITH {CONTEXT_SQL} SELECT CASE WHEN grouping(entity, category, season, y) = 1 THEN 'polygon_crop_season' WHEN grouping(entity, category, season, y) = 3 THEN 'polygon_crop' WHEN grouping(entity, category, season, y) = 9 THEN 'crop_season'
    WHEN grouping(entity, category, season, y) = 11 THEN 'crop' WHEN grouping(entity, category, season, y) = 13 THEN 'global_season' WHEN grouping(entity, category, season, y) = 2 THEN 'polygon_crop_year' WHEN grouping(entity, category, season, y) = 10 THEN 'crop_year' ELSE 'global' END AS level,
  entity, category, season, CAST(y AS INT) AS year, {r6("quantile_cont(target, 0.5) AS median", "quantile_cont(target, 0.75) - quantile_cont(target, 0.25) AS iqr")}, count(*) AS n
  FROM fit GROUP BY GROUPING SETS ((entity, category, season), (entity, category), (category, season), (category), (season), (entity, category, y), (category, y), ())""")
def robust_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.robust_priors(_masked(spark, sf_dir)), "median", "iqr")


@query(f"WITH {CONTEXT_SQL} SELECT entity, date, {r6('prior AS seasonal_prior', 'crop_prior AS crop_seasonal_prior')}, prior_level AS seasonal_prior_level FROM ctx")
def seasonal_prior_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _masked(spark, sf_dir)
    out = season.prior_lookup(panel.where("hidden"), season.robust_priors(panel))
    return rounded(out.select("entity", "date", "seasonal_prior", "crop_seasonal_prior", "seasonal_prior_level"), "seasonal_prior", "crop_seasonal_prior")


def _rec(method: str) -> None:
    @query(f"WITH {CONTEXT_SQL} SELECT entity, date, {r6(f'pred_{method} AS prediction')} FROM preds")
    def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = reconstruct.baseline(reconstruct.context(_masked(spark, sf_dir)), method)
        return rounded(out.select("entity", "date", "prediction"), "prediction")

    for registry in (QUERIES, ORACLES):
        registry[f"rec_{method}"] = registry.pop("rec")


for _method in reconstruct.METHODS[:5]:
    _rec(_method)


@query(f"""WITH {CONTEXT_SQL} SELECT source, count(*) AS n, {r6("sqrt(avg((pred_mean_neighbors - truth) ** 2)) AS rmse_mean_neighbors", "avg(abs(pred_mean_neighbors - truth)) AS mae_mean_neighbors", "sqrt(avg((pred_linear - truth) ** 2)) AS rmse_linear", "avg(abs(pred_linear - truth)) AS mae_linear")} FROM preds GROUP BY source""")
def reconstruction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: hides 15 % of observations, reconstructs them two ways, and reports errors by the source that was hidden."""
    rows, aggs = _predicted(spark, sf_dir), [F.count(F.lit(1)).alias("n")]
    for m in ("mean_neighbors", "linear"):
        _, rmse, mae = evaluate.errors("truth", f"pred_{m}")
        aggs += [rmse.alias(f"rmse_{m}"), mae.alias(f"mae_{m}")]
    return rounded(rows.groupBy("source").agg(*aggs), "rmse_mean_neighbors", "mae_mean_neighbors", "rmse_linear", "mae_linear")


_GAUSS_SQL = """yearly AS (SELECT q.entity, q.date, v.y, sum(exp(-0.5 * ((v.doy - q.doy) / 12.0) ** 2) * v.target) / sum(exp(-0.5 * ((v.doy - q.doy) / 12.0) ** 2)) AS m
    FROM (SELECT * FROM masked WHERE hidden) q JOIN masked v ON v.entity = q.entity AND v.y <> q.y AND abs(v.doy - q.doy) <= 30 AND v.target BETWEEN -1 AND 1 GROUP BY q.entity, q.date, v.y),
  clim AS (SELECT entity, date, avg(m) AS mean, stddev_pop(m) AS std, count(m) AS n FROM yearly GROUP BY entity, date)"""


@query(f"WITH {PANEL_SQL}, {_GAUSS_SQL} SELECT entity, date, {r6('mean AS clim_mean', 'std AS clim_std')}, n AS clim_n FROM (SELECT * FROM masked WHERE hidden) LEFT JOIN clim USING (entity, date)")
def seasonal_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _masked(spark, sf_dir)
    out = season.gaussian(panel.where("hidden"), panel, "target", "clim")
    return rounded(out.select("entity", "date", "clim_mean", "clim_std", "clim_n"), "clim_mean", "clim_std")


@query(f"""WITH {PANEL_SQL}, {_GAUSS_SQL}, v AS (SELECT entity, y, day, target FROM masked WHERE target IS NOT NULL)
  SELECT q.entity, q.date, {r6("coalesce((lv + rv) / 2, lv, rv, mean, 0.5) AS prediction")} FROM (SELECT * FROM masked WHERE hidden) q LEFT JOIN clim USING (entity, date)
    LEFT JOIN LATERAL (SELECT max_by(target, day) AS lv FROM v WHERE v.entity = q.entity AND v.y = q.y AND v.day < q.day) ON true
    LEFT JOIN LATERAL (SELECT min_by(target, day) AS rv FROM v WHERE v.entity = q.entity AND v.y = q.y AND v.day > q.day) ON true""")
def rec_midpoint_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = asof.nearest(_masked(spark, sf_dir).withColumn("year", F.year("date")), "target", by=["year"])
    rows = season.gaussian(panel.where("hidden"), panel, "target", "clim_primary")
    rows = rows.withColumn("primary_midpoint", F.coalesce((F.col("left_value") + F.col("right_value")) / 2, "left_value", "right_value"))
    return rounded(rows.select("entity", "date", reconstruct.midpoint_chain(rows).alias("prediction")), "prediction")


# --- climatology and anomalies -----------------------------------------------------------------------------

_BASE_SQL = """r AS (SELECT entity, category, y AS ry, doy AS rdoy, target AS v FROM panel WHERE target IS NOT NULL),
  pairs AS (SELECT q.entity, q.date, r.ry, r.v FROM panel q JOIN r ON r.entity = q.entity AND r.category = q.category AND r.ry < q.y AND least(abs(r.rdoy - q.doy), 366 - abs(r.rdoy - q.doy)) <= 15),
  med AS (SELECT entity, date, count(DISTINCT ry) AS years, CASE WHEN count(DISTINCT ry) >= 3 THEN quantile_cont(v, 0.5) END AS m FROM pairs GROUP BY entity, date),
  mads AS (SELECT entity, date, quantile_cont(abs(v - m), 0.5) AS mad FROM pairs JOIN med USING (entity, date) WHERE m IS NOT NULL GROUP BY entity, date),
  pts AS (SELECT p.entity, p.date, p.target, coalesce(years, 0) AS years, m, mad, target - m AS residual, (target - m) / greatest(1.4826 * mad, 0.01) AS z FROM panel p LEFT JOIN med USING (entity, date) LEFT JOIN mads USING (entity, date)),
  cand AS (SELECT *, coalesce(z <= {threshold} AND residual < 0, false) AS c FROM pts),
  brk AS (SELECT *, CASE WHEN NOT c OR NOT coalesce(lag(c) OVER w, false) OR date - lag(date) OVER w > 16 THEN 1 ELSE 0 END AS b FROM cand WINDOW w AS (PARTITION BY entity ORDER BY date)),
  isl AS (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY date) AS i FROM brk)"""


@query(f"WITH {PANEL_SQL}, {_BASE_SQL.format(threshold=-2)} SELECT entity, date, years AS n_reference_years, {r6('m AS climatology_median', 'mad AS climatology_mad', 'residual', 'z AS robust_z')}, c AS candidate FROM cand")
def anomaly_points_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.baseline_points(_panel(spark, sf_dir), "target")
    names = ["climatology_median", "climatology_mad", "residual", "robust_z"]
    return rounded(out.select("entity", "date", "n_reference_years", *names, "candidate"), *names)


@query(f"""WITH {PANEL_SQL}, {_BASE_SQL.format(threshold=-1)}, e AS (SELECT entity, i, min(date) AS s, max(date) AS e, count(*) AS n, avg(-residual) AS mag, min(z) AS mz FROM isl WHERE c GROUP BY entity, i HAVING count(*) >= 2)
  SELECT concat_ws(':', entity, CAST(s AS VARCHAR), CAST(e AS VARCHAR)) AS event_id, entity, s AS start_date, e AS end_date, n AS n_points, CAST(e - s + 1 AS BIGINT) AS duration_days, {r6("mag AS magnitude", "mz AS min_z", "mag * (e - s + 1) AS severity")} FROM e""")
def events_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.baseline_events(anomaly.baseline_points(_panel(spark, sf_dir), "target", threshold=-1.0))
    return rounded(out.select("event_id", "entity", "start_date", "end_date", "n_points", "duration_days", "magnitude", "min_z", "severity"), "magnitude", "min_z", "severity")


_DELIVERED_SQL = """obs AS (SELECT *, CASE WHEN s2 IS NOT NULL THEN 's2' WHEN landsat IS NOT NULL THEN 'landsat' ELSE 'modis' END AS source FROM panel WHERE target IS NOT NULL),
  ref AS (SELECT entity, y, doy, 's2' AS source, s2 AS v FROM panel UNION ALL SELECT entity, y, doy, 'landsat', landsat FROM panel UNION ALL SELECT entity, y, doy, 'modis', modis FROM panel),
  yr AS (SELECT q.entity, q.date, r.y, sum(exp(-0.5 * ((r.doy - q.doy) / 12.0) ** 2) * v) / sum(exp(-0.5 * ((r.doy - q.doy) / 12.0) ** 2)) AS m
    FROM obs q JOIN ref r ON r.entity = q.entity AND r.source = q.source AND r.y <> q.y AND abs(r.doy - q.doy) <= 30 AND v BETWEEN -1 AND 1 GROUP BY q.entity, q.date, r.y),
  cl AS (SELECT entity, date, avg(m) AS mu, stddev_pop(m) AS sd, count(m) AS n FROM yr GROUP BY entity, date),
  zs AS (SELECT o.entity, o.date, o.source, mu, sd, coalesce(n, 0) AS n, CASE WHEN target BETWEEN -1 AND 1 AND n >= 3 THEN (target - mu) / greatest(sd, 0.03) END AS z FROM obs o LEFT JOIN cl USING (entity, date))"""


@query(f"""WITH {PANEL_SQL}, {_DELIVERED_SQL} SELECT entity, date, source, {r6("mu AS reference_mean", "sd AS reference_std", "z AS z_score")}, CAST(n AS BIGINT) AS reference_years,
  CASE WHEN z IS NULL THEN 'insufficient_or_invalid' WHEN z < -2 THEN 'strong_negative_candidate' WHEN z < -1 THEN 'negative_candidate' ELSE 'usual' END AS status FROM zs""")
def anomaly_points_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.delivered_points(_panel(spark, sf_dir)).where("target is not null")
    return rounded(out.select("entity", "date", "source", "reference_mean", "reference_std", "z_score", F.col("reference_years").cast("bigint").alias("reference_years"), "status"), "reference_mean", "reference_std", "z_score")


@query(f"""WITH {PANEL_SQL}, {_DELIVERED_SQL}, c AS (SELECT *, coalesce(z < -1, false) AS c FROM zs),
  b AS (SELECT *, CASE WHEN NOT c OR NOT coalesce(lag(c) OVER w, false) OR coalesce(date - lag(date) OVER w, 999) > 16 THEN 1 ELSE 0 END AS b FROM c WINDOW w AS (PARTITION BY entity ORDER BY date)),
  i AS (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY date) AS i FROM b)
  SELECT entity, min(date) AS start_date, max(date) AS end_date, count(*) AS observed_points, CAST(max(date) - min(date) AS BIGINT) AS duration_days, {r6("min(z) AS min_z")} FROM i WHERE c GROUP BY entity, i HAVING count(*) >= 2 AND max(date) - min(date) >= 8""")
def events_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.delivered_events(anomaly.delivered_points(_panel(spark, sf_dir)))
    return rounded(out.select("entity", "start_date", "end_date", "observed_points", "duration_days", "min_z"), "min_z")


_SEASON_DAY = "dayofyear(make_date(2000, month(date), day(date)))"


def _levels(name: str, keys: str) -> str:
    """Annual medians of a level, and its quantiles over other years for each season day asked."""
    k, on = (f"{keys}, " if keys else ""), " AND ".join([f"a.{x} = q.{x}" for x in keys.split(", ") if x] or ["true"])
    own = f"entity, {'category, ' if 'category' in keys else ''}"
    return f"""{name}_own AS (SELECT {own}ry, d, quantile_cont(v, 0.5) AS m FROM spread GROUP BY {own}ry, d),
  {name}_year AS (SELECT {k}ry, d, quantile_cont(m, 0.5) AS m FROM {name}_own GROUP BY {k}ry, d),
  {name}_pair AS (SELECT q.entity, q.date, a.m FROM asked q JOIN {name}_year a ON a.d = q.d AND a.ry <> q.y AND {on}),
  {name}_q AS (SELECT entity, date, count(*) AS n, quantile_cont(m, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM {name}_pair GROUP BY entity, date HAVING count(*) >= 3),
  {name} AS (SELECT entity, date, n, q, greatest(1.4826 * quantile_cont(abs(m - q[3]), 0.5), 0.04) AS s FROM {name}_pair JOIN {name}_q USING (entity, date) GROUP BY entity, date, n, q)"""


_LOYO_SQL = f"""asked AS (SELECT entity, category, date, y, {_SEASON_DAY} AS d, target FROM panel),
  spread AS (SELECT entity, category, y AS ry, (sd - 1 + delta + 366) % 366 + 1 AS d, v FROM (SELECT entity, category, y, {_SEASON_DAY} AS sd, target AS v FROM panel WHERE target IS NOT NULL), (SELECT unnest(generate_series(-10, 10)) AS delta)),
  {_levels("g", "")}, {_levels("c", "category")}, {_levels("p", "entity, category")},
  l1 AS (SELECT a.*, g.n AS n0, g.q AS q0, g.s AS s0, CASE WHEN c.n IS NULL THEN g.q[3] ELSE c.n / (c.n + 3) * c.q[3] + (1 - c.n / (c.n + 3)) * g.q[3] END AS e1, CASE WHEN c.n IS NULL THEN g.q[1] ELSE c.n / (c.n + 3) * c.q[1] + (1 - c.n / (c.n + 3)) * g.q[1] END AS t1, CASE WHEN c.n IS NULL THEN g.q[2] ELSE c.n / (c.n + 3) * c.q[2] + (1 - c.n / (c.n + 3)) * g.q[2] END AS t2, CASE WHEN c.n IS NULL THEN g.q[4] ELSE c.n / (c.n + 3) * c.q[4] + (1 - c.n / (c.n + 3)) * g.q[4] END AS t4, CASE WHEN c.n IS NULL THEN g.q[5] ELSE c.n / (c.n + 3) * c.q[5] + (1 - c.n / (c.n + 3)) * g.q[5] END AS t5,
      CASE WHEN c.n IS NULL THEN g.s ELSE c.n / (c.n + 3) * c.s + (1 - c.n / (c.n + 3)) * g.s END AS s1, c.n AS n1, p.n AS n2, p.q AS q2, p.s AS s2_ FROM asked a LEFT JOIN g USING (entity, date) LEFT JOIN c USING (entity, date) LEFT JOIN p USING (entity, date)),
  loyo AS (SELECT entity, date, target, CASE WHEN n0 IS NULL THEN NULL WHEN n2 IS NULL THEN e1 ELSE n2 / (n2 + 3) * q2[3] + (1 - n2 / (n2 + 3)) * e1 END AS expected, CASE WHEN n0 IS NULL THEN NULL WHEN n2 IS NULL THEN t1 ELSE n2 / (n2 + 3) * q2[1] + (1 - n2 / (n2 + 3)) * t1 END AS q10, CASE WHEN n0 IS NULL THEN NULL WHEN n2 IS NULL THEN t2 ELSE n2 / (n2 + 3) * q2[2] + (1 - n2 / (n2 + 3)) * t2 END AS q25, CASE WHEN n0 IS NULL THEN NULL WHEN n2 IS NULL THEN t4 ELSE n2 / (n2 + 3) * q2[4] + (1 - n2 / (n2 + 3)) * t4 END AS q75, CASE WHEN n0 IS NULL THEN NULL WHEN n2 IS NULL THEN t5 ELSE n2 / (n2 + 3) * q2[5] + (1 - n2 / (n2 + 3)) * t5 END AS q90,
      CASE WHEN n0 IS NULL THEN NULL WHEN n2 IS NULL THEN s1 ELSE n2 / (n2 + 3) * s2_ + (1 - n2 / (n2 + 3)) * s1 END AS scale, CASE WHEN n0 IS NULL THEN 0 ELSE coalesce(n2, n1, n0) END AS years,
      CASE WHEN n0 IS NULL THEN 'insufficient' WHEN n2 IS NOT NULL THEN 'polygon' WHEN n1 IS NOT NULL THEN 'crop' ELSE 'global' END AS level FROM l1)"""


@query(f"WITH {PANEL_SQL}, {_LOYO_SQL} SELECT entity, date, {r6('expected', 'scale AS climatology_scale', 'q10', 'q25', 'expected AS q50', 'q75', 'q90')}, years AS reference_years, level AS reference_level FROM loyo")
def climatology_loyo(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    out = season.leave_one_year_out(panel, panel, "target")
    names = ["expected", "climatology_scale", "q10", "q25", "q50", "q75", "q90"]
    return rounded(out.select("entity", "date", *names, "reference_years", "reference_level"), *names)


_SCORE_SQL = f"""{_LOYO_SQL}, src AS (SELECT entity, date, CASE WHEN s2 IS NOT NULL THEN 's2' WHEN landsat IS NOT NULL THEN 'landsat' ELSE 'modis' END AS source, CASE WHEN (CASE WHEN s2 < 0.2 THEN 1 ELSE 0 END) + (CASE WHEN landsat < 0.2 THEN 1 ELSE 0 END) + (CASE WHEN modis < 0.2 THEN 1 ELSE 0 END) >= 2 THEN true ELSE false END AS multi FROM panel),
  sc AS (SELECT l.*, source, multi, target - expected AS r, (target - expected) / scale AS z, coalesce(source <> lag(source) OVER (PARTITION BY entity ORDER BY date), false) AS sw FROM loyo l JOIN src USING (entity, date)),
  scored AS (SELECT *, CASE level WHEN 'polygon' THEN 1.0 WHEN 'crop' THEN 0.85 WHEN 'global' THEN 0.5 ELSE 0.0 END * CASE WHEN sw AND NOT multi THEN 0.6 ELSE 1.0 END * CASE WHEN scale IS NULL THEN 0 ELSE 1 END AS conf, coalesce(z < -1, false) AS c FROM sc)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row counts as observed; sensors below 0.2 count as negative."""
    panel = _panel(spark, sf_dir)
    low = sum((F.when(F.col(s) < 0.2, 1).otherwise(0) for s in P.SPEC.sensors), F.lit(0))
    source = F.when(F.col("s2").isNotNull(), "s2").when(F.col("landsat").isNotNull(), "landsat").otherwise("modis")
    rows = season.leave_one_year_out(panel, panel, "target").withColumns({"is_observed": F.lit(True), "sensor_negative_count": low, "selected_source": source})
    return anomaly.score_points(rows, "target")


@query(f"WITH {PANEL_SQL}, {_SCORE_SQL} SELECT entity, date, {r6('r AS residual', 'z AS robust_z', 'conf AS confidence')}, sw AS source_switch_risk, multi AS multisensor_confirmation, c AS candidate FROM scored")
def anomaly_points_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scored(spark, sf_dir).select("entity", "date", "residual", "robust_z", "confidence", "source_switch_risk", "multisensor_confirmation", "candidate")
    return rounded(out, "residual", "robust_z", "confidence")


_EVENTS_SQL = f"""{_SCORE_SQL}, kept AS (SELECT * FROM scored WHERE c OR z IS NOT NULL),
  br AS (SELECT *, CASE WHEN c AND (NOT coalesce(lag(c) OVER w, false) OR date - lag(date) OVER w > 10 OR year(date) <> year(lag(date) OVER w)) THEN 1 ELSE 0 END AS b FROM kept WINDOW w AS (PARTITION BY entity ORDER BY date)),
  il AS (SELECT * FROM (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY date) AS i FROM br) WHERE c),
  dd AS (SELECT *, greatest(-r, 0) AS depth, date - lag(date) OVER w AS days, lag(greatest(-r, 0)) OVER w AS pd, (r - lag(r) OVER w) / greatest(date - lag(date) OVER w, 1) AS slope FROM il WINDOW w AS (PARTITION BY entity, i ORDER BY date)),
  ev0 AS (SELECT entity, i, min(date) AS s, max(date) AS e, count(*) AS n, avg(conf) * least(1.0, count(*) / 3) AS conf, quantile_cont(z, 0.5) AS zm, min(z) AS mz, coalesce(sum((depth + pd) * days / 2), 0) AS area, min(slope) AS slope, count(*) FILTER (multi) AS multi, bool_or(sw) AS sw FROM dd GROUP BY entity, i),
  ev AS (SELECT *, CAST(e - s + 1 AS BIGINT) AS dur FROM ev0 WHERE n >= 2 AND e - s + 1 >= 3)"""
_CODES_SQL = """list_filter([CASE WHEN multi >= 2 THEN 'MULTISENSOR_CONFIRMATION' END, CASE WHEN sw THEN 'SOURCE_SWITCH_RISK' END, CASE WHEN conf < 0.55 THEN 'LOW_DATA_COVERAGE' END, CASE WHEN dur >= 14 THEN 'PROLONGED_SUPPRESSION' END, CASE WHEN slope < -0.025 THEN 'RAPID_NEGATIVE_CHANGE' END], lambda x: x IS NOT NULL)"""


@query(f"""WITH {PANEL_SQL}, {_EVENTS_SQL} SELECT entity, s AS start_date, e AS end_date, n AS observed_points, CAST(0 AS BIGINT) AS reconstructed_points, dur AS duration_days, {r6("conf AS confidence", "mz AS min_z", "area AS negative_area", "area * conf AS score")},
  CASE WHEN zm < -2 AND n >= 2 AND dur >= 7 AND conf >= 0.55 THEN 'critical' ELSE 'biomass_suppression' END AS severity, array_to_string({_CODES_SQL}, ',') AS reason_codes FROM ev""")
def events_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.advanced_events(_scored(spark, sf_dir)).withColumn("reason_codes", F.array_join("reason_codes", ","))
    return rounded(out, "confidence", "min_z", "negative_area", "score")


@query(f"""WITH {PANEL_SQL}, {_EVENTS_SQL}, t AS (SELECT *, {_CODES_SQL} AS codes FROM ev)
  SELECT entity, s AS start_date, 'Sustained negative deviation' || CASE WHEN len(codes) > 0 THEN ': ' || array_to_string(list_transform(codes, lambda x: CASE x WHEN 'MULTISENSOR_CONFIRMATION' THEN 'several sensors agree' WHEN 'SOURCE_SWITCH_RISK' THEN 'the sensor changed, so part of the deviation may be its own'
    WHEN 'LOW_DATA_COVERAGE' THEN 'few direct observations support it' WHEN 'PROLONGED_SUPPRESSION' THEN 'it lasted two weeks or longer' ELSE 'the value fell rapidly' END), '; ') ELSE '' END || '. No cause is established.' AS explanation FROM t""")
def event_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.explained(anomaly.advanced_events(_scored(spark, sf_dir))).select("entity", "start_date", "explanation")


@query(f"""WITH {PANEL_SQL}, {_EVENTS_SQL}, s AS (SELECT entity, count(*) AS rows FROM panel GROUP BY entity), x AS (SELECT entity, count(*) AS events, count(*) FILTER (zm < -2 AND dur >= 7 AND conf >= 0.55) AS critical, max(area * conf) AS max_score, max(conf) AS max_confidence FROM ev GROUP BY entity)
  SELECT entity, rows, rows AS observed, coalesce(events, 0) AS events, coalesce(critical, 0) AS critical, {r6("max_score", "max_confidence")} FROM s LEFT JOIN x USING (entity)""")
def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = staged(_scored(spark, sf_dir), "scored")
    return rounded(anomaly.summary(points, anomaly.advanced_events(points)), "max_score", "max_confidence")


@query(f"WITH {PANEL_SQL}, {_SCORE_SQL} SELECT entity, CASE WHEN bool_or(years < 3) THEN 'INSUFFICIENT_REFERENCE_YEARS' ELSE '' END AS warnings FROM scored GROUP BY entity")
def anomaly_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.warnings(_scored(spark, sf_dir), "target").select("entity", F.array_join("warnings", ",").alias("warnings"))


# --- harmonization -----------------------------------------------------------------------------------------

_IQR_SQL = """prs AS (SELECT 's2' AS source, s2 AS a, s2 AS b FROM panel UNION ALL SELECT 'landsat', landsat, s2 FROM panel UNION ALL SELECT 'modis', modis, s2 FROM panel),
  st AS (SELECT source, count(*) AS n, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS da, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS db, quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM prs WHERE a BETWEEN -1 AND 1 AND b BETWEEN -1 AND 1 GROUP BY source),
  maps AS (SELECT source, CASE WHEN source = 's2' THEN 1.0 ELSE db / da END AS slope, CASE WHEN source = 's2' THEN 0.0 ELSE mb - db / da * ma END AS "offset", n AS n_pairs, CASE WHEN source = 's2' THEN 'reference' ELSE 'robust_affine' END AS status FROM st)"""


@query(f"WITH {PANEL_SQL}, {_IQR_SQL} SELECT source, {r6('slope')}, round(\"offset\" + 1e-9, 6) + 0.0 AS \"offset\", n_pairs, status FROM maps")
def iqr_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(harmonize.iqr_affine(_panel(spark, sf_dir)), "slope", "offset")


@query(f"""WITH {PANEL_SQL}, {_IQR_SQL}, e AS (SELECT source, a, b, slope * a + "offset" AS m FROM prs JOIN maps USING (source) WHERE source <> 's2' AND a IS NOT NULL AND b IS NOT NULL)
  SELECT source, count(*) AS n, {r6("avg(abs(a - b)) AS mae_raw", "sqrt(avg((a - b) ** 2)) AS rmse_raw", "quantile_cont(a - b, 0.5) AS median_bias_raw", "avg(abs(m - b)) AS mae_harmonized", "sqrt(avg((m - b) ** 2)) AS rmse_harmonized", "quantile_cont(m - b, 0.5) AS median_bias_harmonized")} FROM e GROUP BY source""")
def sensor_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    out = harmonize.alignment(panel, harmonize.iqr_affine(panel))
    return rounded(out, *[c for c in out.columns if c not in ("source", "n")])


@query(f"""WITH {PANEL_SQL}, {_IQR_SQL}, w AS (SELECT max(slope) FILTER (source = 'landsat') AS sl, max("offset") FILTER (source = 'landsat') AS ol, max(slope) FILTER (source = 'modis') AS sm, max("offset") FILTER (source = 'modis') AS om FROM maps)
  SELECT entity, date, {r6("0.5 * target + 0.25 * (target * sl + ol) + 0.125 * (target * sm + om) + 0.125 * target AS harmonized")}, 'partial_or_identity' AS harmonization_status FROM panel, w""")
def harmonize_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    rows = panel.select("entity", "date", "target", F.lit(0.5).alias("p_s2"), F.lit(0.25).alias("p_landsat"), F.lit(0.125).alias("p_modis"))
    out = harmonize.mixture(rows, "target", harmonize.iqr_affine(panel))
    return rounded(out.select("entity", "date", "harmonized", "harmonization_status"), "harmonized")


@query()
def irls_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust lines have no closed form in SQL; tests hold them against known lines."""
    return harmonize.fit_robust(_panel(spark, sf_dir))


@query()
def harmonize_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    source = F.when(F.col("s2").isNotNull(), "s2").when(F.col("landsat").isNotNull(), "landsat").otherwise("modis")
    return harmonize.apply_robust(panel.withColumn("source", source), harmonize.fit_robust(panel), "target", "source")


# --- evaluation --------------------------------------------------------------------------------------------


@query(f"""WITH {CONTEXT_SQL}, u AS (SELECT 'overall' AS dimension, 'all' AS subgroup, pred_linear AS p, truth FROM preds UNION ALL SELECT 'category', category, pred_linear, truth FROM preds UNION ALL SELECT 'source', source, pred_linear, truth FROM preds
    UNION ALL SELECT 'year', CAST(y AS VARCHAR), pred_linear, truth FROM preds UNION ALL SELECT 'left_bin', left_bin, pred_linear, truth FROM preds),
  m AS (SELECT dimension, subgroup, count(*) AS n, sqrt(avg((p - truth) ** 2)) AS rmse FROM u GROUP BY 1, 2)
  SELECT dimension, subgroup, n, {r6("rmse", "30 * greatest(0.0, 1 - rmse / 0.10) AS gap_score")} FROM m UNION ALL SELECT 'confidence_bin', 'unavailable', count(*), NULL, NULL FROM preds""")
def metric_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir)
    return rounded(evaluate.metric_table(rows, "truth", "pred_linear", ["category", "source", "year", "left_bin", "confidence_bin"]), "rmse", "gap_score")


_ROLE = "CASE WHEN substr(md5(entity), 1, 1) < '8' THEN 'development' ELSE 'audit' END"


def _role(rows: DataFrame) -> DataFrame:
    return rows.withColumn("role", F.when(F.substring(F.md5("entity"), 1, 1) < "8", "development").otherwise("audit"))


@query(f"""WITH {CONTEXT_SQL}, r AS (SELECT *, {_ROLE} AS role FROM preds), u AS (SELECT role, 'year' AS slice, CAST(y AS VARCHAR) AS value, pred_linear - truth AS e FROM r UNION ALL SELECT role, 'source', source, pred_linear - truth FROM r
    UNION ALL SELECT role, 'category', category, pred_linear - truth FROM r UNION ALL SELECT role, 'entity', entity, pred_linear - truth FROM r)
  SELECT role, slice, value, count(*) AS n, {r6("sqrt(avg(e * e)) AS rmse", "avg(abs(e)) AS mae", "30 * greatest(0.0, 1 - sqrt(avg(e * e)) / 0.10) AS gap_score")} FROM u GROUP BY 1, 2, 3""")
def error_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _role(_predicted(spark, sf_dir))
    return rounded(evaluate.error_slices(rows, "truth", "pred_linear", "role", ["year", "source", "category", "entity"]), "rmse", "mae", "gap_score")


_MODE = "substr('ABCD', CAST(y % 4 AS INT) + 1, 1)"


@query(f"WITH {CONTEXT_SQL}, m AS (SELECT {_MODE} AS mode, sqrt(avg((pred_linear - truth) ** 2)) AS r FROM preds GROUP BY 1) SELECT {r6('''sum(r * CASE mode WHEN 'A' THEN 0.5 WHEN 'B' THEN 0.25 WHEN 'C' THEN 0.15 ELSE 0.1 END) AS composite''')} FROM m")
def composite_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir).withColumn("mode", F.substring(F.lit("ABCD"), F.year("date") % 4 + 1, F.lit(1)))
    return rounded(evaluate.composite(rows, "mode", "truth", "pred_linear"), "composite")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible rows with fixed pseudo-probabilities of their source from a hash, for the calibration tables."""
    rows = P.nation_day(spark, sf_dir).where("target is not null")
    a, b = (F.conv(F.substring(F.md5(F.concat_ws("|", "entity", F.col("date").cast("string"))), k, 2), 16, 10).cast("double") + 1 for k in (1, 3))
    label = F.when(F.col("s2").isNotNull(), "s2").when(F.col("landsat").isNotNull(), "landsat").otherwise("modis")
    rows = rows.select("entity", "date", label.alias("label"), a.alias("a"), b.alias("b"), F.substring(F.lit("ABCD"), F.year("date") % 4 + 1, F.lit(1)).alias("mode"))
    total = F.col("a") + F.col("b") + 64
    return rows.withColumns({"p_s2": F.col("a") / total, "p_landsat": F.col("b") / total, "p_modis": 64 / total})


_CLASS_SQL = f"""h AS (SELECT entity, date, y, CASE WHEN s2 IS NOT NULL THEN 's2' WHEN landsat IS NOT NULL THEN 'landsat' ELSE 'modis' END AS label,
    CAST(CAST('0x' || substr(md5(concat_ws('|', entity, CAST(date AS VARCHAR))), 1, 2) AS INT) AS DOUBLE) + 1 AS a, CAST(CAST('0x' || substr(md5(concat_ws('|', entity, CAST(date AS VARCHAR))), 3, 2) AS INT) AS DOUBLE) + 1 AS b FROM panel WHERE target IS NOT NULL),
  cl AS (SELECT {_MODE} AS mode, label, a / (a + b + 64) AS p_s2, b / (a + b + 64) AS p_landsat, 64 / (a + b + 64) AS p_modis FROM h)"""


@query(f"""WITH {PANEL_SQL}, {_CLASS_SQL}, u AS (SELECT mode, label, 's2' AS source, p_s2 AS p FROM cl UNION ALL SELECT mode, label, 'landsat', p_landsat FROM cl UNION ALL SELECT mode, label, 'modis', p_modis FROM cl)
  SELECT mode, source, CAST(greatest(1, ceil(p * 5)) AS INT) AS bin, count(*) AS n, {r6("avg(p) AS mean_probability", "avg(CASE WHEN label = source THEN 1.0 ELSE 0.0 END) AS observed_frequency")} FROM u GROUP BY 1, 2, 3""")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.reliability(_classified(spark, sf_dir), "mode", "label", list(P.SPEC.sensors)), "mean_probability", "observed_frequency")


@query(f"""WITH {PANEL_SQL}, {_CLASS_SQL} SELECT count(*) AS n, {r6("avg(CASE WHEN label = CASE WHEN p_s2 >= p_landsat AND p_s2 >= p_modis THEN 's2' WHEN p_landsat >= p_modis THEN 'landsat' ELSE 'modis' END THEN 1.0 ELSE 0.0 END) AS accuracy",
  "avg((p_s2 - CASE WHEN label = 's2' THEN 1 ELSE 0 END) ** 2 + (p_landsat - CASE WHEN label = 'landsat' THEN 1 ELSE 0 END) ** 2 + (p_modis - CASE WHEN label = 'modis' THEN 1 ELSE 0 END) ** 2) AS brier")} FROM cl""")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.brier(_classified(spark, sf_dir), "label", list(P.SPEC.sensors)), "accuracy", "brier")


_RADII_SQL = """er AS (SELECT source, abs(pred_linear - truth) AS e FROM preds), lab AS (SELECT source AS label, e FROM er UNION ALL SELECT 'global', e FROM er),
  rk AS (SELECT label, e, row_number() OVER (PARTITION BY label ORDER BY e) AS k, count(*) OVER (PARTITION BY label) AS n FROM lab),
  radii AS (SELECT label, level, min(e) AS radius, any_value(n) AS n FROM rk, (SELECT unnest([0.8, 0.95]) AS level) WHERE k >= ceil(least(1.0, ceil((n + 1) * CAST(level AS DOUBLE)) / n) * (n - 1)) + 1 GROUP BY label, level)"""


@query(f"WITH {CONTEXT_SQL}, {_RADII_SQL} SELECT label, CAST(level AS DOUBLE) AS level, {r6('radius')}, n FROM radii")
def residual_quantile_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir)
    return rounded(reconstruct.residual_radii(rows, F.col("pred_linear") - F.col("truth"), F.col("source")), "radius")


@query(f"""WITH {CONTEXT_SQL}, {_RADII_SQL}, j AS (SELECT p.source, p.truth, p.pred_linear - radius AS lo, p.pred_linear + radius AS hi FROM preds p JOIN radii r ON r.label = p.source AND r.level = 0.8)
  SELECT source, count(*) AS n, {r6("avg(CASE WHEN truth BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS coverage", "avg(hi - lo) AS mean_width")} FROM j GROUP BY source""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir)
    radii = reconstruct.residual_radii(rows, F.col("pred_linear") - F.col("truth"), F.col("source"))
    return rounded(evaluate.coverage(reconstruct.intervals(rows, "pred_linear", F.col("source"), radii, 0.8), "truth", ["source"]), "coverage", "mean_width")


def _boot(sums: str, draws: int, seed: int) -> str:
    return f"""tot AS (SELECT entity, count(*) AS n, {sums}, row_number() OVER (ORDER BY entity) - 1 AS i FROM preds GROUP BY entity), sz AS (SELECT count(*) AS k FROM tot),
  sl AS (SELECT draw, slot, k FROM sz, (SELECT unnest(generate_series(0, {draws - 1})) AS draw), LATERAL (SELECT unnest(generate_series(0, k - 1)) AS slot)),
  pk AS (SELECT draw, CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST(draw AS VARCHAR), CAST(slot AS VARCHAR))), 1, 8) AS BIGINT) % k AS i FROM sl)"""


@query(f"""WITH {CONTEXT_SQL}, {_boot("sum((pred_linear - truth) ** 2) AS sse", 1500, 1981)}, b AS (SELECT draw, sqrt(sum(sse) / sum(n)) AS r FROM pk JOIN tot USING (i) GROUP BY draw)
  SELECT {r6("(SELECT sqrt(avg((pred_linear - truth) ** 2)) FROM preds) AS rmse", "quantile_cont(r, 0.025) AS low", "quantile_cont(r, 0.975) AS high")} FROM b""")
def bootstrap_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.bootstrap_rmse(_predicted(spark, sf_dir), "entity", "truth", "pred_linear"), "rmse", "low", "high")


@query(f"""WITH {CONTEXT_SQL}, {_boot("sum((pred_linear - truth) ** 2) AS a, sum((pred_mean_neighbors - truth) ** 2) AS b", 2000, 7)}, g AS (SELECT draw, sqrt(sum(a) / sum(n)) - sqrt(sum(b) / sum(n)) AS g FROM pk JOIN tot USING (i) GROUP BY draw)
  SELECT {r6("(SELECT sqrt(avg((pred_linear - truth) ** 2)) - sqrt(avg((pred_mean_neighbors - truth) ** 2)) FROM preds) AS gain", "quantile_cont(g, 0.025) AS low", "quantile_cont(g, 0.975) AS high", "avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS share")} FROM g""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.paired_bootstrap(_predicted(spark, sf_dir), "entity", "truth", "pred_linear", "pred_mean_neighbors"), "gain", "low", "high", "share")


@query(f"""WITH {CONTEXT_SQL}, f AS (SELECT category AS fold, pred_linear - truth AS e, pred_mean_neighbors - pred_linear AS d FROM preds), s AS (SELECT fold, count(*) AS n, sum(e * e) AS ee, sum(e * d) AS ed, sum(d * d) AS dd FROM f GROUP BY fold),
  t AS (SELECT sum(n) AS n, sum(ee) AS ee, sum(ed) AS ed, sum(dd) AS dd FROM s), g AS (SELECT s.fold, w / 100 AS weight, round((t.ee - s.ee + 2 * (w / 100) * (t.ed - s.ed) + (w / 100) * (w / 100) * (t.dd - s.dd)) / (t.n - s.n), 12) AS o,
    sqrt((s.ee + 2 * (w / 100) * s.ed + (w / 100) * (w / 100) * s.dd) / s.n) AS rmse FROM s, t, (SELECT unnest(generate_series(0, 100)) AS w))
  SELECT fold, weight, {r6("rmse")} FROM g QUALIFY row_number() OVER (PARTITION BY fold ORDER BY o, weight) = 1""")
def blend_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.blend_grid(_predicted(spark, sf_dir), "category", "truth", "pred_linear", "pred_mean_neighbors"), "rmse")


@query(f"""WITH {CONTEXT_SQL} SELECT entity, date, {r6("0.7 * pred_linear + 0.3 * pred_seasonal_crop AS blended", "abs(pred_linear - pred_seasonal_crop) / 2 AS disagreement", "CASE WHEN left_days IS NULL OR right_days IS NULL OR least(left_days, right_days) > 15 THEN 0.5 * (0.7 * pred_linear + 0.3 * pred_seasonal_crop) + 0.5 * pred_mean_neighbors ELSE 0.7 * pred_linear + 0.3 * pred_seasonal_crop END AS gated")} FROM preds""")
def blend_and_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconstruct.blend(_predicted(spark, sf_dir), {"pred_linear": 0.7, "pred_seasonal_crop": 0.3})
    gate = reconstruct.gate_mask("long_one_sided", F.col("left_days"), F.col("right_days"))
    out = reconstruct.apply_gate(rows, "blended", "pred_mean_neighbors", gate)
    return rounded(out.select("entity", "date", "blended", "disagreement", "gated"), "blended", "disagreement", "gated")


@query()
def splines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pchip and akima through the eight nearest observations; tests hold them against known curves."""
    rows = asof.neighbors(_masked(spark, sf_dir), "target").where("hidden")
    return reconstruct.splines(rows).select("entity", "date", "pchip", "akima")


# --- donors ------------------------------------------------------------------------------------------------


@query(f"""WITH {PANEL_SQL}, s AS (SELECT entity, date, s2 - 0.5 AS v FROM masked WHERE s2 BETWEEN -1 AND 1),
  p AS (SELECT a.entity, b.entity AS donor, count(*) AS n, sum(b.v) AS sx, sum(a.v) AS sy, sum(b.v * b.v) AS sxx, sum(a.v * a.v) AS syy, sum(a.v * b.v) AS sxy FROM s a JOIN s b ON a.date = b.date AND a.entity <> b.entity GROUP BY 1, 2 HAVING count(*) >= 12),
  c AS (SELECT entity, donor, n, sx / n + 0.5 AS mx, sy / n + 0.5 AS my, sxx - sx * sx / n AS xx, syy - sy * sy / n AS yy, sxy - sx * sy / n AS xy FROM p),
  f AS (SELECT *, xy / sqrt(greatest(xx * yy, 1e-10)) AS r, greatest(0.2, least(1.8, (xy + 0.15) / (xx + 0.15))) AS slope FROM c)
  SELECT entity, donor, {r6("slope", "my - slope * mx AS intercept", "r ** 4 * n / (n + 30) AS weight")} FROM f WHERE r >= 0.02""")
def donor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are barely correlated, so the least correlation is lower here."""
    return rounded(donors.pair_fits(_masked(spark, sf_dir), "s2", least_corr=0.02), "slope", "intercept", "weight")


@query(f"""WITH {PANEL_SQL}, s AS (SELECT entity, date, s2 - 0.5 AS v FROM masked WHERE s2 BETWEEN -1 AND 1),
  p AS (SELECT a.entity, b.entity AS donor, count(*) AS n, sum(b.v) AS sx, sum(a.v) AS sy, sum(b.v * b.v) AS sxx, sum(a.v * a.v) AS syy, sum(a.v * b.v) AS sxy FROM s a JOIN s b ON a.date = b.date AND a.entity <> b.entity WHERE a.entity < 'NATION_2' GROUP BY 1, 2 HAVING count(*) >= 12),
  c AS (SELECT entity, donor, n, sxx - sx * sx / n AS xx, syy - sy * sy / n AS yy, sxy - sx * sy / n AS xy FROM p) SELECT count(*) AS n, {r6("max((xy / sqrt(greatest(xx * yy, 1e-10))) ** 4 * n / (n + 30)) AS most")} FROM c WHERE xy / sqrt(greatest(xx * yy, 1e-10)) >= 0.2""")
def donor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = donors.pair_fits(_masked(spark, sf_dir), "s2").where("entity < 'NATION_2'")
    return rounded(fits.agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("most")), "most")


_USER_DAY_SQL = """ud AS (SELECT CAST(user_id AS VARCHAR) AS entity, CAST(ts AS DATE) AS date, CAST(user_id % 4 AS VARCHAR) AS category,
    CAST(sum(CAST(value AS DECIMAL(16, 4))) FILTER (event_type = 'view') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'view'), 0) AS s2, CAST(sum(CAST(value AS DECIMAL(16, 4))) FILTER (event_type = 'click') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'click'), 0) AS landsat,
    CAST(sum(CAST(value AS DECIMAL(16, 4))) FILTER (event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'purchase'), 0) AS modis FROM events GROUP BY 1, 2, 3),
  up AS (SELECT *, coalesce(s2, landsat, modis) AS target FROM ud)"""


@query(f"""WITH {_USER_DAY_SQL}, m AS (SELECT entity, date, target, target IS NOT NULL AND substr(md5(concat_ws('|', entity, CAST(date AS VARCHAR), '17')), 1, 2) < '26' AS hidden FROM up),
  s AS (SELECT entity, date, target AS t, target - 0.5 AS v FROM m WHERE NOT hidden AND target BETWEEN -1 AND 1),
  p AS (SELECT a.entity, b.entity AS donor, count(*) AS n, sum(b.v) AS sx, sum(a.v) AS sy, sum(b.v * b.v) AS sxx, sum(a.v * a.v) AS syy, sum(a.v * b.v) AS sxy FROM s a JOIN s b ON a.date = b.date AND a.entity <> b.entity GROUP BY 1, 2 HAVING count(*) >= 12),
  c AS (SELECT entity, donor, n, sx / n + 0.5 AS mx, sy / n + 0.5 AS my, sxx - sx * sx / n AS xx, syy - sy * sy / n AS yy, sxy - sx * sy / n AS xy FROM p),
  f AS (SELECT entity, donor, n, my, mx, greatest(0.2, least(1.8, (xy + 0.15) / (xx + 0.15))) AS slope, xy / sqrt(greatest(xx * yy, 1e-10)) AS r FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY w DESC, donor) AS k FROM (SELECT *, my - slope * mx AS icpt, r ** 4 * n / (n + 30) AS w FROM f WHERE r >= 0.2)),
  d AS (SELECT q.entity, q.date, sum((icpt + slope * s.t) * w) FILTER (k <= 3) / sum(w) FILTER (k <= 3) AS donor_3, count(*) FILTER (k <= 3) AS n3, sum((icpt + slope * s.t) * w) FILTER (k <= 10) / sum(w) FILTER (k <= 10) AS donor_10, count(*) FILTER (k <= 10) AS n10
    FROM m q JOIN k ON k.entity = q.entity AND k.k <= 10 JOIN s ON s.entity = k.donor AND s.date = q.date WHERE q.hidden GROUP BY 1, 2),
  g AS (SELECT entity, avg(w) AS conf FROM k WHERE k <= 3 GROUP BY entity)
  SELECT m.entity, m.date, {r6("donor_3", "donor_10", "conf AS donor_confidence")}, coalesce(n3, 0) AS donor_3_n, coalesce(n10, 0) AS donor_10_n FROM m LEFT JOIN d USING (entity, date) LEFT JOIN g ON g.entity = m.entity WHERE m.hidden""")
def donor_top3_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days."""
    panel = P.masked(P.hash_gaps(staged(P.user_day(spark, sf_dir), "panel")))
    out = donors.donors(panel.where("hidden"), panel, "target")
    return rounded(out.select("entity", "date", "donor_3", "donor_3_n", "donor_10", "donor_10_n", "donor_confidence"), "donor_3", "donor_10", "donor_confidence")


# --- folds -------------------------------------------------------------------------------------------------


@query(f"""WITH {PANEL_SQL}, v AS (SELECT entity, date, y FROM panel WHERE target IS NOT NULL), s AS (SELECT entity, count(*) AS n FROM v GROUP BY entity), o AS (SELECT entity, (row_number() OVER (ORDER BY n DESC, entity) - 1) % 10 AS lap FROM s)
  SELECT entity, CAST(CASE WHEN lap < 5 THEN lap ELSE 9 - lap END AS INT) AS fold FROM o""")
def fold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.entity_groups(P.nation_day(spark, sf_dir))


@query(f"""WITH {PANEL_SQL}, v AS (SELECT entity, date, y FROM panel WHERE target IS NOT NULL),
  h AS (SELECT seed, entity, date, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', entity, CAST(date AS VARCHAR), CAST(seed AS VARCHAR))), entity, date) AS k FROM v, (SELECT unnest([11, 29, 47, 71, 97]) AS seed)),
  l AS (SELECT entity, date, row_number() OVER (ORDER BY md5(concat_ws('|', entity, CAST(date AS VARCHAR), '2011')), entity, date) AS k FROM v WHERE y = (SELECT max(y) FROM v))
  SELECT 'A' AS mode, CASE seed WHEN 11 THEN 0 WHEN 29 THEN 1 WHEN 47 THEN 2 WHEN 71 THEN 3 ELSE 4 END AS repeat, entity, date, substr(md5(concat_ws('|', entity, CAST(seed AS VARCHAR))), 1, 2) >= '80' AS seen FROM h WHERE k <= 1200
  UNION ALL SELECT 'C', 0, entity, date, true FROM l WHERE k <= 1200""")
def fold_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.folds(_panel(spark, sf_dir)).where("mode in ('A', 'C')").select("mode", "repeat", "entity", "date", "seen")


_FOLD_SQL = f"""v AS (SELECT entity, date, y FROM panel WHERE target IS NOT NULL),
  h AS (SELECT seed, entity, date, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', entity, CAST(date AS VARCHAR), CAST(seed AS VARCHAR))), entity, date) AS k FROM v, (SELECT unnest([11, 29, 47, 71, 97]) AS seed)),
  l AS (SELECT entity, date, y, row_number() OVER (ORDER BY md5(concat_ws('|', entity, CAST(date AS VARCHAR), '2011')), entity, date) AS k FROM v WHERE y = (SELECT max(y) FROM v)),
  gs AS (SELECT entity, count(*) AS n FROM v GROUP BY entity), go AS (SELECT entity, (row_number() OVER (ORDER BY n DESC, entity) - 1) % 10 AS lap FROM gs),
  gg AS (SELECT v.*, CAST(CASE WHEN lap < 5 THEN lap ELSE 9 - lap END AS INT) AS fold FROM v JOIN go USING (entity)),
  b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('|', entity, CAST(date AS VARCHAR), '1011')), entity, date) AS k, least(1200, floor(count(*) OVER (PARTITION BY fold) / 3)) AS n FROM gg),
  d1 AS (SELECT *, count(*) OVER (PARTITION BY entity, y) AS n, row_number() OVER (PARTITION BY entity, y ORDER BY date DESC) AS back, md5(concat_ws('|', entity, CAST(y AS VARCHAR), '3011')) AS pick FROM gg),
  d2 AS (SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY pick) AS r, CAST('0x' || substr(pick, 1, 8) AS BIGINT) % 3 + 2 AS len FROM d1 WHERE n >= 7),
  d3 AS (SELECT *, min(date) OVER (PARTITION BY entity) - 15 AS cut FROM d2 WHERE r = 1 AND back <= len),
  d AS (SELECT * FROM d3 JOIN (SELECT entity, min(date) AS first FROM v GROUP BY entity) USING (entity) WHERE first < cut),
  folds AS (SELECT 'A' AS mode, CASE seed WHEN 11 THEN 0 WHEN 29 THEN 1 WHEN 47 THEN 2 WHEN 71 THEN 3 ELSE 4 END AS repeat, 0 AS fold, entity, date, 'transductive' AS context_policy, CAST(NULL AS DATE) AS cutoff_date, substr(md5(concat_ws('|', entity, CAST(seed AS VARCHAR))), 1, 2) >= '80' AS seen FROM h WHERE k <= 1200
    UNION ALL SELECT 'B', 0, fold, entity, date, 'transductive', NULL, false FROM b WHERE k <= n
    UNION ALL SELECT 'C', 0, 0, entity, date, 'past_only', make_date(y, 1, 1), true FROM l WHERE k <= 1200
    UNION ALL SELECT 'D', 0, fold, entity, date, 'one_sided_hard', cut, false FROM d)"""


@query(f"WITH {PANEL_SQL}, {_FOLD_SQL} SELECT * FROM folds")
def fold_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.folds(_panel(spark, sf_dir))


@query(f"""WITH {PANEL_SQL}, n AS (SELECT entity, y, date, row_number() OVER (PARTITION BY entity, y ORDER BY md5(concat_ws('|', entity, CAST(date AS VARCHAR), '5'))) - 1 + CAST('0x' || substr(md5(concat_ws('|', entity, CAST(y AS VARCHAR), '5')), 1, 8) AS BIGINT) AS k FROM panel)
  SELECT entity, y AS year, CAST(k % 7 AS INT) AS part, count(*) AS n FROM n GROUP BY ALL""")
def mask_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mask.partitions(P.nation_day(spark, sf_dir), 5)
    return rows.groupBy("entity", F.year("date").cast("bigint").alias("year"), "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PANEL_SQL}, v AS (SELECT entity, date, y FROM panel WHERE target IS NOT NULL), l AS (SELECT entity, date, row_number() OVER (ORDER BY md5(concat_ws('|', entity, CAST(date AS VARCHAR), '2011')), entity, date) AS k FROM v WHERE y = (SELECT max(y) FROM v))
  SELECT p.y AS year, count(*) FILTER (p.y >= (SELECT max(y) FROM v)) AS hidden, count(l.entity) AS scored, count(*) AS n FROM panel p LEFT JOIN (SELECT * FROM l WHERE k <= 1200) l ON l.entity = p.entity AND l.date = p.date GROUP BY p.y""")
def context_past_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    rows = mask.context_of(panel, mask.folds(panel).where("mode = 'C'"))
    return rows.groupBy(F.year("date").cast("bigint").alias("year")).agg(F.count(F.when(F.col("hidden"), 1)).alias("hidden"), F.count(F.when(F.col("scored"), 1)).alias("scored"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PANEL_SQL}, {_FOLD_SQL}, f AS (SELECT * FROM folds WHERE mode = 'D' AND fold = 0), c AS (SELECT entity, min(cutoff_date) AS cut FROM f GROUP BY entity),
  r AS (SELECT p.*, (SELECT max(o.date) FROM panel o WHERE o.entity = p.entity AND o.target IS NOT NULL AND o.date < c.cut) AS remote, EXISTS (SELECT 1 FROM f WHERE f.entity = p.entity AND f.date = p.date) AS scored FROM panel p JOIN c USING (entity))
  SELECT entity, count(*) FILTER (target IS NOT NULL AND NOT scored AND date = remote) AS visible, count(*) FILTER (scored) AS scored FROM r GROUP BY entity""")
def context_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode D, fold 0: one visible observation per entity of the fold."""
    panel = _panel(spark, sf_dir)
    fold = mask.folds(panel).where("mode = 'D' and fold = 0")
    return mask.context_of(panel, fold).join(fold.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.count(F.when(~F.col("hidden") & F.col("target").isNotNull(), 1)).alias("visible"), F.count(F.when(F.col("scored"), 1)).alias("scored"))


# --- calendar windows --------------------------------------------------------------------------------------

_USER_SQL = """ud AS (SELECT CAST(user_id AS VARCHAR) AS entity, CAST(ts AS DATE) AS date, CAST(user_id % 4 AS VARCHAR) AS category,
    CAST(sum(CAST(value AS DECIMAL(16, 4))) FILTER (event_type = 'view') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'view'), 0) AS s2, CAST(sum(CAST(value AS DECIMAL(16, 4))) FILTER (event_type = 'click') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'click'), 0) AS landsat,
    CAST(sum(CAST(value AS DECIMAL(16, 4))) FILTER (event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'purchase'), 0) AS modis FROM events GROUP BY 1, 2, 3),
  up AS (SELECT *, coalesce(s2, landsat, modis) AS target FROM ud), ends AS (SELECT entity, year(date) AS y, min(date) AS a, max(date) AS b FROM up GROUP BY 1, 2),
  grid AS (SELECT entity, y, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
  sp AS (SELECT g.entity, g.y, g.date, CAST(g.date - DATE '1970-01-01' AS BIGINT) AS day, CAST(CAST(g.entity AS BIGINT) % 4 AS VARCHAR) AS category, s2, target FROM grid g LEFT JOIN up USING (entity, date)),
  fl AS (SELECT *, last_value(CASE WHEN s2 IS NOT NULL THEN day END IGNORE NULLS) OVER b AS ld, last_value(s2 IGNORE NULLS) OVER b AS lv, first_value(CASE WHEN s2 IS NOT NULL THEN day END IGNORE NULLS) OVER a AS rd, first_value(s2 IGNORE NULLS) OVER a AS rv
    FROM sp WINDOW b AS (PARTITION BY entity, y ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity, y ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {_USER_SQL} SELECT entity, date, category, target IS NOT NULL AS has_row, {r6('target')} FROM sp")
def calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.spine(P.user_day(spark, sf_dir)).select("entity", "date", "category", "has_row", "target"), "target")


@query(f"WITH {_USER_SQL} SELECT entity, date, CAST(least(366, coalesce(day - ld, 366)) AS INT) AS s2_since, CAST(least(366, coalesce(rd - day, 366)) AS INT) AS s2_until, {r6('CASE WHEN rd = ld THEN lv ELSE coalesce((lv * (rd - day) + rv * (day - ld)) / (rd - ld), lv, rv) END AS s2_filled')} FROM fl")
def deltas_since_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = windows.filled(windows.deltas(windows.spine(P.user_day(spark, sf_dir)), "s2"), "s2")
    return rounded(grid.select("entity", "date", "s2_since", "s2_until", "s2_filled"), "s2_filled")


@query(f"""WITH {PANEL_SQL}, s AS (SELECT category, (doy - 1 + delta + 366) % 366 + 1 AS doy, target AS v FROM panel, (SELECT unnest(generate_series(-12, 12)) AS delta) WHERE target IS NOT NULL)
  SELECT category, CAST(doy AS INT) AS doy, {r6("CASE WHEN count(*) >= 3 THEN quantile_cont(v, 0.5) END AS median")}, count(*) AS support FROM s GROUP BY category, doy""")
def doy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.doy_profile(P.nation_day(spark, sf_dir), "target", ["category"]), "median")


@query(f"""WITH {_USER_SQL}, w AS (SELECT q.entity, q.date, sum(v.target) AS total, count(v.target) AS seen, count(*) AS valid FROM sp q JOIN sp v ON v.entity = q.entity AND v.y = q.y AND abs(v.day - q.day) <= 30 GROUP BY q.entity, q.date)
  SELECT entity, date, CAST(61 AS INT) AS size, {r6("coalesce(total, 0) AS total")}, CAST(seen AS DOUBLE) AS seen, CAST(valid AS DOUBLE) AS valid FROM w""")
def centred_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.centred(windows.spine(P.user_day(spark, sf_dir)), ["target"])

    def total(k: int):
        return F.aggregate("window", F.lit(0.0), lambda s, x: s + F.get(x, k))

    return rounded(out.select("entity", "date", F.size("window").alias("size"), total(0).alias("total"), total(1).alias("seen"), total(2).alias("valid")), "total")


@query(f"""WITH {PANEL_SQL}, u AS (SELECT unnest(['s2', 'landsat', 'modis']) AS channel, unnest([s2, landsat, modis]) AS v FROM panel) SELECT channel, {r6("quantile_cont(v, 0.5) AS centre", "greatest(stddev_pop(v), 0.01) AS scale")} FROM u WHERE v IS NOT NULL GROUP BY channel""")
def robust_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.scaler(P.nation_day(spark, sf_dir), list(P.SPEC.sensors)), "centre", "scale")


# --- submissions -------------------------------------------------------------------------------------------


@query(f"""WITH {PANEL_SQL}, g AS (SELECT entity, date FROM drawn WHERE hidden), k AS (SELECT *, substr(md5(concat_ws('|', entity, CAST(date AS VARCHAR), '3')), 1, 2) AS h FROM g)
  SELECT type, n FROM (SELECT 'missing_key' AS type, count(*) AS n FROM k WHERE h < '04' OR h >= 'fc' UNION ALL SELECT 'nan_prediction', count(*) FROM k WHERE h >= '04' AND h < '08' UNION ALL SELECT 'string_prediction', count(*) FROM k WHERE h >= '08' AND h < '0c'
    UNION ALL SELECT 'inf_prediction', count(*) FROM k WHERE h >= '0c' AND h < '10' UNION ALL SELECT 'invalid_date', count(*) FROM k WHERE h >= 'fc' UNION ALL SELECT 'row_count_mismatch', 1) WHERE n > 0""")
def submission_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission with some rows left out, some dates broken and some predictions that are no numbers."""
    gaps = staged(P.hash_gaps(P.nation_day(spark, sf_dir)).where("hidden").select(F.col("entity").alias("anon_polygon_id"), "date"), "gaps")
    h = P.hash_byte("anon_polygon_id", "date", 3)
    rows = gaps.where(h >= "04")
    p = F.when(h < "08", "nan").when(h < "0c", "abc").when(h < "10", "-inf").otherwise("0.5")
    day = F.when(h >= "fc", F.concat(F.lit("x"), F.col("date").cast("string"))).otherwise(F.col("date").cast("string"))
    return hygiene.submission_violations(rows.select("anon_polygon_id", day.alias("date"), p.alias("primary_ndvi_pred")), gaps).select("type", "n")


@query("""SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(sha256(concat_ws(chr(31), l_linenumber, l_linestatus, l_orderkey, l_partkey, l_returnflag, l_suppkey)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM lineitem""")
def row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the columns whose text is the same in every engine."""
    return hygiene.row_digest(P.read(spark, sf_dir, "lineitem").select("l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey"))


# --- geometry, learners, streams ---------------------------------------------------------------------------


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square field for each customer, placed by its key; every tenth crosses itself."""
    k = F.col("c_custkey")
    lon, lat, side = F.pmod(k * 37, F.lit(340)) - 170.0, F.pmod(k * 17, F.lit(120)) - 60.0, 0.001 + F.pmod(k, F.lit(50)) / 1000
    text = F.when(k % 10 == 0, "%1$s,%2$s],[%3$s,%4$s],[%3$s,%2$s],[%1$s,%4$s],[%1$s,%2$s").otherwise("%1$s,%2$s],[%3$s,%2$s],[%3$s,%4$s],[%1$s,%4$s],[%1$s,%2$s")
    corners = [c.cast("string") for c in (lon, lat, lon + side, lat + side)]
    body = text
    for i, c in enumerate(corners, 1):
        body = F.replace(body, F.lit(f"%{i}$s"), c)
    return P.read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('{"type":"Polygon","coordinates":[[['), body, F.lit("]]]}")).alias("geojson"))


@query()
def geometry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected areas have no SQL; tests hold them against known fields."""
    from lacuna.operators import geo

    return rounded(geo.checked(_fields(spark, sf_dir), "geojson").select("c_custkey", "code", "vertices", "area_ha", "geometry_hash"), "area_ha")


@query("""WITH c AS (SELECT c_custkey, (c_custkey * 37) % 340 - 170.0 AS lon, (c_custkey * 17) % 120 - 60.0 AS lat, 0.001 + (c_custkey % 50) / 1000 AS side FROM customer)
  SELECT c_custkey FROM c WHERE lon <= 40 AND lon + side >= -30 AND lat <= 50 AND lat + side >= 10""")
def geometry_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.operators import geo

    rows = _fields(spark, sf_dir).withColumn("g", geo.from_geojson(F.col("geojson"))["coordinates"])
    return geo.in_box(rows, "g", (-30.0, 10.0, 40.0, 50.0)).select("c_custkey")


@query()
def gbt_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned member; its results depend on Spark's trees, so tests only hold it against the baselines."""
    from lacuna.operators import learn

    panel = _masked(spark, sf_dir)
    return learn.gbt_member(panel, reconstruct.context(panel)).select("entity", "date", "truth", "pred_gbt")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.streaming import events

    rows = events.tumbling(P.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 600 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 600 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, i""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.streaming import events

    rows = events.sessions(P.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "600 minutes")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("""SELECT o_custkey AS job_id, CASE WHEN count(*) >= 4 THEN 'COMPLETED' WHEN count(*) = 3 THEN 'ANALYZING' WHEN count(*) = 2 THEN 'RECONSTRUCTING' ELSE 'PREPROCESSING' END AS state, CAST(greatest(0, count(*) - 4) AS BIGINT) AS n_illegal FROM orders GROUP BY o_custkey""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order moves its customer's job one state on; a completed one stays."""
    from pyspark.sql import Window

    from lacuna.streaming import events

    rows = P.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).alias("seq"))
    names = F.array(*[F.lit(s) for s in ("PREPROCESSING", "RECONSTRUCTING", "ANALYZING", "COMPLETED")])
    changes = rows.select("job_id", "seq", F.get(names, F.least(F.col("seq"), F.lit(4)) - 1).alias("state"))
    first = rows.select("job_id").distinct().select("job_id", F.lit(0).alias("seq"), F.lit("FETCHING").alias("state"))
    return events.job_states(changes.unionAll(first))


@query(f"""WITH {PANEL_SQL} SELECT CAST(date AS VARCHAR) AS date, CASE WHEN target IS NULL THEN '' ELSE 'x' END AS seen, CASE WHEN s2 IS NULL THEN '1' ELSE '0' END AS gap FROM panel WHERE entity = 'NATION_3'""")
def export_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.sources import files

    rows = P.nation_day(spark, sf_dir).where("entity = 'NATION_3'")
    return files.export_series(rows.select("date", F.when(F.col("target").isNotNull(), "x").alias("seen"), F.col("s2").isNull().alias("gap")))


@query(f"""WITH {CONTEXT_SQL} SELECT entity, p.date, p.hidden AS is_reconstructed, {r6("coalesce(q.pred_linear, p.target) AS reconstructed")} FROM drawn p LEFT JOIN preds q USING (entity, date)""")
def product_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed values as they are, predictions at hidden keys."""
    panel = P.hash_gaps(_panel(spark, sf_dir))
    pred = _predicted(spark, sf_dir).select("entity", "date", "pred_linear")
    joined = panel.join(pred, ["entity", "date"], "left").select("entity", "date", F.col("hidden").alias("is_reconstructed"), F.coalesce("pred_linear", "target").alias("reconstructed"))
    return rounded(joined, "reconstructed")


@query(f"""WITH {PANEL_SQL}, {_BASE_SQL.format(threshold=-1)}, e AS (SELECT entity, i, min(date) AS s, max(date) AS e FROM isl WHERE c GROUP BY entity, i HAVING count(*) >= 2)
  SELECT concat_ws(':', e.entity, CAST(s AS VARCHAR), CAST(e AS VARCHAR)) AS event_id, count(p.date) FILTER (NOT p.hidden) AS observed, count(p.date) FILTER (p.hidden) AS reconstructed FROM e JOIN drawn p ON p.entity = e.entity AND p.date BETWEEN s AND e GROUP BY 1""")
def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = P.hash_gaps(_panel(spark, sf_dir))
    events = anomaly.baseline_events(anomaly.baseline_points(panel, "target", threshold=-1.0))
    return anomaly.event_points(events, panel.withColumn("is_observed", ~F.col("hidden"))).select("event_id", "observed", "reconstructed")


@query()
def features_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole core feature table; its blocks are queries of their own with SQL."""
    from lacuna.plans import features

    return features.core(_masked(spark, sf_dir, True))


@query(f"""WITH {PANEL_SQL}, v AS (SELECT entity, y, day, s2 FROM masked WHERE s2 IS NOT NULL), q AS (SELECT entity, y, date, day FROM masked WHERE hidden),
  p AS (SELECT q.entity, q.date, v.s2, q.day - v.day AS d, row_number() OVER (PARTITION BY q.entity, q.date ORDER BY v.day DESC) AS k FROM q JOIN v ON v.entity = q.entity AND v.y = q.y AND v.day < q.day),
  n AS (SELECT q.entity, q.date, v.s2, v.day - q.day AS d, row_number() OVER (PARTITION BY q.entity, q.date ORDER BY v.day) AS k FROM q JOIN v ON v.entity = q.entity AND v.y = q.y AND v.day > q.day),
  b AS (SELECT *, 1 AS s FROM p WHERE k <= 4 UNION ALL SELECT *, 2 FROM n WHERE k <= 4),
  a AS (SELECT entity, date, avg(s2) FILTER (d <= 21) AS m21, stddev_pop(s2) FILTER (d <= 21) AS s21, avg(s2) FILTER (d <= 45) AS m45, max(s2) FILTER (s = 1 AND k = 3) AS p3, max(d) FILTER (s = 2 AND k = 2) AS n2 FROM b GROUP BY entity, date),
  c AS (SELECT entity, y, count(*) AS n FROM v GROUP BY entity, y)
  SELECT entity, date, {r6("m21 AS s2_mean21", "s21 AS s2_std21", "m45 AS s2_mean45", "p3 AS s2_prev3")}, CAST(n2 AS INT) AS s2_next2_days, coalesce(c.n, 0) AS s2_count FROM q LEFT JOIN a USING (entity, date) LEFT JOIN c USING (entity, y)""")
def temporal_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.plans import features

    rows = features.temporal(_masked(spark, sf_dir), "s2", "s2").where("hidden")
    return rounded(rows.select("entity", "date", "s2_mean21", "s2_std21", "s2_mean45", "s2_prev3", "s2_next2_days", "s2_count"), "s2_mean21", "s2_std21", "s2_mean45", "s2_prev3")


# --- selections --------------------------------------------------------------------------------------------


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)) GROUP BY 1")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of every priority."""
    return evaluate.complete(P.read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = P.read(spark, sf_dir, "orders")
    return evaluate.page(orders, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query(f"""WITH {PANEL_SQL}, {_EVENTS_SQL}, x AS (SELECT entity, max(area * conf) AS score FROM ev GROUP BY entity), t AS (SELECT entity, score FROM x ORDER BY round(score, 9) DESC, entity LIMIT 3) SELECT entity, {r6("score")} FROM t""")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three entities with the strongest events: a top-k report."""
    best = anomaly.advanced_events(_scored(spark, sf_dir)).groupBy("entity").agg(F.max("score").alias("score"))
    return rounded(best.orderBy(F.desc(F.round("score", 9)), "entity").limit(3), "score")


@query(f"""WITH {PANEL_SQL}, {_BASE_SQL.format(threshold=-1)}, k AS (SELECT entity, i, min(date) AS s, max(date) AS e FROM isl WHERE c GROUP BY entity, i HAVING count(*) >= 2), f AS (SELECT entity, s + 1 AS s, e + 2 AS e FROM k WHERE month(s) <> 6),
  pp AS (SELECT k.entity, k.s, k.e, greatest(0, least(k.e, f.e) - greatest(k.s, f.s) + 1) AS b, (k.e - k.s + 1) + (f.e - f.s + 1) AS t, f.s - k.s AS d FROM k LEFT JOIN f ON f.entity = k.entity),
  rr AS (SELECT *, coalesce(b / (t - b), 0) AS iou FROM pp), m AS (SELECT entity, s, e, max(iou) AS iou, min(d) FILTER (iou = mx) AS d FROM (SELECT *, max(iou) OVER (PARTITION BY entity, s, e) AS mx FROM rr) GROUP BY entity, s, e)
  SELECT entity, s AS start_date, e AS end_date, {r6("iou")}, CASE WHEN iou > 0 THEN CAST(d AS INT) END AS delay_days FROM m""")
def event_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known events against shifted ones, some of them missing."""
    known = staged(anomaly.baseline_events(anomaly.baseline_points(_panel(spark, sf_dir), "target", threshold=-1.0)).select("entity", "start_date", "end_date"), "known-events")
    found = known.where(F.month("start_date") != 6).select("entity", F.date_add("start_date", 1).alias("start_date"), F.date_add("end_date", 2).alias("end_date"))
    return rounded(evaluate.overlap(found, known), "iou")
