"""More queries with their SQL: requests, reports, composed predictions and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import anomaly, asof, compose, evaluate, mask, reconstruct, reports, requests, season
from lacuna.plans.queries import _EVENTS_SQL, _FOLD_SQL, _USER_DAY_SQL, _USER_SQL, CONTEXT_SQL, PANEL_SQL, _masked, _panel, _predicted, _scored, query, r6, rounded
from lacuna.sources import files
from lacuna.sources import panel as P
from lacuna.staging import new_path, staged

_BEST = ("nearest_left", "nearest_right", "mean_neighbors", "linear", "seasonal_crop")


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN '  ' ELSE 'c' || o_custkey END AS entity, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderkey AS k FROM orders),
  u AS (SELECT entity, CASE WHEN k % 41 = 0 THEN replace(d, '-', '/') WHEN k % 43 = 0 THEN substr(d, 1, 4) || '-02-30' ELSE d END AS d FROM t),
  v AS (SELECT *, CASE WHEN trim(entity) = '' THEN 'blank_entity' WHEN NOT regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR TRY_CAST(d AS DATE) IS NULL THEN 'invalid_date' END AS p FROM u),
  w AS (SELECT *, count(*) FILTER (p IS NULL) OVER (PARTITION BY entity, d) AS n FROM v)
  SELECT coalesce(p, CASE WHEN n > 1 THEN 'duplicate_key' ELSE 'none' END) AS problem, count(*) AS n FROM w GROUP BY 1""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text keys, some of them blank, some with dates that are none."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    rows = P.read(spark, sf_dir, "orders").select(F.when(k % 50 == 0, "  ").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("entity"), F.when(k % 41 == 0, F.replace(d, F.lit("-"), F.lit("/"))).when(k % 43 == 0, F.concat(F.substring(d, 1, 4), F.lit("-02-30"))).otherwise(d).alias("date"))
    return requests.canonical_keys(rows).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PANEL_SQL}, q AS (SELECT *, CASE WHEN doy = 40 THEN NULL WHEN doy = 50 THEN true ELSE hidden END AS asked FROM drawn)
  SELECT problem, n FROM (SELECT 'mask_is_null' AS problem, count(*) FILTER (asked IS NULL) AS n FROM q UNION ALL SELECT 'asked_row_has_target', count(*) FILTER (asked AND target IS NOT NULL) FROM q UNION ALL SELECT 'mask_is_not_gap', count(*) FILTER (asked IS DISTINCT FROM hidden) FROM q) WHERE n > 0""")
def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request whose mask is broken on two days of each year."""
    doy = F.dayofyear("date")
    rows = P.hash_gaps(_panel(spark, sf_dir)).withColumn("is_gap", F.col("hidden"))
    rows = rows.withColumn("asked", F.when(doy == 40, F.lit(None).cast("boolean")).when(doy == 50, True).otherwise(F.col("hidden")))
    return requests.request_problems(rows, "competition")


_GAP = "CASE WHEN s2 IS NOT NULL THEN false WHEN target IS NULL THEN true END"


@query(f"""WITH {_USER_DAY_SQL}, r AS (SELECT *, {_GAP} AS gap FROM up), e AS (SELECT entity, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT year(date)) AS DOUBLE) AS years FROM r GROUP BY entity),
  u AS (SELECT unnest(['s2', 'landsat', 'modis', 'target', 'nothing']) AS name, unnest([count(*) - count(s2), count(*) - count(landsat), count(*) - count(modis), count(*) - count(target), count(*)]) AS value FROM r)
  SELECT 'missing' AS section, name, CAST(value AS DOUBLE) AS value FROM u UNION ALL SELECT 'infinite', name, 0 FROM u UNION ALL SELECT 'always_missing', 'nothing', 1
  UNION ALL SELECT 'rows_per_entity', unnest(['min', 'median', 'max']), unnest([min(n), quantile_cont(n, 0.5), max(n)]) FROM e UNION ALL SELECT 'years_per_entity', unnest(['min', 'median', 'max']), unnest([min(years), quantile_cont(years, 0.5), max(years)]) FROM e
  UNION ALL SELECT 'category', category, count(*) FROM r GROUP BY category UNION ALL SELECT 'gap_flag', coalesce(CAST(gap AS VARCHAR), 'null'), count(*) FROM r GROUP BY gap UNION ALL SELECT 'keys', 'repeated', count(*) - count(DISTINCT (entity, date)) FROM r""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(P.user_day(spark, sf_dir), "panel")
    gap = F.when(F.col("s2").isNotNull(), False).when(F.col("target").isNull(), True)
    rows = rows.withColumns({"gap": gap, "nothing": F.lit(None).cast("double")})
    return reports.quality_counts(rows, ["s2", "landsat", "modis", "target", "nothing"], "gap")


@query(f"""WITH {_USER_DAY_SQL}, u AS (SELECT unnest(['s2', 'landsat', 'modis', 'target']) AS "column", unnest([count(*) - count(s2), count(*) - count(landsat), count(*) - count(modis), count(*) - count(target)]) AS n, count(*) AS k FROM up)
  SELECT "column", {r6("n / k AS missing_rate")} FROM u ORDER BY n / k DESC, "column" LIMIT 3""")
def most_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three columns that lack most: a top-k report."""
    return rounded(reports.top_missing(P.user_day(spark, sf_dir), ["s2", "landsat", "modis", "target"], 3).select("column", "missing_rate"), "missing_rate")


_SEED = "CAST(CAST('0x' || substr(md5(concat_ws('|', entity, CAST(date AS VARCHAR), '23')), 1, 2) AS INT) % 5 AS INT)"


def _seeded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("repeat", (F.conv(P.hash_byte("entity", "date", 23), 16, 10).cast("int") % 5).cast("int"))


@query(f"""WITH {CONTEXT_SQL}, s AS (SELECT source, {_SEED} AS seed, sqrt(avg((pred_linear - truth) ** 2)) AS r FROM preds GROUP BY 1, 2)
  SELECT source, count(*) AS seeds, {r6("avg(r) AS mean", "stddev_samp(r) AS std", "min(r) AS least", "max(r) AS most")} FROM s GROUP BY source""")
def score_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _seeded(_predicted(spark, sf_dir))
    scores = rows.groupBy("source", "repeat").agg(evaluate.errors("truth", "pred_linear")[1])
    return rounded(reports.over_seeds(scores, ["source"], "rmse"), "mean", "std", "least", "most")


@query(f"""WITH {CONTEXT_SQL}, s AS (SELECT unnest({list(_BEST)}) AS method, unnest([{", ".join(f"sqrt(avg((pred_{m} - truth) ** 2))" for m in _BEST)}]) AS r FROM preds)
  SELECT method, {r6("r AS rmse")} FROM s ORDER BY r, method LIMIT 1""")
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir)
    one = rows.agg(*[evaluate.errors("truth", f"pred_{m}")[1].alias(m) for m in _BEST])
    scores = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("rmse")) for m in _BEST])).alias("x")).select("x.*")
    return rounded(reports.best(scores, "method", "rmse"), "rmse")


@query(f"WITH {PANEL_SQL} SELECT entity, date, category FROM panel QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date) <= 3")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each entity: the stated size of an extract."""
    return reports.head(P.nation_day(spark, sf_dir), 3).select("entity", "date", "category")


@query(f"""WITH {PANEL_SQL}, c AS (SELECT category, min(entity) AS entity FROM panel GROUP BY category)
  SELECT p.entity, p.date, p.category, {r6("target")} FROM panel p JOIN c ON c.entity = p.entity AND c.category = p.category QUALIFY row_number() OVER (PARTITION BY p.entity ORDER BY p.date) <= 30""")
def fixture_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.extract(_panel(spark, sf_dir)).select("entity", "date", "category", "target"), "target")


@query(f"""WITH {PANEL_SQL}, g AS (SELECT entity, date, date - CAST(row_number() OVER (PARTITION BY entity ORDER BY date) AS INT) AS i FROM drawn WHERE hidden),
  r AS (SELECT *, count(*) OVER (PARTITION BY entity, i) AS n, row_number() OVER (PARTITION BY entity, i ORDER BY date) - 1 AS position FROM g), f AS (SELECT *, min(i) OVER (PARTITION BY entity) AS first FROM r WHERE n >= 2)
  SELECT entity, date, position FROM f WHERE i = first AND position < 4""")
def first_gap_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_run(P.hash_gaps(P.nation_day(spark, sf_dir)), F.col("hidden"))


@query(f"""WITH {PANEL_SQL}, q AS (SELECT entity, date, y, target, hidden AND doy % 2 = 0 AS asked FROM masked),
  s AS (SELECT *, count(*) FILTER (NOT asked) OVER (PARTITION BY entity, y ORDER BY date) AS run FROM q WHERE asked OR target IS NOT NULL)
  SELECT entity, date, count(*) OVER (PARTITION BY entity, y, run) AS gap_length, row_number() OVER (PARTITION BY entity, y, run ORDER BY date) - 1 AS gap_position FROM s WHERE asked""")
def requested_run_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only hidden rows on even days are asked for."""
    rows = _masked(spark, sf_dir).withColumn("asked", F.col("hidden") & (F.dayofyear("date") % 2 == 0))
    return mask.requested_runs(rows, "asked")


@query(f"""WITH {PANEL_SQL}, p AS (SELECT entity, date, y, row_number() OVER (PARTITION BY entity, y ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY entity, y) AS n FROM panel),
  k AS (SELECT entity, y, unnest(generate_series(0, CAST(n // 2 AS BIGINT))) AS run FROM (SELECT DISTINCT entity, y, n FROM p)),
  l AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', entity, CAST(y AS VARCHAR), CAST(run AS VARCHAR), '9')), 1, 8) AS BIGINT) % 5 + 1 AS size FROM k), b AS (SELECT *, sum(size + 1) OVER (PARTITION BY entity, y ORDER BY run) - size - 1 AS a FROM l)
  SELECT p.entity, p.date, CAST(b.run AS INT) AS run FROM p LEFT JOIN b ON b.entity = p.entity AND b.y = p.y AND p.pos >= b.a AND p.pos < b.a + b.size""")
def run_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.run_lengths(_panel(spark, sf_dir), 9).select("entity", "date", "run")


def _profile_sql(name: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"{name} AS (SELECT {k}(doy - 1 + delta + 366) % 366 + 1 AS doy, quantile_cont(target, 0.5) AS m FROM masked, (SELECT unnest(generate_series(-12, 12)) AS delta) WHERE target IS NOT NULL GROUP BY {k}2 HAVING count(*) >= 6)".replace("GROUP BY 2", "GROUP BY 1") if not keys else f"{name} AS (SELECT {k}(doy - 1 + delta + 366) % 366 + 1 AS doy, quantile_cont(target, 0.5) AS m FROM masked, (SELECT unnest(generate_series(-12, 12)) AS delta) WHERE target IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 6)"


@query(f"""WITH {PANEL_SQL}, {_profile_sql("a", "entity")}, {_profile_sql("b", "category")}, {_profile_sql("c", "")}
  SELECT q.entity, q.date, {r6("coalesce(a.m, b.m, c.m) AS profile_prior")}, CAST(CASE WHEN a.m IS NOT NULL THEN 2 WHEN b.m IS NOT NULL THEN 1 ELSE 0 END AS INT) AS profile_level FROM (SELECT * FROM masked WHERE hidden) q
    LEFT JOIN a ON a.entity = q.entity AND a.doy = q.doy LEFT JOIN b ON b.category = q.category AND b.doy = q.doy LEFT JOIN c ON c.doy = q.doy""")
def profile_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _masked(spark, sf_dir)
    out = season.profile_prior(panel.where("hidden"), panel, "target")
    return rounded(out.select("entity", "date", "profile_prior", F.col("profile_level").cast("int").alias("profile_level")), "profile_prior")


_COMPOSED_SQL = f"""{CONTEXT_SQL}, m AS (SELECT *, CASE WHEN doy % 7 <> 0 THEN 0.7 * pred_linear + 0.3 * pred_seasonal_crop END AS b, left_days IS NULL OR right_days IS NULL OR least(left_days, right_days) > 15 AS g FROM preds),
  v AS (SELECT *, CASE WHEN b IS NULL THEN pred_mean_neighbors WHEN g THEN 0.5 * b + 0.5 * pred_mean_neighbors ELSE b END AS raw FROM m),
  x AS (SELECT *, greatest(0.1, least(0.9, raw)) AS p FROM v)"""


def _composed(rows: DataFrame) -> DataFrame:
    """Two members, one of which has no number on every seventh day, a gate and a clip."""
    rows = rows.withColumn("pred_first", F.when(F.dayofyear("date") % 7 != 0, F.col("pred_linear")))
    gate = reconstruct.gate_mask("long_one_sided", F.col("left_days"), F.col("right_days"))
    return compose.predict(rows, {"pred_first": 0.7, "pred_seasonal_crop": 0.3}, "pred_mean_neighbors", gate, clip=(0.1, 0.9))


@query(f"""WITH {_COMPOSED_SQL} SELECT entity, date, {r6("p AS prediction", "p - 1 AS lower", "p + 1 AS upper")}, CASE WHEN b IS NULL THEN 'pred_mean_neighbors' WHEN g THEN 'conservative_blend' ELSE 'blend' END AS method,
  CASE WHEN b IS NULL THEN 'nonfinite_model_prediction' WHEN g THEN 'conservative_gate' ELSE '' END AS fallback_reason,
  concat_ws(',', CASE WHEN left_days IS NULL OR right_days IS NULL THEN 'one_sided_or_no_context' END, 'interval_not_coverage_certified', CASE WHEN b IS NULL THEN 'model_nonfinite_replaced' END) AS quality_flags FROM x""")
def composed_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _composed(_predicted(spark, sf_dir)).withColumn("quality_flags", F.array_join("quality_flags", ","))
    return rounded(out.select("entity", "date", "prediction", "lower", "upper", "method", "fallback_reason", "quality_flags"), "prediction", "lower", "upper")


_LEFT_OUT = "substr(md5(concat_ws('|', entity, CAST(date AS VARCHAR), '31')), 1, 2) < '08'"


@query(f"""WITH {_COMPOSED_SQL}, k AS (SELECT entity, date, p FROM x WHERE NOT {_LEFT_OUT}), s AS (SELECT d.entity, count(*) AS n, count(*) FILTER (NOT d.hidden AND d.target IS NOT NULL) AS seen, count(k.p) AS made FROM drawn d LEFT JOIN k ON k.entity = d.entity AND k.date = d.date GROUP BY 1)
  SELECT entity, n, seen AS observed, made AS reconstructed, concat_ws(',', CASE WHEN n = seen THEN 'NO_GAPS' END, CASE WHEN n > seen AND seen = 0 THEN 'NO_OBSERVATIONS' END, CASE WHEN n - seen > made AND seen > 0 THEN 'POINTS_OUTSIDE_MODEL_DATASET' END) AS warnings FROM s""")
def series_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions lack some of the keys that are asked for, so series stay empty there and say so."""
    made = _composed(_predicted(spark, sf_dir)).where(P.hash_byte("entity", "date", 31) >= "08")
    points = staged(compose.series(_masked(spark, sf_dir), made), "points")
    n = points.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_observed"), 1)).alias("observed"), F.count(F.when(F.col("is_reconstructed"), 1)).alias("reconstructed"))
    return n.join(compose.series_warnings(points), "entity").select("entity", "n", "observed", "reconstructed", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {PANEL_SQL}, near AS (SELECT *, last_value(target IGNORE NULLS) OVER b AS lv, first_value(target IGNORE NULLS) OVER a AS rv FROM masked
    WINDOW b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT entity, date, {r6("coalesce((lv + rv) / 2, lv, rv) AS prediction")}, CASE WHEN lv IS NOT NULL AND rv IS NOT NULL THEN 'stub_mean_of_neighbours' WHEN coalesce(lv, rv) IS NOT NULL THEN 'stub_single_neighbour' ELSE 'stub_no_context' END AS method FROM near WHERE hidden""")
def stub_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof.nearest(_masked(spark, sf_dir), "target").where("hidden")
    return rounded(compose.stub(rows).select("entity", "date", "prediction", "method"), "prediction")


@query(f"WITH {PANEL_SQL} SELECT count(*) AS asked, count(*) FILTER (NOT {_LEFT_OUT}) AS found, count(*) FILTER ({_LEFT_OUT}) AS left_out FROM drawn WHERE hidden")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run that lacks some of the keys."""
    gaps = P.hash_gaps(_panel(spark, sf_dir)).where("hidden")
    _, counts = compose.looked_up(gaps, gaps.where(P.hash_byte("entity", "date", 31) >= "08"))
    return counts


@query(f"""WITH {CONTEXT_SQL}, r AS (SELECT entity, date, category AS fold, source, abs(pred_linear - truth) AS e FROM preds), f AS (SELECT DISTINCT fold FROM r),
  pool AS (SELECT f.fold, r.source, r.e FROM f JOIN r ON r.fold <> f.fold), lab AS (SELECT fold, source AS label, e FROM pool UNION ALL SELECT fold, 'global', e FROM pool),
  rk AS (SELECT fold, label, e, row_number() OVER (PARTITION BY fold, label ORDER BY e) AS k, count(*) OVER (PARTITION BY fold, label) AS n FROM lab),
  rad AS (SELECT fold, label, level, min(e) AS radius FROM rk, (SELECT unnest([0.8, 0.95]) AS level) WHERE (label = 'global' OR n >= 60) AND k >= ceil(least(1.0, ceil((n + 1) * CAST(level AS DOUBLE)) / n) * (n - 1)) + 1 GROUP BY ALL),
  j AS (SELECT r.fold, a.level, r.e, coalesce(o.radius, a.radius) AS radius FROM r JOIN rad a ON a.fold = r.fold AND a.label = 'global' LEFT JOIN rad o ON o.fold = r.fold AND o.label = r.source AND o.level = a.level)
  SELECT fold, CAST(level AS DOUBLE) AS level, count(*) AS n, {r6("avg(CASE WHEN e <= radius THEN 1.0 ELSE 0.0 END) AS coverage", "avg(2 * radius) AS mean_width")} FROM j GROUP BY 1, 2""")
def coverage_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories are the folds."""
    out = compose.coverage_by_fold(_predicted(spark, sf_dir), "category", "truth", "pred_linear", F.col("source"))
    return rounded(out, "coverage", "mean_width")


@query(f"""WITH {PANEL_SQL}, {_EVENTS_SQL}, x AS (SELECT entity, count(*) AS events, max(area * conf) AS score, count(*) FILTER (sw OR conf < 0.55) AS risky FROM ev GROUP BY entity),
  s AS (SELECT entity, coalesce(events, 0) AS events, round(coalesce(score, 0), 9) AS score, coalesce(risky, 0) AS risky, unsupported FROM (SELECT entity, count(*) FILTER (target IS NULL) AS unsupported FROM panel GROUP BY entity) LEFT JOIN x USING (entity)),
  a AS (SELECT entity, row_number() OVER (ORDER BY score DESC, entity) AS place, events FROM s), b AS (SELECT * FROM a WHERE place <= 3 AND events > 0),
  d AS (SELECT entity, row_number() OVER (ORDER BY risky DESC, unsupported DESC, score DESC, entity) AS place FROM s WHERE entity NOT IN (SELECT entity FROM b))
  SELECT 'strong_candidate' AS review_group, CAST(place AS INT) AS place, entity FROM b UNION ALL SELECT 'questionable_control', CAST(place AS INT), entity FROM d WHERE place <= 3""")
def review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities to look at: three with the strongest events, three that are least certain."""
    events = anomaly.advanced_events(_scored(spark, sf_dir))
    risky = F.array_contains("reason_codes", "SOURCE_SWITCH_RISK") | (F.col("confidence") < 0.55)
    per = events.groupBy("entity").agg(F.count(F.lit(1)).alias("events"), F.round(F.max("score"), 9).alias("max_score"), F.count(F.when(risky, 1)).alias("risky_events"))
    every = _panel(spark, sf_dir).groupBy("entity").agg(F.count(F.when(F.col("target").isNull(), 1)).alias("unsupported"))
    return compose.cases(every.join(per, "entity", "left").na.fill(0, ["events", "max_score", "risky_events"]))


@query(f"""WITH {PANEL_SQL} SELECT count(*) AS rows, count(DISTINCT entity) AS entities, min(date) AS first_date, max(date) AS last_date, count(target) AS targets, {r6("sum(target) AS total")}, CAST(0 AS BIGINT) AS repeated_keys FROM panel""")
def control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(files.control_totals(_panel(spark, sf_dir), ("entity", "date"), "target"), "total")


@query(f"WITH {PANEL_SQL}, {_FOLD_SQL} SELECT mode, repeat, fold, count(*) AS n, count(DISTINCT entity) AS entities, min(date) AS first_date FROM folds GROUP BY ALL")
def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds written and read again."""
    path = new_path(spark, "folds")
    files.save_folds(mask.folds(_panel(spark, sf_dir)), path)
    return files.load_folds(spark, path).groupBy("mode", "repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.min("date").alias("first_date"))


@query(f"WITH {CONTEXT_SQL} SELECT entity AS anon_polygon_id, CAST(date AS VARCHAR) AS date, printf('%.4f', round(pred_linear + 1e-9, 4)) AS primary_ndvi_pred FROM preds")
def submission_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as a submission and read again as text."""
    path = new_path(spark, "submission")
    rows = _predicted(spark, sf_dir).select(F.col("entity").alias("anon_polygon_id"), "date", F.round(F.col("pred_linear") + 1e-9, 4).alias("primary_ndvi_pred"))
    files.write_submission(rows, path, 4)
    return files.read_submission(spark, path)


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice count once."""
    from lacuna.streaming import events

    rows = P.read(spark, sf_dir, "events")
    return events.deduplicated(rows.unionAll(rows)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query()
def features_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole delivered feature table; its blocks are queries of their own with SQL."""
    from lacuna.plans import features

    return features.delivered(_masked(spark, sf_dir, True))


@query()
def source_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned, so tests only hold it against chance."""
    from lacuna.operators import learn

    label = F.when(F.col("s2").isNotNull(), "s2").when(F.col("landsat").isNotNull(), "landsat").otherwise("modis")
    rows = learn.training_rows(_panel(spark, sf_dir).withColumn("source", label))
    return learn.source_classifier(staged(rows, "training"), "source").select("entity", "date", "source", "source_guess")


_TEMPLATES = """t0 AS (SELECT entity, date, month(date) AS month, category, row_number() OVER (ORDER BY entity, date) AS template FROM masked WHERE hidden),
  asked AS (SELECT template, CAST(template % 9 + 1 AS INT) AS length0, month, CASE WHEN template % 50 = 0 THEN 'NOWHERE' ELSE category END AS category FROM t0 WHERE substr(md5(concat_ws('|', entity, CAST(date AS VARCHAR), 't')), 1, 1) IN ('0', '1'))"""


@query(f"""WITH RECURSIVE {PANEL_SQL}, {_TEMPLATES},
  tmpl AS (SELECT template, least(length0, 8) AS length, month, category, md5(concat_ws('|', CAST(template AS VARCHAR), '5')) AS o FROM asked),
  slots AS (SELECT entity, y, min(category) AS category, list(date ORDER BY date) AS dates FROM masked WHERE target IS NOT NULL GROUP BY entity, y),
  turns AS (SELECT *, md5(concat_ws('|', entity, CAST(y AS VARCHAR), '5')) AS o FROM slots),
  years AS (SELECT entity, y, category, row_number() OVER (PARTITION BY category ORDER BY o, entity, y) - 1 AS turn, count(*) OVER (PARTITION BY category) AS n FROM turns
    UNION ALL SELECT entity, y, '*', row_number() OVER (ORDER BY o, entity, y) - 1, count(*) OVER () FROM turns),
  homes AS (SELECT t.*, CASE WHEN t.category IN (SELECT category FROM slots) THEN t.category ELSE '*' END AS home FROM tmpl t),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY o, template) - 1 AS k FROM homes),
  dealt AS (SELECT r.template, r.length, r.month, r.o, z.entity, z.y FROM ranked r JOIN (SELECT DISTINCT category, n FROM years) c ON c.category = r.home JOIN years z ON z.category = r.home AND z.turn = r.k % c.n),
  lined AS (SELECT *, row_number() OVER (PARTITION BY entity, y ORDER BY o, template) AS step FROM dealt),
  scan AS (
    SELECT entity, y, 0 AS step, [false FOR d IN dates] AS taken, CAST(NULL AS BIGINT) AS template, CAST(NULL AS BIGINT) AS at FROM slots
    UNION ALL
    SELECT entity, y, step, CASE WHEN spot IS NULL THEN taken ELSE [taken[i + 1] OR (i >= spot % 1000 - 1 AND i <= spot % 1000 + length) FOR i IN range(len(taken))] END, template, spot % 1000
    FROM (SELECT s.entity, s.y, l.step, s.taken, l.template, l.length,
        list_min([least(abs(month(z.dates[i + 1]) - l.month), 12 - abs(month(z.dates[i + 1]) - l.month)) * 1000 + i FOR i IN range(len(s.taken) - l.length + 1) IF NOT list_contains(s.taken[i + 1:i + l.length], true)]) AS spot
      FROM scan s JOIN lined l ON l.entity = s.entity AND l.y = s.y AND l.step = s.step + 1 JOIN slots z ON z.entity = s.entity AND z.y = s.y))
  SELECT d.template, d.length, d.entity, CAST(d.y AS INT) AS year, z.dates[s.at + 1] AS first_date, z.dates[s.at + d.length] AS last_date
  FROM dealt d JOIN scan s ON s.template = d.template JOIN slots z ON z.entity = d.entity AND z.y = d.y""")
def matched_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs like those of the hidden rows, placed among the visible ones."""
    from lacuna.operators.ranks import numbered

    panel = staged(_masked(spark, sf_dir), "masked")
    rows = numbered(panel.where("hidden").select("entity", "date", "category"), [F.col("entity"), F.col("date")], "n").withColumn("template", F.col("n") + 1)
    drawn = F.substring(F.md5(F.concat_ws("|", "entity", F.col("date").cast("string"), F.lit("t"))), 1, 1)
    asked = rows.where(drawn.isin("0", "1")).select("template", (F.col("template") % 9 + 1).cast("int").alias("length"), F.month("date").alias("month"), F.when(F.col("template") % 50 == 0, "NOWHERE").otherwise(F.col("category")).alias("category"))
    return mask.matched_runs(panel, asked, 5)


_CHANNELS, _HALF, _BOUNDS = ("target", "s2", "landsat"), 7, (5.0, 120.0)


def _window_sql(mode: str) -> str:
    """All numbers of a row's window, each summed over its days with the day's place as weight."""
    seen = ", ".join(f"CASE WHEN {c} BETWEEN {_BOUNDS[0]} AND {_BOUNDS[1]} THEN {c} END AS v_{c}, coalesce({c} NOT BETWEEN {_BOUNDS[0]} AND {_BOUNDS[1]}, false) AS b_{c}" for c in _CHANNELS)
    near = ", ".join(f"last_value(CASE WHEN v_{c} IS NOT NULL THEN day END IGNORE NULLS) OVER b AS l_{c}, first_value(CASE WHEN v_{c} IS NOT NULL THEN day END IGNORE NULLS) OVER a AS r_{c}" for c in _CHANNELS)
    x = "v_target" if mode == "filled" else "(v_target - prior)"
    ends = f"last_value({x} IGNORE NULLS) OVER b AS lv, first_value({x} IGNORE NULLS) OVER a AS rv"
    line = "CASE WHEN r_target = l_target THEN lv ELSE coalesce((lv * (r_target - day) + rv * (day - l_target)) / (r_target - l_target), lv, rv) END"
    base = f"coalesce({line}, prior)" if mode == "filled" else f"prior + coalesce({line}, 0)"
    z = "(({0}) - (SELECT centre FROM sc WHERE channel = '{1}')) / (SELECT scale FROM sc WHERE channel = '{1}')"
    own = [f"coalesce({z.format(f'v_{c}', c)}, 0)" for c in _CHANNELS] + [f"CAST(v_{c} IS NOT NULL AS DOUBLE)" for c in _CHANNELS] + [f"CAST(b_{c} AS DOUBLE)" for c in _CHANNELS]
    own += [f"ln(1 + least(366, coalesce(day - l_{c}, 366)))" for c in _CHANNELS] + [f"ln(1 + least(366, coalesce(r_{c} - day, 366)))" for c in _CHANNELS]
    phase = "2 * pi() * (dayofyear(date) - 1) / dayofyear(make_date(year(date), 12, 31))"
    own += [f"sin({phase})", f"cos({phase})", "1.0", z.format(base, "target"), z.format("prior", "target"), "1.0"]
    made = ", ".join(f"{f} AS f{k}" for k, f in enumerate(own))
    out = r6(*[f"sum((v.day - q.day + {_HALF + 1}) * v.f{k}) AS f{k}" for k in range(len(own))])
    return f"""WITH {_USER_SQL}, sp3 AS (SELECT sp.*, up.landsat FROM sp LEFT JOIN up USING (entity, date)), u AS (SELECT unnest(['target', 's2', 'landsat']) AS channel, unnest([target, s2, landsat]) AS v FROM up),
      sc AS (SELECT channel, quantile_cont(v, 0.5) AS centre, greatest(stddev_pop(v), 0.01) AS scale FROM u WHERE v IS NOT NULL GROUP BY channel),
      pr AS (SELECT category, quantile_cont(target, 0.5) AS prior FROM up WHERE target IS NOT NULL GROUP BY category),
      se AS (SELECT entity, y, date, day, prior, {seen} FROM sp3 JOIN pr USING (category)),
      ne AS (SELECT *, {near}, {ends} FROM se WINDOW b AS (PARTITION BY entity, y ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity, y ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      own AS (SELECT entity, y, date, day, {made} FROM ne)
      SELECT q.entity, q.date, {out} FROM own q JOIN own v ON v.entity = q.entity AND v.y = q.y AND abs(v.day - q.day) <= {_HALF} GROUP BY q.entity, q.date"""


def _window_rows(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    from lacuna.operators import windows
    from lacuna.operators.ranks import few, quantiles

    panel = staged(P.user_day(spark, sf_dir), "user-days")
    found = quantiles(panel.where("target is not null").select("category", "target"), ["category"], "target", (0.5,))
    priors = staged(found.select("category", F.get("q", 0).alias("prior")), "category-priors")
    grid = windows.spine(panel).join(few(priors, priors.count()), "category")
    out = windows.features(grid, list(_CHANNELS), windows.scaler(panel, list(_CHANNELS)), F.col("prior"), F.lit(1.0), _BOUNDS, _HALF, mode)
    size = 5 * len(_CHANNELS) + 6

    def total(k: int):
        return F.aggregate(F.transform("window", lambda x, j: (j + 1) * F.get(x, k)), F.lit(0.0), lambda s, x: s + x)

    ok = F.when((F.size("window") == 2 * _HALF + 1) & F.forall("window", lambda x: F.size(x) == size), F.col("entity"))
    return rounded(out.select(ok.alias("entity"), "date", *[total(k).alias(f"f{k}") for k in range(size)]), *[f"f{k}" for k in range(size)])


@query(_window_sql("filled"))
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole windows of 5C + 6 numbers a day."""
    return _window_rows(spark, sf_dir, "filled")


@query(_window_sql("anchored"))
def window_features_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_rows(spark, sf_dir, "anchored")


@query(f"""WITH {PANEL_SQL}, u AS (SELECT unnest(['target', 's2', 'landsat', 'modis', 'truth', 'category']) AS name, unnest([target IS NOT NULL, s2 IS NOT NULL, landsat IS NOT NULL, modis IS NOT NULL, truth IS NOT NULL, category IS NOT NULL]) AS there FROM masked WHERE hidden)
  SELECT name FROM u GROUP BY name HAVING NOT bool_or(there)""")
def gap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that no hidden row has: what a mask has to hide."""
    found = mask.mask_columns(_masked(spark, sf_dir).where("hidden"), ["target", "s2", "landsat", "modis", "truth", "category"])
    return spark.createDataFrame([(c,) for c in found], "name string")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderkey % 4 < 2 AND o_orderkey % 5 > 0) AS gaps, count(*) FILTER (o_orderkey % 4 >= 2 AND o_orderkey % 5 > 0) AS others, count(*) FILTER (o_orderkey % 5 = 0) AS unknown FROM orders GROUP BY 1""")
def parsed_gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as texts in several spellings, read as booleans."""
    from lacuna.functions.scalar import bool_of

    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, None).otherwise(F.get(F.array(*map(F.lit, (" TRUE", "1", "false ", "0"))), (k % 4).cast("int")))
    rows = P.read(spark, sf_dir, "orders").withColumn("gap", bool_of(text))
    return rows.groupBy("o_orderpriority").agg(F.count(F.when(F.col("gap"), 1)).alias("gaps"), F.count(F.when(~F.col("gap"), 1)).alias("others"), F.count(F.when(F.col("gap").isNull(), 1)).alias("unknown"))


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE 'c' || (o_custkey % 40) END AS entity, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR * (CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE 0 END) AS date,
    CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END AS category, CASE WHEN o_orderkey % 17 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN o_orderkey % 13 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS target,
    CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 11 < 2 END AS is_gap FROM orders),
  r AS (SELECT unnest(['blank_entity', 'date_with_time', 'missing_category', 'not_finite:target', 'null_gap_flag', 'value_on_gap_row', 'duplicate_key', 'missing_column:doy', 'not_numeric:s2']) AS rule,
    unnest([count(*) FILTER (trim(entity) = ''), count(*) FILTER (date <> date_trunc('day', date)), count(*) FILTER (category IS NULL), count(*) FILTER (isnan(target) OR isinf(target)), count(*) FILTER (is_gap IS NULL), count(*) FILTER (is_gap), count(*) - count(DISTINCT (entity, date)), 1, 1]) AS n FROM o)
  SELECT rule, CAST(n AS BIGINT) AS n FROM r WHERE n > 0""")
def panel_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a panel that breaks most rules: of its columns, its keys, its values and its flags. Every row has s2, as text."""
    from lacuna.operators import hygiene

    k = F.col("o_orderkey")
    late = F.col("o_orderdate").cast("timestamp") + F.when(k % 9 == 0, F.expr("interval 5 hours")).otherwise(F.expr("interval 0 hours"))
    value = F.when(k % 17 == 0, float("inf")).when(k % 13 == 0, float("nan")).when(k % 11 != 0, F.col("o_totalprice").cast("double"))
    rows = P.read(spark, sf_dir, "orders").select(F.when(k % 50 == 0, " ").otherwise(F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string"))).alias("entity"), late.alias("date"), F.when(k % 31 != 0, F.col("o_orderpriority")).alias("category"), value.alias("target"), F.col("o_orderstatus").alias("s2"), F.when(k % 19 != 0, k % 11 < 2).alias("is_gap"))
    return hygiene.violations(rows, required=("doy",))


_RUN_MEMBERS = {"pred_linear": 5.0, "pred_seasonal_crop": 3.0, "pred_mean_neighbors": 2.0}
_RUN_MEAN = " + ".join(f"{w / 10} * {m}" for m, w in _RUN_MEMBERS.items())


@query(f"""WITH {CONTEXT_SQL}, u AS (SELECT entity, date, 2 * ({_RUN_MEAN}) AS p, sqrt({" + ".join(f"{w / 10} * ({m} - ({_RUN_MEAN})) ** 2" for m, w in _RUN_MEMBERS.items())}) AS disagreement,
    coalesce(year(date - CAST(left_days AS INT)) = y, false) AS l, coalesce(year(date + CAST(right_days AS INT)) = y, false) AS r FROM preds)
  SELECT entity, date, {r6("p - 0.06 AS lower", "p + 0.06 AS upper", "disagreement")}, 'interval_empirical_not_conformal,harmonization_not_applied,interval_width_from_documentation' || CASE WHEN NOT l AND NOT r THEN ',no_same_season_context' WHEN l <> r THEN ',one_sided_context' ELSE '' END
    || CASE WHEN p > 1 OR p < -1 THEN ',prediction_outside_physical_range' ELSE '' END AS quality_flags FROM u""")
def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of three members whose prediction is twice their mean, so that some lie outside the physical range."""
    rows = staged(_predicted(spark, sf_dir), "predicted")
    mean = sum((w / 10 * F.col(m) for m, w in _RUN_MEMBERS.items()), F.lit(0.0))
    left, right = compose.same_season(F.col("left_days"), -1), compose.same_season(F.col("right_days"), 1)
    out = compose.run_diagnostics(rows.withColumn("prediction", 2 * mean), "prediction", _RUN_MEMBERS, left, right, 0.06, False)
    return rounded(out.select("entity", "date", "lower", "upper", "disagreement", F.array_join("quality_flags", ",").alias("quality_flags")), "lower", "upper", "disagreement")
