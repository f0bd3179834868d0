"""Queries of learned members, what columns are worth, the search among candidates, and saved state, with SQL where it can fit the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import anomaly, learn, season
from lacuna.plans.queries import _SCORE_SQL, CONTEXT_SQL, ORACLES, PANEL_SQL, _masked, _predicted, _scored, query, r6, rounded
from lacuna.sources import bundle
from lacuna.sources import panel as P
from lacuna.staging import new_path, staged

CLASSES = P.SPEC.sensors


def _class_sql(expression: str) -> str:
    """An expression of each class, {c}, as columns."""
    return ", ".join(expression.format(c=c) for c in CLASSES)


@query(f"""WITH {CONTEXT_SQL}, r AS (SELECT entity, date, category, source, truth, pred_linear, CAST('0x' || substr(md5(concat_ws('|', entity, '41')), 1, 2) AS INT) % 3 AS part FROM preds),
  fit_on AS (SELECT k.part AS held, r.* FROM (SELECT DISTINCT part FROM r) k JOIN r ON r.part <> k.part),
  own AS (SELECT held, category, {_class_sql("count(*) FILTER (source = '{c}') / count(*) AS own_{c}")} FROM fit_on GROUP BY held, category),
  every AS (SELECT held, {_class_sql("count(*) FILTER (source = '{c}') / count(*) AS all_{c}, CASE WHEN count(*) FILTER (source = '{c}') >= 50 THEN avg(truth - pred_linear) FILTER (source = '{c}') ELSE 0 END AS shift_{c}")} FROM fit_on GROUP BY held),
  x AS (SELECT r.*, {_class_sql("coalesce(own_{c}, all_{c}) AS p_{c}, pred_linear + shift_{c} AS expert_{c}")} FROM r JOIN every e ON e.held = r.part LEFT JOIN own o ON o.held = r.part AND o.category = r.category)
  SELECT entity, date, {r6(*[f"{k}_{c} AS {k}_{c}" for c in CLASSES for k in ("p", "expert")], " + ".join(f"p_{c} * expert_{c}" for c in CLASSES) + " AS pred_experts")} FROM x""")
def expert_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts of one number each and shares of classes, out of fold: the protocol of the learned ones, which SQL can repeat."""
    rows = _predicted(spark, sf_dir)
    learner = learn.source_experts("source", CLASSES, learn.frequencies("source", ["category"], CLASSES), learn.mean_residual("pred_linear"), "pred_linear")
    names = [f"{k}_{c}" for c in CLASSES for k in ("p", "expert")] + ["pred_experts"]
    return rounded(learn.cross_fitted(rows, learner).select("entity", "date", *names), *names)


@query()
def source_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest and trees; tests hold probabilities, weights and error against the plain line."""
    rows = learn.calendar(_predicted(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in learn.FEATURES if c not in ("sin_doy", "cos_doy")})
    learner = learn.source_experts("source", CLASSES, learn.forest_probabilities("source", CLASSES), learn.boosted_residual("pred_linear"), "pred_linear")
    return learn.cross_fitted(rows, learner).select("entity", "date", "source", "truth", "pred_linear", *[f"p_{c}" for c in CLASSES], "pred_experts")


_MEMBERS = {"pred_linear": 0.5, "pred_seasonal_crop": 0.3, "pred_mean_neighbors": 0.2}


def _blend_sql(swapped: str | None = None) -> str:
    return " + ".join(f"{w} * {'d' if m == swapped else 'q'}.{m}" for m, w in _MEMBERS.items())


@query(f"""WITH {CONTEXT_SQL}, q AS (SELECT category AS fold, entity, date, truth, {", ".join(_MEMBERS)}, row_number() OVER (PARTITION BY category ORDER BY entity, date) AS n FROM preds),
  d AS (SELECT *, row_number() OVER (PARTITION BY fold, rep ORDER BY md5(concat_ws('|', entity, CAST(date AS VARCHAR), CAST(11 + rep AS VARCHAR))), entity, date) AS dn FROM q, (SELECT unnest([0, 1]) AS rep)),
  j AS (SELECT q.fold, d.rep, q.truth, unnest({list(_MEMBERS)}) AS feature, unnest([{", ".join(_blend_sql(m) for m in _MEMBERS)}]) AS p FROM q JOIN d ON d.fold = q.fold AND d.dn = q.n),
  o AS (SELECT fold, count(*) AS n, sqrt(avg(({_blend_sql()} - truth) ** 2)) AS rmse FROM q GROUP BY fold), s AS (SELECT fold, feature, rep, sqrt(avg((p - truth) ** 2)) AS r FROM j GROUP BY ALL)
  SELECT s.fold, feature, o.n, {r6("o.rmse AS rmse", "avg(r - o.rmse) AS importance", "stddev_pop(r) AS spread")} FROM s JOIN o ON o.fold = s.fold GROUP BY s.fold, feature, o.n, o.rmse""")
def column_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each member is worth to a blend, by category."""
    blend = sum((w * F.col(m) for m, w in _MEMBERS.items()), F.lit(0.0))
    out = learn.permutation_importance(_predicted(spark, sf_dir), "category", "truth", list(_MEMBERS), lambda rows: rows.withColumn("prediction", blend))
    return rounded(out, "rmse", "importance", "spread")


_RUNGS = (1, 2, 4, 5)


def _rung_sql(i: int, size: int) -> str:
    left = f"AND k IN (SELECT k FROM x{i - 1} WHERE kept)" if i else ""
    kept = "place = 1" if size == _RUNGS[-1] else "place <= ceil(n / 2)"
    return f"x{i} AS (SELECT *, {kept} AS kept FROM (SELECT k, m, row_number() OVER (ORDER BY round(m, 12), k) AS place, count(*) OVER () AS n FROM (SELECT k, avg(r) AS m FROM o WHERE pos <= {size} {left} GROUP BY k)))"


@query(f"""WITH {CONTEXT_SQL}, f AS (SELECT category AS fold, k, sqrt(avg(((1 - k / 10) * pred_linear + k / 10 * pred_seasonal_crop - truth) ** 2)) AS r FROM preds, (SELECT unnest(range(11)) AS k) GROUP BY 1, 2),
  o AS (SELECT *, dense_rank() OVER (ORDER BY fold) AS pos FROM f), {", ".join(_rung_sql(i, s) for i, s in enumerate(_RUNGS))}
  SELECT rung, candidate, folds, {r6("m AS rmse")}, kept FROM ({" UNION ALL ".join(f"SELECT CAST({i} AS INT) AS rung, 'w' || lpad(CAST(k AS VARCHAR), 2, '0') AS candidate, CAST({s} AS INT) AS folds, m, kept FROM x{i}" for i, s in enumerate(_RUNGS))})""")
def pruned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of the seasonal member by successive halving over the five categories: a row for each candidate of each rung."""
    rows = staged(_predicted(spark, sf_dir).select("category", "truth", "pred_linear", "pred_seasonal_crop"), "search-rows")
    candidates = {f"w{k:02}": (1 - k / 10) * F.col("pred_linear") + k / 10 * F.col("pred_seasonal_crop") for k in range(11)}
    _, found = learn.pruned_search(rows, "category", "truth", candidates)
    return rounded(spark.createDataFrame(found, "rung int, candidate string, folds int, rmse double, kept boolean"), "rmse")


@query(ORACLES["seasonal_prior_lookup"])
def saved_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors fitted, saved as a bundle, loaded again, and looked up."""
    panel, path = _masked(spark, sf_dir), new_path(spark, "bundle")
    bundle.save(spark, path, {"priors": season.robust_priors(panel)}, {"method": "seasonal prior"}, "1")
    out = season.prior_lookup(panel.where("hidden"), bundle.load(spark, path, "1").tables["priors"])
    return rounded(out.select("entity", "date", "seasonal_prior", "crop_seasonal_prior", "seasonal_prior_level"), "seasonal_prior", "crop_seasonal_prior")


@query(f"WITH {PANEL_SQL}, {_SCORE_SQL} SELECT entity, CASE WHEN bool_or(years < 3) THEN 'INSUFFICIENT_REFERENCE_YEARS' ELSE '' END AS warnings FROM scored GROUP BY entity UNION ALL SELECT r_name, 'EMPTY_SERIES' FROM region")
def asked_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are asked for beside the entities, and have no series."""
    points = staged(_scored(spark, sf_dir), "scored")
    asked = points.select("entity").unionAll(P.read(spark, sf_dir, "region").select("r_name"))
    return anomaly.warnings(points, "target", asked=asked).select("entity", F.array_join("warnings", ",").alias("warnings"))
