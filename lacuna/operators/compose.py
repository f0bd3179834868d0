"""Predictions composed of members, fallback, gate, clip, intervals and flags, and the series that is made of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import reconstruct
from lacuna.operators.reconstruct import COMPOSITE_WEIGHTS
from lacuna.sources.panel import SPEC, PanelSpec
from lacuna.staging import staged


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def predict(rows: DataFrame, members: dict[str, float], fallback: str, gate: Column | None = None, gate_weight: float = 0.5, clip: tuple[float, float] | None = None, radii: DataFrame | None = None, label: Column | None = None, level: float = 0.95, width: float = 1.0) -> DataFrame:
    """rows with prediction, method, fallback_reason, lower, upper, interval_status and quality_flags.

    Members are blended with their weights; a blend that is no number gives way to the fallback; where the gate holds the
    prediction is pulled half way to the fallback; then it is clipped, if a range is given. Intervals are the radii of the row's
    label, or `width` to each side, which is not called calibrated.
    """
    blended = reduce(lambda a, b: a + b, [F.lit(w) * F.col(m) for m, w in members.items()])
    df = rows.withColumn("_blend", blended)
    df = df.withColumns({"_bad": ~_finite(F.col("_blend")), "_gated": F.coalesce(gate, F.lit(False)) if gate is not None else F.lit(False)})
    value = F.when(F.col("_bad"), F.col(fallback)).when(F.col("_gated"), (1 - gate_weight) * F.col("_blend") + gate_weight * F.col(fallback)).otherwise(F.col("_blend"))
    raw = df.withColumn("_raw", value)
    df = raw.withColumn("prediction", F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), "_raw")) if clip else F.col("_raw"))
    df = df.withColumns({
        "method": F.when(F.col("_bad"), fallback).when(F.col("_gated"), "conservative_blend").otherwise("blend"),
        "fallback_reason": F.when(F.col("_bad"), "nonfinite_model_prediction").when(F.col("_gated"), "conservative_gate").otherwise(""),
    })
    if radii is not None:
        df = reconstruct.intervals(df, "prediction", label if label is not None else F.lit("all"), radii, level).withColumn("interval_status", F.lit("empirical"))
    else:
        df = df.withColumns({"lower": F.col("prediction") - width, "upper": F.col("prediction") + width, "interval_status": F.lit("uncalibrated_default")})
    flags = {
        "one_sided_or_no_context": F.col("left_days").isNull() | F.col("right_days").isNull(),
        "prediction_outside_physical_range": ~F.col("prediction").between(-1, 1),
        "interval_not_coverage_certified": F.col("interval_status") != "empirical",
        "model_nonfinite_replaced": F.col("_bad"),
    }
    df = df.withColumn("quality_flags", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in flags.items()])))
    return df.drop("_blend", "_bad", "_gated", "_raw")


def stub(rows: DataFrame) -> DataFrame:
    """rows with prediction (the mean of the neighbours, or the only one), method and confidence: what stands in for a model, and says so."""
    lv, rv = F.col("left_value"), F.col("right_value")
    sides = lv.isNotNull().cast("int") + rv.isNotNull().cast("int")
    return rows.withColumns({"prediction": F.coalesce((lv + rv) / 2, lv, rv), "method": F.when(sides == 2, "stub_mean_of_neighbours").when(sides == 1, "stub_single_neighbour").otherwise("stub_no_context"), "confidence": F.lit(None).cast("double")})


def looked_up(asked: DataFrame, known: DataFrame, spec: PanelSpec = SPEC) -> tuple[DataFrame, DataFrame]:
    """(predictions of the keys that a stored run has, one row: asked, found, left out). Unknown points are left out, not made up."""
    keys = asked.select(*spec.keys).distinct()
    found = known.join(keys, spec.keys, "left_semi")
    marked = keys.join(known.select(*spec.keys).distinct().withColumn("_known", F.lit(1)), spec.keys, "left")
    return found, marked.agg(F.count(F.lit(1)).alias("asked"), F.count("_known").alias("found"), (F.count(F.lit(1)) - F.count("_known")).alias("left_out"))


def same_season(days: Column, side: int, spec: PanelSpec = SPEC) -> Column:
    """Whether the nearest value, so many days before (side -1) or after (1) a row, lies in the row's year."""
    d = F.col(spec.date)
    return F.coalesce(F.year(F.date_add(d, (side * days).cast("int"))) == F.year(d), F.lit(False))


def run_diagnostics(rows: DataFrame, prediction: str, members: dict[str, float], left: Column, right: Column, half_width: float, measured: bool) -> DataFrame:
    """rows of a stored run with lower and upper (half_width to each side), disagreement and quality_flags, each of what the run does not know.

    Disagreement is the members' deviation from their mean, weighted with their shares. It is there for all rows or, where one member of
    one row is no number or there are not two members, for none: then it is 0 and the flags say so. left and right: whether there is context
    on that side. measured: whether half_width comes from errors that were measured. The prediction is never clipped.
    """
    total = sum(members.values())
    if any(w < 0 for w in members.values()) or (members and total <= 0):
        raise ValueError("weights must be non-negative and not all zero")
    whole = F.lit(len(members) >= 2)
    for m in members:
        whole = whole & _finite(F.col(m))
    known = F.lit(False)
    df = rows
    if len(members) >= 2:
        df = rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.bool_and(whole), F.lit(False)).alias("_known"))))  # one row
        known = F.col("_known")
    mean = sum((F.col(m) * (w / total) for m, w in members.items()), F.lit(0.0))
    variance = sum((F.pow(F.col(m) - mean, F.lit(2.0)) * (w / total) for m, w in members.items()), F.lit(0.0))
    rules = {
        "interval_empirical_not_conformal": F.lit(True), "harmonization_not_applied": F.lit(True), "interval_width_from_documentation": F.lit(not measured), "model_disagreement_unavailable": ~known,
        "no_same_season_context": ~left & ~right, "one_sided_context": left != right, "prediction_outside_physical_range": ~F.coalesce(F.col(prediction).between(-1, 1), F.lit(False)),
    }
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    out = df.withColumns({"lower": F.col(prediction) - half_width, "upper": F.col(prediction) + half_width, "disagreement": F.when(known, F.sqrt(variance)).otherwise(0.0), "quality_flags": flags})
    return out.drop("_known")


def series(panel: DataFrame, predictions: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Every row of the panel with value, is_observed, is_reconstructed, lower, upper and method. A row that is neither observed nor
    predicted stays empty; an observed one stays as it is."""
    p = predictions.select(*spec.keys, "prediction", "lower", "upper", "method", F.lit(True).alias("_made"))
    joined = panel.join(p, spec.keys, "left")
    seen = _finite(F.col(spec.target))
    made = ~seen & F.col("_made").isNotNull()
    return joined.select(*spec.keys, F.when(seen, F.col(spec.target)).when(made, F.col("prediction")).alias("value"), seen.alias("is_observed"), made.alias("is_reconstructed"), *[F.when(made, F.col(c)).alias(c) for c in ("lower", "upper", "method")])


def series_warnings(points: DataFrame, is_stub: bool = False, spec: PanelSpec = SPEC) -> DataFrame:
    """(entity, warnings) of each series: NO_GAPS, NO_OBSERVATIONS, POINTS_OUTSIDE_MODEL_DATASET, MODEL_STUB_USED, in this order."""
    n = points.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_observed"), 1)).alias("seen"), F.count(F.when(F.col("is_reconstructed"), 1)).alias("made"))
    gaps = F.col("n") - F.col("seen")
    rules = {"NO_GAPS": gaps == 0, "NO_OBSERVATIONS": (gaps > 0) & (F.col("seen") == 0), "POINTS_OUTSIDE_MODEL_DATASET": (gaps > F.col("made")) & (F.col("seen") > 0), "MODEL_STUB_USED": F.lit(is_stub)}
    return n.select(spec.entity, F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])).alias("warnings"))


# --- choosing a gate and a blend on out-of-fold rows ----------------------------------------------------------


def _score(per_mode: dict[str, tuple[float, int]]) -> float:
    return sum(w * (per_mode[m][0] / per_mode[m][1]) ** 0.5 for m, w in COMPOSITE_WEIGHTS.items()) if all(per_mode.get(m, (0, 0))[1] for m in COMPOSITE_WEIGHTS) else float("inf")


def select_gate(rows: DataFrame, prediction: str, fallback: str, truth: str, gates: dict[str, Column], weight: float = 0.5, most_unseen: float = 0.003) -> tuple[str | None, list[dict[str, object]]]:
    """(the gate that is taken or None, what each did). rows: out-of-fold, with mode, repeat and seen.

    A gate is acceptable if it picks a row, if the median over (mode, repeat) of the change in RMSE is below zero, if RMSE on unseen
    entities grows by most_unseen at most and if the weighted RMSE of the modes falls; the best of these is taken. All gates come from
    one aggregation by (mode, repeat, seen).
    """
    error = F.col(prediction) - F.col(truth)
    aggs = [F.count(error).alias("n"), F.sum(error * error).alias("sse")]
    for k, mask in enumerate(gates.values()):
        picked = F.coalesce(mask, F.lit(False))
        moved = F.when(picked, (1 - weight) * F.col(prediction) + weight * F.col(fallback)).otherwise(F.col(prediction)) - F.col(truth)
        aggs += [F.count(F.when(picked, 1)).alias(f"n{k}"), F.sum(moved * moved).alias(f"s{k}")]
    found = rows.groupBy("mode", "repeat", "seen").agg(*aggs).collect()  # one row for each mode, repeat and seen

    def by(keys, value, keep=lambda r: True) -> dict:
        out: dict = {}
        for r in filter(keep, found):
            s, n = out.get(keys(r), (0.0, 0))
            out[keys(r)] = (s + (r[value] or 0.0), n + r.n)
        return out

    before = _score(by(lambda r: r["mode"], "sse"))
    taken, lowest, tried = None, before, []
    for k, name in enumerate(gates):
        old, new = (by(lambda r: (r["mode"], r.repeat), c) for c in ("sse", f"s{k}"))
        changes = [(new[g][0] / new[g][1]) ** 0.5 - (old[g][0] / old[g][1]) ** 0.5 for g in old if old[g][1]]
        unseen_old, unseen_new = (by(lambda r: 0, c, lambda r: not r.seen).get(0, (0.0, 0)) for c in ("sse", f"s{k}"))
        unseen = (unseen_new[0] / unseen_new[1]) ** 0.5 - (unseen_old[0] / unseen_old[1]) ** 0.5 if unseen_old[1] else 0.0
        score = _score(by(lambda r: r["mode"], f"s{k}"))
        middle = float(np.median(changes)) if changes else 0.0
        ok = sum(r[f"n{k}"] for r in found) > 0 and middle < 0 and unseen <= most_unseen and score < before
        tried.append({"gate": name, "composite": score, "median_change": middle, "unseen_change": unseen, "accepted": ok})
        if ok and score < lowest:
            taken, lowest = name, score
    return taken, tried


def select_blend(rows: DataFrame, members: list[str], truth: str, pairs: tuple[tuple[str, str], ...] = (), steps: int = 2000) -> tuple[dict[str, float], str, dict[str, float]]:
    """(weights, name of the candidate, score of each candidate): the least weighted RMSE of the modes among single members, equal pairs
    and non-negative weights of sum one, which projected gradient steps look for. The rows are read once: each mode's Gram matrix of errors
    is all that the search needs."""
    places = [(a, b) for a in range(len(members)) for b in range(a, len(members))]
    errors = [F.col(m) - F.col(truth) for m in members]
    found = rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), *[F.avg(errors[a] * errors[b]).alias(f"g{k}") for k, (a, b) in enumerate(places)]).collect()  # one row a mode
    grams: dict[str, np.ndarray] = {}
    for r in found:
        g = np.zeros((len(members),) * 2)
        for k, (a, b) in enumerate(places):
            g[a, b] = g[b, a] = r[f"g{k}"]
        grams[r["mode"]] = g
    if not set(COMPOSITE_WEIGHTS) <= grams.keys():
        raise ValueError("rows of all four modes are needed")

    def score(w: np.ndarray) -> float:
        return sum(c * max(0.0, float(w @ grams[m] @ w)) ** 0.5 for m, c in COMPOSITE_WEIGHTS.items())

    candidates = {f"single:{m}": np.eye(len(members))[i] for i, m in enumerate(members)}
    for a, b in pairs:
        candidates[f"half:{a}:{b}"] = sum(np.eye(len(members))[members.index(x)] / 2 for x in (a, b))
    w, step = np.full(len(members), 1 / len(members)), 0.1
    for _ in range(steps):
        slope = sum(c * (grams[m] @ w) / max(1e-12, float(w @ grams[m] @ w) ** 0.5) for m, c in COMPOSITE_WEIGHTS.items())
        new = reconstruct._to_simplex(w - step * slope)
        if score(new) < score(w):
            w = new
        else:
            step /= 2
            if step < 1e-12:
                break
    candidates["optimized"] = w
    scores = {name: score(x) for name, x in candidates.items()}
    name = min(scores, key=lambda k: (scores[k], list(scores).index(k)))
    return dict(zip(members, candidates[name].tolist())), name, scores


def coverage_by_fold(rows: DataFrame, fold: str, truth: str, prediction: str, label: Column, levels: tuple[float, ...] = (0.8, 0.95), least: int = 60, spec: PanelSpec = SPEC) -> DataFrame:
    """(fold, level, n, coverage, mean_width): each fold's rows in intervals whose radii come from the rows of other folds, without the
    keys that the fold has, by label where the others have `least` rows of it, else from all of them.

    Folds are few: a row stands once for each fold that it calibrates, and all radii come from one set of passes.
    """
    e = F.abs(F.col(prediction) - F.col(truth))
    base = staged(rows.select(*spec.keys, F.col(fold).alias("_fold"), F.col(truth).alias("_t"), F.col(prediction).alias("_p"), label.alias("_label"), e.alias("_e")).where("_e is not null"), "out-of-fold")
    folds = base.select(F.col("_fold").alias("_for")).distinct()
    held = base.select(*spec.keys, F.col("_fold").alias("_for")).distinct()
    pool = base.crossJoin(F.broadcast(folds)).where("_fold <> _for").join(held, [*spec.keys, "_for"], "left_anti")
    radii = reconstruct.radii_of(pool.select(F.col("_for").cast("string").alias("pool"), F.col("_label").alias("label"), F.col("_e").alias("e")), ["pool"], levels, least)
    radii = staged(radii, "radii")
    asked = base.withColumn("pool", F.col("_fold").cast("string")).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    own = radii.where("label <> 'global'").select("pool", F.col("label").alias("_label"), "level", F.col("radius").alias("_own"))
    every = radii.where("label = 'global'").select("pool", "level", F.col("radius").alias("_all"))
    joined = asked.join(F.broadcast(every), ["pool", "level"]).join(F.broadcast(own), ["pool", "_label", "level"], "left")
    radius = F.coalesce("_own", "_all")
    inside = (F.col("_e") <= radius).cast("double")
    return joined.groupBy(F.col("pool").alias("fold"), "level").agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"), F.avg(2 * radius).alias("mean_width"))


def cases(summary: DataFrame, k: int = 3, spec: PanelSpec = SPEC) -> DataFrame:
    """(review_group, place, entity): the k entities of the highest max_score that have events, then, of the others, the k that are least
    certain: by risky events, unsupported observations and max_score, all falling, then name. summary: one row an entity."""
    rows = staged(summary, "summary")
    strong = rows.orderBy(F.desc("max_score"), spec.entity).limit(k).where("events > 0")
    rest = rows.join(F.broadcast(strong.select(spec.entity)), spec.entity, "left_anti")
    doubt = rest.orderBy(F.desc("risky_events"), F.desc("unsupported"), F.desc("max_score"), spec.entity).limit(k)
    from pyspark.sql import Window

    first = F.row_number().over(Window.orderBy(F.desc("max_score"), spec.entity))  # k rows
    second = F.row_number().over(Window.orderBy(F.desc("risky_events"), F.desc("unsupported"), F.desc("max_score"), spec.entity))
    return strong.select(F.lit("strong_candidate").alias("review_group"), first.alias("place"), spec.entity).unionAll(doubt.select(F.lit("questionable_control"), second, spec.entity))
