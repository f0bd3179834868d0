"""Baselines that fill hidden targets, blends of members, gates and intervals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import asof, season
from lacuna.operators.ranks import order_statistics
from lacuna.shipping import ship
from lacuna.sources.panel import SPEC, PanelSpec
from lacuna.staging import staged

METHODS = ("nearest_left", "nearest_right", "mean_neighbors", "linear", "seasonal_crop", "pchip", "akima")
COMPOSITE_WEIGHTS = {"A": 0.50, "B": 0.25, "C": 0.15, "D": 0.10}


def context(masked: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Hidden rows with their nearest neighbours, linear interpolation and seasonal priors fitted on visible rows."""
    rows = asof.nearest(masked, spec.target, spec)
    rows = rows.withColumn("linear", asof.linear(*[F.col(c) for c in ("left_value", "left_days", "right_value", "right_days")]))
    rows = rows.withColumn("mean_neighbors", F.coalesce((F.col("left_value") + F.col("right_value")) / 2, "linear"))
    return season.prior_lookup(rows.where("hidden"), season.robust_priors(masked, spec), spec)


def baseline(rows: DataFrame, method: str) -> DataFrame:
    """rows (from `context`) with prediction, method and reason. With one neighbour only, every method but seasonal_crop
    takes the mean of it and the prior; without any, the prior."""
    column = {"nearest_left": "left_value", "nearest_right": "right_value", "mean_neighbors": "mean_neighbors", "linear": "linear", "seasonal_crop": "crop_seasonal_prior", "pchip": "pchip", "akima": "akima"}[method]
    left, right, prior = F.col("left_value"), F.col("right_value"), F.col("seasonal_prior")
    edge = (left.isNull() != right.isNull()) if method != "seasonal_crop" else F.lit(False)
    smooth = F.lit(method in ("pchip", "akima")) & F.col("linear").isNotNull()
    own = F.col(column)
    return rows.withColumns({
        "prediction": F.when(edge, (F.coalesce(left, right) + prior) / 2).when(own.isNotNull(), own).when(smooth, F.col("linear")).otherwise(prior),
        "method": F.when(edge, "edge_neighbor_prior").when(own.isNotNull(), method).when(smooth, "linear").otherwise("seasonal_fallback"),
        "reason": F.when(edge, "one_neighbor_plus_seasonal_prior").when(own.isNotNull(), "").when(smooth, f"{method}_unavailable_linear").otherwise(F.col("seasonal_prior_level")),
    })


def all_baselines(rows: DataFrame) -> DataFrame:
    """rows with pred_{method} of the five methods that need no spline."""
    for method in METHODS[:5]:
        rows = baseline(rows, method).withColumnRenamed("prediction", f"pred_{method}").drop("method", "reason")
    return rows


def midpoint_chain(rows: DataFrame, kind: str = "midpoint") -> Column:
    """Delivered baseline: midpoint or linear of same-year neighbours, else the climatology's mean, else 0.5."""
    return F.coalesce(F.col(f"primary_{kind}"), F.col("clim_primary_mean"), F.lit(0.5))


def pchip(x: np.ndarray, y: np.ndarray, q: np.ndarray | float) -> np.ndarray:
    """Monotone piecewise cubics through increasing x (along the last axis), at q within their ranges: slopes at inner points are weighted
    harmonic means of the neighbouring secants (Fritsch and Butland), ends take a three-point formula."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if x.shape[-1] == 2:
        return y[..., 0] + d[..., 0] * (q - x[..., 0])
    m = np.zeros_like(y)
    a, b = 2 * h[..., 1:] + h[..., :-1], h[..., 1:] + 2 * h[..., :-1]
    ok = d[..., :-1] * d[..., 1:] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        m[..., 1:-1] = np.where(ok, (a + b) / (a / d[..., :-1] + b / d[..., 1:]), 0.0)

    def end(i: int, j: int) -> np.ndarray:
        s = ((2 * h[..., i] + h[..., j]) * d[..., i] - h[..., i] * d[..., j]) / (h[..., i] + h[..., j])
        steep = (d[..., i] * d[..., j] < 0) & (np.abs(s) > 3 * np.abs(d[..., i]))
        return np.where(s * d[..., i] <= 0, 0.0, np.where(steep, 3 * d[..., i], s))

    m[..., 0], m[..., -1] = end(0, 1), end(-1, -2)
    return _hermite(x, y, m, q)


def akima(x: np.ndarray, y: np.ndarray, q: np.ndarray | float) -> np.ndarray:
    """Akima's splines of 1970 through increasing x (along the last axis), at q within their ranges."""
    d = np.diff(y) / np.diff(x)
    first, last = d[..., :1], d[..., -1:]
    d = np.concatenate([3 * first - 2 * d[..., 1:2], 2 * first - d[..., 1:2], d, 2 * last - d[..., -2:-1], 3 * last - 2 * d[..., -2:-1]], axis=-1)
    w = np.abs(np.diff(d))
    left, right = w[..., 2:], w[..., :-2]
    total = left + right
    flat = total <= 1e-9 * np.maximum(total.max(axis=-1, keepdims=True), 0)
    m = np.where(flat, (d[..., 1:-2] + d[..., 2:-1]) / 2, (left * d[..., 1:-2] + right * d[..., 2:-1]) / np.where(flat, 1, total))
    return _hermite(x, y, m, q)


def _hermite(x: np.ndarray, y: np.ndarray, m: np.ndarray, q: np.ndarray | float) -> np.ndarray:
    q = np.asarray(q, float)
    k = np.clip((x <= q[..., None]).sum(axis=-1) - 1, 0, x.shape[-1] - 2)[..., None]

    def at(v: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.take_along_axis(v, i, axis=-1)[..., 0]

    h = at(x, k + 1) - at(x, k)
    t = (q - at(x, k)) / h
    return (2 * t**3 - 3 * t**2 + 1) * at(y, k) + (t**3 - 2 * t**2 + t) * h * at(m, k) + (3 * t**2 - 2 * t**3) * at(y, k + 1) + (t**3 - t**2) * h * at(m, k + 1)


def splines(rows: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """rows (from asof.neighbors with k = 4) with pchip (at least three points, both sides) and akima (five). Rows of equal numbers of points are
    one matrix: a batch has a handful of them."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for days, values, day in batches:
            n = days.map(len).to_numpy()
            out = np.full((len(n), 2), np.nan)
            for size in np.unique(n[n >= 3]).tolist():
                which = np.flatnonzero(n == size)
                x, y = (np.concatenate(c.iloc[which].tolist()).astype(float).reshape(-1, size) for c in (days, values))
                q = day.iloc[which].to_numpy(float)
                out[which, 0] = pchip(x, y, q)
                if size >= 5:
                    out[which, 1] = akima(x, y, q)
            yield pd.DataFrame(out, columns=["pchip", "akima"])

    spline = F.pandas_udf(_typed(run), "pchip double, akima double")
    both = (F.size("left") > 0) & (F.size("right") > 0)
    points = F.when(both, F.array_sort(F.concat("left", "right"))).otherwise(F.slice("left", 1, 0))  # without both sides no curve
    packed = rows.withColumn("_p", points)
    made = packed.withColumn("_s", spline(F.transform("_p", lambda p: p["day"]), F.transform("_p", lambda p: p["v"]), F.unix_date(spec.date)))
    return made.withColumns({c: F.nanvl(f"_s.{c}", F.lit(None).cast("double")) for c in ("pchip", "akima")}).drop("_s", "_p")


def _typed(run):
    def typed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        yield from run(batches)

    typed.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return typed


def blend(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with blended (weights are non-negative and sum to one) and disagreement (population deviation of members)."""
    if min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must be non-negative and sum to one")
    parts = [F.col(c) * w for c, w in weights.items()]
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in weights]) / len(weights)
    var = reduce(lambda a, b: a + b, [F.pow(F.col(c) - mean, F.lit(2.0)) for c in weights]) / len(weights)
    return rows.withColumns({"blended": reduce(lambda a, b: a + b, parts), "disagreement": F.sqrt(var)})


def gate_mask(kind: str, left_days: Column, right_days: Column, confidence: Column | None = None, seen: Column | None = None, disagreement: Column | None = None, quality: Column | None = None, threshold: float | None = None) -> Column:
    """Rows that a gate picks; without a distance a row is never short and always long."""
    if kind == "short_two_sided":
        return F.coalesce((left_days <= 15) & (right_days <= 15), F.lit(False))
    if kind == "long_one_sided":
        return left_days.isNull() | right_days.isNull() | (F.least(left_days, right_days) > 15)
    picks = {"low_source_confidence": lambda: confidence < threshold, "unseen": lambda: ~seen, "high_disagreement": lambda: disagreement >= threshold, "low_context_quality": lambda: quality <= threshold}
    return F.coalesce(picks[kind](), F.lit(False))


def apply_gate(rows: DataFrame, prediction: str, fallback: str, mask: Column, weight: float = 0.5) -> DataFrame:
    """rows with gated: the prediction pulled to the fallback by `weight` where the mask holds."""
    return rows.withColumn("gated", F.when(mask, (1 - weight) * F.col(prediction) + weight * F.col(fallback)).otherwise(F.col(prediction)))


def fit_weights(rows: DataFrame, members: list[str], truth: str, ridge: float = 2e-6, drop: float = 0.01) -> dict[str, float]:
    """Non-negative weights of sum one with the least squared error: the members' Gram matrix is one aggregation, the
    rest projected gradient steps on it. Weights under `drop` are dropped and the rest scaled."""
    pairs = [(a, b) for i, a in enumerate(members) for b in members[i:]]
    row = rows.agg(*[F.avg(F.col(a) * F.col(b)).alias(f"g{k}") for k, (a, b) in enumerate(pairs)], *[F.avg(F.col(a) * F.col(truth)).alias(f"t{k}") for k, a in enumerate(members)]).first()
    g, t = np.zeros((len(members),) * 2), np.array([row[f"t{k}"] for k in range(len(members))])
    for k, (a, b) in enumerate(pairs):
        g[members.index(a), members.index(b)] = g[members.index(b), members.index(a)] = row[f"g{k}"]
    g += ridge * np.eye(len(members))
    w, step = np.full(len(members), 1 / len(members)), 1 / (2 * np.linalg.norm(g, 2))
    for _ in range(5000):
        w = _to_simplex(w - step * 2 * (g @ w - t))
    w = np.where(w < drop, 0, w)
    return dict(zip(members, (w / w.sum()).tolist()))


def _to_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    k = np.arange(1, len(v) + 1)
    shift = (np.cumsum(u) - 1) / k
    return np.maximum(v - shift[np.flatnonzero(u > shift)[-1]], 0)


def interval_bins(rows: DataFrame) -> Column:
    """context:source labels of residual bins."""
    short = F.coalesce(F.greatest("left_days", "right_days") <= 15, F.lit(False)) & F.col("left_days").isNotNull() & F.col("right_days").isNotNull()
    names = ("s2", "landsat", "modis")
    most = F.greatest(*[f"p_{s}" for s in names])
    best = F.lit("modis")
    for s in ("landsat", "s2"):
        best = F.when(F.col(f"p_{s}") == most, s).otherwise(best)
    return F.concat_ws(":", F.when(short, "short_two_sided").otherwise("hard_context"), F.when(most >= 0.65, best).otherwise("uncertain"))


def residual_radii(rows: DataFrame, error: Column, label: Column | None = None, levels: tuple[float, ...] = (0.8, 0.95), least: int = 60) -> DataFrame:
    """(label, level, radius, n): finite-sample quantiles, of the kind 'higher', of absolute errors by bin of at least
    `least` rows, and of all rows under the label 'global'. No bin is gathered or sorted whole."""
    df = rows.select((label if label is not None else F.lit("all")).alias("label"), F.abs(error).alias("e")).where("e is not null")
    return radii_of(df, [], levels, least)


def radii_of(errors: DataFrame, pools: list[str], levels: tuple[float, ...], least: int) -> DataFrame:
    """(pools, label, level, radius, n) of errors (pools, label, e), as residual_radii has them, for each pool."""
    both = staged(errors.withColumn("label", F.explode(F.array("label", F.lit("global")))), "errors")
    sizes = both.groupBy(*pools, "label").agg(F.count(F.lit(1)).alias("n")).where((F.col("label") == "global") | (F.col("n") >= least))
    asked = sizes.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    q = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * F.col("level")) / F.col("n"))
    asked = asked.withColumn("place", F.ceil(q * (F.col("n") - 1)) + 1)
    return order_statistics(both, [*pools, "label"], "e", asked).select(*pools, "label", "level", F.col("value").alias("radius"), "n")


def intervals(rows: DataFrame, prediction: str, label: Column, radii: DataFrame, level: float = 0.95) -> DataFrame:
    """rows with lower and upper: the prediction less and plus its bin's radius, or all rows' where its bin has none."""
    of_level = radii.where(F.col("level") == level)
    bins = of_level.where("label <> 'global'").select(F.col("label").alias("_label"), F.col("radius").alias("_bin"))
    everything = of_level.where("label = 'global'").agg(F.max("radius").alias("_all"))
    out = rows.withColumn("_label", label).join(F.broadcast(bins), "_label", "left").crossJoin(F.broadcast(everything))
    radius = F.coalesce("_bin", "_all")
    return out.withColumns({"lower": F.col(prediction) - radius, "upper": F.col(prediction) + radius}).drop("_label", "_bin", "_all")
