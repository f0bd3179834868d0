"""Calendar grids and fixed windows for sequence models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import asof
from lacuna.operators.ranks import quantiles
from lacuna.sources.panel import SPEC, PanelSpec


def spine(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Every day between the first and the last row of each entity and year; days without a row have nulls. The category is
    filled forward, then backward."""
    ends = panel.groupBy(spec.entity, F.year(spec.date).alias("year")).agg(F.min(spec.date).alias("a"), F.max(spec.date).alias("b"))
    days = ends.select(spec.entity, "year", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(spec.date))
    out = days.join(panel, spec.keys, "left")
    order = Window.partitionBy(spec.entity, "year").orderBy(spec.date)
    before = F.last(spec.category, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(spec.category, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return out.withColumns({"has_row": F.col(spec.target).isNotNull(), spec.category: F.coalesce(before, after)})


def deltas(grid: DataFrame, value: str, cap: int = 366, spec: PanelSpec = SPEC) -> DataFrame:
    """grid with {value}_since and {value}_until: days to the nearest value at or before and at or after, at most `cap`."""
    day = F.unix_date(spec.date)
    order = Window.partitionBy(spec.entity, "year").orderBy(spec.date)
    seen = F.when(F.col(value).isNotNull(), day)
    since = day - F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    until = F.first(seen, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)) - day
    return grid.withColumns({f"{value}_since": F.least(F.lit(cap), F.coalesce(since, F.lit(cap))), f"{value}_until": F.least(F.lit(cap), F.coalesce(until, F.lit(cap)))})


def filled(grid: DataFrame, value: str, spec: PanelSpec = SPEC) -> DataFrame:
    """grid with {value}_filled: linear between values, flat beyond the first and the last of the entity's year."""
    rows = asof.nearest(grid, value, spec, ["year"], "_f_")
    line = asof.linear(*[F.col(f"_f_{c}") for c in ("left_value", "left_days", "right_value", "right_days")])
    return rows.withColumn(f"{value}_filled", F.coalesce(value, line)).drop(*[f"_f_{c}" for c in ("left_value", "left_days", "right_value", "right_days")])


def anchored(grid: DataFrame, value: str, prior: Column, spec: PanelSpec = SPEC) -> DataFrame:
    """grid with {value}_anchored: the prior plus the interpolated offsets of the values from it."""
    out = filled(grid.withColumns({"_prior": prior, "_offset": F.col(value) - prior}), "_offset", spec)
    return out.withColumn(f"{value}_anchored", F.col("_prior") + F.coalesce("_offset_filled", F.lit(0.0))).drop("_prior", "_offset", "_offset_filled")


def _around(grid: DataFrame, own: Column, size: int, half: int, spec: PanelSpec) -> DataFrame:
    """grid with window: the arrays `own` (of `size` numbers) of 2 * half + 1 days around each; days outside its year's grid are all zero."""
    day = F.unix_date(spec.date)
    order = Window.partitionBy(spec.entity, "year").orderBy(day).rangeBetween(-half, half)
    got = F.collect_list(F.struct(day.alias("d"), own.alias("x"))).over(order)
    blank = F.array_repeat(F.lit(0.0), size)
    # grid days are consecutive, so only the ends of a year need padding
    first, last = F.element_at("_w", 1)["d"], F.element_at("_w", -1)["d"]
    ordered = F.transform(F.array_sort("_w"), lambda e: e["x"])
    before, after = F.array_repeat(blank, (first - day + half).cast("int")), F.array_repeat(blank, (day + half - last).cast("int"))
    return grid.withColumn("_w", F.array_sort(got)).withColumn("window", F.concat(before, ordered, after)).drop("_w")


def centred(grid: DataFrame, values: list[str], half: int = 30, spec: PanelSpec = SPEC) -> DataFrame:
    """grid with window: 2 * half + 1 days around each, each an array of the values (0 for null), a flag per value, and 1
    where the day is within the year's grid; days outside are all zero."""
    own = F.array(*[F.coalesce(v, F.lit(0.0)) for v in values], *[F.col(v).isNotNull().cast("double") for v in values], F.lit(1.0))
    return _around(grid, own, 2 * len(values) + 1, half, spec)


def features(grid: DataFrame, values: list[str], scales: DataFrame, prior: Column, prior_level: Column, bounds: tuple[float, float] = (-1.0, 1.0), half: int = 30, mode: str = "filled", spec: PanelSpec = SPEC) -> DataFrame:
    """grid with window: 2 * half + 1 days around each, each an array of 5C + 6 numbers for C values.

    By value: the value less its centre over its scale (0 where none), whether there is one, whether one was left out as beyond the
    bounds, then the logarithms of one more than the days since and until one (at most 366). Then the year's phase as sine and
    cosine, 1 (0 for days outside the year's grid, as all their numbers), the first value's base and the prior, each less the centre
    over the scale, and the prior's level. The base is interpolated (mode 'filled'), or the prior plus interpolated
    offsets from it ('anchored'), and the prior where the year has no value. scales: from `scaler`, a row a value.
    """
    if mode not in ("filled", "anchored"):
        raise ValueError("mode is 'filled' or 'anchored'")
    known = F.broadcast(scales.groupBy().agg(*[F.max(F.when(F.col("channel") == v, F.struct("centre", "scale"))).alias(f"_scale_{v}") for v in values]))  # one row
    rows = grid.crossJoin(known)
    for v in values:
        inside = F.col(v).between(*bounds)
        rows = rows.withColumns({f"_bad_{v}": F.coalesce(~inside, F.lit(False)).cast("double"), f"_{v}": F.when(inside, F.col(v))})
        rows = deltas(rows, f"_{v}", spec=spec)
    rows = rows.withColumns({"_own_prior": prior, "_level": prior_level})
    rows = filled(rows, f"_{values[0]}", spec) if mode == "filled" else anchored(rows, f"_{values[0]}", F.col("_own_prior"), spec)
    base = F.coalesce(f"_{values[0]}_{mode}", "_own_prior")
    leap = F.dayofyear(F.make_date(F.year(spec.date), F.lit(12), F.lit(31)))
    phase = 2 * math.pi * (F.dayofyear(spec.date) - 1) / leap

    def scaled(x: Column, v: str) -> Column:
        return (x - F.col(f"_scale_{v}.centre")) / F.col(f"_scale_{v}.scale")

    own = [F.coalesce(scaled(F.col(f"_{v}"), v), F.lit(0.0)) for v in values]
    own += [F.col(f"_{v}").isNotNull().cast("double") for v in values] + [F.col(f"_bad_{v}") for v in values]
    own += [F.log1p(F.col(f"_{v}_{side}")) for side in ("since", "until") for v in values]
    own += [F.sin(phase), F.cos(phase), F.lit(1.0), scaled(base, values[0]), scaled(F.col("_own_prior"), values[0]), F.col("_level").cast("double")]
    made = _around(rows, F.array(*own), len(own), half, spec)
    return made.select(*grid.columns, "window")


def scaler(rows: DataFrame, values: list[str], floor: float = 0.01) -> DataFrame:
    """One row per value: its median and population deviation (floored)."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(v).alias("channel"), F.col(v).alias("v")) for v in values])).alias("x")).select("x.*")
    found = quantiles(pairs.where("v is not null"), ["channel"], "v", (0.5,), (F.stddev_pop("v").alias("_s"),))
    return found.select("channel", F.get("q", 0).alias("centre"), F.greatest("_s", F.lit(floor)).alias("scale"))
