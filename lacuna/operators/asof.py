"""As-of joins within an entity's own rows, as windows over one shuffle by entity.

Panel rows include the rows to fill, so the k nearest observations before and after a row are found by
window frames; no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.sources.panel import SPEC, PanelSpec


def neighbors(panel: DataFrame, value: str, k: int = 4, spec: PanelSpec = SPEC, by: list[str] | None = None, prefix: str = "") -> DataFrame:
    """panel with {prefix}left and {prefix}right: arrays of (day, v) of the up to k nearest non-null values
    strictly before and after each row, nearest first. by: further columns that bound the search (a year)."""
    day = F.unix_date(spec.date)
    seen = F.when(F.col(value).isNotNull(), F.struct(day.alias("day"), F.col(value).alias("v")))
    window = Window.partitionBy(spec.entity, *(by or []))
    # only rows with a value count against k: number them, and take a frame of k numbers
    ranked = panel.withColumns({"_n": F.count(value).over(window.orderBy(spec.date).rowsBetween(Window.unboundedPreceding, 0)), "_x": seen})
    # for a row with a value _n counts itself, so the k before it have numbers _n - k .. _n - 1
    before = window.orderBy("_n").rangeBetween(-k, 0)
    after = window.orderBy("_n").rangeBetween(0, k)
    out = ranked.withColumns({"_b": F.collect_list("_x").over(before), "_a": F.collect_list("_x").over(after)})
    left = F.filter("_b", lambda x: x["day"] < day)
    right = F.filter("_a", lambda x: x["day"] > day)
    return out.withColumns({f"{prefix}left": F.slice(F.reverse(F.array_sort(left)), 1, k), f"{prefix}right": F.slice(F.array_sort(right), 1, k)}).drop("_n", "_x", "_b", "_a")


def nearest(panel: DataFrame, value: str, spec: PanelSpec = SPEC, by: list[str] | None = None, prefix: str = "") -> DataFrame:
    """panel with {prefix}left_value, _left_days, _right_value, _right_days of the nearest values: k = 1 by
    running last and first values."""
    window = Window.partitionBy(spec.entity, *(by or [])).orderBy(spec.date)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.unix_date(spec.date).alias("day"), F.col(value).alias("v")))
    left = F.last(seen, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(seen, ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))
    out = panel.withColumns({"_l": left, "_r": right})
    day = F.unix_date(spec.date)
    return out.withColumns({f"{prefix}left_value": F.col("_l.v"), f"{prefix}left_days": day - F.col("_l.day"), f"{prefix}right_value": F.col("_r.v"), f"{prefix}right_days": F.col("_r.day") - day}).drop("_l", "_r")


def with_context(queries: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Rows of `nearest`; one that has no value on either side is an error, as its entity has no observation to go by."""
    alone = F.col("left_days").isNull() & F.col("right_days").isNull()
    return queries.withColumn("left_value", F.when(alone, F.raise_error(F.concat(F.lit("no observation of "), F.col(spec.entity))).cast("double")).otherwise(F.col("left_value")))


def linear(left: Column, left_days: Column, right: Column, right_days: Column) -> Column:
    """Interpolated by days; with one neighbour its value; else null."""
    return F.coalesce((left * right_days + right * left_days) / (left_days + right_days), left, right)


def gap_runs(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Hidden rows with gap_length and gap_position (from 1): runs among the slots of the entity's year that
    have a target or are hidden; naturally missing rows neither break a run nor count."""
    slots = panel.where(F.col(spec.target).isNotNull() | F.col("hidden")).withColumn("_year", F.year(spec.date))
    whole = Window.partitionBy(spec.entity, "_year")
    order = whole.orderBy(spec.date)
    slots = slots.withColumn("_run", F.count(F.when(~F.col("hidden"), 1)).over(order))
    gaps = slots.where("hidden")
    run = Window.partitionBy(spec.entity, "_year", "_run")
    return gaps.withColumns({"gap_length": F.count(F.lit(1)).over(run), "gap_position": F.row_number().over(run.orderBy(spec.date)).cast("bigint")}).drop("_run", "_year")


def calendar_runs(rows: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """(entity, start, end, length) of runs of rows on consecutive days."""
    order = Window.partitionBy(spec.entity).orderBy(spec.date)
    island = F.unix_date(spec.date) - F.row_number().over(order)
    return rows.withColumn("_i", island).groupBy(spec.entity, "_i").agg(F.min(spec.date).alias("start"), F.max(spec.date).alias("end"), F.count(F.lit(1)).alias("length")).drop("_i")


def local_shape(rows: DataFrame, prefix: str = "") -> DataFrame:
    """From `neighbors` with k = 4: local_level and local_iqr of the up to eight values, local_slope between the
    two nearest, local_curvature, the edge flags and context_quality."""
    left, right = F.col(f"{prefix}left"), F.col(f"{prefix}right")
    day = F.unix_date("date")

    def v(side: Column, k: int) -> Column:
        return F.get(side, k)["v"]

    def d(side: Column, k: int) -> Column:
        return F.get(side, k)["day"]

    both = F.array_sort(F.concat(F.transform(left, lambda x: x["v"]), F.transform(right, lambda x: x["v"])))
    n = F.size(both)

    def quantile(q: float) -> Column:
        at = (n - 1) * q
        low = F.floor(at).cast("int")
        a, b = F.get(both, low), F.coalesce(F.get(both, low + 1), F.get(both, low))
        return F.when(n > 0, a + (b - a) * (at - low))

    previous = (v(left, 0) - v(left, 1)) / (d(left, 0) - d(left, 1))
    following = (v(right, 1) - v(right, 0)) / (d(right, 1) - d(right, 0))
    close = F.least(day - d(left, 0), d(right, 0) - day)
    sides = (F.size(left) > 0).cast("int") + (F.size(right) > 0).cast("int")
    return rows.withColumns({
        "local_level": quantile(0.5), "local_iqr": quantile(0.75) - quantile(0.25),
        "local_slope": (v(right, 0) - v(left, 0)) / (d(right, 0) - d(left, 0)), "local_curvature": following - previous,
        "left_missing": (F.size(left) == 0).cast("int"), "right_missing": (F.size(right) == 0).cast("int"),
        "is_edge": (sides < 2).cast("int"), "context_quality": F.coalesce(sides / 2 / (1 + close / 15), F.lit(0.0)),
    })
