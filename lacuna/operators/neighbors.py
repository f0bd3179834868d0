"""Range and same-date statistics around a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalar import cleaned, out_of_range, quantile
from lacuna.operators.ranks import quantiles
from lacuna.sources.panel import SPEC, PanelSpec


def range_counts(panel: DataFrame, value: str, days: tuple[int, ...] = (7, 15, 30), prefix: str = "", spec: PanelSpec = SPEC) -> DataFrame:
    """panel with {prefix}count_{d}d and {prefix}density_{d}d: values within d days, the row's own included."""
    order = Window.partitionBy(spec.entity).orderBy(F.unix_date(spec.date))
    counts = {f"{prefix}count_{d}d": F.count(value).over(order.rangeBetween(-d, d)) for d in days}
    out = panel.withColumns(counts)
    return out.withColumns({f"{prefix}density_{d}d": F.col(f"{prefix}count_{d}d") / (2 * d) for d in days})


def range_stats(panel: DataFrame, value: str, kind: str, days: int = 30, prefix: str = "", spec: PanelSpec = SPEC) -> DataFrame:
    """panel with {prefix}median, _iqr, _count and _invalid_count of the other rows' values within `days` days; values
    out of physical range count as invalid and are left out. One row per entity and date."""
    order = Window.partitionBy(spec.entity).orderBy(F.unix_date(spec.date))
    before, after = order.rangeBetween(-days, -1), order.rangeBetween(1, days)
    good, bad = cleaned(F.col(value), kind), out_of_range(F.col(value), kind)
    values = F.array_sort(F.concat(F.collect_list(good).over(before), F.collect_list(good).over(after)))
    n_bad = F.count(F.when(bad, 1)).over(before) + F.count(F.when(bad, 1)).over(after)
    out = panel.withColumn("_vs", values)
    return out.withColumns({f"{prefix}median": quantile(F.col("_vs"), 0.5), f"{prefix}iqr": quantile(F.col("_vs"), 0.75) - quantile(F.col("_vs"), 0.25), f"{prefix}count": F.size("_vs").cast("bigint"), f"{prefix}invalid_count": n_bad}).drop("_vs")


def same_date_others(queries: DataFrame, panel: DataFrame, value: str, prefix: str, spec: PanelSpec = SPEC) -> DataFrame:
    """queries with {prefix}median, _iqr and _count of the value of all other entities on the row's date.

    Values are ranked within their date once. Leaving out one row moves a quantile's place by one at most, so only the
    few values beside those places are brought to the date's rows, which take theirs by their own rank. A date has at
    most one row per entity.
    """
    shares = (0.25, 0.5, 0.75)
    seen = panel.where(F.col(value).isNotNull()).select(spec.date, spec.entity, F.col(value).cast("double").alias("_v"))
    day = Window.partitionBy(spec.date)
    ranked = seen.withColumns({"_r": F.row_number().over(day.orderBy("_v", spec.entity)) - 1, "_n": F.count(F.lit(1)).over(day).cast("int")})
    beside = reduce(lambda a, b: a | b, [F.col("_r").between(F.floor((F.col("_n") - 2) * q), F.floor((F.col("_n") - 1) * q) + 2) for q in shares])
    by_date = ranked.where(beside).groupBy(spec.date).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"), F.max("_n").alias("_n"))
    own = ranked.select(*spec.keys, F.col("_r").alias("_own"))
    out = queries.join(own, spec.keys, "left").join(by_date, spec.date, "left")
    out = out.withColumn("_m", F.coalesce(F.col("_n") - F.col("_own").isNotNull().cast("int"), F.lit(0)))

    def value_at(place: Column) -> Column:
        return F.try_element_at("_at", place + F.coalesce((place >= F.col("_own")).cast("int"), F.lit(0)))

    def at(q: float) -> Column:
        place = (F.col("_m") - 1) * q
        low = F.floor(place).cast("int")
        a = value_at(low)
        return F.when(F.col("_m") > 0, a + (F.coalesce(value_at(low + 1), a) - a) * (place - low))

    return out.withColumns({f"{prefix}median": at(0.5), f"{prefix}iqr": at(0.75) - at(0.25), f"{prefix}count": F.col("_m").cast("bigint")}).drop("_at", "_n", "_own", "_m")


def same_date(queries: DataFrame, panel: DataFrame, value: str, spec: PanelSpec = SPEC) -> DataFrame:
    """queries with date_all_* and date_crop_* mean, std, count and median of the value over all rows of the date, and
    those of the row's category."""
    out = queries
    for label, keys in (("all", [spec.date]), ("crop", [spec.date, spec.category])):
        seen = panel.where(F.col(value).isNotNull()).select(*keys, value)
        agg = quantiles(seen, keys, value, (0.5,), (F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")))
        agg = agg.select(*keys, F.col("_mean").alias(f"date_{label}_mean"), F.col("_std").alias(f"date_{label}_std"), F.col("n").alias(f"date_{label}_count"), F.get("q", 0).alias(f"date_{label}_median"))
        out = out.join(agg, keys, "left")
    return out


def source_probabilities(queries: DataFrame, panel: DataFrame, fit: DataFrame, labels: tuple[str, ...] = ("s2", "landsat", "modis", "unknown"), days: int = 30, spec: PanelSpec = SPEC) -> DataFrame:
    """queries with p_{label} and source_confidence. The weight of a label is how many labelled targets the entity has within
    `days` days, plus other entities on the date, plus the label's share of fit, plus 1/4.

    panel: masked, with a `source` label per row; queries: rows of panel without a target; fit: labelled rows.
    """
    total = fit.agg(*[F.count(F.when(F.col("source") == s, 1)).alias(f"_fit_{s}") for s in labels], F.count(F.lit(1)).alias("_fit"))
    order = Window.partitionBy(spec.entity).orderBy(F.unix_date(spec.date)).rangeBetween(-days, days)
    seen = F.col(spec.target).isNotNull()
    local = panel.withColumns({f"_near_{s}": F.count(F.when(seen & (F.col("source") == s), 1)).over(order) for s in labels})
    dates = panel.where(seen).groupBy(spec.date).agg(*[F.count(F.when(F.col("source") == s, 1)).alias(f"_date_{s}") for s in labels])
    asked = queries.select(*spec.keys).join(local.select(*spec.keys, *[f"_near_{s}" for s in labels]), spec.keys).join(dates, spec.date, "left").crossJoin(F.broadcast(total))
    weights = {s: F.col(f"_near_{s}") + F.coalesce(f"_date_{s}", F.lit(0)) + F.col(f"_fit_{s}") / F.greatest(F.lit(1), F.col("_fit")) + 0.25 for s in labels}
    whole = sum(weights.values(), F.lit(0.0))
    asked = asked.select(*spec.keys, *[(w / whole).alias(f"p_{s}") for s, w in weights.items()])
    return asked.withColumn("source_confidence", F.greatest(*[f"p_{s}" for s in labels]))


def regional(queries: DataFrame, panel: DataFrame, value: str, own: Column, spec: PanelSpec = SPEC) -> DataFrame:
    """queries with {value}_same_date (the median of other entities), _same_date_count, and _reconstructed: that, or where
    no other entity has a value `own` (an interpolation)."""
    out = same_date_others(queries, panel, value, f"{value}_same_date_", spec)
    return out.withColumn(f"{value}_reconstructed", F.coalesce(f"{value}_same_date_median", own))
