"""Seasonal priors and climatologies.

Joins on |day - day| <= radius would form all pairs of an entity's rows. Here they are RANGE frames over the day of the
year, whose ends are repeated on the other side where the year is a circle, or each reference row is spread over the days
that it serves and joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions.scalar import quantile, season_bin, season_day
from lacuna.operators.ranks import quantiles
from lacuna.sources.panel import SPEC, PanelSpec
from lacuna.staging import staged

#: Which keys each prior is grouped by, from the most to the least specific; then those that are only features.
LEVELS = ("polygon_crop_season", "polygon_crop", "crop_season", "crop", "global_season")
EXTRA = ("polygon_crop_year", "crop_year")


def _keys(spec: PanelSpec) -> dict[str, list[str]]:
    e, c = spec.entity, spec.category
    return {"polygon_crop_season": [e, c, "season"], "polygon_crop": [e, c], "crop_season": [c, "season"], "crop": [c], "global_season": ["season"], "polygon_crop_year": [e, c, "year"], "crop_year": [c, "year"], "global": []}


def robust_priors(rows: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """(level, entity, category, season, year, median, iqr, n) of the targets: eight groupings in one pass
    over one expanded shuffle, none of them gathered beyond ranks.LARGE values. Columns that a level does not use are null."""
    sets = _keys(spec)
    df = rows.where(F.col(spec.target).isNotNull()).select(spec.entity, spec.category, season_bin(F.col(spec.date)).alias("season"), F.year(spec.date).alias("year"), F.col(spec.target).alias("y"))
    columns = [spec.entity, spec.category, "season", "year"]
    none = {c: F.lit(None).cast(df.schema[c].dataType) for c in columns}
    levels = F.array(*[F.struct(F.lit(name).alias("level"), *[(F.col(c) if c in keys else none[c]).alias(c) for c in columns]) for name, keys in sets.items()])
    spread = df.select(F.explode(levels).alias("x"), "y").select("x.*", "y")
    agg = quantiles(spread, ["level", *columns], "y", (0.25, 0.5, 0.75))
    return agg.select("level", *columns, F.get("q", 1).alias("median"), (F.get("q", 2) - F.get("q", 0)).alias("iqr"), "n")


def prior_lookup(queries: DataFrame, priors: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """queries with seasonal_prior and its level (the most specific prior that exists), crop_seasonal_prior (which
    leaves out the entity), and prior_* medians. Without any prior both are 0.5."""
    e, c = spec.entity, spec.category
    priors = staged(priors, "priors")
    df = queries.withColumns({"season": season_bin(F.col(spec.date)), "year": F.year(spec.date)})
    # one row for each entity of a category, for each category, and for all: a level's medians by season or year are a map
    for keys, names in (([e, c], ("polygon_crop_season", "polygon_crop", "polygon_crop_year")), ([c], ("crop_season", "crop", "crop_year")), ([], ("global_season", "global"))):
        aggs, reads = [], {}
        for name in names:
            here, rest = F.col("level") == name, [k for k in _keys(spec)[name] if k not in keys]
            if rest:
                aggs.append(F.map_from_entries(F.collect_list(F.when(here & F.col(rest[0]).isNotNull(), F.struct(rest[0], "median")))).alias(f"_{name}"))
                reads[f"prior_{name}"] = F.try_element_at(f"_{name}", F.col(rest[0]))
            else:
                aggs.append(F.max(F.when(here, F.col("median"))).alias(f"_{name}"))
                reads[f"prior_{name}"] = F.col(f"_{name}")
        side = priors.where(F.col("level").isin(*names)).groupBy(*keys).agg(*aggs)
        df = df.join(side, keys, "left") if keys else df.crossJoin(F.broadcast(side))
        df = df.withColumns(reads).drop(*[f"_{n}" for n in names])
    found = F.coalesce(*[F.when(F.col(f"prior_{n}").isNotNull(), F.lit(n)) for n in LEVELS], F.when(F.col("prior_global").isNotNull(), F.lit("global_median")), F.lit("unfitted_default"))
    default = F.coalesce("prior_global", F.lit(0.5))
    return df.withColumns({"seasonal_prior": F.coalesce(*[f"prior_{n}" for n in LEVELS], default), "seasonal_prior_level": found, "crop_seasonal_prior": F.coalesce("prior_crop_season", "prior_crop", "prior_global_season", default)})


def gaussian(queries: DataFrame, context: DataFrame, value: str, prefix: str, spec: PanelSpec = SPEC, sigma: float = 12.0, radius: int = 30) -> DataFrame:
    """queries with {prefix}_mean, _std (population) and _n over years: in each other year of the entity a kernel-weighted
    mean of the values within `radius` days of the year's day (no wrap at the year's end)."""
    day = F.dayofyear(spec.date)
    q = queries.select(spec.entity, F.year(spec.date).alias("_qy"), day.alias("_qd")).distinct()
    c = context.where(F.col(value).between(-1, 1)).select(spec.entity, F.year(spec.date).alias("_y"), day.alias("_d"), F.col(value).alias("_v"))
    # a reference row serves the days around it: an equality join instead of a range
    c = c.withColumn("_qd", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_d") - radius), F.least(F.lit(366), F.col("_d") + radius))))
    w = F.exp(-0.5 * F.pow((F.col("_d") - F.col("_qd")) / sigma, F.lit(2.0)))
    yearly = c.groupBy(spec.entity, "_y", "_qd").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("_m"))
    found = q.join(yearly, [spec.entity, "_qd"]).where("_y <> _qy").groupBy(spec.entity, "_qy", "_qd").agg(F.avg("_m").alias(f"{prefix}_mean"), F.stddev_pop("_m").alias(f"{prefix}_std"), F.count("_m").alias(f"{prefix}_n"))
    keyed = queries.withColumns({"_qy": F.year(spec.date), "_qd": day})
    return keyed.join(found, [spec.entity, "_qy", "_qd"], "left").drop("_qy", "_qd")


def _circular(day: Column, radius: int) -> Column:
    return F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.pmod(day - 1 + d, F.lit(366)) + 1)


def _on_circle(day: Column, radius: int) -> Column:
    """The day, and a day near the year's end once more on the other side of the year."""
    return F.filter(F.array(day, day + 366, day - 366), lambda x: x.between(1 - radius, 366 + radius))


def _medians_around(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(keys, _ry, _d of 1..366, m): of rows (keys, _ry, _d, _v) the median of a year's values within `radius` days, where there are any."""
    seen = rows.select(*keys, "_ry", F.explode(_on_circle(F.col("_d"), radius)).alias("_d"), "_v", F.lit(False).alias("_asked"))
    days = rows.select(*keys, "_ry").distinct().select(*keys, "_ry", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("_d"), F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_asked"))
    near = Window.partitionBy(*keys, "_ry").orderBy("_d").rangeBetween(-radius, radius)
    out = seen.unionAll(days).withColumn("_near", F.collect_list("_v").over(near)).where("_asked and size(_near) > 0")
    return out.select(*keys, "_ry", "_d", quantile(F.sort_array("_near"), 0.5).alias("m"))


def previous_years(queries: DataFrame, reference: DataFrame, value: str, spec: PanelSpec = SPEC, radius: int = 15, least_years: int = 3) -> DataFrame:
    """queries with n_reference_years, climatology_median and climatology_mad of the entity's values, in its category,
    within `radius` days of the year's day (circular) in strictly earlier years; null under least_years."""
    e, c, day = F.col(spec.entity), F.col(spec.category), F.dayofyear(spec.date)
    packed = F.struct(*[F.col(x) for x in queries.columns])
    kind = queries.select(packed.alias("x")).schema["x"].dataType.simpleString()
    asked = queries.select(e.alias("_e"), c.alias("_c"), day.alias("_d"), F.year(spec.date).alias("_y"), F.lit(None).cast("double").alias("_v"), packed.alias("_row"))
    rows = reference.where(F.col(value).isNotNull()).select(e.alias("_e"), c.alias("_c"), F.explode(_on_circle(day, radius)).alias("_d"), F.year(spec.date).alias("_y"), F.col(value).cast("double").alias("_v"), F.lit(None).cast(kind).alias("_row"))
    near = Window.partitionBy("_e", "_c").orderBy("_d").rangeBetween(-radius, radius)
    both = asked.unionAll(rows).withColumn("_near", F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_y", "_v"))).over(near)).where("_row is not null")
    both = both.withColumn("_near", F.when(F.col("_e").isNotNull() & F.col("_c").isNotNull(), F.filter("_near", lambda x: x["_y"] < F.col("_y"))))
    both = both.withColumn("_years", F.coalesce(F.size(F.array_distinct(F.transform("_near", lambda x: x["_y"]))), F.lit(0)).cast("bigint"))
    both = both.withColumn("_years", F.greatest(F.lit(0), "_years").cast("bigint"))
    both = both.withColumn("_m", F.when(F.col("_years") >= least_years, quantile(F.sort_array(F.transform("_near", lambda x: x["_v"])), 0.5)))
    both = both.withColumn("_mad", F.when(F.col("_m").isNotNull(), quantile(F.sort_array(F.transform("_near", lambda x: F.abs(x["_v"] - F.col("_m")))), 0.5)))
    return both.select("_row.*", F.col("_years").alias("n_reference_years"), F.col("_m").alias("climatology_median"), F.col("_mad").alias("climatology_mad"))


def _pooled(w: Column, narrow: str, wide: str) -> Column:
    return F.zip_with(narrow, wide, lambda a, b: w * a + (1 - w) * b)


def leave_one_year_out(queries: DataFrame, reference: DataFrame, value: str, spec: PanelSpec = SPEC, radius: int = 10, least_years: int = 3, floor: float = 0.04, pooling: float = 3.0) -> DataFrame:
    """queries with expected, climatology_scale, q10..q90, reference_years and reference_level.

    For all rows, those of the category, and those of the entity in its category: values within `radius` season days in
    all other years -> median by entity and year -> median by year -> quantiles and scaled MAD over years (floored).
    Levels with least_years are pooled from the widest to the narrowest with weight years / (years + pooling).
    """
    e, c = spec.entity, spec.category
    r = reference.where(F.col(value).isNotNull()).select(e, c, F.year(spec.date).alias("_ry"), season_day(F.col(spec.date)).alias("_d"), F.col(value).cast("double").alias("_v"))
    own, alone = _medians_around(r, [e, c], radius), _medians_around(r, [e], radius)
    # medians of a year and day by level, from one grouping; then each level's years of a day as a short array
    none = F.lit(None).cast("string")
    levels = F.array(F.struct(F.lit("crop").alias("l"), none.alias("e"), F.col(c).cast("string").alias("c")), F.struct(F.lit("polygon").alias("l"), F.col(e).cast("string").alias("e"), F.col(c).cast("string").alias("c")))
    spread = own.select(F.explode(levels).alias("x"), "_ry", "_d", "m").select("x.*", "_ry", "_d", "m")
    spread = spread.unionAll(alone.select(F.lit("global"), none, none, "_ry", "_d", "m"))
    annual = quantiles(spread, ["l", "e", "c", "_ry", "_d"], "m", (0.5,)).withColumn("m", F.get("q", 0))
    by_day = staged(annual.groupBy("l", "e", "c", "_d").agg(F.collect_list(F.struct("_ry", "m")).alias("_all")), "climatology")
    q = queries.select(e, c, F.year(spec.date).alias("_y"), season_day(F.col(spec.date)).alias("_d")).distinct()
    for name, keys in (("global", []), ("crop", [c]), ("polygon", [e, c])):
        side = by_day.where(F.col("l") == name).select(*[F.col("e" if k == e else "c").alias(k) for k in keys], "_d", "_all")
        q = q.join(side, [*keys, "_d"], "left")
        q = q.withColumn("_others", F.sort_array(F.transform(F.filter("_all", lambda x: x["_ry"] != F.col("_y")), lambda x: x["m"])))
        q = q.withColumn("_q", F.when(F.size("_others") >= least_years, F.array(*[quantile(F.col("_others"), p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])))
        mad = quantile(F.sort_array(F.transform("_others", lambda x: F.abs(x - F.get("_q", 2)))), 0.5)
        q = q.withColumn(name, F.when(F.col("_q").isNotNull(), F.struct("_q", F.greatest(1.4826 * mad, F.lit(floor)).alias("s"), F.size("_others").cast("bigint").alias("n")))).drop("_all", "_others", "_q")
    values, scale, years, level = F.col("global._q"), F.col("global.s"), F.col("global.n"), F.lit("global")
    q = q.withColumns({"_v0": values, "_s0": scale})
    for i, name in enumerate(("crop", "polygon")):
        w = F.col(f"{name}.n") / (F.col(f"{name}.n") + pooling)
        has = F.col(name).isNotNull()
        q = q.withColumns({f"_v{i + 1}": F.when(has, _pooled(w, f"{name}._q", f"_v{i}")).otherwise(F.col(f"_v{i}")), f"_s{i + 1}": F.when(has, w * F.col(f"{name}.s") + (1 - w) * F.col(f"_s{i}")).otherwise(F.col(f"_s{i}"))})
        years, level = F.when(has, F.col(f"{name}.n")).otherwise(years), F.when(has, F.lit(name)).otherwise(level)
    ok = F.col("global").isNotNull()
    found = q.select(spec.entity, spec.category, "_y", "_d", F.when(ok, F.get("_v2", 2)).alias("expected"), F.when(ok, F.col("_s2")).alias("climatology_scale"), F.when(ok, years).otherwise(0).cast("bigint").alias("reference_years"), F.when(ok, level).otherwise("insufficient").alias("reference_level"), *[F.when(ok, F.get("_v2", i)).alias(f"q{p}") for i, p in enumerate((10, 25, 50, 75, 90))])
    keyed = queries.withColumns({"_y": F.year(spec.date), "_d": season_day(F.col(spec.date))})
    return keyed.join(found, [spec.entity, spec.category, "_y", "_d"], "left").drop("_y", "_d")


def doy_profile(rows: DataFrame, value: str, keys: list[str], spec: PanelSpec = SPEC, radius: int = 12, least: int = 3) -> DataFrame:
    """(keys, doy 1..366, median, support): the cyclic rolling median of a value over days of the year."""
    spread = rows.where(F.col(value).isNotNull()).select(*keys, F.explode(_circular(F.dayofyear(spec.date), radius)).alias("doy"), F.col(value).alias("v"))
    agg = quantiles(spread, [*keys, "doy"], "v", (0.5,))
    return agg.select(*keys, "doy", F.when(F.col("n") >= least, F.get("q", 0)).alias("median"), F.col("n").alias("support"))


def profile_prior(queries: DataFrame, rows: DataFrame, value: str, spec: PanelSpec = SPEC, radius: int = 12, least: int = 6) -> DataFrame:
    """queries with profile_prior and profile_level: the cyclic median of the day of the year of the entity (2), else of its category (1), else
    of all rows (0); a profile counts where it rests on at least `least` values. Without any the prior is null."""
    df = queries.withColumn("doy", F.dayofyear(spec.date))
    for name, keys in (("polygon", [spec.entity]), ("crop", [spec.category]), ("global", [])):
        side = doy_profile(rows, value, keys, spec, radius, least).select(*keys, "doy", F.col("median").alias(f"_{name}"))
        df = df.join(side, [*keys, "doy"], "left")
    found = F.coalesce("_polygon", "_crop", "_global")
    level = F.when(F.col("_polygon").isNotNull(), 2).when(F.col("_crop").isNotNull(), 1).otherwise(0)
    return df.withColumns({"profile_prior": found, "profile_level": level}).drop("doy", "_polygon", "_crop", "_global")
