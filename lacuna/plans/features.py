"""Wide feature tables for hidden rows, composed of the operators.

Each block adds columns keyed by entity and date to the masked panel's hidden rows; blocks on an entity's own rows
share one shuffle by entity, same-date blocks one by date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalar import cleaned, out_of_range, source_label
from lacuna.operators import asof, donors, learn, neighbors, reconstruct, season
from lacuna.sources.panel import SPEC, PanelSpec
from lacuna.staging import staged


def refuse_leaks(masked: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """masked, with an error for any hidden row that still has a dynamic value."""
    there = [F.col(c).isNotNull() for c in spec.dynamic if c in masked.columns]
    bad = there[0]
    for c in there[1:]:
        bad = bad | c
    return masked.withColumn("hidden", F.when(F.col("hidden") & bad, F.raise_error(F.lit("a hidden row has a value")).cast("boolean")).otherwise(F.col("hidden")))


def temporal(rows: DataFrame, value: str, prefix: str, k: int = 4, spec: PanelSpec = SPEC, clip: bool = True) -> DataFrame:
    """rows with the k values before and after in the same year and their distances, linear, midpoint, nearest (the left one on a
    tie), span, slope, count in the year, means within 21 and 45 days, deviation within 21, and a clipped linear."""
    year = rows.withColumn("_y", F.year(spec.date)) if "_y" not in rows.columns else rows
    year = year.withColumn(f"{prefix}_count", F.count(value).over(Window.partitionBy(spec.entity, "_y")))
    out = asof.neighbors(year, value, k, spec, ["_y"], "_t_")
    day = F.unix_date(spec.date)
    sides = {"prev": "_t_left", "next": "_t_right"}
    made: dict[str, Column] = {}
    for side, column in sides.items():
        for j in range(k):
            made[f"{prefix}_{side}{j + 1}"] = F.get(F.col(column), j)["v"]
            made[f"{prefix}_{side}{j + 1}_days"] = F.abs(F.get(F.col(column), j)["day"] - day)
    out = out.withColumns(made)
    prev, nxt, dl, dr = (F.col(f"{prefix}_{c}") for c in ("prev1", "next1", "prev1_days", "next1_days"))

    def line(a: Column, b: Column) -> Column:
        return F.coalesce(a + (b - a) * dl / (dl + dr), (a + b) / 2, a, b)

    def near(radius: int) -> Column:
        return F.transform(F.filter(F.concat("_t_left", "_t_right"), lambda x: F.abs(x["day"] - day) <= radius), lambda x: x["v"])

    def mean(a: Column) -> Column:
        return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))

    out = out.withColumns({f"{prefix}_linear": line(prev, nxt), f"{prefix}_midpoint": F.coalesce((prev + nxt) / 2, prev, nxt), f"{prefix}_nearest": F.when(nxt.isNull() | (dl <= dr), prev).otherwise(nxt), f"{prefix}_span": dl + dr, f"{prefix}_slope": (nxt - prev) / (dl + dr), "_n21": near(21), "_n45": near(45)})
    out = out.withColumns({f"{prefix}_mean21": mean(F.col("_n21")), f"{prefix}_mean45": mean(F.col("_n45"))})
    spread = F.sqrt(mean(F.transform("_n21", lambda x: F.pow(x - F.col(f"{prefix}_mean21"), F.lit(2.0)))))
    low, high = F.lit(-1.0), F.lit(1.0)
    robust = line(F.greatest(low, F.least(high, prev)), F.greatest(low, F.least(high, nxt))) if clip else F.col(f"{prefix}_linear")
    # greatest() and least() pass over nulls, so a missing neighbour must stay missing
    robust = F.when(prev.isNotNull() & nxt.isNotNull(), robust).otherwise(F.coalesce(F.greatest(low, F.least(high, prev)) if clip else prev, nxt) if not clip else F.when(prev.isNotNull(), F.greatest(low, F.least(high, prev))).when(nxt.isNotNull(), F.greatest(low, F.least(high, nxt))))
    return out.withColumns({f"{prefix}_std21": spread, f"{prefix}_robust_linear": robust}).drop("_t_left", "_t_right", "_n21", "_n45")


def core(masked: DataFrame, spec: PanelSpec = SPEC, kinds: dict[str, str] | None = None) -> DataFrame:
    """Core feature table: calendar, priors, four neighbours a side with flags, shape, counts, runs, same-date statistics,
    context of every channel, rebuilt weather, source probabilities and splines."""
    kinds = kinds or {spec.target: "ndvi", **dict.fromkeys(spec.sensors, "ndvi"), "temp": "temp", "precip": "precip"}
    panel = refuse_leaks(masked, spec).withColumn("source", source_label(F.col(spec.target), {s: F.col(s) for s in spec.sensors}))
    rows = neighbors.range_counts(asof.neighbors(panel, spec.target, 4, spec), spec.target, prefix="target_", spec=spec)
    rows = asof.nearest(rows, spec.target, spec)
    for c in [c for c in spec.dynamic if c in panel.columns]:
        good = f"_c_{c}"
        rows = rows.withColumn(good, F.col(c) if c == spec.target else cleaned(F.col(c), kinds[c]))
        rows = neighbors.range_stats(asof.nearest(rows, good, spec, prefix=f"{c}_"), c, kinds[c], prefix=f"{c}_context_", spec=spec)
        rows = rows.withColumn(f"{c}_interpolated", asof.linear(*[F.col(f"{c}_{x}") for x in ("left_value", "left_days", "right_value", "right_days")])).drop(good)
    for s in spec.sensors:
        rows = neighbors.range_counts(rows, s, prefix=f"availability_{s}_", spec=spec)
    rows = learn.calendar(rows.where("hidden"), spec)
    made: dict[str, Column] = {}
    for side in ("left", "right"):
        for j in range(4):
            v, name = F.get(F.col(side), j)["v"], f"target_{side}_{j + 1}"
            bad = out_of_range(v, "ndvi")
            made |= {name: v, f"{name}_cleaned": F.when(~bad, v), f"{name}_invalid_flag": bad.cast("int"), f"{name}_missing_flag": v.isNull().cast("int"), f"days_{side}_{j + 1}": F.abs(F.get(F.col(side), j)["day"] - F.unix_date(spec.date))}
    rows = reconstruct.splines(asof.local_shape(rows.withColumns(made)), spec).drop("left", "right")
    rows = rows.withColumn("linear", asof.linear(*[F.col(c) for c in ("left_value", "left_days", "right_value", "right_days")]))
    rows = rows.withColumn("mean_neighbors", F.coalesce((F.col("left_value") + F.col("right_value")) / 2, "linear"))
    rows = season.prior_lookup(rows.drop("season", "year"), season.robust_priors(panel, spec), spec)
    rows = rows.join(asof.gap_runs(panel, spec).select(*spec.keys, "gap_length", "gap_position"), spec.keys, "left")
    rows = neighbors.same_date_others(rows, panel, spec.target, "same_date_target_", spec)
    for c in [c for c in spec.weather if c in panel.columns]:
        rows = neighbors.regional(rows, panel, c, F.col(f"{c}_interpolated"), spec)
    chances = neighbors.source_probabilities(panel.where("hidden"), panel, panel.where(F.col(spec.target).isNotNull()).select("source"), spec=spec)
    return rows.join(chances, spec.keys, "left")


def delivered(masked: DataFrame, spec: PanelSpec = SPEC, with_donors: bool = True) -> DataFrame:
    """Delivered feature table: calendar phases, same-year neighbours of every channel, seasonal means, same-date statistics, donors,
    and differences between them."""
    panel = staged(refuse_leaks(masked, spec).withColumn("_y", F.year(spec.date)), "delivered-panel")
    rows = panel
    names = {spec.target: "primary", **{s: s for s in spec.sensors}}
    for c, prefix in names.items():
        rows = temporal(rows, c, prefix, 4, spec)
    for c in [c for c in spec.weather if c in panel.columns]:
        rows = temporal(rows, c, c, 2, spec, clip=False)
    # what follows joins narrow tables to hidden rows alone: written between blocks, no plan holds them all
    rows = staged(learn.calendar(rows.where("hidden"), spec), "delivered")
    for c, prefix in names.items():
        rows = season.gaussian(rows, panel, c, f"clim_{prefix}", spec)
        rows = staged(neighbors.same_date(rows, panel, c, spec).withColumnsRenamed({f"date_{x}_{s}": f"date_{x}_{prefix}_{s}" for x in ("all", "crop") for s in ("mean", "std", "count", "median")}), "delivered")
    for s in spec.sensors:
        if with_donors:
            rows = donors.donors(rows, panel, s, spec).withColumnsRenamed({"donor_3": f"donor_{s}_3", "donor_10": f"donor_{s}_10", "donor_3_n": f"donor_{s}_3_n", "donor_10_n": f"donor_{s}_10_n", "donor_confidence": f"donor_{s}_confidence"})
    rows = staged(rows, "delivered")
    made: dict[str, Column] = {}
    for s in spec.sensors:
        made |= {f"{s}_minus_primary": F.col(f"{s}_linear") - F.col("primary_linear"), f"{s}_minus_clim": F.col(f"{s}_linear") - F.col(f"clim_{s}_mean"), f"{s}_phase16_prev": F.cos(2 * math.pi * F.col(f"{s}_prev1_days") / 16), f"{s}_phase16_next": F.cos(2 * math.pi * F.col(f"{s}_next1_days") / 16)}
        if with_donors:
            made[f"{s}_donor_disagreement"] = F.col(f"donor_{s}_3") - F.col(f"{s}_linear")
    lines = F.array_compact(F.array(*[f"{s}_linear" for s in spec.sensors]))
    n = F.size(lines)
    mean = F.aggregate(lines, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.pow(x - mean, F.lit(2.0))) / (n - 1)
    made |= {"primary_minus_clim": F.col("primary_linear") - F.col("clim_primary_mean"), "one_sided": (F.col("primary_prev1").isNull() | F.col("primary_next1").isNull()).cast("int"), "source_spread": F.when(n > 1, F.sqrt(var))}
    return rows.withColumns(made).drop("_y")
