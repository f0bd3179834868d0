"""Anomaly points and events: scores against a climatology, then gaps and islands per entity."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import season
from lacuna.sources.panel import SPEC, PanelSpec

#: What each reason says. Fixed codes.
EXPLANATIONS = {
    "LOW_PRECIPITATION": "precipitation was below half its usual amount",
    "HIGH_TEMPERATURE": "it was over three degrees warmer than usual",
    "LOW_NDWI": "the water index was low",
    "MULTISENSOR_CONFIRMATION": "several sensors agree",
    "SOURCE_SWITCH_RISK": "the sensor changed, so part of the deviation may be its own",
    "LOW_DATA_COVERAGE": "few direct observations support it",
    "PROLONGED_SUPPRESSION": "it lasted two weeks or longer",
    "RAPID_NEGATIVE_CHANGE": "the value fell rapidly",
}


def baseline_points(panel: DataFrame, value: str, spec: PanelSpec = SPEC, threshold: float = -2.0, floor: float = 0.01, **climatology: int) -> DataFrame:
    """panel with residual, robust_z and candidate against the entity's earlier years."""
    df = season.previous_years(panel, panel, value, spec, **climatology)
    df = df.withColumn("residual", F.col(value) - F.col("climatology_median"))
    df = df.withColumn("robust_z", F.col("residual") / F.greatest(1.4826 * F.col("climatology_mad"), F.lit(floor)))
    return df.withColumn("candidate", F.coalesce((F.col("robust_z") <= threshold) & (F.col("residual") < 0), F.lit(False)))


def islands(points: DataFrame, breaks: Column, spec: PanelSpec = SPEC) -> DataFrame:
    """Candidates with `_event`: a running count of breaks within the entity."""
    order = Window.partitionBy(spec.entity).orderBy(spec.date)
    return points.withColumn("_event", F.sum(F.when(breaks, 1).otherwise(0)).over(order)).where("candidate")


def baseline_events(points: DataFrame, spec: PanelSpec = SPEC, max_gap: int = 16, least: int = 2) -> DataFrame:
    """Runs of candidates that any other row, or more than max_gap days between rows, breaks."""
    order = Window.partitionBy(spec.entity).orderBy(spec.date)
    previous = F.lag("candidate").over(order)
    far = F.datediff(spec.date, F.lag(spec.date).over(order)) > max_gap
    marked = points.withColumn("_break", ~F.coalesce(previous, F.lit(False)) | far | ~F.col("candidate"))
    confidence = F.col("confidence") if "confidence" in points.columns else F.lit(1.0)
    events = islands(marked, F.col("_break"), spec).groupBy(spec.entity, "_event").agg(
        F.min(spec.date).alias("start_date"), F.max(spec.date).alias("end_date"), F.count(F.lit(1)).alias("n_points"),
        F.avg(-F.col("residual")).alias("magnitude"), F.avg(confidence).alias("confidence"), F.min("robust_z").alias("min_z"),
    )
    days = F.datediff("end_date", "start_date") + 1
    events = events.where(F.col("n_points") >= least).withColumn("duration_days", days.cast("bigint"))
    name = F.concat_ws(":", spec.entity, F.date_format("start_date", "yyyy-MM-dd"), F.date_format("end_date", "yyyy-MM-dd"))
    return events.withColumns({"event_id": name, "severity": F.col("magnitude") * F.col("duration_days") * F.col("confidence")}).drop("_event")


def delivered_points(panel: DataFrame, spec: PanelSpec = SPEC, floor: float = 0.03, least_years: int = 3) -> DataFrame:
    """Observed rows with source, z_score and status against the seasonal mean of their own sensor's other years."""
    source = F.lit("missing")
    for s in reversed(spec.sensors):
        source = F.when(F.col(s).isNotNull(), s).otherwise(source)
    df = panel.withColumn("source", source)
    for s in spec.sensors:
        df = season.gaussian(df, panel, s, f"clim_{s}", spec)

    def own(stat: str) -> Column:
        out = F.lit(None).cast("double")
        for s in spec.sensors:
            out = F.when(F.col("source") == s, F.col(f"clim_{s}_{stat}")).otherwise(out)
        return out

    df = df.withColumns({"reference_mean": own("mean"), "reference_std": own("std"), "reference_years": F.coalesce(own("n"), F.lit(0.0))})
    ok = F.col(spec.target).between(-1, 1) & (F.col("reference_years") >= least_years) & F.col("reference_mean").isNotNull()
    df = df.withColumn("z_score", F.when(ok, (F.col(spec.target) - F.col("reference_mean")) / F.greatest("reference_std", F.lit(floor))))
    z = F.col("z_score")
    return df.withColumn("status", F.when(z.isNull(), "insufficient_or_invalid").when(z < -2, "strong_negative_candidate").when(z < -1, "negative_candidate").otherwise("usual"))


def delivered_events(points: DataFrame, spec: PanelSpec = SPEC, max_gap: int = 16, least: int = 2, least_days: int = 8) -> DataFrame:
    """Runs of negative rows among those observed; duration is the plain difference of dates."""
    seen = points.where(F.col(spec.target).isNotNull()).withColumn("candidate", F.coalesce(F.col("z_score") < -1, F.lit(False)))
    order = Window.partitionBy(spec.entity).orderBy(spec.date)
    far = F.coalesce(F.datediff(spec.date, F.lag(spec.date).over(order)), F.lit(999)) > max_gap
    marked = seen.withColumn("_break", ~F.col("candidate") | ~F.coalesce(F.lag("candidate").over(order), F.lit(False)) | far)
    events = islands(marked, F.col("_break"), spec).groupBy(spec.entity, "_event").agg(F.min(spec.date).alias("start_date"), F.max(spec.date).alias("end_date"), F.count(F.lit(1)).alias("observed_points"), F.min("z_score").alias("min_z"))
    return events.withColumn("duration_days", F.datediff("end_date", "start_date").cast("bigint")).where((F.col("observed_points") >= least) & (F.col("duration_days") >= least_days)).drop("_event")


def score_points(points: DataFrame, value: str, spec: PanelSpec = SPEC, suppression: float = -1.0, least_quality: float = 0.3) -> DataFrame:
    """points (with expected, climatology_scale, reference_level and is_observed) with residual, robust_z, effective_z,
    multisensor_confirmation, source_switch_risk, confidence and candidate.

    Optional columns: quality, uncertainty_std, or lower and upper (an 80 % interval), sensor_negative_count,
    selected_source, calibration_supported.
    """
    has = set(points.columns)
    sigma = F.lit(None).cast("double")
    if "uncertainty_std" in has:
        sigma = F.col("uncertainty_std")
    elif {"lower", "upper"} <= has:
        sigma = (F.col("upper") - F.col("lower")) / (2 * NormalDist().inv_cdf(0.9))
    df = points.withColumns({"quality": F.coalesce("quality", F.lit(0.0)) if "quality" in has else F.lit(1.0), "_sigma": sigma})
    unknown = ~F.col("is_observed") & F.col(value).isNotNull() & F.col("_sigma").isNull()
    combined = F.sqrt(F.pow("climatology_scale", F.lit(2.0)) + F.pow(F.coalesce("_sigma", F.lit(0.0)), F.lit(2.0)))
    df = df.withColumns({"_unknown": unknown, "_combined": combined, "residual": F.col(value) - F.col("expected")})
    df = df.withColumns({"robust_z": F.col("residual") / F.col("climatology_scale"), "effective_z": F.col("residual") / F.col("_combined"), "multisensor_confirmation": F.coalesce(F.col("sensor_negative_count") >= 2, F.lit(False)) if "sensor_negative_count" in has else F.lit(False)})
    switch = F.lit(False)
    if "selected_source" in has:
        there = F.when(F.col("selected_source").isNotNull() & ~F.col("selected_source").isin("unknown", "missing", "") & F.col(value).isNotNull(), F.col("selected_source"))
        before = F.last(there, ignorenulls=True).over(Window.partitionBy(spec.entity).orderBy(spec.date).rowsBetween(Window.unboundedPreceding, -1))
        switch = F.coalesce(there != before, F.lit(False))
    df = df.withColumn("source_switch_risk", switch)
    level = F.when(F.col("reference_level") == "polygon", 1.0).when(F.col("reference_level") == "crop", 0.85).when(F.col("reference_level") == "global", 0.5).otherwise(0.0)
    c = F.col("quality") * level * F.coalesce(F.col("climatology_scale") / F.col("_combined"), F.lit(0.0)) * F.when(F.col("is_observed"), 1.0).otherwise(0.5)
    c = c * F.when(F.col("source_switch_risk") & ~F.col("multisensor_confirmation"), 0.6).otherwise(1.0)
    c = F.when(F.col("_unknown"), F.least(c, F.lit(0.2))).otherwise(c)
    supported = F.col("calibration_supported") if "calibration_supported" in has else F.lit(True)
    candidate = (F.col("effective_z") < suppression) & (F.col("quality") >= least_quality) & supported & ~F.col("_unknown")
    return df.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), "candidate": F.coalesce(candidate, F.lit(False))}).drop("_sigma", "_combined", "_unknown")


def advanced_events(points: DataFrame, spec: PanelSpec = SPEC, max_gap: int = 10, least: int = 2, least_days: int = 3, critical_z: float = -2.0, critical_observed: int = 2, critical_days: int = 7, critical_confidence: float = 0.55, least_quality: float = 0.3) -> DataFrame:
    """Events of candidates. Only a reliable normal row, more than max_gap days, or a new year breaks one; rows without a
    score or of low quality are passed over."""
    kept = points.where(F.col("candidate") | (F.col("effective_z").isNotNull() & (F.col("quality") >= least_quality)))
    order = Window.partitionBy(spec.entity).orderBy(spec.date)
    before = F.lag(spec.date).over(order)
    starts = ~F.coalesce(F.lag("candidate").over(order), F.lit(False)) | (F.datediff(spec.date, before) > max_gap) | (F.year(spec.date) != F.year(before))
    rows = islands(kept.withColumn("_break", F.col("candidate") & starts), F.col("_break"), spec)
    within = Window.partitionBy(spec.entity, "_event").orderBy(spec.date)
    depth = F.greatest(-F.col("residual"), F.lit(0.0))
    days = F.datediff(spec.date, F.lag(spec.date).over(within))
    rows = rows.withColumns({"_depth": depth, "_days": days, "_slope": (F.col("residual") - F.lag("residual").over(within)) / F.greatest(days, F.lit(1))})
    rows = rows.withColumn("_area", (F.col("_depth") + F.lag("_depth").over(within)) * F.col("_days") / 2)

    def share(column: str) -> list[Column]:
        if column not in points.columns:
            return [F.lit(0).alias(f"_n_{column}"), F.lit(None).cast("double").alias(f"_m_{column}")]
        return [F.count(column).alias(f"_n_{column}"), F.expr(f"percentile({column}, 0.5D)").alias(f"_m_{column}")]

    agg = rows.groupBy(spec.entity, "_event").agg(
        F.min(spec.date).alias("start_date"), F.max(spec.date).alias("end_date"), F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("is_observed"), 1)).alias("observed_points"), F.avg("confidence").alias("_c"), F.expr("percentile(effective_z, 0.5D)").alias("_z"),
        F.min("robust_z").alias("min_z"), F.coalesce(F.sum("_area"), F.lit(0.0)).alias("negative_area"), F.min("_slope").alias("_slope"),
        F.count(F.when(F.col("multisensor_confirmation"), 1)).alias("_multi"), F.max("source_switch_risk").alias("_switch"),
        *share("precip_ratio"), *share("temp_anomaly"), *share("ndwi_z"),
    )
    agg = agg.withColumns({"duration_days": (F.datediff("end_date", "start_date") + 1).cast("bigint"), "reconstructed_points": F.col("_n") - F.col("observed_points"), "confidence": F.col("_c") * F.least(F.lit(1.0), F.col("_n") / 3)})
    agg = agg.where((F.col("_n") >= least) & (F.col("duration_days") >= least_days))
    critical = (F.col("_z") < critical_z) & (F.col("observed_points") >= critical_observed) & (F.col("duration_days") >= critical_days) & (F.col("confidence") >= critical_confidence)
    enough = F.greatest(F.lit(2), F.ceil(F.col("_n") * 0.7))
    rules = {
        "LOW_PRECIPITATION": (F.col("_n_precip_ratio") >= enough) & (F.col("_m_precip_ratio") < 0.5),
        "HIGH_TEMPERATURE": (F.col("_n_temp_anomaly") >= enough) & (F.col("_m_temp_anomaly") > 3),
        "LOW_NDWI": (F.col("_n_ndwi_z") >= enough) & (F.col("_m_ndwi_z") < -1),
        "MULTISENSOR_CONFIRMATION": F.col("_multi") >= 2,
        "SOURCE_SWITCH_RISK": F.col("_switch"),
        "LOW_DATA_COVERAGE": (F.col("confidence") < critical_confidence) | (F.col("reconstructed_points") > F.col("observed_points")),
        "PROLONGED_SUPPRESSION": F.col("duration_days") >= 14,
        "RAPID_NEGATIVE_CHANGE": F.col("_slope") < -0.025,
    }
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    agg = agg.withColumns({"severity": F.when(critical, "critical").otherwise("biomass_suppression"), "score": F.col("negative_area") * F.col("confidence"), "reason_codes": codes})
    return agg.drop("_event", "_n", "_c", "_z", "_slope", "_multi", "_switch", *[f"_{k}_{c}" for k in "nm" for c in ("precip_ratio", "temp_anomaly", "ndwi_z")])


def explained(events: DataFrame) -> DataFrame:
    """events with explanation: a sentence per reason code, in their order."""
    texts = F.create_map(*[F.lit(x) for kv in EXPLANATIONS.items() for x in kv])
    said = F.concat_ws("; ", F.transform("reason_codes", lambda c: F.element_at(texts, c)))
    return events.withColumn("explanation", F.concat(F.lit("Sustained negative deviation"), F.when(F.size("reason_codes") > 0, F.concat(F.lit(": "), said)).otherwise(F.lit("")), F.lit(". No cause is established.")))


def warnings(points: DataFrame, value: str, least_years: int = 3, spec: PanelSpec = SPEC, asked: DataFrame | None = None) -> DataFrame:
    """(entity, warnings): what weakens an entity's result. Entities that were asked for and have no row have EMPTY_SERIES alone."""
    thin = F.col("reference_years") < least_years
    weak = ~F.col("is_observed") & F.col(value).isNotNull() & (F.col("confidence") <= 0.2)
    flags = points.groupBy(spec.entity).agg(F.max(thin).alias("a"), F.max(F.col(value).isNull()).alias("b"), F.max(weak).alias("c"))
    names = (("a", "INSUFFICIENT_REFERENCE_YEARS"), ("b", "MISSING_HARMONIZED_VALUES"), ("c", "LOW_RECONSTRUCTION_SUPPORT"))
    out = flags.select(spec.entity, F.array_compact(F.array(*[F.when(F.col(k), F.lit(n)) for k, n in names])).alias("warnings"))
    if asked is None:
        return out
    empty = asked.select(spec.entity).distinct().join(out, spec.entity, "left_anti")
    return out.unionAll(empty.select(spec.entity, F.array(F.lit("EMPTY_SERIES"))))


def event_points(events: DataFrame, points: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """events with observed and reconstructed points in their span: each event is spread over its days and joined by equality."""
    days = events.select(spec.entity, "event_id", F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias(spec.date))
    seen = days.join(points, spec.keys).groupBy("event_id").agg(F.count(F.when(F.col("is_observed"), 1)).alias("observed"), F.count(F.when(~F.col("is_observed"), 1)).alias("reconstructed"))
    return events.join(seen, "event_id", "left")


def summary(points: DataFrame, events: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Per entity: rows, observed rows, events, critical events, the largest score and confidence."""
    p = points.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_observed"), 1)).alias("observed"))
    e = events.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"), F.max("score").alias("max_score"), F.max("confidence").alias("max_confidence"))
    return p.join(e, spec.entity, "left").na.fill(0, ["events", "critical"])
