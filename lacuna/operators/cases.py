"""Made anomaly cases of known spans, and the audit of a year against the years before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import anomaly, compose, evaluate, harmonize, season
from lacuna.operators.ranks import few
from lacuna.sources.panel import SPEC, PanelSpec
from lacuna.staging import staged

#: What a case does to its series, and how deep it goes in scales of the climatology. Fixed values.
DEPTHS = {"mild_pulse": 1.625, "medium_pulse": 3.25, "strong_pulse": 6.25, "source_switch": 0.0, "single_outlier": 11.25, "wide_uncertainty": 3.75, "normal": 0.0}
PULSES = ("mild_pulse", "medium_pulse", "strong_pulse")
#: By how many scales the raw value of another sensor differs, and how uncertain a reconstructed row is.
RAW_SHIFT, UNCERTAINTY = 7.5, 10.0


def _drawn(*parts: Column | str) -> Column:
    """A seeded draw of 32 bits that every engine repeats."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def synthetic(season_rows: DataFrame, seed: int = 7, spec: PanelSpec = SPEC, least: int = 6, most: int = 17, noise: float = 0.2) -> DataFrame:
    """Seven cases for each entity of season_rows: one row per entity and day of a season, with expected, climatology_scale and
    reference_level. Rows without an expectation are passed over.

    The entity of a case is "entity:kind"; `field` and `kind` tell its parts. The value follows the expectation with noise; a run of `least`
    to `most` rows (all of a shorter series), whose place and length are hashes, is disturbed as the kind says. `in_pulse` marks the rows that
    an event should cover. Columns are those that anomaly.score_points reads, and value_raw.
    """
    e, d = F.col(spec.entity), F.col(spec.date)
    own = Window.partitionBy(spec.entity)
    rows = season_rows.where("expected is not null and climatology_scale is not null").select(e.alias("field"), d, F.col("expected"), F.col("climatology_scale"), F.col("reference_level"), (F.row_number().over(own.orderBy(spec.date)) - 1).alias("_place"), F.count(F.lit(1)).over(own).alias("_n"))
    rows = rows.withColumn("kind", F.explode(F.array(*map(F.lit, DEPTHS))))
    depth = F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv])[F.col("kind")]
    size = F.least(F.col("_n"), least + _drawn("field", "kind", F.lit("length"), F.lit(str(seed))) % (most - least + 1))
    rows = rows.withColumn("_size", size)
    rows = rows.withColumn("_from", _drawn("field", "kind", F.lit("start"), F.lit(str(seed))) % (F.col("_n") - F.col("_size") + 1))
    within = (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_from") + F.col("_size"))
    kind, scale = F.col("kind"), F.col("climatology_scale")
    hit = F.when(kind == "single_outlier", F.col("_place") == F.col("_from")).otherwise(within)
    jitter = noise * (2 * _drawn("field", "kind", d.cast("string"), F.lit(str(seed))) / 4294967296.0 - 1)
    value = F.col("expected") + scale * jitter - F.when(hit, depth * scale).otherwise(0.0)
    switched = (kind == "source_switch") & (F.col("_place") >= F.col("_from"))
    unsure = (kind == "wide_uncertainty") & within
    pulse = kind.isin(*PULSES) & within
    return rows.select(
        F.concat_ws(":", "field", "kind").alias(spec.entity), spec.date, "field", "kind", "expected", "climatology_scale", "reference_level",
        value.alias("value"), (value - F.when(switched, RAW_SHIFT * scale).otherwise(0.0)).alias("value_raw"), pulse.alias("in_pulse"),
        F.when(switched, spec.sensors[-1]).otherwise(spec.sensors[0]).alias("selected_source"), (~unsure).alias("is_observed"), F.lit(1.0).alias("quality"),
        F.when(unsure, UNCERTAINTY * scale).alias("uncertainty_std"), F.when(pulse, 2).otherwise(0).alias("sensor_negative_count"),
        F.when(pulse, 0.3).alias("precip_ratio"), F.when(pulse, 4.5).alias("temp_anomaly"),
    )


def judged(cases: DataFrame, least: int = 2, spec: PanelSpec = SPEC) -> DataFrame:
    """One row a case: entity, kind, expects_event, events, critical, outside (events that meet no pulse), iou (of the best event; null
    without a pulse) and support_delay_days (from the pulse's first day to its `least`-th candidate; not an alarm's delay, as the detector
    looks back)."""
    points = staged(anomaly.score_points(cases, "value", spec), "case-points")
    events = staged(anomaly.advanced_events(points, spec, least=least), "case-events")
    truth = points.where("in_pulse").groupBy(spec.entity).agg(F.min(spec.date).alias("start_date"), F.max(spec.date).alias("end_date"))
    met = evaluate.overlap(events, truth, spec.entity).select(spec.entity, "iou")
    found = events.join(truth.select(spec.entity, F.col("start_date").alias("_s"), F.col("end_date").alias("_e")), spec.entity, "left")
    apart = F.coalesce((F.col("end_date") < F.col("_s")) | (F.col("start_date") > F.col("_e")), F.lit(True))
    found = found.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"), F.count(F.when(apart, 1)).alias("outside"))
    first = F.min(F.when(F.col("in_pulse"), F.col(spec.date))).over(Window.partitionBy(spec.entity))
    seen = F.row_number().over(Window.partitionBy(spec.entity, "_hit").orderBy(spec.date))
    support = points.withColumns({"_first": first, "_hit": F.col("in_pulse") & F.col("candidate")}).withColumn("_k", seen).where(F.col("_hit") & (F.col("_k") == least))
    support = support.select(spec.entity, F.datediff(spec.date, "_first").alias("support_delay_days"))
    out = points.groupBy(spec.entity).agg(F.first("kind").alias("kind"), F.max("in_pulse").alias("expects_event"))
    return out.join(found, spec.entity, "left").na.fill(0, ["events", "critical", "outside"]).join(met, spec.entity, "left").join(support, spec.entity, "left")


def by_kind(verdicts: DataFrame) -> DataFrame:
    """(kind, cases, with_events, critical, outside, iou, support_delay_days) over the cases of a kind; the last two are means."""
    return verdicts.groupBy("kind").agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("events") > 0, 1)).alias("with_events"), F.sum("critical").alias("critical"), F.sum("outside").alias("outside"), F.avg("iou").alias("iou"), F.avg("support_delay_days").alias("support_delay_days"))


# --- a year against the years before it -----------------------------------------------------------------------

#: From the rows before the year and the rows to map: those rows with harmonized and calibration_supported.
Harmonizer = Callable[[DataFrame, DataFrame], DataFrame]


def pooled(reference: DataFrame, rows: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Robust lines of all rows, categories and entities, pooled."""
    return harmonize.apply_robust(rows, harmonize.fit_robust(reference, spec=spec), spec.target, "selected_source", spec=spec)


def affine(reference: DataFrame, rows: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """One map for each sensor, from quartiles and medians."""
    maps = harmonize.iqr_affine(reference, spec=spec).select(F.col("source").alias("selected_source"), "slope", "offset", (~F.col("status").startswith("identity")).alias("calibration_supported"))
    mapped = rows.join(few(maps, len(spec.sensors)), "selected_source", "left")
    return mapped.withColumns({"harmonized": F.col("slope") * F.col(spec.target) + F.col("offset"), "calibration_supported": F.coalesce("calibration_supported", F.lit(False))})


def observations(panel: DataFrame, spec: PanelSpec = SPEC, tolerance: float = 1e-10) -> DataFrame:
    """panel with is_observed, selected_source and quality (1 for a value in [-1, 1], else 0). A target that is not the first sensor's
    value is an error, as is a requested gap."""
    if "hidden" in panel.columns:
        panel = panel.withColumn("hidden", F.when(F.col("hidden"), F.raise_error(F.lit("an audit reads observations, not gaps")).cast("boolean")).otherwise(F.col("hidden")))
    t, source = F.col(spec.target), F.lit("unknown")
    for s in reversed(spec.sensors):
        source = F.when(F.col(s).isNotNull(), s).otherwise(source)
    same = F.abs(t - F.coalesce(*spec.sensors)) <= tolerance
    checked = F.when(t.isNull() | F.coalesce(same, F.lit(False)), t).otherwise(F.raise_error(F.lit("the target is not its first sensor's value")).cast("double"))
    return panel.withColumns({spec.target: checked, "is_observed": t.isNotNull(), "selected_source": source, "quality": F.coalesce(t.between(-1, 1), F.lit(False)).cast("double")})


def audit_points(panel: DataFrame, year: int, harmonizer: Harmonizer = pooled, spec: PanelSpec = SPEC) -> DataFrame:
    """The scored points of a year. Maps and climatology come from earlier years alone, so nothing of the year is in what it is held against.
    Both sides must have rows. panel is best a written table."""
    of = F.year(spec.date)
    for what, rows in (("earlier years", panel.where(of < year)), ("the year", panel.where(of == year))):
        if rows.isEmpty():
            raise ValueError(f"no rows of {what}")
    seen = observations(panel.where(of <= year), spec)
    mapped = staged(harmonizer(seen.where(of < year), seen), "harmonized")
    rows = season.leave_one_year_out(mapped.where(of == year), mapped.where(of < year), "harmonized", spec)
    return anomaly.score_points(rows, "harmonized", spec)


def audit(points: DataFrame, spec: PanelSpec = SPEC, k: int = 3) -> DataFrame:
    """One row an entity: rows, observed, unsupported (observed, but of a sensor without a map), events, critical, risky_events (a sensor
    changed, or confidence under 0.7), max_score (0 without events), max_confidence, and review_group and place of the 2 k entities to look
    at. There is no truth in it: events are candidates."""
    points = staged(points, "audit-points")
    events = anomaly.advanced_events(points, spec)
    risky = F.array_contains("reason_codes", "SOURCE_SWITCH_RISK") | (F.col("confidence") < 0.7)
    per = events.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"), F.count(F.when(risky, 1)).alias("risky_events"), F.round(F.max("score"), 9).alias("max_score"), F.max("confidence").alias("max_confidence"))
    rows = points.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_observed"), 1)).alias("observed"), F.count(F.when(F.col("is_observed") & ~F.col("calibration_supported"), 1)).alias("unsupported"))
    summary = staged(rows.join(per, spec.entity, "left").na.fill(0, ["events", "critical", "risky_events", "max_score"]), "audit-summary")
    return summary.join(F.broadcast(compose.cases(summary, k, spec)), spec.entity, "left")  # at most 2 k rows
