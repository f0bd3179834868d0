"""Profiles, data-quality counts and validation of panels and submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, NumericType, TimestampNTZType, TimestampType

from lacuna.operators.asof import calendar_runs
from lacuna.sources.panel import SPEC, PanelSpec
from lacuna.staging import staged

SUBMISSION = ("anon_polygon_id", "date", "primary_ndvi_pred")


def profile(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """One row: rows, entities, dates, range of dates, rows with a target."""
    return panel.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(spec.entity).alias("entities"), F.countDistinct(spec.date).alias("dates"), F.min(spec.date).alias("first_date"), F.max(spec.date).alias("last_date"), F.count(spec.target).alias("observed"))


def missingness(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, n_infinite, missing_rate), from one aggregation."""
    one = panel.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull() | F.isnan(c), 1)).alias(f"m_{c}") for c in columns], *[F.count(F.when(F.abs(F.col(c)) == float("inf"), 1)).alias(f"i_{c}") for c in columns])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("n_missing"), F.col(f"i_{c}").alias("n_infinite")) for c in columns]))
    return one.select("n", parts.alias("x")).select("x.*", (F.col("x.n_missing") / F.col("n")).alias("missing_rate"))


def entity_profile(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """(entity, n_observed, first_date, last_date, category), by falling number of observations, then name."""
    seen = F.when(F.col(spec.target).isNotNull(), F.col(spec.date))
    return panel.groupBy(spec.entity).agg(F.count(spec.target).alias("n_observed"), F.min(seen).alias("first_date"), F.max(seen).alias("last_date"), F.min_by(spec.category, F.when(F.col(spec.category).isNotNull(), F.col(spec.date))).alias("category")).orderBy(F.desc("n_observed"), spec.entity)


def load_series(panel: DataFrame, entity: str, start: str, end: str, spec: PanelSpec = SPEC) -> DataFrame:
    """One entity's rows of a closed range of dates; filters reach the scan of a stored panel."""
    return panel.where((F.col(spec.entity) == entity) & F.col(spec.date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn(spec.category, F.coalesce(spec.category, F.lit("unknown")))


def violations(panel: DataFrame, spec: PanelSpec = SPEC, required: tuple[str, ...] = (), numeric: tuple[str, ...] | None = None) -> DataFrame:
    """(rule, n) for each rule that rows break, all but repeated keys from one aggregation.

    Of the table, with n = 1: missing_column:c and not_numeric:c (text, say, where numbers belong), gap_flag_not_boolean, date_not_a_date. Of rows:
    blank keys, no date, a date with a time of day, no category, infinities and NaN (not_finite:c), a null gap flag, values
    on gap rows, and rows whose key has stood before. numeric: the target, sensors and weather that are there, unless given.
    """
    kinds = {f.name: f.dataType for f in panel.schema.fields}
    numeric = tuple(c for c in spec.dynamic if c in kinds) if numeric is None else numeric
    broken = [f"missing_column:{c}" for c in dict.fromkeys((*spec.keys, spec.category, *required)) if c not in kinds]
    broken += [f"not_numeric:{c}" for c in numeric if c in kinds and not isinstance(kinds[c], NumericType)]
    rules: dict[str, Column] = {}
    if spec.entity in kinds:
        rules["blank_entity"] = F.col(spec.entity).isNull() | (F.trim(F.col(spec.entity).cast("string")) == "")
    if spec.date in kinds:
        d = F.col(spec.date)
        rules["missing_date"] = d.isNull()
        if isinstance(kinds[spec.date], (TimestampType, TimestampNTZType)):
            rules["date_with_time"] = F.coalesce(d != F.date_trunc("day", d), F.lit(False))
        elif not isinstance(kinds[spec.date], (DateType, NumericType)):
            broken.append("date_not_a_date")
    if spec.category in kinds:
        rules["missing_category"] = F.col(spec.category).isNull()
    rules |= {f"not_finite:{c}": F.isnan(c) | (F.abs(c) == float("inf")) for c in numeric if isinstance(kinds.get(c), (DoubleType, FloatType))}
    if "is_gap" in kinds:
        if isinstance(kinds["is_gap"], BooleanType):
            rules["null_gap_flag"] = F.col("is_gap").isNull()
            rules["value_on_gap_row"] = F.col("is_gap") & reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in numeric if c in kinds], F.lit(False))
        else:
            broken.append("gap_flag_not_boolean")
    spark = panel.sparkSession
    out = spark.createDataFrame([(name, 1) for name in broken], "rule string, n bigint")
    if rules:
        counts = panel.agg(*[F.count(F.when(rule, 1)).alias(f"_{k}") for k, rule in enumerate(rules.values())])
        out = out.unionAll(counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{k}").alias("n")) for k, n in enumerate(rules)])).alias("x")).select("x.*"))
    if set(spec.keys) <= kinds.keys():
        repeated = panel.groupBy(*spec.keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n"))
        out = out.unionAll(repeated.select(F.lit("duplicate_key"), "n"))
    return out.where("n > 0")


def always_missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column) of those without any value."""
    one = rows.agg(*[F.count(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("x")).where("x.n = 0").select("x.column")


def gap_histogram(gaps: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """(bucket, runs, rows): calendar-consecutive runs of 1, 2, 3 and 4+ days."""
    n = F.col("length")
    return calendar_runs(gaps, spec).groupBy(F.when(n >= 4, "4+").otherwise(n.cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("rows"))


def hierarchy_check(panel: DataFrame, tolerance: float = 1e-10, spec: PanelSpec = SPEC) -> DataFrame:
    """One row: whether targets equal their first sensor: rows checked, matching, rate, largest difference."""
    first = F.coalesce(*spec.sensors)
    diff = F.abs(F.col(spec.target) - first)
    return panel.where(F.col(spec.target).isNotNull() & first.isNotNull()).agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(diff <= tolerance, 1)).alias("matching"), F.avg((diff <= tolerance).cast("double")).alias("rate"), F.max(diff).alias("max_diff"))


def row_digest(rows: DataFrame) -> DataFrame:
    """One row: count and an order-free digest of the rows' values, the sum of the first 15 hex digits of their SHA-256."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("digest"))


def submission_violations(submission: DataFrame, gaps: DataFrame, examples: int = 10) -> DataFrame:
    """(type, n, examples) of what is wrong with a submission of three string columns, against gap keys (anon_polygon_id,
    date: date). Examples are the first by key."""
    columns = submission.columns
    if tuple(columns) != SUBMISSION:
        kind = "wrong_column_order" if set(columns) == set(SUBMISSION) else "accidental_pandas_index" if any(c.lower().startswith("unnamed") or c == "_c0" for c in columns) else "wrong_columns"
        return submission.sparkSession.createDataFrame([(kind, 1, [",".join(columns)])], "type string, n bigint, examples array<string>")
    s = submission.select(F.col(SUBMISSION[0]).alias("id"), F.col(SUBMISSION[1]).alias("raw"), F.col(SUBMISSION[2]).cast("string").alias("p"))
    day = F.when(F.col("raw").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_to_date(raw, 'yyyy-MM-dd')"))
    # both tables are read several times, so they are derived once
    s = staged(s.withColumns({"day": day, "key": F.concat_ws("|", "id", "raw"), "low": F.lower(F.trim("p"))}), "submission")
    asked = staged(gaps.select(F.col("anon_polygon_id").alias("id"), F.col("date").alias("day")).distinct(), "asked")
    number = F.expr("try_cast(p as double)")
    nan = F.col("p").isNull() | F.col("low").isin("nan", "na", "none", "null", "")
    inf = ~nan & F.col("low").rlike(r"^[+-]?inf")
    text = ~nan & ~inf & number.isNull()
    bad = {"invalid_date": F.col("day").isNull(), "nan_prediction": nan, "inf_prediction": inf, "string_prediction": text}
    found = [s.select(F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(kind)) for kind, rule in bad.items()]))).alias("type"), "key")]
    repeats = s.groupBy("id", "raw", "key").count().where("count > 1")
    found.append(repeats.select(F.lit("duplicate_key"), "key", F.explode(F.sequence(F.lit(2), F.col("count").cast("int"))).alias("k")).drop("k"))
    own = s.where("day is not null").select("id", "day").distinct()
    met = own.withColumn("_own", F.lit(True)).join(asked.withColumn("_asked", F.lit(True)), ["id", "day"], "full")
    apart = F.when(F.col("_own").isNull(), "missing_key").when(F.col("_asked").isNull(), "extra_key")
    found.append(met.select(apart.alias("type"), F.concat_ws("|", "id", F.col("day").cast("string")).alias("key")).where("type is not null"))
    rows = reduce(DataFrame.unionAll, found)
    # the first examples per kind come from partial top lists, not from whole groups
    ranked = staged(rows.groupBy("type", "key").count(), "violations")
    total = ranked.groupBy("type").agg(F.sum("count").alias("n"))
    from pyspark.sql import Window

    top = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("type").orderBy("key"))).where(F.col("_k") <= examples).groupBy("type").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    out = total.join(top, "type")
    counts = s.agg(F.count(F.lit(1)).alias("got")).crossJoin(asked.agg(F.count(F.lit(1)).alias("expected"))).where("got <> expected")
    return out.unionAll(counts.select(F.lit("row_count_mismatch"), F.lit(1).cast("bigint"), F.array(F.format_string("got %d, expected %d", "got", "expected"))))
