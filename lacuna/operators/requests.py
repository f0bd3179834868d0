"""Checks of what is asked for: keys, masks, ranges of dates, columns, and what a run needs before it starts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.sources.panel import SPEC, PanelSpec

MODES = ("web", "competition")


def canonical_keys(rows: DataFrame, entity: str = "entity", day: str = "date") -> DataFrame:
    """rows of text keys with `key_date` (a date) and `problem`: blank_entity, invalid_date (anything but a real day written
    YYYY-MM-DD), duplicate_key (every row of a key that stands more than once), or null."""
    written = F.when(F.col(day).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr(f"try_to_date({day}, 'yyyy-MM-dd')"))
    out = rows.withColumn("key_date", written)
    out = out.withColumn("problem", F.when(F.col(entity).isNull() | (F.trim(F.col(entity)) == ""), "blank_entity").when(F.col("key_date").isNull(), "invalid_date"))
    same = F.count(F.when(F.col("problem").isNull(), 1)).over(Window.partitionBy(entity, "key_date"))
    return out.withColumn("problem", F.when(F.col("problem").isNull() & (same > 1), "duplicate_key").otherwise(F.col("problem")))


def request_problems(rows: DataFrame, mode: str, asked: str = "asked", spec: PanelSpec = SPEC) -> DataFrame:
    """(problem, n) of a request: rows of a panel with a column that marks what is asked for.

    Infinite targets count as missing. A row asked for has no target; in the mode 'competition' exactly the rows of
    is_gap are asked for.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    target = F.col(spec.target)
    seen = target.isNotNull() & ~F.isnan(target) & (F.abs(target) != float("inf"))
    rules: dict[str, Column] = {
        "blank_key": F.col(spec.entity).isNull() | (F.trim(F.col(spec.entity)) == "") | F.col(spec.date).isNull(),
        "mask_is_null": F.col(asked).isNull(),
        "asked_row_has_target": F.col(asked) & seen,
    }
    if mode == "competition":
        rules["mask_is_not_gap"] = ~F.col(asked).eqNullSafe(F.col("is_gap"))
    counts = rows.agg(*[F.count(F.when(rule, 1)).alias(name) for name, rule in rules.items()])
    found = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")
    repeats = rows.groupBy(*spec.keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n"))
    return found.unionAll(repeats.select(F.lit("duplicate_key"), "n")).where("n > 0")


def check_range(start: date, end: date, most_days: int = 1830) -> None:
    """A range of dates runs forward and is not longer than most_days."""
    if end < start:
        raise ValueError("the range ends before it starts")
    if (end - start).days > most_days:
        raise ValueError(f"the range is longer than {most_days} days")


def columns_with(df: DataFrame, prefixes: tuple[str, ...], other: tuple[str, ...] = ()) -> list[str]:
    """The columns that a model may read: those of an allowed prefix or name, in their order; all others are not."""
    return [c for c in df.columns if c in other or c.startswith(prefixes)]


def preflight(wanted: dict[str, object], found: dict[str, object]) -> list[str]:
    """What speaks against a run: entries of its manifest (hashes, versions, column lists, counts) that are missing, not
    asked for, or of another value, in order of name."""
    missing = [f"missing:{k}" for k in wanted.keys() - found.keys()]
    extra = [f"unexpected:{k}" for k in found.keys() - wanted.keys()]
    return sorted(missing + extra + [f"differs:{k}" for k in wanted.keys() & found.keys() if wanted[k] != found[k]])
