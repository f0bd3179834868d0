"""Data-quality reports, and their JSON and Markdown."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.hygiene import missingness
from lacuna.sources.panel import SPEC, PanelSpec


def _spread(counts: DataFrame, section: str, value: str = "n") -> DataFrame:
    """(section, name, value) of the least, median and most of a column of counts."""
    one = counts.agg(F.min(value).cast("double").alias("min"), F.percentile(F.col(value), F.lit(0.5)).alias("median"), F.max(value).cast("double").alias("max"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("min", "median", "max")])).alias("x")).select("x.*")


def quality_counts(panel: DataFrame, columns: list[str], gap: str | None = None, spec: PanelSpec = SPEC) -> DataFrame:
    """(section, name, value): missing and infinite values of each column; rows and years of an entity (least, median, most); rows of
    each category; gap flags true, false and null; repeated keys; columns without any value."""
    per_column = missingness(panel, columns)
    parts = [per_column.select(F.lit(s).alias("section"), F.col("column").alias("name"), F.col(c).cast("double").alias("value")) for s, c in (("missing", "n_missing"), ("infinite", "n_infinite"))]
    by_entity = panel.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.year(spec.date)).alias("years"))
    parts += [_spread(by_entity, "rows_per_entity"), _spread(by_entity, "years_per_entity", "years")]
    parts.append(panel.groupBy(F.coalesce(F.col(spec.category), F.lit("null")).alias("c")).count().select(F.lit("category"), "c", F.col("count").cast("double")))
    if gap:
        parts.append(panel.groupBy(F.coalesce(F.col(gap).cast("string"), F.lit("null")).alias("g")).count().select(F.lit("gap_flag"), "g", F.col("count").cast("double")))
    repeats = panel.groupBy(*spec.keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("double").alias("n"))
    parts.append(repeats.select(F.lit("keys"), F.lit("repeated"), "n"))
    rows = panel.agg(F.count(F.lit(1)).alias("_rows"))
    empty = per_column.crossJoin(F.broadcast(rows)).where("n_missing = _rows")
    parts.append(empty.select(F.lit("always_missing"), "column", F.lit(1.0)))
    return reduce(DataFrame.unionAll, parts)


def top_missing(panel: DataFrame, columns: list[str], n: int = 15) -> DataFrame:
    """The n columns with the highest missing rates; ties by name."""
    return missingness(panel, columns).orderBy(F.desc("missing_rate"), "column").limit(n)


def over_seeds(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, seeds, mean, std, least, most) of a score over the seeds or variants of a run."""
    return scores.groupBy(*keys).agg(F.count(score).alias("seeds"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.min(score).alias("least"), F.max(score).alias("most"))


def best(scores: DataFrame, name: str, score: str) -> DataFrame:
    """One row: the candidate of the least score; ties by name."""
    return scores.where(F.col(score).isNotNull()).orderBy(score, name).limit(1)


def head(rows: DataFrame, n: int, spec: PanelSpec = SPEC) -> DataFrame:
    """The first n rows of each entity by date."""
    place = F.row_number().over(Window.partitionBy(spec.entity).orderBy(spec.date))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def most_important(importance: dict[str, float], mandatory: tuple[str, ...], n: int = 96) -> list[str]:
    """The n most important columns, ties by name, and those that must be there."""
    top = sorted(importance, key=lambda c: (-importance[c], c))[:n]
    return top + [c for c in mandatory if c not in top]


def first_run(rows: DataFrame, flag: Column, least: int = 2, most: int = 4, spec: PanelSpec = SPEC) -> DataFrame:
    """(entity, date, position from 0) of each entity's first run of flagged rows on consecutive days that is at least `least` long, of
    which at most `most` are taken."""
    marked = rows.where(flag).select(*spec.keys)
    order = Window.partitionBy(spec.entity).orderBy(spec.date)
    marked = marked.withColumn("_run", F.date_sub(F.col(spec.date), F.row_number().over(order)))
    run = Window.partitionBy(spec.entity, "_run")
    marked = marked.withColumns({"_n": F.count(F.lit(1)).over(run), "position": F.row_number().over(run.orderBy(spec.date)) - 1}).where(F.col("_n") >= least)
    marked = marked.withColumn("_first", F.min("_run").over(Window.partitionBy(spec.entity)))
    return marked.where((F.col("_run") == F.col("_first")) & (F.col("position") < most)).select(*spec.keys, "position")


def extract(panel: DataFrame, n: int = 30, spec: PanelSpec = SPEC) -> DataFrame:
    """A small fixture: of each category the first entity by name, and its first n rows."""
    chosen = panel.groupBy(spec.category).agg(F.min(spec.entity).alias(spec.entity))
    return head(panel.join(F.broadcast(chosen), [spec.category, spec.entity], "left_semi"), n, spec)


def as_json(sections: dict[str, DataFrame]) -> str:
    """The rows of small reports, with sorted keys and in a fixed order, so that equal reports are equal bytes."""
    made = {name: sorted((r.asDict(True) for r in df.collect()), key=lambda r: json.dumps(r, sort_keys=True, default=str)) for name, df in sections.items()}
    return json.dumps(made, sort_keys=True, indent=1, default=str, ensure_ascii=False) + "\n"


def as_markdown(title: str, sections: dict[str, DataFrame]) -> str:
    """A heading and a table for each small report, in the order given."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = sorted(tuple("" if v is None else str(v) for v in r) for r in df.collect())
        out += ["", f"## {name}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *[f"| {' | '.join(x.replace('|', chr(92) + '|') for x in r)} |" for r in rows]]
    return "\n".join(out) + "\n"
