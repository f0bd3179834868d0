"""Leakage-safe masking and validation folds, with hashes in place of random generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.ranks import few, numbered
from lacuna.sources.panel import SPEC, PanelSpec, hash_byte
from lacuna.staging import staged


def apply_mask(panel: DataFrame, keys: DataFrame, columns: list[str], spec: PanelSpec = SPEC) -> DataFrame:
    """panel with the columns nulled at keys and is_gap. A key that the panel lacks raises an error when rows are read."""
    asked = keys.select(*spec.keys).distinct()
    marked = asked.withColumn("_asked", F.lit(True))
    own = panel.withColumn("_own", F.lit(True))
    joined = own.join(marked, spec.keys, "full")
    ok = F.when(F.col("_own").isNull(), F.raise_error(F.lit("a key to mask is not in the panel")).cast("boolean")).otherwise(F.coalesce("_asked", F.lit(False)))
    out = joined.withColumn("is_gap", ok)
    return out.withColumns({c: F.when(~F.col("is_gap"), F.col(c)) for c in columns}).drop("_own", "_asked")


def mask_columns(gap_rows: DataFrame, candidates: list[str]) -> list[str]:
    """The candidates that no gap row has: one aggregation of counts."""
    row = gap_rows.agg(*[F.count(c).alias(c) for c in candidates]).first()
    return [c for c in candidates if row[c] == 0]


def censored(before: DataFrame, after: DataFrame, columns: list[str], spec: PanelSpec = SPEC) -> DataFrame:
    """Keys at which `after` lost a value that `before` had."""
    b = after.select(*spec.keys, *[F.col(c).alias(f"_{c}") for c in columns])
    lost = reduce(lambda x, y: x | y, [F.col(c).isNotNull() & F.col(f"_{c}").isNull() for c in columns])
    return before.join(b, spec.keys).where(lost).select(*spec.keys)


def key_differences(left: DataFrame, right: DataFrame, truth: str, tolerance: float = 1e-12, spec: PanelSpec = SPEC) -> DataFrame:
    """One row: keys only in the left, only in the right, repeated in either, and shared with differing truths."""
    a, b = left.select(*spec.keys, F.col(truth).alias("_a")), right.select(*spec.keys, F.col(truth).alias("_b"))
    one = a.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_na"), F.max("_a").alias("_a")).join(b.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_nb"), F.max("_b").alias("_b")), spec.keys, "full")
    return one.agg(
        F.count(F.when(F.col("_nb").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("_na").isNull(), 1)).alias("only_right"),
        F.count(F.when((F.col("_na") > 1) | (F.col("_nb") > 1), 1)).alias("repeated"), F.count(F.when(F.abs(F.col("_a") - F.col("_b")) > tolerance, 1)).alias("differing"),
    )


def partitions(rows: DataFrame, seed: int, parts: int = 7, spec: PanelSpec = SPEC) -> DataFrame:
    """rows with `part` 0..parts - 1: each entity's year dealt out evenly in hash order, from a hashed first part on."""
    draw = F.md5(F.concat_ws("|", spec.entity, F.col(spec.date).cast("string"), F.lit(str(seed))))
    season = Window.partitionBy(spec.entity, F.year(spec.date))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", spec.entity, F.year(spec.date).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("part", ((F.row_number().over(season.orderBy(draw)) - 1 + start) % parts).cast("int"))


def _sampled(rows: DataFrame, seed: int, most: int, spec: PanelSpec) -> DataFrame:
    """Up to `most` rows in hash order: the stated size of a validation set."""
    draw = F.md5(F.concat_ws("|", spec.entity, F.col(spec.date).cast("string"), F.lit(str(seed))))
    return rows.withColumn("_draw", draw).orderBy("_draw", *spec.keys).limit(most).drop("_draw")


def entity_groups(panel: DataFrame, groups: int = 5, spec: PanelSpec = SPEC) -> DataFrame:
    """(entity, fold): entities with targets, dealt in snake order of falling size, so that folds are near equal."""
    sizes = panel.where(F.col(spec.target).isNotNull()).groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n"))
    sizes = numbered(sizes, [F.desc("n"), F.col(spec.entity)], "_place")
    lap = (F.col("_place") % (2 * groups)).cast("int")
    return sizes.select(spec.entity, F.when(lap < groups, lap).otherwise(2 * groups - 1 - lap).cast("int").alias("fold"))


def folds(panel: DataFrame, seeds: tuple[int, ...] = (11, 29, 47, 71, 97), groups: int = 5, most: int = 1200, spec: PanelSpec = SPEC) -> DataFrame:
    """(mode, repeat, fold, entity, date, context_policy, cutoff_date, seen) of four validation modes.

    A: rows of all entities, half of the entities held out of fitting, once per seed. B: rows of one group of entities, all held
    out. C: rows of the last year, with the past as context. D: the last two to four observations of a hashed season of
    each entity of a group, with one remote observation as context. Sizes are bounded by `most`, as folds are samples.
    """
    seen = panel.where(F.col(spec.target).isNotNull()).select(*spec.keys)
    out = []

    def add(rows: DataFrame, mode: str, repeat: int, fold, policy: str, cutoff, known) -> None:
        out.append(rows.select(F.lit(mode).alias("mode"), F.lit(repeat).alias("repeat"), (F.lit(fold) if isinstance(fold, int) else fold).cast("int").alias("fold"), *spec.keys, F.lit(policy).alias("context_policy"), cutoff.cast("date").alias("cutoff_date"), known.alias("seen")))

    none = F.lit(None)
    for repeat, seed in enumerate(seeds):
        add(_sampled(seen, seed, most, spec), "A", repeat, 0, "transductive", none, hash_byte(spec.entity, seed) >= "80")
    grouped = seen.join(entity_groups(panel, groups, spec), spec.entity)
    draw = F.md5(F.concat_ws("|", spec.entity, F.col(spec.date).cast("string"), F.lit(str(seeds[0] + 1000))))
    order = Window.partitionBy("fold").orderBy(draw, *spec.keys)
    size = F.least(F.lit(most), F.floor(F.count(F.lit(1)).over(Window.partitionBy("fold")) / 3))
    add(grouped.withColumns({"_k": F.row_number().over(order), "_n": size}).where("_k <= _n"), "B", 0, F.col("fold"), "transductive", none, F.lit(False))
    last = seen.agg(F.year(F.max(spec.date)).alias("_last"))
    late = seen.crossJoin(F.broadcast(last)).where(F.year(spec.date) == F.col("_last"))
    add(_sampled(late, seeds[0] + 2000, most, spec), "C", 0, 0, "past_only", F.make_date(F.col("_last"), F.lit(1), F.lit(1)), F.lit(True))
    season = Window.partitionBy(spec.entity, F.year(spec.date))
    rows = grouped.withColumns({"_n": F.count(F.lit(1)).over(season), "_y": F.year(spec.date), "_back": F.row_number().over(season.orderBy(F.desc(spec.date)))}).where("_n >= 7")
    pick = F.md5(F.concat_ws("|", spec.entity, F.col("_y").cast("string"), F.lit(str(seeds[0] + 3000))))
    rows = rows.withColumn("_year", F.dense_rank().over(Window.partitionBy(spec.entity).orderBy(pick))).where("_year = 1")
    length = F.conv(F.substring(pick, 1, 8), 16, 10).cast("bigint") % 3 + 2
    tail = rows.where(F.col("_back") <= length).withColumn("_cut", F.date_sub(F.min(spec.date).over(Window.partitionBy(spec.entity)), 15))
    earliest = seen.groupBy(spec.entity).agg(F.min(spec.date).alias("_first"))
    tail = tail.join(earliest, spec.entity).where("_first < _cut")
    add(tail, "D", 0, F.col("fold"), "one_sided_hard", F.col("_cut"), F.lit(False))
    return reduce(DataFrame.unionAll, out)


def context_of(panel: DataFrame, fold: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """panel with hidden (nothing dynamic may be used) and scored (in the fold). fold: one fold's rows.

    transductive hides the fold's keys; past_only also everything from the cutoff on; one_sided_hard also all rows of the
    fold's entities but the last observation before their cutoff.
    """
    keys = fold.select(*spec.keys).distinct().withColumn("scored", F.lit(True))
    per = staged(fold.groupBy(spec.entity).agg(F.max("context_policy").alias("_policy"), F.min("cutoff_date").alias("_cut")), "fold-entities")
    whole = fold.agg(F.min(F.when(F.col("context_policy") == "past_only", F.col("cutoff_date"))).alias("_past"))
    rows = panel.join(keys, spec.keys, "left").join(few(per, per.count()), spec.entity, "left").crossJoin(F.broadcast(whole))
    remote = F.max(F.when(F.col(spec.target).isNotNull() & (F.col(spec.date) < F.col("_cut")), F.col(spec.date))).over(Window.partitionBy(spec.entity))
    scored = F.coalesce("scored", F.lit(False))
    hard = F.coalesce((F.col("_policy") == "one_sided_hard") & ~F.col(spec.date).eqNullSafe(remote), F.lit(False))
    past = F.coalesce(F.col(spec.date) >= F.col("_past"), F.lit(False))
    return rows.withColumns({"hidden": scored | hard | past, "scored": scored}).drop("_policy", "_cut", "_past")


def requested_runs(rows: DataFrame, asked: str, spec: PanelSpec = SPEC) -> DataFrame:
    """(entity, date, gap_length, gap_position from 0) of the rows asked for. A run ends at a row that has a target and is not asked for, and
    at the year's end; rows that are neither do not count."""
    seen = F.col(spec.target).isNotNull() & ~F.isnan(F.col(spec.target))
    slots = rows.where(F.col(asked) | seen).select(*spec.keys, F.col(asked).alias("_gap"), F.year(spec.date).alias("_year"))
    order = Window.partitionBy(spec.entity, "_year").orderBy(spec.date)
    slots = slots.withColumn("_run", F.count(F.when(~F.col("_gap"), 1)).over(order)).where("_gap")
    run = Window.partitionBy(spec.entity, "_year", "_run")
    return slots.select(*spec.keys, F.count(F.lit(1)).over(run).alias("gap_length"), (F.row_number().over(run.orderBy(spec.date)) - 1).alias("gap_position"))


def run_lengths(rows: DataFrame, seed: int, longest: int = 5, spec: PanelSpec = SPEC) -> DataFrame:
    """rows with `run` (null: a visible separator): each entity's year is dealt out, in order of date, in runs of hashed length 1 to
    `longest` with one visible row after each, so that runs never grow together."""
    season = Window.partitionBy(spec.entity, "_year")
    df = rows.withColumn("_year", F.year(spec.date)).withColumn("_at", F.row_number().over(season.orderBy(spec.date)) - 1)
    years = df.groupBy(spec.entity, "_year").agg(F.count(F.lit(1)).alias("_n"))
    runs = years.select(spec.entity, "_year", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / 2).cast("int"))).alias("run"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", spec.entity, F.col("_year").cast("string"), F.col("run").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint") % longest + 1
    runs = runs.withColumn("_size", drawn.cast("int"))
    upto = F.sum(F.col("_size") + 1).over(season.orderBy("run"))
    runs = runs.withColumn("_begin", upto - F.col("_size") - 1)
    taken = runs.select(spec.entity, "_year", "run", F.explode(F.sequence(F.col("_begin").cast("int"), (F.col("_begin") + F.col("_size") - 1).cast("int"))).alias("_at"))
    return df.join(taken, [spec.entity, "_year", "_at"], "left").drop("_year", "_at")


def _in_category(rows: DataFrame, order: Column, more: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with `name`: their number, from 0, in their _category, in an order that is total; and (_category, {name}_of: how many)."""
    made = staged(numbered(rows, [F.col("_category"), order, *more], "_number"), "numbered-in-category")
    groups = staged(made.groupBy("_category").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias(f"{name}_of")), "categories")
    made = made.join(few(groups.select("_category", "_first"), groups.count()), "_category")
    return made.withColumn(name, F.col("_number") - F.col("_first")).drop("_number", "_first"), groups.drop("_first")


#: The longest run of a template, and how many runs of one length a year may hold at most: every second of 366 days.
LONGEST, MOST_RUNS = 8, 183


def matched_runs(panel: DataFrame, templates: DataFrame, seed: int, spec: PanelSpec = SPEC) -> DataFrame:
    """(template, length, entity, year, first_date, last_date): every template with where it was placed, the last two null if it was not.

    templates: template (unique), length (more than LONGEST counts as that), month, and the panel's category. A template is dealt to an
    entity's year of its category (of all, if the category has none), in hashed order, in turn. In one scan in that order each takes the
    free stretch of observed rows whose first month is nearest to its own (the earliest of those), and keeps the rows beside it
    visible, so that no two runs touch. As places only become fewer, a year looks at MOST_RUNS + 1 templates of a length at most; those
    behind them could not be placed.
    """

    def drawn(*parts: Column) -> Column:
        return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))

    category = F.coalesce(F.col(spec.category).cast("string"), F.lit(""))
    seen = panel.where(F.col(spec.target).isNotNull()).select(F.col(spec.entity).alias("entity"), F.year(spec.date).alias("year"), F.col(spec.date).alias("date"), category.alias("_category"))
    slots = staged(seen.groupBy("entity", "year").agg(F.min("_category").alias("_category"), F.sort_array(F.collect_set("date")).alias("dates")), "slots")
    years, counts = _in_category(slots.select("entity", "year", "_category"), drawn(F.col("entity"), F.col("year").cast("string")), [F.col("entity"), F.col("year")], "_turn")
    whole = years.select("entity", "year", F.lit(None).cast("string").alias("_category"), F.lit(0).alias("_turn"))
    everywhere = numbered(whole.drop("_turn"), [drawn(F.col("entity"), F.col("year").cast("string")), F.col("entity"), F.col("year")], "_turn").withColumn("_category", F.lit("*"))
    total = slots.count()
    asked = templates.select("template", F.least(F.col("length"), F.lit(LONGEST)).cast("int").alias("length"), F.col("month").cast("int").alias("month"), category.alias("_category"))
    known = few(counts, counts.count())
    placed = asked.join(known, "_category", "left").withColumn("_category", F.when(F.col("_turn_of").isNull(), "*").otherwise(F.concat(F.lit("c"), "_category"))).withColumn("_years", F.coalesce("_turn_of", F.lit(total))).drop("_turn_of")
    order = drawn(F.col("template").cast("string"))
    placed, _ = _in_category(placed.withColumn("_order", order), F.col("_order"), [F.col("template")], "_k")
    places = years.withColumn("_category", F.concat(F.lit("c"), "_category")).select("entity", "year", "_category", "_turn").unionByName(everywhere.select("entity", "year", "_category", "_turn"))
    dealt = staged(placed.withColumn("_turn", F.pmod("_k", F.greatest(F.col("_years"), F.lit(1)))).join(places, ["_category", "_turn"], "left").select("template", "length", "month", "_order", "entity", "year"), "dealt")
    rank = F.row_number().over(Window.partitionBy("entity", "year", "length").orderBy("_order", "template"))
    tried = dealt.where("entity is not null").withColumn("_rank", rank).where(F.col("_rank") <= MOST_RUNS + 1)
    each = tried.groupBy("entity", "year").agg(F.array_sort(F.collect_list(F.struct("_order", "template", "length", "month"))).alias("asked"))
    scanned = each.join(slots.select("entity", "year", "dates"), ["entity", "year"])
    kind = templates.schema["template"].dataType.simpleString()
    start = F.struct(F.transform("dates", lambda d: F.lit(False)).alias("taken"), F.array().cast(f"array<struct<template:{kind},at:int,length:int>>").alias("made"))

    def place(s: Column, t: Column) -> Column:
        def score(i: Column) -> Column:
            apart = F.abs(F.month(F.get("dates", i)) - t["month"])
            return F.struct(F.least(apart, 12 - apart).alias("apart"), i.alias("at"))

        room = F.size("dates") - t["length"]
        starts = F.when(room >= 0, F.sequence(F.lit(0), room)).otherwise(F.array().cast("array<int>"))
        free = F.filter(starts, lambda i: ~F.exists(F.slice(s["taken"], i + 1, t["length"]), lambda x: x))

        def put(at: Column) -> Column:
            taken = F.transform(s["taken"], lambda x, i: x | F.coalesce(i.between(at - 1, at + t["length"]), F.lit(False)))
            one = F.array(F.struct(t["template"].alias("template"), at.alias("at"), t["length"].alias("length")))
            return F.struct(taken.alias("taken"), F.when(at.isNull(), s["made"]).otherwise(F.concat(s["made"], one)).alias("made"))

        # an array of one, so that the place is looked for once
        return F.get(F.transform(F.array(F.array_min(F.transform(free, score))["at"]), put), 0)

    runs = scanned.withColumn("_r", F.explode(F.aggregate("asked", start, place)["made"]))
    runs = runs.select(F.col("_r.template").alias("template"), F.get("dates", F.col("_r.at")).alias("first_date"), F.get("dates", F.col("_r.at") + F.col("_r.length") - 1).alias("last_date"))
    return dealt.select("template", "length", "entity", "year").join(runs, "template", "left")
