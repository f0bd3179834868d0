"""Error metrics, slices, calibration tables and bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.scalar import gap_score
from lacuna.operators.ranks import few, numbered
from lacuna.operators.reconstruct import COMPOSITE_WEIGHTS
from lacuna.staging import staged


def errors(truth: str, prediction: str) -> list[Column]:
    e = F.col(prediction) - F.col(truth)
    return [F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")]


def metric_table(rows: DataFrame, truth: str, prediction: str, dimensions: list[str]) -> DataFrame:
    """(dimension, subgroup, n, rmse, gap_score): overall and by each dimension, in one pass of grouping sets. A null
    subgroup is a group of its own; a dimension that rows lack has one row 'unavailable'."""
    there = [d for d in dimensions if d in rows.columns]
    sets = [[], *[[F.col(d)] for d in there]]
    agg = rows.groupingSets(sets, *there).agg(*errors(truth, prediction)[:2], *[F.grouping(d).alias(f"_g_{d}") for d in there])
    name, value = F.lit("overall"), F.lit("all")
    for d in there:
        name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"_g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("null"))).otherwise(value)
    out = agg.select(name.alias("dimension"), value.alias("subgroup"), "n", "rmse", gap_score(F.col("rmse")).alias("gap_score"))
    for d in dimensions:
        if d not in there:
            out = out.unionAll(rows.agg(F.lit(d), F.lit("unavailable"), F.count(F.lit(1)), F.lit(None).cast("double"), F.lit(None).cast("double")))
    return out


def error_slices(rows: DataFrame, truth: str, prediction: str, role: str, dimensions: list[str]) -> DataFrame:
    """(role, slice, value, n, rmse, mae, gap_score) for each role and each value of each dimension."""
    agg = rows.groupingSets([[F.col(role), F.col(d)] for d in dimensions], role, *dimensions).agg(*errors(truth, prediction), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        name, value = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name), F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return agg.select(F.col(role).alias("role"), name.alias("slice"), value.alias("value"), "n", "rmse", "mae", gap_score(F.col("rmse")).alias("gap_score"))


def composite(rows: DataFrame, mode: str, truth: str, prediction: str) -> DataFrame:
    """One row: the weighted RMSE of the four modes; null unless all are there."""
    per = rows.groupBy(mode).agg(*errors(truth, prediction))
    weight = F.lit(None).cast("double")
    for m, w in COMPOSITE_WEIGHTS.items():
        weight = F.when(F.col(mode) == m, w).otherwise(weight)
    per = per.withColumn("w", weight).where("w is not null and rmse is not null")
    return per.agg(F.when(F.count(F.lit(1)) == len(COMPOSITE_WEIGHTS), F.sum(F.col("w") * F.col("rmse"))).alias("composite"))


def reliability(rows: DataFrame, mode: str, label: str, classes: list[str]) -> DataFrame:
    """(mode, source, bin, n, mean_probability, observed_frequency) by fifths of p_{class}."""
    pairs = rows.select(mode, label, F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(f"p_{c}").alias("p")) for c in classes])).alias("x")).select(mode, label, "x.*")
    fifth = F.greatest(F.lit(1), F.ceil(F.col("p") * 5)).cast("int")
    return pairs.where("p is not null").groupBy(mode, "source", fifth.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability"), F.avg((F.col(label) == F.col("source")).cast("double")).alias("observed_frequency"))


def brier(rows: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """One row: accuracy of the likeliest class (the first of equal ones) and the multi-class Brier score."""
    best = F.lit(classes[-1])
    most = F.greatest(*[f"p_{c}" for c in classes])
    score = F.lit(0.0)
    for c in reversed(classes[:-1]):
        best = F.when(F.col(f"p_{c}") == most, c).otherwise(best)
    for c in classes:
        score = score + F.pow(F.col(f"p_{c}") - (F.col(label) == c).cast("double"), F.lit(2.0))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == best).cast("double")).alias("accuracy"), F.avg(score).alias("brier"))


#: Slots of a draw that one row spreads.
SLOTS = 10_000


def block_sums(rows: DataFrame, block: str, sums: dict[str, Column]) -> DataFrame:
    """(_block, n and the sums, number: from 0, by name) of each block, written once: all draws start from it."""
    totals = rows.groupBy(F.col(block).alias("_block")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return staged(numbered(totals, [F.col("_block")]), "blocks")


def draw_blocks(totals: DataFrame, sums: list[str], draws: int, seed: int) -> DataFrame:
    """(draw, n and the sums). Slot i of draw b takes the block whose number is a hash of (seed, b, i) modulo the number of blocks, so every
    engine repeats it. A draw's slots are spread and added up where they are made: the blocks' sums come to
    them as a broadcast table if they are few, and only partial sums by draw are shuffled."""
    size = totals.count()
    spark = totals.sparkSession
    # no row of a draw holds more slots than a range
    ranges = -(-size // SLOTS)
    first = F.pmod("id", F.lit(max(1, ranges))) * SLOTS
    slots = spark.range(draws * ranges).select(F.floor(F.col("id") / max(1, ranges)).alias("draw"), F.explode(F.sequence(first, F.least(first + SLOTS, F.lit(size)) - 1)).alias("slot"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("bigint") % max(1, size)
    return slots.withColumn("number", pick).join(few(totals, size), "number").groupBy("draw").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])


def bootstrap_rmse(rows: DataFrame, block: str, truth: str, prediction: str, draws: int = 1500, seed: int = 1981) -> DataFrame:
    """One row: RMSE and its 2.5 % and 97.5 % quantiles over resamples of whole blocks. The rows are read once."""
    e = F.pow(F.col(prediction) - F.col(truth), F.lit(2.0))
    totals = block_sums(rows, block, {"sse": e, "seen": e.isNotNull().cast("bigint")})
    sample = draw_blocks(totals, ["sse"], draws, seed).select(F.sqrt(F.col("sse") / F.col("n")).alias("r"))
    ci = sample.agg(F.expr("percentile(r, array(0.025D, 0.975D))").alias("q"))
    return totals.agg(F.sqrt(F.sum("sse") / F.sum("seen")).alias("rmse")).crossJoin(F.broadcast(ci)).select("rmse", F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def paired_bootstrap(rows: DataFrame, block: str, truth: str, first: str, second: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """One row: the gain in RMSE of `second` over `first`, its interval, and the share of draws with a gain."""
    a, b = (F.pow(F.col(p) - F.col(truth), F.lit(2.0)) for p in (first, second))
    gain = F.sqrt(F.col("a") / F.col("n")) - F.sqrt(F.col("b") / F.col("n"))
    totals = block_sums(rows, block, {"a": a, "b": b, "na": a.isNotNull().cast("bigint"), "nb": b.isNotNull().cast("bigint")})
    sample = draw_blocks(totals, ["a", "b"], draws, seed).select(gain.alias("g"))
    ci = sample.agg(F.expr("percentile(g, array(0.025D, 0.975D))").alias("q"), F.avg((F.col("g") > 0).cast("double")).alias("share"))
    return totals.agg((F.sqrt(F.sum("a") / F.sum("na")) - F.sqrt(F.sum("b") / F.sum("nb"))).alias("gain")).crossJoin(F.broadcast(ci)).select("gain", F.get("q", 0).alias("low"), F.get("q", 1).alias("high"), "share")


def blend_grid(rows: DataFrame, fold: str, truth: str, first: str, second: str) -> DataFrame:
    """(fold, weight, rmse): for each fold the weight of `second`, of 0, 0.01 .. 1, that is best on all other folds, and the fold's
    RMSE with it. All from three sums per fold; the least weight wins ties."""
    from pyspark.sql import Window

    e, d = F.col(first) - F.col(truth), F.col(second) - F.col(first)
    per = rows.groupBy(F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("ee"), F.sum(e * d).alias("ed"), F.sum(d * d).alias("dd"))
    total = per.agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "ee", "ed", "dd")])
    grid = per.crossJoin(F.broadcast(total)).withColumn("weight", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("weight", F.col("weight") / 100)

    def mse(n: Column, ee: Column, ed: Column, dd: Column) -> Column:
        return (ee + 2 * F.col("weight") * ed + F.col("weight") * F.col("weight") * dd) / n

    others = mse(*[F.col(f"_{c}") - F.col(c) for c in ("n", "ee", "ed", "dd")])
    grid = grid.withColumns({"_o": F.round(others, 12), "rmse": F.sqrt(F.greatest(F.lit(0.0), mse(*[F.col(c) for c in ("n", "ee", "ed", "dd")])))})
    best = F.row_number().over(Window.partitionBy("fold").orderBy("_o", "weight"))
    return grid.withColumn("_k", best).where("_k = 1").select("fold", "weight", "rmse")


def adoption(gain: float | None, seeds: int, unseen_delta: float | None, low: float | None, least_seeds: int = 3, least_gain: float = 0.002, most_unseen: float = 0.003) -> tuple[bool, list[str]]:
    """Whether a new member is adopted, and what speaks against it; anything unknown speaks against it."""
    rules = {"too_few_seeds": seeds >= least_seeds, "gain_too_small": gain is not None and gain >= least_gain, "unseen_worse": unseen_delta is not None and unseen_delta <= most_unseen, "gain_not_certain": low is not None and low > 0}
    against = [k for k, ok in rules.items() if not ok]
    return not against, against


def coverage(rows: DataFrame, truth: str, keys: list[str]) -> DataFrame:
    """(keys, n, coverage, mean_width) of lower and upper."""
    inside = F.col(truth).between(F.col("lower"), F.col("upper")).cast("double")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"))


def complete(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Rows of the groups that have every member that occurs at all (relational division)."""
    total = rows.agg(F.countDistinct(member).alias("_all"))
    whole = rows.groupBy(group).agg(F.countDistinct(member).alias("_n")).join(F.broadcast(total), F.col("_n") == F.col("_all"))
    return rows.join(whole.select(group), group, "left_semi")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The number-th page (from 1) of rows in order; the order must be total for pages to be stable."""
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("no such page")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def overlap(found: DataFrame, known: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, start, end, iou, delay_days) for each known interval (start_date, end_date): its best intersection over union with a
    found one of the entity in days, and how late that one starts; 0 and null where none meets it."""
    f = found.select(entity, F.col("start_date").alias("_s"), F.col("end_date").alias("_e"))
    pairs = known.join(f, entity, "left")
    both = F.greatest(F.lit(0), F.datediff(F.least("end_date", "_e"), F.greatest("start_date", "_s")) + 1)
    either = F.datediff("end_date", "start_date") + 1 + F.datediff("_e", "_s") + 1 - both
    iou = F.coalesce(both / either, F.lit(0.0))
    best = pairs.groupBy(entity, "start_date", "end_date").agg(F.max(F.struct(iou.alias("iou"), (-F.datediff("_s", "start_date")).alias("d"))).alias("b"))
    return best.select(entity, "start_date", "end_date", "b.iou", F.when(F.col("b.iou") > 0, -F.col("b.d")).alias("delay_days"))
