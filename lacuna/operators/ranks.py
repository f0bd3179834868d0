"""Numbers and order statistics over whole tables, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.staging import staged

#: A table of at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, n: int) -> DataFrame:
    """A table of n rows as the small side of a join."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """rows with their number, from 0, in a total order: ranges of the order are numbered each in its own task, and only
    their sizes are added up in one."""
    parts = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_before") + place).cast("bigint")).drop("_part", "_before")


def order_statistics(rows: DataFrame, keys: list[str], value: str, asked: DataFrame, bins: int = 4096) -> DataFrame:
    """asked (keys, place: from 1, and other columns) with `value`: the place-th smallest value of its group.

    One pass counts the values in equal bins between the group's least and largest, a second one looks only into the bins
    that hold a place, by distinct value. Nulls are left out; a place beyond the group's size has no row. rows are read
    three times, so they are best a written table.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = staged(rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "ends")
    share = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    binned = rows.join(few(ends, ends.count()), keys).withColumn("_bin", F.coalesce(F.least(F.lit(bins - 1), F.floor(share * bins)), F.lit(0)).cast("int"))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin"))
    hit = asked.join(counts.withColumn("_upto", upto), keys).where((F.col("place") <= F.col("_upto")) & (F.col("place") > F.col("_upto") - F.col("_n")))
    hit = staged(hit.withColumn("_rest", F.col("place") - F.col("_upto") + F.col("_n")).drop("_upto", "_n"), "places")
    wanted = hit.select(*keys, "_bin").distinct()
    inside = binned.join(few(wanted, wanted.count()), [*keys, "_bin"]).groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = inside.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))).where("_n > 0")
    found = hit.join(inside, [*keys, "_bin"]).where((F.col("_rest") <= F.col("_upto")) & (F.col("_rest") > F.col("_upto") - F.col("_n")))
    return found.select(*asked.columns, F.col("_v").alias("value"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): exact, by order_statistics."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = n.select(*keys, F.explode(F.array(F.floor((F.col("n") - 1) / 2) + 1, F.floor(F.col("n") / 2) + 1)).alias("place"))
    return order_statistics(rows, keys, value, asked).groupBy(*keys).agg(F.avg("value").alias("median"))


#: A group of at most so many values may be gathered in one task.
LARGE = 100_000


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: tuple[float, ...], aggs: tuple[Column, ...] = (), large: int | None = None) -> DataFrame:
    """(keys, n: how many values, q: their exact quantiles by linear interpolation, and further aggregates of the rows), a row per group.

    Groups of more than `large` values are not gathered: order_statistics finds their places, for all of them (and so for all
    grouping sets that rows were spread over) at once. Keys may be null. rows are staged, so they are derived once.
    """
    large = LARGE if large is None else large
    rows = staged(rows, "quantile-rows")
    places = [F.lit(float(p)) for p in probs]
    exact = F.percentile(F.col(value).cast("double"), F.array(*places)).alias("q")
    n = F.count(value).alias("n")
    if rows.count() <= large:  # no group has more
        return rows.groupBy(*keys).agg(n, exact, *aggs)
    sizes = staged(rows.groupBy(*keys).agg(n, *aggs).withColumn("_g", F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))), "group-sizes")
    big = sizes.where(F.col("n") > large).select("_g", "n")
    many = big.count()
    if not many:
        return rows.groupBy(*keys).agg(n, exact, *aggs)
    keyed = rows.select(F.struct(*keys).alias("_g") if keys else F.struct(F.lit(0).alias("_")).alias("_g"), F.col(value).alias("_value"))
    names = few(big.select("_g"), many)
    small = keyed.join(names, "_g", "left_anti").groupBy("_g").agg(F.percentile(F.col("_value").cast("double"), F.array(*places)).alias("q"))
    spots = F.array_distinct(F.flatten(F.transform(F.array(*places), lambda p: F.array(F.floor((F.col("n") - 1) * p) + 1, F.ceil((F.col("n") - 1) * p) + 1))))
    found = order_statistics(keyed.join(names, "_g", "left_semi"), ["_g"], "_value", big.select("_g", F.explode(spots).alias("place")))
    # as many entries as places were asked for
    held = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("_m")).join(few(big, many), "_g")

    def at(p: Column) -> Column:
        spot = (F.col("n") - 1) * p
        low, high = F.floor(spot), F.ceil(spot)
        a, b = F.element_at("_m", low + 1), F.element_at("_m", high + 1)
        return F.when(low == high, a).otherwise((high - spot) * a + (spot - low) * b)

    both = small.unionAll(held.select("_g", F.transform(F.array(*places), at).alias("q")))
    return sizes.join(both, "_g", "left").select(*keys, "n", "q", *[c for c in sizes.columns if c not in (*keys, "n", "_g")])
