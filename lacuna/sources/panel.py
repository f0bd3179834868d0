"""Panels: one row per entity and day, with sensors of falling priority, a target, and covariates.

PanelSpec names the columns; every operator takes one. The bindings build panels from the star-schema tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "entity"
    date: str = "date"
    category: str = "category"
    target: str = "target"
    sensors: tuple[str, ...] = ("s2", "landsat", "modis")
    weather: tuple[str, ...] = ("temp", "precip")

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.date]

    @property
    def dynamic(self) -> list[str]:
        return [self.target, *self.sensors, *self.weather]


SPEC = PanelSpec()


def exact_mean(value: Column, scale: int = 4) -> Column:
    """The mean as one exact decimal sum and one division: the same on every engine and partitioning."""
    n = F.count(value)
    return F.sum(value.cast(f"decimal(16,{scale})")).cast("double") / F.nullif(n, F.lit(0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(value: Column) -> Column:
    """NaN and both infinities become null: they are no observations."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def nation_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    by = rows.groupBy(F.col("n_name").alias("entity"), F.col("o_orderdate").cast("date").alias("date"))
    return by.agg((exact_mean(F.col("o_totalprice"), 2) / 10000).alias("temp"), F.count(F.lit(1)).cast("double").alias("precip"))


def nation_day(spark: SparkSession, sf_dir: str, weather: bool = False) -> DataFrame:
    """entity (nation), date (of shipping), category (region), three sensors (mean discount x 10 by return
    flag A, N, R) and the target: the first sensor that is there. nation and region are fixed dimensions."""
    lineitem, supplier, nation, region = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    by = rows.groupBy(F.col("n_name").alias("entity"), F.col("l_shipdate").cast("date").alias("date"), F.col("r_name").alias("category"))
    sensors = {"s2": "A", "landsat": "N", "modis": "R"}
    panel = by.agg(*[(exact_mean(F.when(F.col("l_returnflag") == flag, F.col("l_discount"))) * 10).alias(name) for name, flag in sensors.items()])
    panel = panel.withColumn("target", F.coalesce(*sensors))
    return panel.join(nation_weather(spark, sf_dir), ["entity", "date"], "left") if weather else panel


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (user), date, category (user mod 4), sensors view, click and purchase, temp from errors and precip
    from signups. A fifth of the rows have no target: natural gaps."""
    events = read(spark, sf_dir, "events")
    by = events.groupBy(F.col("user_id").cast("string").alias("entity"), F.col("ts").cast("date").alias("date"), (F.col("user_id") % 4).cast("string").alias("category"))
    kinds = {"s2": "view", "landsat": "click", "modis": "purchase", "temp": "error", "precip": "signup"}
    panel = by.agg(*[exact_mean(F.when(F.col("event_type") == kind, F.col("value"))).alias(name) for name, kind in kinds.items()])
    return panel.withColumn("target", F.coalesce("s2", "landsat", "modis"))


def hash_byte(*parts: Column | str | int) -> Column:
    """The first two hex digits of the md5 of the parts joined by '|': a seeded draw that every engine repeats."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) if isinstance(p, int) else F.col(p) for p in parts]
    return F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 2)


def hash_gaps(panel: DataFrame, seed: int = 17, spec: PanelSpec = SPEC) -> DataFrame:
    """panel with `hidden`: 38 in 256 of the rows that have a target."""
    return panel.withColumn("hidden", F.col(spec.target).isNotNull() & (hash_byte(spec.entity, spec.date, seed) < "26"))


def masked(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Rows with `hidden` lose every dynamic value; `truth` keeps the target."""
    out = panel.withColumn("truth", F.col(spec.target))
    return out.withColumns({c: F.when(~F.col("hidden"), F.col(c)) for c in spec.dynamic if c in panel.columns})


def masked_but(panel: DataFrame, static: tuple[str, ...], spec: PanelSpec = SPEC) -> DataFrame:
    """As `masked`, but hidden rows keep only the keys, the category and the columns named static: whatever else a panel comes to have,
    provenance and quality columns included, is hidden unless it is allowed."""
    kept = {spec.entity, spec.date, spec.category, "hidden", *static}
    out = panel.withColumn("truth", F.col(spec.target))
    return out.withColumns({c: F.when(~F.col("hidden"), F.col(c)) for c in panel.columns if c not in kept})
