"""Cross-entity donors: values of correlated entities on the same date."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lacuna.operators.ranks import few, numbered
from lacuna.shipping import ship
from lacuna.sources.panel import SPEC, PanelSpec
from lacuna.staging import staged


#: Entities of a tile, and days of a block of their values.
TILE, BLOCK = 512, 64
_FITS = "entity {0}, donor {0}, slope double, intercept double, weight double"


class _Sums:
    """Sums over shared days for all pairs of a lower and an upper tile (or of one with itself), block by block."""

    def __init__(self, tile: int, one: bool):
        self.tile, self.one = tile, one
        self.names: tuple[dict[int, object], dict[int, object]] = ({}, {})
        self.n, self.sx, self.sy, self.sxx, self.syy, self.sxy = (np.zeros((tile, tile)) for _ in range(6))

    def add(self, rows: list[tuple]) -> None:
        """rows of one block: (upper, place in the tile, entity, days in the block, values)"""
        held, seen = np.zeros((2, self.tile, BLOCK)), np.zeros((2, self.tile, BLOCK))
        for upper, place, name, days, values in rows:
            self.names[upper][place] = name
            held[int(upper), place, days], seen[int(upper), place, days] = values, 1.0
        y, x = held[0], held[0 if self.one else 1]
        my, mx = seen[0], seen[0 if self.one else 1]
        self.n += my @ mx.T
        self.sy += y @ mx.T
        self.sx += my @ x.T
        self.syy += (y * y) @ mx.T
        self.sxx += my @ (x * x).T
        self.sxy += y @ x.T

    def fits(self, least: int, least_corr: float) -> list[tuple]:
        """(entity, donor, slope, intercept, weight) in both directions."""
        out, names = [], (self.names[0], self.names[0 if self.one else 1])
        n = np.maximum(self.n, 1)
        xx, yy, xy = self.sxx - self.sx * self.sx / n, self.syy - self.sy * self.sy / n, self.sxy - self.sx * self.sy / n
        corr = xy / np.sqrt(np.maximum(xx * yy, 1e-10))
        good = (self.n >= least) & (corr >= least_corr)
        if self.one:
            np.fill_diagonal(good, False)
        weight = corr**4 * n / (n + 30)
        for flip in (False,) if self.one else (False, True):
            spread, of, on = (yy, self.sx, self.sy) if flip else (xx, self.sy, self.sx)
            slope = np.clip((xy + 0.15) / (spread + 0.15), 0.2, 1.8)
            intercept = of / n + 0.5 - slope * (on / n + 0.5)
            for i, j in zip(*(k.tolist() for k in np.nonzero(good))):
                pair = (names[1][j], names[0][i]) if flip else (names[0][i], names[1][j])
                out.append((*pair, float(slope[i, j]), float(intercept[i, j]), float(weight[i, j])))
        return out


def tile_pairs(packed: DataFrame, least: int) -> DataFrame:
    """(s, t), s <= t, of the tiles of packed (tile, block, days) of which two entities may share `least` days: in no block can a pair
    share more days than the fullest entity of either tile has there. With missing values no such bound holds for correlations."""
    most = packed.groupBy("tile", "block").agg(F.max(F.size("days")).alias("most"))
    one, two = most.toDF("s", "block", "a"), most.toDF("t", "block", "b")
    shared = one.join(two, "block").where("s <= t").groupBy("s", "t").agg(F.sum(F.least("a", "b")).alias("shared"))
    return shared.where(F.col("shared") >= least).select("s", "t")


def pair_fits(context: DataFrame, value: str, spec: PanelSpec = SPEC, least: int = 12, least_corr: float = 0.2, tile: int = TILE) -> DataFrame:
    """(entity, donor, slope, intercept, weight) of pairs of entities that share `least` dates and correlate.

    A blocked product of the matrix of values with itself: entities in tiles, days in blocks; a pair of tiles is one group that
    adds up its blocks as they come, so there is no row per pair and date. Pairs of tiles that cannot share enough days are passed
    over. Values are shifted by 1/2 before squaring, which leaves covariances as they are and sums small. An entity has one
    row a date; null entities are none.
    """
    ship(context.sparkSession)
    day = F.unix_date(F.col(spec.date).cast("date"))
    rows = context.where(F.col(value).between(-1, 1) & F.col(spec.entity).isNotNull()).select(F.col(spec.entity).alias("name"), F.floor(day / BLOCK).alias("block"), F.pmod(day, F.lit(BLOCK)).alias("day"), (F.col(value) - 0.5).alias("v"))
    rows = staged(rows, "donor-values")
    names = staged(numbered(rows.select("name").distinct(), [F.col("name")]), "donor-entities")
    place = names.select("name", F.floor(F.col("number") / tile).alias("tile"), F.pmod("number", F.lit(tile)).cast("int").alias("place"))
    grouped = rows.groupBy("name", "block").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("x"))
    packed = staged(grouped.join(few(place, names.count()), "name").select("tile", "place", "name", "block", F.col("x.day").alias("days"), F.col("x.v").alias("values")), "donor-blocks")
    pairs = staged(tile_pairs(packed, least), "tile-pairs")
    n = pairs.count()
    lower = packed.join(few(pairs.withColumn("tile", F.col("s")), n), "tile").withColumn("upper", F.lit(False))
    upper = packed.join(few(pairs.where("s < t").withColumn("tile", F.col("t")), n), "tile").withColumn("upper", F.lit(True))
    met = lower.unionByName(upper).select("s", "t", "block", "upper", "place", "name", "days", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [name_type, name_type, pa.float64(), pa.float64(), pa.float64()]
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (s, t), group in groupby(each, key=lambda x: x[:2]):
            sums = _Sums(tile, s == t)
            for _, block in groupby(group, key=lambda x: x[2]):
                sums.add([x[3:] for x in block])
            made = sums.fits(least, least_corr)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds)], names=["entity", "donor", "slope", "intercept", "weight"])

    kind = context.schema[spec.entity].dataType
    name_type = to_arrow_type(kind)
    return met.repartition("s", "t").sortWithinPartitions("s", "t", "block").mapInArrow(run, _FITS.format(kind.simpleString()))


def donors(queries: DataFrame, context: DataFrame, value: str, spec: PanelSpec = SPEC, tops: tuple[int, ...] = (3, 10)) -> DataFrame:
    """queries with donor_{k}, donor_{k}_n and donor_confidence: the weighted mean of the k strongest donors' mapped values on the
    date. Donors are chosen before it is known whether they have a value on the date."""
    order = Window.partitionBy("entity").orderBy(F.desc("weight"), "donor")
    ranked = staged(pair_fits(context, value, spec), "donor-fits").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(tops))
    strength = ranked.where("rank <= 3").groupBy("entity").agg(F.avg("weight").alias("donor_confidence"))
    seen = context.where(F.col(value).between(-1, 1)).select(F.col(spec.entity).alias("donor"), F.col(spec.date).alias("_date"), F.col(value).alias("_v"))
    asked = queries.select(F.col(spec.entity).alias("entity"), F.col(spec.date).alias("_date"))
    made = asked.join(ranked, "entity").join(seen, ["donor", "_date"]).withColumn("_p", F.col("intercept") + F.col("slope") * F.col("_v"))
    aggs = []
    for k in tops:
        top = F.col("rank") <= k
        aggs += [(F.sum(F.when(top, F.col("_p") * F.col("weight"))) / F.sum(F.when(top, F.col("weight")))).alias(f"donor_{k}"), F.count(F.when(top, 1)).alias(f"donor_{k}_n")]
    found = made.groupBy("entity", "_date").agg(*aggs).withColumnsRenamed({"entity": spec.entity, "_date": spec.date})
    out = queries.join(found, spec.keys, "left").join(strength.withColumnRenamed("entity", spec.entity), spec.entity, "left")
    return out.na.fill(0, [f"donor_{k}_n" for k in tops])
