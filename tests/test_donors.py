"""Donors by tiles against a plain loop over pairs."""

import datetime
import random

import numpy as np
import pytest

from lacuna.operators import donors

DAY = datetime.date(2019, 1, 1)


def panel(seed, entities, days, half=0):
    r = random.Random(seed)
    trend = [r.random() for _ in range(days)]
    rows = []
    for k in range(entities):
        mine = r.choice([0.0, 0.5, 1.0])
        for d in range(days):
            if r.random() < 0.6 and (not half or (k % 2 == 0) == (d < days // 2)):
                rows.append((f"e{k:03d}", DAY + datetime.timedelta(d), r.choice([None, 7.0] + [mine * trend[d] + (1 - mine) * r.random()] * 20)))
    return rows


def plain(rows, least=12, least_corr=0.2):
    series = {}
    for e, d, v in rows:
        if v is not None and -1 <= v <= 1:
            series.setdefault(e, {})[d] = v
    out = {}
    for a, one in series.items():
        for b, two in series.items():
            days = sorted(set(one) & set(two))
            if a != b and len(days) >= least:
                y, x, n = np.array([one[d] for d in days]), np.array([two[d] for d in days]), len(days)
                xx, yy, xy = ((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum()
                corr = xy / np.sqrt(max(xx * yy, 1e-10))
                if corr >= least_corr:
                    slope = min(1.8, max(0.2, (xy + 0.15) / (xx + 0.15)))
                    out[a, b] = tuple(round(v, 9) for v in (slope, y.mean() - slope * x.mean(), corr**4 * n / (n + 30)))
    return out


@pytest.mark.parametrize("tile", [4, 512])
def test_fits_against_plain(spark, tile):
    rows = [*panel(1, 23, 200), (None, DAY, 0.5), ("lone", DAY, 0.5)]
    df = spark.createDataFrame(rows, "entity string, date date, target double").repartition(3)
    got = {(x.entity, x.donor): tuple(round(v, 9) for v in (x.slope, x.intercept, x.weight)) for x in donors.pair_fits(df, "target", tile=tile).collect()}
    want = plain(rows)
    assert got == want and len(want) > 50
    assert donors.pair_fits(df.limit(0), "target", tile=tile).count() == 0


def test_tiles_that_cannot_share_days_are_passed_over(spark):
    rows = sorted(panel(2, 16, 400, half=1), key=lambda x: (int(x[0][1:]) % 2, x[0]))
    names = {e: f"{int(e[1:]) % 2}{e}" for e, *_ in rows}  # early ones and late ones in tiles of their own
    rows = [(names[e], d, v) for e, d, v in rows]
    df = spark.createDataFrame(rows, "entity string, date date, target double")
    from pyspark.sql import functions as F

    packed = df.where("target between -1 and 1").groupBy(F.floor(F.substring("entity", 1, 1).cast("int")).alias("tile"), "entity", F.floor(F.unix_date("date") / donors.BLOCK).alias("block")).agg(F.collect_list("date").alias("days"))
    assert sorted(tuple(x) for x in donors.tile_pairs(packed, 200).collect()) == []
    kept = {tuple(x) for x in donors.tile_pairs(packed, 70).collect()}
    assert {(0, 0), (1, 1)} <= kept and (0, 1) not in kept
    got = {(x.entity, x.donor) for x in donors.pair_fits(df, "target", tile=8, least=70).collect()}
    assert got == set(plain(rows, 70))


def test_no_row_for_each_pair_and_date(spark):
    df = spark.createDataFrame(panel(3, 10, 60), "entity string, date date, target double")
    plan = donors.pair_fits(df, "target")._jdf.queryExecution().executedPlan().toString()
    assert "_date" not in plan and "MapInArrow" in plan
