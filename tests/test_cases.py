"""Made cases, the audit of a year, warnings of empty series and context errors."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lacuna.operators import anomaly, asof, cases, compose

START = dt.date(2020, 4, 1)


def season_rows(spark, entities=3, days=75):
    rows = [(f"e{e}", START + dt.timedelta(2 * k), 0.5 + 0.1 * e, 0.04, "polygon") for e in range(entities) for k in range(days)]
    return spark.createDataFrame(rows, "entity string, date date, expected double, climatology_scale double, reference_level string")


def test_pulses_are_found_and_controls_stay_silent(spark):
    made = cases.judged(cases.synthetic(season_rows(spark)))
    found = {r.entity: r for r in made.collect()}
    assert len(found) == 21 and {r.kind for r in found.values()} == set(cases.DEPTHS)
    for r in found.values():
        if r.kind in cases.PULSES:
            assert r.expects_event and r.events == 1 and r.iou > 0.8 and r.outside == 0 and r.support_delay_days == 2
        else:
            assert not r.expects_event and r.events == 0 and r.iou is None and r.support_delay_days is None
        assert r.critical == (r.kind in ("medium_pulse", "strong_pulse"))
    kinds = {r.kind: r for r in cases.by_kind(made).collect()}
    assert kinds["strong_pulse"].with_events == kinds["strong_pulse"].cases == 3 and kinds["normal"].with_events == 0


def test_cases_repeat_and_keep_to_their_kind(spark):
    rows = cases.synthetic(season_rows(spark))
    a, b = (sorted(map(str, x.collect())) for x in (rows, cases.synthetic(season_rows(spark).repartition(5))))
    assert a == b and a != sorted(map(str, cases.synthetic(season_rows(spark), seed=8).collect()))
    for r in rows.collect():
        off = (r.value - r.expected) / r.climatology_scale
        if r.in_pulse:
            assert abs(off + cases.DEPTHS[r.kind]) <= 0.2 + 1e-9 and r.precip_ratio == 0.3 and r.sensor_negative_count == 2
        elif r.kind in ("normal", "source_switch", *cases.PULSES):
            assert abs(off) <= 0.2 + 1e-9 and r.precip_ratio is None
        assert r.is_observed == (r.uncertainty_std is None)
        assert (r.selected_source == "modis") == (r.value_raw < r.value)


def test_short_and_empty_seasons(spark):
    short = cases.synthetic(season_rows(spark, 1, 3))
    assert short.count() == 21 and cases.judged(short).count() == 7
    nothing = season_rows(spark).withColumn("expected", F.lit(None).cast("double"))
    assert cases.judged(cases.synthetic(nothing)).count() == 0


def audited(spark, drop=0.4, years=(2015, 2021), shift=0.0):
    rows = []
    for y in range(*years):
        for k in range(40):
            d = dt.date(y, 5, 1) + dt.timedelta(2 * k)
            for e in range(4):
                v = 0.5 + 0.015 * ((y + k + e) % 3) + (shift if y == years[1] - 1 else 0)
                v -= drop if e == 1 and y == years[1] - 1 and 10 <= k < 20 else 0
                other = k % 2 == 1
                rows.append((f"e{e}", d, "c", None if other else v, v * 2 - 0.3 if other or k % 4 == 0 else None, None))
    df = spark.createDataFrame(rows, "entity string, date date, category string, s2 double, landsat double, modis double")
    return df.withColumn("target", F.coalesce("s2", "landsat", "modis"))


@pytest.mark.parametrize("harmonizer", [cases.affine, cases.pooled])
def test_audit_finds_the_fallen_entity(spark, harmonizer):
    out = {r.entity: r for r in cases.audit(cases.audit_points(audited(spark), 2020, harmonizer)).collect()}
    assert len(out) == 4 and all(r.rows == r.observed == 40 and r.unsupported == 0 for r in out.values())
    assert out["e1"].events >= 1 and out["e1"].review_group == "strong_candidate" and out["e1"].place == 1
    assert [out[e].events for e in ("e0", "e2", "e3")] == [0, 0, 0] and out["e0"].max_score == 0
    assert sorted(r.place for r in out.values() if r.review_group == "questionable_control") == [1, 2, 3]


def test_audit_sees_nothing_of_the_year_in_what_it_holds_it_against(spark):
    """Later years change nothing, and the year itself does not move its expectation."""
    a = audited(spark)
    later = a.withColumn("date", F.add_months("date", 12)).where(F.year("date") == 2021).withColumns({c: F.col(c) - 0.3 for c in ("s2", "landsat", "modis", "target")})
    names = ["entity", "date", "expected", "climatology_scale", "harmonized", "effective_z"]
    want = sorted(map(str, cases.audit_points(a, 2020, cases.affine).select(*names).collect()))
    assert sorted(map(str, cases.audit_points(a.unionByName(later), 2020, cases.affine).select(*names).collect())) == want
    moved = cases.audit_points(audited(spark, shift=0.2), 2020, cases.affine).select("entity", "date", "expected").collect()
    still = cases.audit_points(a, 2020, cases.affine).select("entity", "date", "expected").collect()
    assert sorted(map(str, moved)) == sorted(map(str, still))


def test_audit_refuses_gaps_other_targets_and_absent_years(spark):
    a = audited(spark)
    for year in (2015, 2030):
        with pytest.raises(ValueError):
            cases.audit_points(a, year)
    with pytest.raises(PySparkException, match="first sensor"):
        cases.observations(a.withColumn("target", F.col("target") + 0.1)).collect()
    with pytest.raises(PySparkException, match="not gaps"):
        cases.observations(a.withColumn("hidden", F.lit(True))).collect()
    assert cases.observations(a.withColumn("hidden", F.lit(False))).count() == a.count()


def test_empty_series_and_missing_context(spark):
    points = spark.createDataFrame([("a", 0.5, 1, True, 0.9)], "entity string, v double, reference_years int, is_observed boolean, confidence double")
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "entity string")
    assert {r.entity: r.warnings for r in anomaly.warnings(points, "v", asked=asked).collect()} == {"a": ["INSUFFICIENT_REFERENCE_YEARS"], "b": ["EMPTY_SERIES"]}
    rows = spark.createDataFrame([("a", START, 0.4), ("a", START + dt.timedelta(1), None), ("b", START, None)], "entity string, date date, target double")
    near = asof.nearest(rows, "target").where("target is null")
    assert asof.with_context(near.where("entity = 'a'")).first().left_value == 0.4
    with pytest.raises(PySparkException, match="no observation of b"):
        asof.with_context(near).collect()


def test_run_diagnostics(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 5, 1), 0.2, 0.4, 0.3, 10, 20), ("b", dt.date(2020, 1, 3), 1.0, 1.4, 1.2, 10, None), ("c", dt.date(2020, 1, 3), 0.0, 0.0, 0.0, 10, 400)], "entity string, date date, x double, y double, p double, ld int, rd int")
    left, right = compose.same_season(F.col("ld"), -1), compose.same_season(F.col("rd"), 1)
    shared = ["interval_empirical_not_conformal", "harmonization_not_applied"]

    def found(df, members, measured=True):
        return {r.entity: r for r in compose.run_diagnostics(df, "p", members, left, right, 0.1, measured).collect()}

    out = found(rows, {"x": 3.0, "y": 1.0})
    assert out["a"].disagreement == pytest.approx((0.75 * 0.05**2 + 0.25 * 0.15**2) ** 0.5) and out["a"].quality_flags == shared
    assert out["b"].quality_flags == [*shared, "no_same_season_context", "prediction_outside_physical_range"] and out["b"].upper == pytest.approx(1.3)
    assert out["c"].quality_flags == [*shared, "no_same_season_context"]
    for df, members in ((rows, {"x": 1.0}), (rows, {}), (rows.withColumn("y", F.when(F.col("entity") != "c", F.col("y"))), {"x": 1.0, "y": 1.0}), (rows.withColumn("y", F.lit(float("nan"))), {"x": 1.0, "y": 1.0})):
        out = found(df, members, False)
        assert all(r.disagreement == 0 and r.quality_flags[2:4] == ["interval_width_from_documentation", "model_disagreement_unavailable"] for r in out.values())
    assert "one_sided_context" in found(rows.withColumn("date", F.lit(dt.date(2020, 12, 31))), {"x": 1.0, "y": 1.0})["a"].quality_flags
    assert found(rows.where("false"), {"x": 1.0, "y": 1.0}) == {}
    with pytest.raises(ValueError):
        found(rows, {"x": 1.0, "y": -1.0})
