"""Small fixtures with values worked out by hand or published."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import scalar
from lacuna.operators import anomaly, asof, evaluate, geo, harmonize, hygiene, mask, reconstruct, season
from lacuna.sources import files
from lacuna.sources import panel as P
from lacuna.streaming import events

SCHEMA = "entity string, date date, category string, target double, s2 double, landsat double, modis double, hidden boolean"


def series(spark, values, hidden=(), step=5, start=dt.date(2022, 6, 1), entity="p0"):
    rows = [(entity, start + dt.timedelta(days=step * i), "crop", v, v, None, None, i in hidden) for i, v in enumerate(values)]
    return P.masked(spark.createDataFrame(rows, SCHEMA))


def test_linear_and_mean_through_a_run(spark):
    rows = series(spark, [0.2 + 0.02 * i for i in range(8)], {2, 3, 4, 5})
    got = {r.date: r for r in reconstruct.all_baselines(reconstruct.context(rows)).collect()}
    assert [round(got[d].pred_linear, 12) for d in sorted(got)] == [0.24, 0.26, 0.28, 0.30]
    assert [round(got[d].pred_mean_neighbors, 12) for d in sorted(got)] == [0.27] * 4
    runs = asof.gap_runs(rows).orderBy("date").collect()
    assert [(r.gap_length, r.gap_position) for r in runs] == [(4, 1), (4, 2), (4, 3), (4, 4)]


def test_an_edge_takes_half_of_the_prior(spark):
    rows = series(spark, [0.3, 0.5, 0.9], {2})
    (r,) = reconstruct.baseline(reconstruct.context(rows), "linear").collect()
    assert r.prediction == pytest.approx((0.5 + 0.4) / 2) and r.reason == "one_neighbor_plus_seasonal_prior"
    (r,) = reconstruct.baseline(reconstruct.context(series(spark, [None, 0.5], {1})), "linear").collect()
    assert r.prediction == 0.5 and r.reason == "unfitted_default"


def test_hidden_values_do_not_leak(spark):
    values = [0.2, 0.4, 0.1, 0.7, 0.3, 0.6]
    poisoned = [1e9 if i in (1, 4) else v for i, v in enumerate(values)]
    a, b = (sorted(tuple(r) for r in reconstruct.all_baselines(reconstruct.context(series(spark, v, {1, 4}))).drop("truth").collect()) for v in (values, poisoned))
    assert a == b


def _pulse_frames(spark, depth):
    base = [(k, 0.5 + 0.15 * math.sin(k / 28)) for k in range(75)]
    offset = {2015: -0.008, 2016: 0.006, 2017: 0.0, 2018: 0.004, 2019: -0.004}
    ref = [("p", dt.date(y, 4, 1) + dt.timedelta(days=2 * k), "c", v + o, True, 1.0, "s2") for y, o in offset.items() for k, v in base]
    query = [("p", dt.date(2020, 4, 1) + dt.timedelta(days=2 * k), "c", v + depth * (25 <= k <= 36), True, 1.0, "s2", 2 if 25 <= k <= 36 else 0, 0.3, 5.0) for k, v in base]
    kind = "entity string, date date, category string, value double, is_observed boolean, quality double, selected_source string"
    return spark.createDataFrame(ref, kind), spark.createDataFrame(query, f"{kind}, sensor_negative_count int, precip_ratio double, temp_anomaly double")


@pytest.mark.parametrize(("depth", "severity"), [(0.0, None), (-0.065, "biomass_suppression"), (-0.25, "critical")])
def test_pulses(spark, depth, severity):
    ref, query = _pulse_frames(spark, depth)
    points = anomaly.score_points(season.leave_one_year_out(query, ref, "value"), "value")
    found = anomaly.explained(anomaly.advanced_events(points)).collect()
    if severity is None:
        assert not found
        return
    (e,) = found
    assert (str(e.start_date), str(e.end_date), e.severity, e.observed_points) == ("2020-05-21", "2020-06-12", severity, 12)
    if depth == -0.25:
        assert e.negative_area == pytest.approx(5.5) and e.min_z == pytest.approx(-6.25) and e.score == pytest.approx(5.5)
        assert e.reason_codes == ["LOW_PRECIPITATION", "HIGH_TEMPERATURE", "MULTISENSOR_CONFIRMATION", "PROLONGED_SUPPRESSION"]
        assert "two weeks" in e.explanation


def test_robust_line_passes_outliers(spark):
    s2 = np.linspace(0.2, 0.8, 120)
    modis = (s2 - 0.1) / 0.8
    modis[7] = 0.9
    start = dt.date(2020, 1, 1)
    rows = [("p", start + dt.timedelta(days=i), "c", float(a), float(a), None, float(b), False) for i, (a, b) in enumerate(zip(s2, modis))]
    df = spark.createDataFrame(rows, SCHEMA)
    maps = harmonize.fit_robust(df)
    out = harmonize.apply_robust(spark.createDataFrame([("p", "c", "modis", 0.5), ("p", "c", "landsat", 0.5), ("p", "c", "s2", 0.5)], "entity string, category string, source string, v double"), maps, "v", "source")
    got = {r.source: r for r in out.collect()}
    assert got["modis"].harmonized == pytest.approx(0.5, abs=0.002) and got["s2"].harmonized == 0.5
    assert got["landsat"].harmonized is None and not got["landsat"].calibration_supported


def test_splines():
    x = np.array([0.0, 1, 3, 4, 7, 9])
    assert reconstruct.pchip(x, 2 * x + 1, 5.0) == pytest.approx(11) and reconstruct.akima(x, 2 * x + 1, 5.0) == pytest.approx(11)
    step = np.array([0.0, 0, 0, 1, 1, 1])
    assert all(0 <= reconstruct.pchip(x, step, q) <= 1 for q in np.linspace(0, 9, 50))
    assert reconstruct.akima(x, x**2, 3.0) == pytest.approx(9)


def plain_pchip(x: np.ndarray, y: np.ndarray, q: float) -> float:
    """Monotone piecewise cubic through increasing x, at q within their range: slopes at inner points are weighted
    harmonic means of the neighbouring secants (Fritsch and Butland), ends take a three-point formula."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return float(y[0] + d[0] * (q - x[0]))
    m = np.zeros_like(y)
    a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    ok = d[:-1] * d[1:] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(ok, (a + b) / (a / d[:-1] + b / d[1:]), 0.0)

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    return plain_hermite(x, y, m, q)


def plain_akima(x: np.ndarray, y: np.ndarray, q: float) -> float:
    """Akima's spline of 1970 through increasing x, at q within their range."""
    d = np.diff(y) / np.diff(x)
    d = np.concatenate([[3 * d[0] - 2 * d[1], 2 * d[0] - d[1]], d, [2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]])
    w = np.abs(np.diff(d))
    left, right = w[2:], w[:-2]
    total = left + right
    flat = total <= 1e-9 * max(total.max(), 0)
    m = np.where(flat, (d[1:-2] + d[2:-1]) / 2, (left * d[1:-2] + right * d[2:-1]) / np.where(flat, 1, total))
    return plain_hermite(x, y, m, q)


def plain_hermite(x: np.ndarray, y: np.ndarray, m: np.ndarray, q: float) -> float:
    k = min(max(int(np.searchsorted(x, q, "right")) - 1, 0), len(x) - 2)
    h = x[k + 1] - x[k]
    t = (q - x[k]) / h
    return float((2 * t**3 - 3 * t**2 + 1) * y[k] + (t**3 - 2 * t**2 + t) * h * m[k] + (3 * t**2 - 2 * t**3) * y[k + 1] + (t**3 - t**2) * h * m[k + 1])


def test_splines_of_many_rows_equal_plain_ones(spark):
    r = np.random.default_rng(3)
    for n in range(3, 9):
        x = np.cumsum(r.integers(1, 40, (200, n)), axis=1).astype(float)
        y = np.where(r.random((200, 1)) < 0.2, 0.5, r.choice([0.1, 0.2, 0.4, 0.9], (200, n)))
        q = x[:, 0] + r.random(200) * (x[:, -1] - x[:, 0])
        q[:20] = x[:20, 1]
        want = [plain_pchip(a, b, c) for a, b, c in zip(x, y, q)]
        assert np.allclose(reconstruct.pchip(x, y, q), want, atol=1e-12)
        if n >= 5:
            assert np.allclose(reconstruct.akima(x, y, q), [plain_akima(a, b, c) for a, b, c in zip(x, y, q)], atol=1e-12)


def test_spline_columns(spark):
    """Numbers of points from none to eight, one side only, and null where there is no curve."""
    shape = "array<struct<day:int,v:double>>"
    sides = [(a, b) for a in range(5) for b in range(5)]
    rows = [("2020-01-01", [(18262 - 3 * k - 1, 0.1 * k) for k in range(a)], [(18262 + 2 * k + 1, 0.3 - 0.1 * (k % 2)) for k in range(b)], a, b) for a, b in sides]
    df = spark.createDataFrame(rows, f"d string, left {shape}, right {shape}, a int, b int").withColumn("date", F.to_date("d"))
    for g in reconstruct.splines(df).collect():
        points = sorted((p.day, p.v) for p in [*g.left, *g.right])
        x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points])
        curve = g.a and g.b
        assert g.pchip == (pytest.approx(plain_pchip(x, y, 18262)) if curve and len(x) >= 3 else None)
        assert g.akima == (pytest.approx(plain_akima(x, y, 18262)) if curve and len(x) >= 5 else None)


def test_scores_and_weights(spark):
    assert spark.range(1).select(scalar.gap_score(F.lit(0.06))).first()[0] == pytest.approx(12)
    rows = spark.createDataFrame([(float(i), float(i) + 0.5, float(i) - 0.5, "A") for i in range(20)], "y double, a double, b double, mode string")
    w = reconstruct.fit_weights(rows, ["a", "b"], "y")
    assert w["a"] == pytest.approx(0.5, abs=1e-3) and sum(w.values()) == pytest.approx(1)
    assert evaluate.composite(rows, "mode", "y", "a").first()[0] is None
    assert evaluate.adoption(0.003, 3, 0.0, 0.001) == (True, []) and evaluate.adoption(None, 2, 0.1, None)[0] is False


def test_labels_and_validation(spark):
    rows = spark.createDataFrame([(0.5, 0.5, None, None), (0.5, 0.4, 0.5, None), (0.5, None, None, 0.50000001), (0.5, 0.1, None, None), (None, 0.1, None, None)], "t double, s2 double, landsat double, modis double")
    got = [r[0] for r in rows.select(scalar.source_label(F.col("t"), {s: F.col(s) for s in ("s2", "landsat", "modis")})).collect()]
    assert got == ["s2", "landsat", "modis", "unknown", "unknown"]
    gaps = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("b", dt.date(2020, 1, 2))], "anon_polygon_id string, date date")

    def kinds(data, columns=hygiene.SUBMISSION):
        s = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in columns))
        return {r.type for r in hygiene.submission_violations(s, gaps).collect()}

    good = [("a", "2020-01-01", "0.1"), ("b", "2020-01-02", "-2e-1")]
    assert kinds(good) == set()
    assert kinds([*good, good[0]]) == {"duplicate_key", "row_count_mismatch"}
    assert kinds([good[0], ("b", "2020-02-30", "inf")]) == {"invalid_date", "inf_prediction", "missing_key"}
    assert kinds([good[0], ("c", "2020-01-02", "x")]) == {"string_prediction", "missing_key", "extra_key"}
    assert kinds(good, ("date", "anon_polygon_id", "primary_ndvi_pred")) == {"wrong_column_order"}


def test_masks(spark):
    df = series(spark, [0.1, 0.2, 0.3]).drop("hidden", "truth")
    out = mask.apply_mask(df, df.limit(1), ["target"])
    assert out.where("is_gap and target is null").count() == 1 and out.where("not is_gap").count() == 2
    with pytest.raises(Exception, match="not in the panel"):
        mask.apply_mask(df, spark.createDataFrame([("zz", dt.date(2020, 1, 1))], "entity string, date date"), ["target"]).collect()


def test_geometry(spark):
    def text(ring):
        return '{"type":"Polygon","coordinates":[[' + ",".join(f"[{x},{y}]" for x, y in ring) + "]]}"

    square = [(30, 50), (30.01, 50), (30.01, 50.01), (30, 50.01), (30, 50)]
    cases = {"good": text(square), "bow": text([(30, 50), (30.01, 50.01), (30.01, 50), (30, 50.01), (30, 50)]), "far": text([(x + 300, y) for x, y in square]), "wide": text([(-170, 0), (170, 0), (170, 1), (-170, 0)]), "tiny": text([(30 + (x - 30) / 1000, 50 + (y - 50) / 1000) for x, y in square]), "point": '{"type":"Point","coordinates":[1,2]}', "junk": "no json"}
    got = {r.k: r for r in geo.checked(spark.createDataFrame(list(cases.items()), "k string, g string"), "g").collect()}
    assert {k: r.code for k, r in got.items()} == {"good": None, "bow": None, "far": "COORDINATES_OUT_OF_RANGE", "wide": "ANTIMERIDIAN_NOT_SUPPORTED", "tiny": "AREA_TOO_SMALL", "point": "INVALID_GEOMETRY_TYPE", "junk": "INVALID_GEOMETRY"}
    # a bow-tie is two triangles that share the crossing
    assert got["bow"].repaired and not got["good"].repaired and got["bow"].vertices == 8 and len(got["bow"].geometry) == 2
    assert got["bow"].area_ha == pytest.approx(got["good"].area_ha / 2, rel=1e-3)
    # the ellipsoid's own area of this cell, to the scale error of a zone
    assert got["good"].area_ha == pytest.approx(79.74, rel=0.002) and got["good"].vertices == 5


def test_files(spark, tmp_path):
    names = files.KINDS["test"]
    row = ["a", "2022-06-01", *["0.5"] * len(files.VALUES), "wheat", "false"]
    row[2], row[3] = "inf", ""
    (tmp_path / "t.csv").write_text(",".join(names) + "\n" + ",".join(row) + "\n")
    got = files.read_panel(spark, str(tmp_path / "t.csv"), "test").first()
    assert got.s2_ndvi is None and got.s2_evi is None and got.primary_ndvi == 0.5 and got.is_synthetic_gap is False
    with pytest.raises(ValueError, match="missing"):
        files.read_panel(spark, str(tmp_path / "t.csv"), "train")
    out = str(tmp_path / "sub")
    files.write_submission(spark.createDataFrame([("b", dt.date(2022, 1, 2), 0.25), ("a", dt.date(2022, 1, 1), 1 / 3)], "anon_polygon_id string, date date, primary_ndvi_pred double"), out)
    assert sorted(tuple(r) for r in files.read_submission(spark, out).collect()) == [("a", "2022-01-01", "0.3333333333"), ("b", "2022-01-02", "0.2500000000")]


def test_streams_equal_batches(spark, tmp_path):
    rows = P.read(spark, "/root/testdata/sf0.001", "events")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    live = events.tumbling(events.stream(spark, str(tmp_path / "in"), rows), late="60 days")
    q = live.writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    want = events.tumbling(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(str, spark.table("tumbling").select("window_start", "event_type", "n").collect())) == sorted(map(str, want.select("window_start", "event_type", "n").collect()))


def test_submissions_are_derived_once(spark, tmp_path):
    """What a submission and its gaps come from is read once each, however many rules look at them."""
    n = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    gaps = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("b", dt.date(2020, 1, 2)), ("c", dt.date(2020, 1, 3))], "anon_polygon_id string, date date").mapInArrow(seen, "anon_polygon_id string, date date")
    names = ", ".join(f"{c} string" for c in hygiene.SUBMISSION)
    rows = spark.createDataFrame([("a", "2020-01-01", "nan"), ("a", "2020-01-01", "1"), ("d", "2020-01-03", "x"), (None, "x", "inf")], names).mapInArrow(seen, names)
    got = {r.type: (r.n, r.examples) for r in hygiene.submission_violations(rows, gaps).collect()}
    assert got == {"nan_prediction": (1, ["a|2020-01-01"]), "string_prediction": (1, ["d|2020-01-03"]), "inf_prediction": (1, ["x"]), "invalid_date": (1, ["x"]), "duplicate_key": (1, ["a|2020-01-01"]), "missing_key": (2, ["b|2020-01-02", "c|2020-01-03"]), "extra_key": (1, ["d|2020-01-03"]), "row_count_mismatch": (1, ["got 4, expected 3"])}
    assert n.value == 7
