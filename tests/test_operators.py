"""Operators that SQL does not cover, and hot keys."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import staging
from lacuna.operators import compose, evaluate, harmonize, mask, neighbors, ranks, reports, requests
from lacuna.sources import files

DAY = datetime.date(2000, 1, 1)


def test_numbers_and_places(spark):
    r = random.Random(1)
    values = [round(r.gauss(0, 1), 2) for _ in range(500)] + [0.5] * 300 + [1e9]
    rows = spark.createDataFrame([("a", x) for x in values] + [("b", 1.0)], "k string, v double").repartition(7)
    got = [x.v for x in ranks.numbered(rows.where("k = 'a'"), [F.col("v")], "i").orderBy("i").collect()]
    assert got == sorted(values)
    asked = spark.createDataFrame([("a", p) for p in (1, 2, 400, 801)] + [("b", 1), ("b", 2)], "k string, place bigint")
    for bins in (1, 7, 4096):
        found = {(x.k, x.place): x.value for x in ranks.order_statistics(rows, ["k"], "v", asked, bins).collect()}
        assert found == {("a", p): sorted(values)[p - 1] for p in (1, 2, 400, 801)} | {("b", 1): 1.0}
    assert {x.k: x.median for x in ranks.medians(rows, ["k"], "v").collect()} == {"a": float(np.median(values)), "b": 1.0}


def test_lines_in_rounds_are_those_of_one_task(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        x = r.uniform(-0.5, 0.5)
        rows.append((f"e{k % 2}", DAY + datetime.timedelta(k), "c", 0.7 * x + 0.1 + r.gauss(0, 0.02) + (1 if k % 40 == 0 else 0) * 0.3, x, x if k % 3 else None))
    panel = spark.createDataFrame(rows, "entity string, date date, category string, s2 double, landsat double, modis double").repartition(3)
    a, b = ({(x.source, x.level, x.key): (x.n, round(x.slope, 8), round(x.offset, 8), round(x.scale, 8)) for x in harmonize.fit_robust(panel, gathered=n, rounds=4).collect()} for n in (100_000, 150))
    assert a == b and len(a) == 8 and abs(a["landsat", "global", "*"][1] - 0.7) < 0.05


def test_bounds_are_mapped(spark):
    maps = spark.createDataFrame([("landsat", "global", "*", 2.0, 0.1, 1000)], "source string, level string, key string, slope double, offset double, n bigint")
    rows = spark.createDataFrame([("e", "c", 0.2, 0.1, 0.3, 0.05, "landsat")], "entity string, category string, v double, lower double, upper double, sigma double, source string")
    x = harmonize.apply_robust(rows, maps, "v", "source", sigma="sigma", bounds=("lower", "upper")).first()
    assert [round(v, 9) for v in (x.harmonized, x.lower, x.upper, x.sigma)] == [0.5, 0.3, 0.7, 0.1]


def test_same_date_of_visible_rows_and_one_date(spark):
    r = random.Random(3)
    rows = [(f"e{k}", DAY, r.choice([None, 0.1, 0.2, r.random()])) for k in range(200)] + [("x", DAY + datetime.timedelta(1), 0.5)]
    panel = spark.createDataFrame(rows, "entity string, date date, v double").repartition(5)
    got = {(x.entity, x.date): (x.o_count, x.o_median, x.o_iqr) for x in neighbors.same_date_others(panel, panel, "v", "o_").collect()}
    for e, d, _ in rows:
        others = [v for f, g, v in rows if g == d and f != e and v is not None]
        n, median, iqr = got[e, d]
        assert n == len(others)
        if others:
            assert abs(median - np.median(others)) < 1e-12 and abs(iqr - (np.quantile(others, 0.75) - np.quantile(others, 0.25))) < 1e-12


def test_bootstrap_without_rows_or_values(spark):
    kind = "b string, t double, p double"
    assert evaluate.bootstrap_rmse(spark.createDataFrame([], kind), "b", "t", "p", 5).first().rmse is None
    one = evaluate.bootstrap_rmse(spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, None)], kind), "b", "t", "p", 20).first()
    assert one.rmse == 1.0


def out_of_fold(spark):
    r, rows = random.Random(4), []
    for k in range(800):
        t = r.random()
        rows.append(("ABCD"[k % 4], k % 5, k % 3 == 0, t, t + r.gauss(0, 0.2), t + r.gauss(0, 0.05), 0.5, k))
    return spark.createDataFrame(rows, "mode string, repeat int, seen boolean, truth double, pred_a double, pred_b double, pred_c double, k int")


def test_gates_and_blends(spark):
    rows = out_of_fold(spark)
    gates = {"worse": F.col("pred_b") > 2, "all": F.lit(True), "some": F.col("k") < 400}
    taken, tried = compose.select_gate(rows, "pred_a", "pred_b", "truth", gates)
    assert taken == "all" and [x["accepted"] for x in tried] == [False, True, True]
    assert compose.select_gate(rows, "pred_b", "pred_a", "truth", gates)[0] is None
    weights, name, scores = compose.select_blend(rows, ["pred_a", "pred_b", "pred_c"], "truth", (("pred_a", "pred_b"),))
    assert name == "optimized" and abs(sum(weights.values()) - 1) < 1e-9 and weights["pred_b"] > 0.8 and scores["optimized"] <= min(scores.values())
    with pytest.raises(ValueError):
        compose.select_blend(rows.where("mode <> 'D'"), ["pred_a"], "truth")


def test_requests():
    requests.check_range(DAY, DAY + datetime.timedelta(1830))
    for end in (DAY - datetime.timedelta(1), DAY + datetime.timedelta(1831)):
        with pytest.raises(ValueError):
            requests.check_range(DAY, end)
    assert requests.preflight({"a": 1, "b": 2}, {"b": 3, "c": 1}) == ["differs:b", "missing:a", "unexpected:c"]
    assert reports.most_important({"a": 1.0, "b": 2.0, "c": 2.0}, ("a", "b"), 2) == ["b", "c", "a"]


def test_reports_are_stable(spark):
    df = spark.createDataFrame([("b", 2), ("a|x", 1)], "name string, n int")
    text = reports.as_json({"two": df, "one": df.repartition(2)})
    assert json.loads(text)["one"] == [{"n": 1, "name": "a|x"}, {"n": 2, "name": "b"}] and text == reports.as_json({"one": df, "two": df})
    assert "| a\\|x | 1 |" in reports.as_markdown("t", {"one": df}) and requests.columns_with(df, ("na",)) == ["name"]


def panel_lines(names, k):
    return [",".join({"anon_polygon_id": "p", "date": f"2020-01-{k:02d}", "crop_type": "c", "is_synthetic_gap": "false", "s2_ndvi": "0.1", "s2_evi": "0.9", "s2_ndwi": "nan"}.get(n, "1") for n in names)]


def test_each_panel_file_has_its_own_order(spark, tmp_path):
    names = list(files.KINDS["test"])
    other = [*names[1:], names[0]]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("\n".join([",".join(names), *panel_lines(names, 1)]) + "\n")
    (tmp_path / "d" / "b.csv").write_text("\ufeff" + "\n".join([",".join(f'"{n}"' for n in other), *panel_lines(other, 2)]) + "\n")
    got = files.read_panel(spark, str(tmp_path / "d"), "test").collect()
    assert [(x.anon_polygon_id, x.s2_ndvi, x.s2_evi, x.s2_ndwi, x.is_synthetic_gap) for x in got] == [("p", 0.1, 0.9, None, False)] * 2
    assert files.control_totals(files.read_panel(spark, str(tmp_path / "d"), "test")).first()[:] == (2, 1, datetime.date(2020, 1, 1), datetime.date(2020, 1, 2), 2, 2.0, 0)
    (tmp_path / "d" / "c.csv").write_text(",".join(names[:-1]) + "\n")
    with pytest.raises(ValueError):
        files.read_panel(spark, str(tmp_path / "d"), "test")


def test_unions_pairs_and_hashes(spark, tmp_path):
    names = list(files.KINDS["test"])
    for name, k in (("one_train", 1), ("one_test", 2), ("two_test", 3)):
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(names), *panel_lines(names, k)]) + "\n")
    assert list(files.available_datasets(spark, str(tmp_path))) == ["one"]
    path = str(tmp_path / "one_test.csv")
    both = files.read_union(spark, {"test": path}, {"test": files.file_sha256(spark, path).first().sha256})
    assert both.select("dataset", "year", "doy").first()[:] == ("test", 2020, 2)
    with pytest.raises(ValueError):
        files.read_union(spark, {"test": path}, {"test": "0" * 64})


def test_a_failed_submission_leaves_the_old_one(spark, tmp_path):
    path, kind = str(tmp_path / "s"), "anon_polygon_id string, date date, primary_ndvi_pred double"
    files.write_submission(spark.createDataFrame([("a", DAY, 0.1)], kind), path)
    files.write_submission(spark.createDataFrame([("b", DAY, 0.1 + 0.2)], kind), path, None)
    assert [float(x.primary_ndvi_pred) for x in files.read_submission(spark, path).collect()] == [0.1 + 0.2]
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception):
            files.write_submission(spark.createDataFrame([("c", DAY, 0.1), ("d", DAY, bad)], kind), path)
    assert [x.anon_polygon_id for x in files.read_submission(spark, path).collect()] == ["b"]


def test_bytes_of_submissions(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("a,b,c\né,2,3\n".encode())
    (tmp_path / "bad.csv").write_bytes(b"\xef\xbb\xbfa,b,c\n1,2\n1,2,3,4\n")
    (tmp_path / "raw.csv").write_bytes(b"a,b,\xff\n")
    got = {(x.path.rsplit("/", 1)[1], x.rule): x.n for x in files.strict_lines(spark, str(tmp_path)).collect()}
    assert got == {("bad.csv", "byte_order_mark"): 1, ("bad.csv", "wrong_field_count"): 2, ("raw.csv", "not_utf8"): 1}


def test_artifacts(spark, tmp_path):
    df, path = spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int"), str(tmp_path / "a")
    digest = files.write_artifact(df, path, ["name"])
    assert [tuple(x) for x in files.read_artifact(spark, path, digest, df.schema).orderBy("name").collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        files.read_artifact(spark, path, "x", df.schema)


def test_staged_tables_go_with_their_scope(spark):
    def build():
        inner = staging.staged(spark.range(5), "inner")
        build.path = inner.inputFiles()[0]
        return inner.selectExpr("id * 2 as x")

    out = staging.settled(spark, "outer", build)
    assert sorted(x.x for x in out.collect()) == [0, 2, 4, 6, 8]
    place = spark._jvm.org.apache.hadoop.fs.Path(build.path)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_unknown_columns_are_hidden(spark):
    from lacuna.sources import panel as P

    rows = spark.createDataFrame([("e", DAY, "c", 0.5, "sensor", 7, True), ("f", DAY, "c", 0.6, "sensor", 8, False)], "entity string, date date, category string, target double, provenance string, doy int, hidden boolean")
    got = {x.entity: (x.target, x.provenance, x.doy, x.truth) for x in P.masked_but(rows, ("doy",)).collect()}
    assert got == {"e": (None, None, 7, 0.5), "f": (0.6, "sensor", 8, 0.6)}


@pytest.mark.parametrize("large", [10**9, 50, 0])
def test_quantiles_of_groups_of_any_size(spark, large):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, 3]), r.choice([None, 0.5, r.gauss(0, 1), r.random() ** 9])) for _ in range(2000)] + [("one", 1, 2.5), ("none", 1, None), ("flat", 1, 1.0), ("flat", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(5)
    for keys in (["k"], ["k", "j"], []):
        got = ranks.quantiles(df, keys, "v", (0.0, 0.1, 0.5, 0.975, 1.0), (F.max("j").alias("most"),), large)
        want = df.groupBy(*keys).agg(F.count("v").alias("n"), F.expr("percentile(v, array(0.0D, 0.1D, 0.5D, 0.975D, 1.0D))").alias("q"), F.max("j").alias("most"))
        plain = lambda d: sorted((*[str(x[k]) for k in keys], x.n, x.most, str(x.q and [round(y, 12) for y in x.q])) for x in d.collect())
        assert plain(got) == plain(want)


def test_no_task_holds_a_hot_group(spark):
    """A million distinct values of one group: no operator of the plan that is read has a percentile over them."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 1000).alias("v")).unionAll(spark.range(10).select(F.lit("cold"), F.col("id").cast("double")))
    found = ranks.quantiles(df, ["k"], "v", (0.25, 0.5, 0.75))
    got = {x.k: (x.n, [round(v, 9) for v in x.q]) for x in found.collect()}
    values = np.sort(np.array([(k * 7919) % 1_000_003 for k in range(1_000_000)]) / 1000)
    assert got == {"hot": (1_000_000, [round(float(v), 9) for v in np.quantile(values, (0.25, 0.5, 0.75))]), "cold": (10, [2.25, 4.5, 6.75])}


def test_matched_runs_do_not_touch_and_all_are_told(spark):
    r = random.Random(4)
    rows = [(f"e{e}", DAY + datetime.timedelta(d), ["a", "b", None][e % 3], r.choice([None, 1.0, 2.0])) for e in range(5) for d in range(0, 500, r.choice([1, 3, 9]))]
    panel = spark.createDataFrame(rows, "entity string, date date, category string, target double")
    asked = [(k, r.choice([1, 2, 4, 8, 30]), r.randrange(1, 13), r.choice(["a", "b", None, "none such"])) for k in range(400)]
    got = mask.matched_runs(panel, spark.createDataFrame(asked, "template bigint, length int, month int, category string"), 3).collect()
    assert sorted(x.template for x in got) == list(range(400))
    seen = {}
    for e, d, _, v in rows:
        if v is not None:
            seen.setdefault((e, d.year), []).append(d)
    by = {}
    for x in got:
        if x.first_date:
            days = seen[x.entity, x.year]
            a, b = days.index(x.first_date), days.index(x.last_date)
            assert b - a + 1 == x.length == min(8, asked[x.template][1])
            by.setdefault((x.entity, x.year), []).append((a, b))
    for runs in by.values():
        runs.sort()
        assert all(b + 1 < c for (_, b), (c, _) in zip(runs, runs[1:]))
    # what was not placed has no room left for a single row of its length
    for x in got:
        if x.first_date is None:
            taken = {k for a, b in by.get((x.entity, x.year), []) for k in range(a - 1, b + 2)}
            n = len(seen[x.entity, x.year])
            assert not any(all(k + j not in taken for j in range(x.length)) for k in range(n - x.length + 1))
    assert 30 < sum(len(v) for v in by.values()) < 400
    assert mask.matched_runs(panel, spark.createDataFrame([], "template bigint, length int, month int, category string"), 3).count() == 0


def test_window_modes_and_byte_order_marks(spark, tmp_path):
    from lacuna.operators import windows

    with pytest.raises(ValueError):
        windows.features(spark.range(1), ["v"], spark.range(1), F.lit(0.0), F.lit(0.0), mode="other")
    (tmp_path / "s.csv").write_text("\ufeffanon_polygon_id,date,primary_ndvi_pred\na,2022-01-01,0.5\n", encoding="utf-8")
    assert files.read_submission(spark, str(tmp_path / "s.csv")).columns == ["anon_polygon_id", "date", "primary_ndvi_pred"]


def test_draws_do_not_depend_on_how_slots_are_cut(spark, monkeypatch):
    totals = spark.createDataFrame([(str(k), 1, float(k), k) for k in range(25)], "_block string, n bigint, v double, number bigint")
    want = sorted(map(tuple, evaluate.draw_blocks(totals, ["v"], 7, 3).collect()))
    for slots in (1, 4, 25):
        monkeypatch.setattr(evaluate, "SLOTS", slots)
        assert sorted(map(tuple, evaluate.draw_blocks(totals, ["v"], 7, 3).collect())) == want and all(x[1] == 25 for x in want)
    assert evaluate.draw_blocks(totals.limit(0), ["v"], 7, 3).count() == 0


def test_submission_is_compared_before_it_takes_its_place(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out.csv")
    rows = spark.createDataFrame([(" a", "2020-01-01", 0.25), ("b,c", "2020-01-02", -0.5), ('q"', "2020-01-02", 1.0)], "anon_polygon_id string, d string, primary_ndvi_pred double").withColumn("date", F.to_date("d"))
    files.write_submission(rows, path, 4)
    want = {(" a", "2020-01-01", "0.2500"), ("b,c", "2020-01-02", "-0.5000"), ('q"', "2020-01-02", "1.0000")}
    assert {tuple(r) for r in files.read_submission(spark, path).collect()} == want
    whole = files.read_submission
    monkeypatch.setattr(files, "read_submission", lambda s, p: whole(s, p).withColumn("primary_ndvi_pred", F.lit("0.1000")))
    with pytest.raises(ValueError, match="not what was meant"):
        files.write_submission(rows, path, 4)
    monkeypatch.undo()
    assert {tuple(r) for r in files.read_submission(spark, path).collect()} == want
    assert [p.name for p in tmp_path.iterdir()] == ["out.csv"]
