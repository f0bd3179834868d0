"""Members out of fold, importances, and the pruned search against plain loops."""

import hashlib
import math
import random
from statistics import fmean, median, pstdev

import pytest
from pyspark.sql import functions as F

from lacuna.operators import learn
from lacuna.plans import learned  # noqa: F401  it registers its queries
from lacuna.plans import queries as Q

SF = "/root/testdata/sf0.001"
CLASSES = ("s2", "landsat", "modis")


def made_rows(spark, n=240, entities=12):
    r = random.Random(5)
    rows = [(f"e{k % entities}", f"2020-01-{k % 28 + 1:02}", "ab"[k % 2], CLASSES[r.randrange(3)], r.random(), r.random(), r.random(), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "entity string, d string, category string, source string, truth double, a double, b double, k int").withColumn("date", F.date_add(F.to_date("d"), F.col("k") * 30))


def test_rows_are_out_of_fold(spark):
    """A learner that tells which entities it was fitted on."""
    _, df = made_rows(spark)

    def learner(rows):
        seen = rows.agg(F.collect_set("entity").alias("seen"))
        return lambda asked: asked.crossJoin(F.broadcast(seen))

    out = learn.cross_fitted(df, learner).collect()
    assert len(out) == 240 and all(r.entity not in r.seen for r in out) and all(len(r.seen) >= 4 for r in out)
    with pytest.raises(ValueError):
        learn.cross_fitted(df.where("entity = 'e0'"), learner)


def test_expert_of_few_rows_is_the_anchor(spark):
    _, df = made_rows(spark)
    rows = df.where("source <> 'modis' or entity = 'e3'")
    learner = learn.source_experts("source", CLASSES, learn.frequencies("source", ["category"], CLASSES), learn.mean_residual("a"), "a")
    for r in learn.cross_fitted(rows, learner).collect():
        p = [r[f"p_{c}"] for c in CLASSES]
        assert abs(sum(p) - 1) < 1e-12 and min(p) >= 0 and r.expert_modis == r.a
        assert math.isclose(r.pred_experts, sum(x * r[f"expert_{c}"] for x, c in zip(p, CLASSES)), abs_tol=1e-12)


def test_unseen_group_takes_all_shares(spark):
    _, df = made_rows(spark)
    predict = learn.frequencies("source", ["category"], CLASSES)(df)
    r = predict(df.limit(1).withColumn("category", F.lit("z"))).first()
    n = df.count()
    assert math.isclose(r.p_s2, df.where("source = 's2'").count() / n)


def test_tree_experts(spark):
    rows = Q.QUERIES["source_experts"](spark, SF).collect()
    assert len(rows) > 500 and all(abs(sum(r[f"p_{c}"] for c in CLASSES) - 1) < 1e-9 for r in rows)

    def rmse(c):
        return fmean((r[c] - r.truth) ** 2 for r in rows) ** 0.5

    assert rmse("pred_experts") < rmse("pred_linear")


def plain_importance(rows, features, weights, repeats, seed):
    out = {}
    for fold in sorted({r["category"] for r in rows}):
        mine = sorted((r for r in rows if r["category"] == fold), key=lambda r: (r["entity"], r["date"]))

        def rmse(values):
            return fmean((sum(w * v[f] for f, w in weights.items()) - v["truth"]) ** 2 for v in values) ** 0.5

        own = rmse(mine)
        for f in features:
            got = []
            for k in range(repeats):
                order = sorted(mine, key=lambda r: (hashlib.md5(f"{r['entity']}|{r['date']}|{seed + k}".encode()).hexdigest(), r["entity"], r["date"]))
                got.append(rmse([{**r, f: d[f]} for r, d in zip(mine, order)]))
            out[fold, f] = (len(mine), own, fmean(g - own for g in got), pstdev(got))
    return out


def test_importance_equals_a_plain_loop(spark):
    _, df = made_rows(spark)
    df = df.withColumn("truth", F.when(F.col("k") % 17 != 0, F.col("a") * 0.8 + 0.1))
    weights = {"a": 0.8, "b": 0.0}
    found = learn.permutation_importance(df, "category", "truth", ["a", "b"], lambda r: r.withColumn("prediction", 0.8 * F.col("a") + 0.0 * F.col("b")), repeats=3)
    rows = [r.asDict() for r in df.where("truth is not null").collect()]
    want = plain_importance(rows, ["a", "b"], weights, 3, 11)
    got = {(r["fold"], r.feature): (r.n, r.rmse, r.importance, r.spread) for r in found.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(got[k], w)), k
    assert all(got[f, "b"][2] == 0 and got[f, "a"][2] > 0.05 for f in "ab")


def plain_search(rows, candidates, first):
    folds = sorted({r["fold"] for r in rows})
    left, size, out, rung = list(candidates), min(first, len(folds)), [], 0
    while True:
        mean = {c: fmean(fmean((candidates[c](r) - r["truth"]) ** 2 for r in rows if r["fold"] == f) ** 0.5 for f in folds[:size]) for c in left}
        ranked = sorted(left, key=lambda c: (round(mean[c], 12), list(candidates).index(c)))
        keep = ranked[: math.ceil(len(ranked) / 2)] if size < len(folds) else ranked[:1]
        if size < len(folds):
            assert all(mean[c] <= median(mean.values()) + 1e-12 for c in keep)
        out += [(rung, c, size, c in keep) for c in left]
        if size == len(folds):
            return ranked[0], out
        left, size, rung = [c for c in left if c in keep], min(2 * size, len(folds)), rung + 1


@pytest.mark.parametrize("first", [1, 3, 50])
def test_pruned_search_equals_a_plain_loop(spark, first):
    rows, df = made_rows(spark)
    df = df.withColumn("fold", F.col("k") % 7)
    plain = [{"fold": r[7] % 7, "truth": r[4], "a": r[5], "b": r[6]} for r in rows]
    names = [f"w{k}" for k in range(9)] + ["twin"]
    weight = {n: (k / 8 if n != "twin" else 0.5) for k, n in enumerate(names)}
    columns = {n: weight[n] * F.col("a") + (1 - weight[n]) * F.col("b") for n in names}
    functions = {n: (lambda r, w=weight[n]: w * r["a"] + (1 - w) * r["b"]) for n in names}
    best, found = learn.pruned_search(df, "fold", "truth", columns, first)
    want, trail = plain_search(plain, functions, first)
    assert best == want and best != "twin" and [(x["rung"], x["candidate"], x["folds"], x["kept"]) for x in found] == trail


def test_search_of_nothing(spark):
    _, df = made_rows(spark)
    for rows, candidates in ((df, {}), (df.where("false"), {"a": F.col("a")})):
        with pytest.raises(ValueError):
            learn.pruned_search(rows, "category", "truth", candidates)
