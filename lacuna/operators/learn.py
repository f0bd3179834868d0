"""Learned members: tree regressors on neighbour and calendar features, experts of each source, out of fold by entity; what their
columns are worth; and the search among candidates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import reconstruct
from lacuna.operators.ranks import few, numbered
from lacuna.sources.panel import SPEC, PanelSpec, hash_byte
from lacuna.staging import staged

FEATURES = ("left_value", "right_value", "left_days", "right_days", "linear", "mean_neighbors", "seasonal_prior", "crop_seasonal_prior", "sin_doy", "cos_doy")


def calendar(rows: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """rows with year, month, doy, iso_week and the day's phase in several periods, from the absolute day."""
    day = F.datediff(spec.date, F.lit("2000-01-01").cast("date"))
    doy = F.dayofyear(spec.date)
    phases = {f"{f}_{p:g}".replace(".", "_"): fun(2 * math.pi * day / p) for p in (5, 8, 10, 16, 32, 365.25, 182.625) for f, fun in (("sin", F.sin), ("cos", F.cos))}
    return rows.withColumns({"year": F.year(spec.date), "month": F.month(spec.date), "doy": doy, "iso_week": F.weekofyear(spec.date), "sin_doy": F.sin(2 * math.pi * doy / 365.25), "cos_doy": F.cos(2 * math.pi * doy / 365.25), **phases})


def pipeline(stage, category: str) -> Pipeline:
    names = list(FEATURES)
    filled = [f"{c}_f" for c in names]
    return Pipeline(stages=[StringIndexer(inputCol=category, outputCol="_category", handleInvalid="keep"), Imputer(inputCols=names, outputCols=filled, strategy="median"), VectorAssembler(inputCols=[*filled, "_category"], outputCol="features"), stage])


def training_rows(panel: DataFrame, seed: int = 3, spec: PanelSpec = SPEC) -> DataFrame:
    """A second hashed mask over visible rows: their neighbours, priors and truth, to learn from."""
    visible = panel.where(F.col(spec.target).isNotNull())
    from lacuna.sources.panel import hash_gaps, masked

    rows = reconstruct.context(masked(hash_gaps(visible.drop("hidden", "truth"), seed, spec), spec), spec)
    return calendar(rows, spec).withColumns({c: F.col(c).cast("double") for c in FEATURES})


def gbt_member(panel: DataFrame, queries: DataFrame, spec: PanelSpec = SPEC, trees: int = 10) -> DataFrame:
    """queries (from reconstruct.context) with pred_gbt from trees fitted on pseudo gaps of the visible rows."""
    model = pipeline(GBTRegressor(labelCol="truth", maxIter=trees, maxDepth=4, seed=1), spec.category).fit(training_rows(panel, spec=spec))
    rows = calendar(queries, spec).withColumns({c: F.col(c).cast("double") for c in FEATURES})
    return model.transform(rows).withColumnRenamed("prediction", "pred_gbt").drop("features", "_category", *[f"{c}_f" for c in FEATURES])


def source_classifier(rows: DataFrame, label: str, parts: int = 3, spec: PanelSpec = SPEC, trees: int = 10) -> DataFrame:
    """rows with `source_guess`, each from a forest fitted without the row's group of entities (by hash)."""
    group = F.pmod(F.xxhash64(spec.entity), F.lit(parts))
    rows = rows.withColumn("_part", group)
    out = None
    for k in range(parts):
        index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep").fit(rows)
        model = pipeline(RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=5, seed=k), spec.category).fit(index.transform(rows.where(F.col("_part") != k)))
        names = F.array(*[F.lit(x) for x in index.labels])
        held = model.transform(rows.where(F.col("_part") == k)).withColumn("source_guess", F.get(names, F.col("prediction").cast("int")))
        held = held.select(*[c for c in rows.columns if c != "_part"], "source_guess")
        out = held if out is None else out.unionAll(held)
    return out


# --- members as functions, out of fold -------------------------------------------------------------------------

#: What rows to fit on give: rows with the same columns and further ones, which the learner names.
Predictor = Callable[[DataFrame], DataFrame]
Learner = Callable[[DataFrame], Predictor]


def entity_part(parts: int, spec: PanelSpec = SPEC) -> Column:
    """The part, from 0, of an entity: a hash, so the rows of one entity are never on both sides."""
    return (F.conv(hash_byte(spec.entity, 41), 16, 10).cast("int") % parts).cast("int")


def cross_fitted(rows: DataFrame, learner: Learner, parts: int = 3, spec: PanelSpec = SPEC) -> DataFrame:
    """rows with the columns of a learner, each row's from a fit on the other parts' entities. A part that has no rows, or to whose rows no
    others are left, has none to give: of two entities in one part nothing comes back, which is an error."""
    rows = staged(rows.withColumn("_part", entity_part(parts, spec)), "cross-fit")
    there = sorted(r[0] for r in rows.select("_part").distinct().collect())  # at most `parts` rows
    if len(there) < 2:
        raise ValueError("entities of two parts are needed")
    out = None
    for k in there:
        held = learner(rows.where(F.col("_part") != k).drop("_part"))(rows.where(F.col("_part") == k).drop("_part"))
        out = held if out is None else out.unionByName(held)
    return out


def forest_probabilities(label: str, classes: tuple[str, ...], spec: PanelSpec = SPEC, trees: int = 10, seed: int = 1) -> Learner:
    """p_{class}: a forest's; classes that the fit has not seen have 0, so the probabilities of a row have sum one."""

    def fit(rows: DataFrame) -> Predictor:
        index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep").fit(rows)
        model = pipeline(RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=5, seed=seed), spec.category).fit(index.transform(rows))
        seen = index.labels

        def predict(asked: DataFrame) -> DataFrame:
            p = vector_to_array("probability")
            known = sum((F.get(p, i) for i in range(len(seen))), F.lit(0.0))  # a forest may leave some to the place of unknown labels
            made = model.transform(asked)
            return made.select(*asked.columns, *[(F.get(p, seen.index(c)) / known if c in seen else F.lit(0.0)).alias(f"p_{c}") for c in classes])

        return predict

    return fit


def frequencies(label: str, keys: list[str], classes: tuple[str, ...]) -> Learner:
    """p_{class}: the shares of the classes among the rows of equal keys, else among all; one count for each of few groups."""

    def fit(rows: DataFrame) -> Predictor:
        def shares(by: list[str], tail: str) -> DataFrame:
            n = [F.count(F.when(F.col(label) == c, 1)) for c in classes]
            return rows.where(F.col(label).isin(*classes)).groupBy(*by).agg(*[(x / F.count(F.lit(1))).alias(f"_{tail}_{c}") for x, c in zip(n, classes)])

        groups = staged(shares(keys, "own"), "shares")

        def predict(asked: DataFrame) -> DataFrame:
            made = asked.join(few(groups, groups.count()), keys, "left").crossJoin(F.broadcast(shares([], "all")))
            return made.select(*asked.columns, *[F.coalesce(f"_own_{c}", f"_all_{c}").alias(f"p_{c}") for c in classes])

        return predict

    return fit


def boosted_residual(anchor: str, truth: str = "truth", spec: PanelSpec = SPEC, trees: int = 10) -> Callable[[str], Learner]:
    """For each class a learner of expert_{class}: the anchor and what trees make of the residuals from it."""

    def of(name: str) -> Learner:
        def fit(rows: DataFrame) -> Predictor:
            model = pipeline(GBTRegressor(labelCol="_residual", maxIter=trees, maxDepth=4, seed=1), spec.category).fit(rows.withColumn("_residual", F.col(truth) - F.col(anchor)))
            return lambda asked: model.transform(asked).select(*asked.columns, (F.col(anchor) + F.col("prediction")).alias(f"expert_{name}"))

        return fit

    return of


def mean_residual(anchor: str, truth: str = "truth") -> Callable[[str], Learner]:
    """For each class a learner of expert_{class}: the anchor and the mean of the residuals from it, one number."""

    def of(name: str) -> Learner:
        def fit(rows: DataFrame) -> Predictor:
            shift = rows.agg(F.avg(F.col(truth) - F.col(anchor)).alias("_shift"))
            return lambda asked: asked.crossJoin(F.broadcast(shift)).select(*asked.columns, (F.col(anchor) + F.coalesce("_shift", F.lit(0.0))).alias(f"expert_{name}"))

        return fit

    return of


def source_experts(label: str, classes: tuple[str, ...], guesser: Learner, expert: Callable[[str], Learner], anchor: str, least: int = 50) -> Learner:
    """p_{class}, expert_{class} and pred_experts, the experts' values weighted with the probabilities of their class.

    An expert learns from the rows of its class alone; one of fewer than `least` rows is the anchor as it stands. The label is only read in
    fitting: a row that is asked for is not known by its source.
    """

    def fit(rows: DataFrame) -> Predictor:
        sizes = {r[0]: r[1] for r in rows.where(F.col(label).isin(*classes)).groupBy(label).count().collect()}  # one row a class
        guess = guesser(rows)
        experts = {c: expert(c)(rows.where(F.col(label) == c)) for c in classes if sizes.get(c, 0) >= least}

        def predict(asked: DataFrame) -> DataFrame:
            made = guess(asked)
            for c in classes:
                made = experts[c](made) if c in experts else made.withColumn(f"expert_{c}", F.col(anchor))
            return made.withColumn("pred_experts", sum((F.col(f"p_{c}") * F.col(f"expert_{c}") for c in classes[1:]), F.col(f"p_{classes[0]}") * F.col(f"expert_{classes[0]}")))

        return predict

    return fit


# --- what columns are worth -----------------------------------------------------------------------------------


def permutation_importance(rows: DataFrame, fold: str, truth: str, features: list[str], predict: Predictor, prediction: str = "prediction", repeats: int = 2, seed: int = 11, spec: PanelSpec = SPEC) -> DataFrame:
    """(fold, feature, n, rmse, importance, spread): by how much a fold's RMSE grows when one column's values are dealt anew among the fold's
    rows, as the mean and population deviation over repeats. rows are held out: not those that the predictor was fitted on.

    Rows are numbered by (fold, key) and by (fold, hash); a fold has the same range of numbers in both orders, so a join by number
    gives each row a donor of its fold. Each row then stands once as it is and once for each repeat and column, with the
    donor's value, and all are predicted in one pass. Rows without a truth or a prediction are left out.
    """
    rows = staged(rows.where(F.col(truth).isNotNull()), "held-out")
    key = [F.col(fold), F.col(spec.entity), F.col(spec.date)]
    base = staged(numbered(rows, key, "_n"), "numbered")
    variants = [base.withColumns({"_feature": F.lit(None).cast("string"), "_repeat": F.lit(-1)})]
    for k in range(repeats):
        order = F.md5(F.concat_ws("|", F.col(spec.entity), F.col(spec.date).cast("string"), F.lit(str(seed + k))))
        donors = numbered(rows.select(fold, spec.entity, spec.date, *[F.col(c).alias(f"_d_{c}") for c in features], order.alias("_o")), [F.col(fold), F.col("_o"), F.col(spec.entity), F.col(spec.date)], "_n").drop(fold, spec.entity, spec.date, "_o")
        both = base.join(donors, "_n").withColumns({"_repeat": F.lit(k), "_feature": F.explode(F.array(*map(F.lit, features)))})
        both = both.withColumns({c: F.when(F.col("_feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)) for c in features})
        variants.append(both.select(*base.columns, "_feature", "_repeat"))
    every = variants[0]
    for v in variants[1:]:
        every = every.unionByName(v)
    e = F.col(prediction) - F.col(truth)
    per = staged(predict(every).groupBy(F.col(fold).alias("fold"), F.col("_feature").alias("feature"), "_repeat").agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("r")), "permuted")
    own = per.where("feature is null").select("fold", F.col("r").alias("rmse"))
    made = per.where("feature is not null").join(F.broadcast(own), "fold")  # one row a fold
    return made.groupBy("fold", "feature").agg(F.max("n").alias("n"), F.max("rmse").alias("rmse"), F.avg(F.col("r") - F.col("rmse")).alias("importance"), F.stddev_pop("r").alias("spread"))


# --- searching among candidates ---------------------------------------------------------------------------------


def pruned_search(rows: DataFrame, fold: str, truth: str, candidates: dict[str, Column], first: int = 1) -> tuple[str, list[dict[str, object]]]:
    """(the best candidate, what each rung found): successive halving over folds.

    A rung looks at `first` folds, then at twice as many as before, up to all; of a candidate it keeps the mean of its folds' RMSE. The
    better half goes on: those not above the median of the rung. Ties go by the candidates' order, and the last rung, of all folds, decides.
    A rung reads only its new folds' rows, and all candidates that are left come from one aggregation by fold, so Spark's work falls as
    candidates go. Candidates are columns; a learned one is its out-of-fold prediction.
    """
    if not candidates or first < 1:
        raise ValueError("no candidates")
    left, scores, seen, found, rung = list(candidates), {c: [] for c in candidates}, 0, [], 0
    folds = sorted(r[0] for r in rows.where(F.col(truth).isNotNull() & F.col(fold).isNotNull()).select(fold).distinct().collect())  # one row a fold
    if not folds:
        raise ValueError("no rows")
    size = min(first, len(folds))
    while True:
        new = folds[seen:size]
        errors = [F.sqrt(F.avg(F.pow(candidates[c] - F.col(truth), F.lit(2.0)))).alias(f"r{k}") for k, c in enumerate(left)]
        for r in sorted(rows.where(F.col(fold).isin(*new)).groupBy(F.col(fold).alias("fold")).agg(*errors).collect(), key=lambda r: r["fold"]):
            for k, c in enumerate(left):
                scores[c].append(math.inf if r[f"r{k}"] is None else r[f"r{k}"])
        mean = {c: sum(scores[c]) / size for c in left}
        ranked = sorted(left, key=lambda c: (round(mean[c], 12), list(candidates).index(c)))
        keep = set(ranked[: -(-len(ranked) // 2)] if size < len(folds) else ranked[:1])
        found += [{"rung": rung, "candidate": c, "folds": size, "rmse": mean[c], "kept": c in keep} for c in left]
        if size == len(folds):
            return ranked[0], found
        left, seen, size, rung = [c for c in left if c in keep], size, min(2 * size, len(folds)), rung + 1
