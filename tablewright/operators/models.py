"""Classification and regression tournaments on a fixed 70/15/15 split.

The prepared table (key, label, feature vector, split) is persisted once; candidates fit on its train
part in parallel driver threads, are ranked on val and verified on test. A candidate that fails is
recorded, not hidden.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import ident, py_round_half_up, require_columns
from tablewright.operators import boosting, kernel, network
from tablewright.operators.features import MAX_INDICATORS, assembled, fit_features, fit_standardiser
from tablewright.operators.knn import nearest_neighbours
from tablewright.operators.metrics import class_metrics, regression_metrics
from tablewright.operators.split import dense_row_index, split_70_15_15
from tablewright.session import materialised, persisted

KEY, LABEL, SPLIT, VEC, ARR = "__key", "__label", "split", "__features", "__x"


@dataclass(frozen=True)
class Settings:
    """Model sizes. The defaults are the full tournament; smaller ones suit quick runs."""

    trees: int = 50
    forest_depth: int = 10
    boost_rounds: int = 50
    classifier_boost_depth: int = 5
    regressor_boost_depth: int = 4
    boost_rate: float = 0.1
    boost_ridge: float = 1.0
    logistic_iterations: int = 500
    landmarks: int = 200
    svm_iterations: int = 50
    neighbours: int = 5
    hidden: tuple[int, ...] = (32, 16)
    network_iterations: int = 150
    folds: int = 5
    ridge_alpha: float = 1.0
    lasso_alpha: float = 0.1
    lasso_iterations: int = 1000
    seed: int = 42
    parallelism: int = 3


@dataclass(frozen=True)
class Prepared:
    """Model-ready rows: key, label, feature vector, split. ``slots`` are the features with their places in the vector."""

    data: DataFrame
    slots: tuple[tuple[str, int], ...]
    classes: tuple[str, ...]
    n_train: int
    label_std: float
    width: int

    def part(self, name: str) -> DataFrame:
        return self.data.where(F.col(SPLIT) == name)


def prepare(
    df: DataFrame,
    target: str,
    classify: bool,
    key: str | None = None,
    seed: int = 42,
    fit_scope: str = "train",
) -> Prepared:
    """Split, then encode and standardise. Rows without a target are left out.

    ``fit_scope`` "train" learns categories, medians and scales on the train part only; "all"
    learns them on every row.
    """
    require_columns(df, target, *([key] if key else []))
    rows = df.where(ident(target).isNotNull())
    if key is None:
        key = KEY
        rows = dense_row_index(rows, KEY)
    # The split, the encoding and the scaling read the rows several times each.
    rows = persisted(rows)
    try:
        return _prepare(rows, target, classify, key, seed, fit_scope)
    finally:
        rows.unpersist()


def _prepare(rows: DataFrame, target: str, classify: bool, key: str, seed: int, fit_scope: str) -> Prepared:
    placed = split_70_15_15(rows, key=key, seed=seed, stratify=target if classify else None, name=SPLIT)
    scope = placed.where(F.col(SPLIT) == "train") if fit_scope == "train" else placed
    held = [key, target, SPLIT]
    model = fit_features(scope, exclude=held)
    standardiser = fit_standardiser(replace(model, wide=()).transform(scope), model.columns)  # wide columns have no scale, their codes need no join
    encoded = standardiser.transform(model.transform(placed, keep=held))
    classes: tuple[str, ...] = ()
    if classify:
        found = [r[0] for r in rows.select(ident(target)).distinct().limit(MAX_INDICATORS + 1).collect()]
        if len(found) > MAX_INDICATORS:
            raise ValueError(f"{target!r} has more than {MAX_INDICATORS} distinct values, which is not a class label")
        found.sort()
        codes = F.array(*[F.lit(v) for v in found])
        label = (F.array_position(codes, ident(target)) - 1).cast("double")
        classes = tuple(str(v) for v in found)
    else:
        label = ident(target).cast("double")
    data = persisted(
        assembled(encoded, model, VEC).select(ident(key).alias(KEY), label.alias(LABEL), F.col(VEC), F.col(SPLIT))
    )
    train = (
        data.where(F.col(SPLIT) == "train")
        .agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("s"))
        .first()
    )
    width = sum(size for _, size in model.slots)
    return Prepared(data, tuple(model.slots), classes, train["n"], train["s"] or 0.0, width or 1)


# ---- fitted candidates: each adds ``prediction`` (and ``prob``, an array, where it has one) ------


@dataclass(frozen=True)
class Fitted:
    score: Callable[[DataFrame], DataFrame]
    importances: tuple[float, ...] = ()


def _classifier(model, importances: Sequence[float] = (), proba: bool = True) -> Fitted:
    def score(df: DataFrame) -> DataFrame:
        base = df.columns
        out = model.transform(df)
        prob = vector_to_array(F.col("probability")) if proba else F.lit(None).cast("array<double>")
        return out.select(*[ident(c) for c in base], F.col("prediction"), prob.alias("prob"))

    return Fitted(score, tuple(float(x) for x in importances))


def _regressor(model, importances: Sequence[float] = ()) -> Fitted:
    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).select(*[ident(c) for c in df.columns], F.col("prediction"))

    return Fitted(score, tuple(float(x) for x in importances))


def _argmax(prob: Column) -> Column:
    """Index of the largest entry, the first on ties."""
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("double")


def fit_forest_classifier(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    model = RandomForestClassifier(
        featuresCol=VEC, labelCol=LABEL, numTrees=s.trees, maxDepth=s.forest_depth, seed=s.seed
    ).fit(train)
    return _classifier(model, model.featureImportances.toArray())


def _boosted(train: DataFrame, p: Prepared, s: Settings, loss: str, depth: int) -> boosting.Model:
    rows = train.select(vector_to_array(VEC).alias("x"), F.col(LABEL).alias("y"))
    return boosting.fit(rows, p.width, loss, len(p.classes), s.boost_rounds, depth, s.boost_rate, s.boost_ridge)


def fit_boosted_classifier(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    """Gradient-boosted trees of second order; all classes are one model."""
    model = _boosted(train, p, s, boosting.LOGISTIC if len(p.classes) == 2 else boosting.SOFTMAX, s.classifier_boost_depth)

    def score(df: DataFrame) -> DataFrame:
        out = df.select(*[ident(c) for c in df.columns], boosting.prediction(model, vector_to_array(VEC)).alias("prob"))
        return out.withColumn("prediction", _argmax(F.col("prob")))

    return Fitted(score, tuple(model.importances()))


def fit_logistic(train: DataFrame, p: Prepared, s: Settings, vec: str = VEC) -> Fitted:
    n = max(train.count(), 1)
    model = LogisticRegression(
        featuresCol=vec, labelCol=LABEL, maxIter=s.logistic_iterations, regParam=1.0 / n, standardization=False
    ).fit(train)
    return _classifier(model, np.abs(model.coefficientMatrix.toArray()).mean(axis=0))


def kernel_map(train: DataFrame, p: Prepared, s: Settings) -> kernel.KernelMap:
    return kernel.fit(train.select(vector_to_array(VEC).alias("x"), KEY), F.col(KEY), 1.0 / p.width, s.landmarks, s.seed)


STORED_FEATURES = 20_000_000  # values, 160 MB; beyond, a machine computes the features in every pass


def fit_svm(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    """Kernel machine with a radial kernel (gamma = 1 / width): a linear one on landmark features.

    ``prob`` holds logistic margins per class, which is what the stacking ensemble takes from it.
    """
    landmarks = kernel_map(train, p, s)
    codes = [1] if len(p.classes) == 2 else list(range(len(p.classes)))
    rows = train.select(vector_to_array(VEC).alias("x"), F.col(LABEL).alias("y"))
    penalty, width = 1.0 / max(p.n_train, 1), landmarks.whitening.shape[1]
    if p.n_train * width <= STORED_FEATURES:  # Spark's machine keeps the features of all rows
        z = array_to_vector(landmarks.column(vector_to_array(F.col(VEC))))
        mapped = train.select(z.alias("__z"), LABEL).persist()
        try:
            svc = LinearSVC(featuresCol="__z", labelCol="__one", maxIter=s.svm_iterations, regParam=penalty)
            fits = [svc.fit(mapped.withColumn("__one", (F.col(LABEL) == float(c)).cast("double"))) for c in codes]
        finally:
            mapped.unpersist()
        found = [(m.coefficients.toArray(), float(m.intercept)) for m in fits]
    else:
        found = kernel.machines(rows, landmarks, codes, s.svm_iterations, penalty)

    def score(df: DataFrame) -> DataFrame:
        out = df.withColumn("__m", landmarks.margins(vector_to_array(F.col(VEC)), found))
        soft = [1 / (1 + F.exp(-F.get("__m", F.lit(i)))) for i in range(len(codes))]
        prob = F.array(1 - soft[0], soft[0]) if len(codes) == 1 else F.array(*soft)
        out = out.select(*[ident(c) for c in df.columns], prob.alias("prob"))
        return out.withColumn("prediction", _argmax(F.col("prob")))

    return Fitted(score)


def fit_neighbours(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    k = min(s.neighbours, max(p.n_train, 1))

    def score(df: DataFrame) -> DataFrame:
        arrays = [x.withColumn(ARR, vector_to_array(VEC)) for x in (train, df)]
        near = nearest_neighbours(*arrays, ARR, KEY, LABEL, k)
        share = near.groupBy("query").agg(
            F.array(*[F.avg((F.col("label") == float(c)).cast("double")) for c in range(len(p.classes))]).alias("prob")
        )
        return df.join(share, F.col(KEY) == F.col("query")).drop("query").withColumn("prediction", _argmax(F.col("prob")))

    return Fitted(score)


def _network(train: DataFrame, p: Prepared, s: Settings, loss: str) -> network.Network:
    rows = train.select(vector_to_array(VEC).alias("x"), F.col(LABEL).alias("y"), KEY)
    return network.fit(rows, p.width, loss, len(p.classes), F.col(KEY), s.hidden, s.network_iterations, s.seed)


def fit_network(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    """A network that stops early on a held-out share of the train part."""
    model = _network(train, p, s, network.SOFTMAX)

    def score(df: DataFrame) -> DataFrame:
        out = df.select(*[ident(c) for c in df.columns], network.prediction(model, vector_to_array(VEC)).alias("prob"))
        return out.withColumn("prediction", _argmax(F.col("prob")))

    return Fitted(score)


def soft_vote(members: Sequence[Fitted]) -> Fitted:
    """Mean of the members' probabilities, computed along one chain of projections without a join."""

    def score(df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(members):
            out = m.score(out).withColumnRenamed("prob", f"__v{i}").drop("prediction")
        mean = F.col("__v0")
        for i in range(1, len(members)):
            mean = F.zip_with(mean, F.col(f"__v{i}"), lambda a, b: a + b)
        out = out.select(*[ident(c) for c in df.columns], mean.alias("prob"))
        out = out.withColumn("prob", F.transform("prob", lambda x: x / F.lit(float(len(members)))))
        return out.withColumn("prediction", _argmax(F.col("prob")))

    return Fitted(score)


def _stack_inputs(members: Sequence[Fitted], df: DataFrame) -> DataFrame:
    out = df
    for i, m in enumerate(members):
        out = m.score(out).withColumnRenamed("prob", f"__v{i}").drop("prediction")
    return out.select(
        *[ident(c) for c in df.columns], array_to_vector(F.concat(*[F.col(f"__v{i}") for i in range(len(members))])).alias("__meta")
    )


def fit_stacking(train: DataFrame, p: Prepared, s: Settings, fits: Sequence[Callable], members: Sequence[Fitted]) -> Fitted:
    """Logistic regression over out-of-fold base probabilities; folds follow a hash of the key.

    The folds' fits, mostly small jobs one after another, run side by side. The probabilities are written once: the steps of the
    regression then read a short table instead of carrying every fold's models and searches along.
    """
    spark = train.sparkSession
    folded = train.withColumn("__fold", F.pmod(F.xxhash64(F.col(KEY), F.lit(s.seed)), F.lit(s.folds)))

    def part(f: int) -> DataFrame:
        rest = folded.where(F.col("__fold") != f)
        return _stack_inputs([fit(rest, p, s) for fit in fits], folded.where(F.col("__fold") == f)).select(LABEL, "__meta")

    with ThreadPoolExecutor(max_workers=s.parallelism) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(part), f) for f in range(s.folds)]
        parts = [r.result() for r in runs]
    meta_rows = persisted(materialised(reduce(DataFrame.unionByName, parts)))
    try:
        meta = fit_logistic(meta_rows, p, s, vec="__meta")
    finally:
        meta_rows.unpersist()

    def score(df: DataFrame) -> DataFrame:
        out = meta.score(_stack_inputs(members, df))
        return out.select(*[ident(c) for c in df.columns], "prediction", "prob")

    return Fitted(score)


def fit_forest_regressor(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    model = RandomForestRegressor(
        featuresCol=VEC, labelCol=LABEL, numTrees=s.trees, maxDepth=s.forest_depth, seed=s.seed
    ).fit(train)
    return _regressor(model, model.featureImportances.toArray())


def fit_boosted_regressor(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    model = _boosted(train, p, s, boosting.SQUARES, s.regressor_boost_depth)

    def score(df: DataFrame) -> DataFrame:
        found = F.get(boosting.prediction(model, vector_to_array(VEC)), F.lit(0))
        return df.select(*[ident(c) for c in df.columns], found.alias("prediction"))

    return Fitted(score, tuple(model.importances()))


def _ridge(train: DataFrame, p: Prepared, alpha: float, vec: str = VEC):
    # Spark divides the penalty by the label's deviation when it standardises the label.
    return LinearRegression(
        featuresCol=vec, labelCol=LABEL, elasticNetParam=0.0, regParam=alpha * p.label_std / max(p.n_train, 1),
        standardization=False, solver="normal" if p.width <= 4000 else "l-bfgs",
    ).fit(train)


MAX_DENSE = 64  # columns beside a wide one whose products are summed in one aggregate


def _places(p: Prepared) -> tuple[Column, list[Column]]:
    """Of a table with one wide column, last in the vector: its code in a row (null without one) and the other features."""
    d = len(p.slots) - 1
    vec = F.unwrap_udt(VEC)
    at, values = vec["indices"], vec["values"]
    sparse = F.get(F.filter(at, lambda i: i >= d), F.lit(0)) - d
    dense = F.nullif(F.array_position(F.slice(values, d + 1, p.width), F.lit(1.0)), F.lit(0)).cast("int") - 1
    found = F.map_from_arrays(at, values)
    rest = [F.when(at.isNull(), F.get(values, F.lit(j))).otherwise(F.coalesce(F.element_at(found, F.lit(j)), F.lit(0.0))) for j in range(d)]
    return F.when(at.isNull(), dense).otherwise(sparse), rest


def fit_wide_ridge(train: DataFrame, p: Prepared, alpha: float) -> Fitted:
    """Ridge on one wide column of indicators and a few others, exactly. A category's coefficient follows from its sums once the others
    are known, and those solve a small system in which the categories are eliminated; the coefficients stay a written table."""
    code, rest = _places(p)
    d = len(rest) + 1
    rows = train.select(code.alias("code"), F.col(LABEL).alias("y"), F.lit(1.0).alias("q0"), *[c.alias(f"q{j + 1}") for j, c in enumerate(rest)])
    q = [F.col(f"q{j}") for j in range(d)]

    def system(df: DataFrame, target: str, share: Column) -> tuple[np.ndarray, np.ndarray]:
        products = [F.sum(share * q[i] * q[j]) for i in range(d) for j in range(i + 1)]
        row = df.agg(*products, *[F.sum(share * c * F.col(target)) for c in q]).first()
        sums = np.array([v or 0.0 for v in row])
        square = np.zeros((d, d))
        square[np.tril_indices(d)] = sums[: len(products)]
        return square + np.tril(square, -1).T, sums[len(products) :]

    whole, right = system(rows, "y", F.lit(1.0))
    sums = materialised(rows.where("code is not null").groupBy("code").agg(F.sum("y").alias("t"), *[F.sum(c).alias(f"q{j}") for j, c in enumerate(q)]))
    inner, inner_right = system(sums, "t", 1 / (q[0] + F.lit(alpha)))
    penalty = np.diag([0.0, *[alpha] * (d - 1)])
    theta = np.linalg.lstsq(whole + penalty - inner, right - inner_right, rcond=None)[0]
    level = lambda: sum((F.lit(float(t)) * c for t, c in zip(theta, q)), F.lit(0.0))
    own = materialised(sums.select(F.col("code").alias("__code"), ((F.col("t") - level()) / (q[0] + F.lit(alpha))).alias("__own")))

    def score(df: DataFrame) -> DataFrame:
        fixed = sum((F.lit(float(t)) * c for t, c in zip(theta[1:], rest)), F.lit(float(theta[0])))
        out = df.select("*", fixed.alias("__fixed"), code.alias("__at")).join(own, F.col("__at") == F.col("__code"), "left")
        return out.select(*[ident(c) for c in df.columns], (F.col("__fixed") + F.coalesce("__own", F.lit(0.0))).alias("prediction"))

    total = own.agg(F.sum(F.abs("__own"))).first()[0] or 0.0
    return Fitted(score, (*(float(abs(t)) for t in theta[1:]), float(total)))  # one value per feature


def fit_ridge(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    sizes = [size for _, size in p.slots]
    if p.width > 4000 and s.ridge_alpha > 0 and len(sizes) <= MAX_DENSE and set(sizes[:-1]) <= {1}:
        return fit_wide_ridge(train, p, s.ridge_alpha)
    model = _ridge(train, p, s.ridge_alpha)
    return _regressor(model, np.abs(model.coefficients.toArray()))


def fit_lasso(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    model = LinearRegression(
        featuresCol=VEC, labelCol=LABEL, elasticNetParam=1.0, regParam=s.lasso_alpha, maxIter=s.lasso_iterations,
        standardization=False,
    ).fit(train)
    return _regressor(model, np.abs(model.coefficients.toArray()))


def fit_ols(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    model = LinearRegression(featuresCol=VEC, labelCol=LABEL, regParam=0.0).fit(train)
    return _regressor(model, np.abs(model.coefficients.toArray()))


def fit_network_regressor(train: DataFrame, p: Prepared, s: Settings) -> Fitted:
    model = _network(train, p, s, network.SQUARES)

    def score(df: DataFrame) -> DataFrame:
        found = F.get(network.prediction(model, vector_to_array(VEC)), F.lit(0))
        return df.select(*[ident(c) for c in df.columns], found.alias("prediction"))

    return Fitted(score)


# Candidates in declared order, which settles ties in the ranking.
CLASSIFIERS: dict[str, Callable] = {
    "Random Forest": fit_forest_classifier,
    "Gradient-Boosted Trees": fit_boosted_classifier,
    "Logistic Regression": fit_logistic,
    "Support Vector Machine (RBF, landmarks)": fit_svm,
    "K-Nearest Neighbors": fit_neighbours,
    "Multilayer Perceptron": fit_network,
}
SOFT_VOTING = "Ensemble - Soft Voting"
STACKING = "Ensemble - Stacking"
VOTERS = ("Random Forest", "Gradient-Boosted Trees", "Logistic Regression")
STACKED = ("Random Forest", "Support Vector Machine (RBF, landmarks)", "K-Nearest Neighbors")
REGRESSORS: dict[str, Callable] = {
    "Random Forest Regressor": fit_forest_regressor,
    "Gradient Boosting Regressor": fit_boosted_regressor,
    "Ridge Regression (L2)": fit_ridge,
    "Lasso Regression (L1)": fit_lasso,
    "Linear Regression (OLS)": fit_ols,
    "Multilayer Perceptron Regressor": fit_network_regressor,
}

CLS_SCHEMA = "rank int, algorithm string, val_f1 double, test_f1 double, test_accuracy string, verdict string"
REG_SCHEMA = (
    "rank int, algorithm string, val_r2 double, test_r2 double, test_mse double, test_mae double, verdict string"
)


@dataclass(frozen=True)
class TournamentResult:
    task: str
    best_algorithm: str
    scores: dict[str, float]
    leaderboard: DataFrame
    importances: DataFrame
    failures: DataFrame
    holdout: DataFrame  # (actual, predicted) of the test part, lazy
    classes: tuple[str, ...] = field(default_factory=tuple)


def _run(spark: SparkSession, jobs: dict[str, Callable], parallelism: int) -> tuple[dict, dict[str, str]]:
    """Independent jobs in parallel driver threads; errors are kept by name."""
    done: dict[str, object] = {}
    failed: dict[str, str] = {}

    def attempt(name: str, job: Callable) -> None:
        try:
            done[name] = job()
        except Exception as e:  # a failing candidate must not end the tournament
            failed[name] = f"{type(e).__name__}: {str(e)[:300]}"

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(attempt), *item) for item in jobs.items()]
        for r in runs:
            r.result()
    return done, failed


def _scored(spark: SparkSession, fitted: dict, names: Sequence[str], held: DataFrame, metric: Callable, parallelism: int):
    """Val and test scores of every fitted candidate, in declared order."""

    def job(f: Fitted) -> Callable:
        return lambda: {r[SPLIT]: r for r in metric(f.score(held), LABEL, "prediction", SPLIT).collect()}

    rows, failed = _run(spark, {n: job(fitted[n]) for n in names if n in fitted}, parallelism)
    scored = [
        {"name": n, "order": i, "val": rows[n].get("val"), "test": rows[n].get("test")} for i, n in enumerate(names) if n in rows
    ]
    return [c for c in scored if c["val"] is not None and c["test"] is not None], failed


def _importances(spark, slots: Sequence[tuple[str, int]], values: Sequence[float]) -> DataFrame:
    """One row per feature; the places of a wide column are added up, so the shares cover the whole model. ``values`` may be one per feature."""
    rows = []
    if len(values) == len(slots):
        slots = [(name, 1) for name, _ in slots]
    if values and len(values) >= sum(size for _, size in slots):
        total, at = sum(values) or 1.0, 0
        for name, size in slots:
            v = float(sum(values[at : at + size]))
            rows.append((name, py_round_half_up(v, 4), py_round_half_up(v / total, 4)))
            at += size
    return spark.createDataFrame(rows, "feature string, importance double, share double")


def _failures(spark, failed: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(failed.items()), "algorithm string, error string")


def classification_tournament(
    df: DataFrame,
    target: str,
    key: str | None = None,
    models: Sequence[str] | None = None,
    settings: Settings = Settings(),
    fit_scope: str = "train",
) -> TournamentResult:
    """Ranks classifiers by weighted F1 on val and reports them on test."""
    spark = df.sparkSession
    names = list(models) if models is not None else [*CLASSIFIERS, SOFT_VOTING, STACKING]
    p = prepare(df, target, True, key, settings.seed, fit_scope)
    try:
        train = p.part("train")
        held = p.data.where(F.col(SPLIT) != "train")
        needed = [n for n in CLASSIFIERS if n in names or (SOFT_VOTING in names and n in VOTERS) or (STACKING in names and n in STACKED)]
        fitted, failed = _run(
            spark, {n: (lambda n=n: CLASSIFIERS[n](train, p, settings)) for n in needed}, settings.parallelism
        )
        late: dict[str, Callable[[], Fitted]] = {}
        if SOFT_VOTING in names:
            late[SOFT_VOTING] = lambda: soft_vote([fitted[v] for v in VOTERS])
        if STACKING in names:
            late[STACKING] = lambda: fit_stacking(
                train, p, settings, [CLASSIFIERS[v] for v in STACKED], [fitted[v] for v in STACKED]
            )
        more, failed_late = _run(spark, late, settings.parallelism)
        fitted, failed = fitted | more, failed | failed_late
        scored, failed_score = _scored(spark, fitted, names, held, class_metrics, settings.parallelism)
        failed |= failed_score
        if not scored:
            raise ValueError(f"no classifier could be scored: {failed}")
        scored.sort(key=lambda c: (-c["val"]["weighted_f1"], c["order"]))
        rows = [
            (
                i + 1, c["name"], py_round_half_up(c["val"]["weighted_f1"], 4), py_round_half_up(c["test"]["weighted_f1"], 4),
                f"{100 * c['test']['accuracy']:.2f}%", "Winner" if i == 0 else "Evaluated",
            )
            for i, c in enumerate(scored)
        ]
        best = scored[0]
        winner = fitted[best["name"]]
        holdout = winner.score(p.part("test")).select(F.col(LABEL).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"))
        return TournamentResult(
            "Classification",
            best["name"],
            {
                "accuracy": py_round_half_up(best["test"]["accuracy"], 4),
                "f1_score": rows[0][3],
                "val_f1_score": rows[0][2],
            },
            spark.createDataFrame(rows, CLS_SCHEMA),
            _importances(spark, p.slots, winner.importances),
            _failures(spark, {n: e for n, e in failed.items() if n in names}),
            holdout,
            p.classes,
        )
    finally:
        p.data.unpersist()


def regression_tournament(
    df: DataFrame,
    target: str,
    key: str | None = None,
    models: Sequence[str] | None = None,
    settings: Settings = Settings(),
    fit_scope: str = "train",
) -> TournamentResult:
    """Ranks regressors by R2 on val and reports them on test."""
    spark = df.sparkSession
    names = list(models) if models is not None else list(REGRESSORS)
    p = prepare(df, target, False, key, settings.seed, fit_scope)
    try:
        train = p.part("train")
        held = p.data.where(F.col(SPLIT) != "train")
        fitted, failed = _run(
            spark, {n: (lambda n=n: REGRESSORS[n](train, p, settings)) for n in names}, settings.parallelism
        )
        scored, failed_score = _scored(spark, fitted, names, held, regression_metrics, settings.parallelism)
        failed |= failed_score
        if not scored:
            raise ValueError(f"no regressor could be scored: {failed}")
        scored.sort(key=lambda c: (-c["val"]["r2"], c["order"]))
        rows = [
            (
                i + 1, c["name"], py_round_half_up(c["val"]["r2"], 4), py_round_half_up(c["test"]["r2"], 4),
                py_round_half_up(c["test"]["mse"], 4), py_round_half_up(c["test"]["mae"], 4), "Winner" if i == 0 else "Evaluated",
            )
            for i, c in enumerate(scored)
        ]
        winner = fitted[scored[0]["name"]]
        holdout = winner.score(p.part("test")).select(F.col(LABEL).alias("actual"), F.col("prediction").alias("predicted"))
        return TournamentResult(
            "Regression",
            scored[0]["name"],
            {"r2_score": rows[0][3], "val_r2_score": rows[0][2], "mse": rows[0][4], "mae": rows[0][5]},
            spark.createDataFrame(rows, REG_SCHEMA),
            _importances(spark, p.slots, winner.importances),
            _failures(spark, failed),
            holdout,
        )
    finally:
        p.data.unpersist()
