"""Statistical gates: correlation, sampling adequacy, sphericity, significance, principal components.

Spark reduces the rows to moments; what reaches the driver is bounded by the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    columns_where,
    ident,
    is_number,
    normalise,
    py_round_half_up,
    require_columns,
    round_half_up,
)
from tablewright.functions.tails import chi2_sf, f_sf, t_two_sided

# Rating limits, the suitability rule and the significance level.
EXCELLENT, MODERATE, SUITABLE, ALPHA = 0.8, 0.6, 0.55, 0.05
DET_FLOOR = 1e-10
PAIRWISE_COLUMNS = 24


@dataclass(frozen=True)
class Moments:
    """Listwise moments of the numeric columns. Constant columns have no correlation and are set aside."""

    columns: tuple[str, ...]
    constant: tuple[str, ...]
    n: int
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    corr: np.ndarray


def numeric_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns without booleans, rows with any gap removed."""
    columns = list(columns) if columns is not None else columns_where(df, is_number)
    require_columns(df, *columns)
    if len(columns) < 2:
        raise ValueError("at least two numeric columns are needed")
    return normalise(df.select(*[ident(c) for c in columns])).dropna("any")


def fit_moments(df: DataFrame, columns: Sequence[str] | None = None) -> Moments:
    rows = numeric_rows(df, columns)
    names = rows.columns
    rows = rows.select(*[ident(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i)] if len(names) <= PAIRWISE_COLUMNS else []
    row = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(names))],
        *[F.stddev_pop(f"c{i}").alias(f"s{i}") for i in range(len(names))],
        *[(F.min(f"c{i}") == F.max(f"c{i}")).alias(f"k{i}") for i in range(len(names))],
        *[F.covar_pop(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in pairs],
    ).first()
    live = [i for i in range(len(names)) if row[f"k{i}"] is False]
    corr = np.eye(len(live))
    if pairs or len(names) < 2:
        for a, i in enumerate(live):
            for b, j in enumerate(live[:a]):
                r = row[f"r{i}_{j}"] / (row[f"s{i}"] * row[f"s{j}"])
                corr[a, b] = corr[b, a] = min(max(r, -1.0), 1.0)
    elif live:
        vec = VectorAssembler(inputCols=[f"c{i}" for i in live], outputCol="v").transform(rows).select("v")
        corr = Correlation.corr(vec, "v").first()[0].toArray()
    return Moments(
        tuple(names[i] for i in live),
        tuple(names[i] for i in range(len(names)) if i not in live),
        row["n"],
        tuple(row[f"m{i}"] for i in live),
        tuple(row[f"s{i}"] for i in live),
        corr,
    )


def correlation_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x, y, r) for every ordered pair of columns, the diagonal included."""
    m = fit_moments(df, columns)
    rows = [
        (a, b, py_round_half_up(float(m.corr[i, j]), 6)) for i, a in enumerate(m.columns) for j, b in enumerate(m.columns)
    ]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def kmo_bartlett(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: sampling adequacy with its rating, sphericity test and the clustering verdict."""
    m = fit_moments(df, columns)
    p = len(m.columns)
    if p < 2:
        raise ValueError("at least two numeric columns with more than one value are needed")
    det = float(np.linalg.det(m.corr))
    if det <= 0:
        det = DET_FLOOR
    chi_sq = -(m.n - 1 - (2 * p + 5) / 6) * math.log(det)
    degrees = p * (p - 1) // 2
    p_value = chi2_sf(chi_sq, degrees)

    inverse = np.linalg.pinv(m.corr)
    scale = np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(p, dtype=bool)
    r2 = float((m.corr[off] ** 2).sum())
    a2 = float(((inverse / scale)[off] ** 2).sum())
    kmo = py_round_half_up(min(max(r2 / (r2 + a2), 0.0), 1.0), 4) if r2 + a2 > 0 else 0.0
    rating = "Excellent" if kmo >= EXCELLENT else "Moderate / Suitable" if kmo >= MODERATE else "Poor Suitability"
    row = (
        m.n,
        p,
        list(m.constant),
        kmo,
        rating,
        py_round_half_up(chi_sq, 2),
        degrees,
        float(f"{p_value:.4e}"),
        "Suitable" if kmo >= SUITABLE and p_value < ALPHA else "Unsuitable",
    )
    return df.sparkSession.createDataFrame(
        [row],
        "num_rows bigint, num_columns int, constant_columns array<string>, kmo_score double, kmo_rating string, "
        "bartlett_chi_sq double, bartlett_df int, bartlett_p_value double, clustering_suitability string",
    )


SIGNIFICANCE_SCHEMA = (
    "feature string, test string, classes bigint, num_rows bigint, statistic double, df1 double, df2 double, "
    "p_value string, significant string, action string"
)


def _class_moments(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(feature, class, n, mean, var): one wide aggregate per class, unpivoted after the shuffle."""
    aggs = []
    for i, f in enumerate(features):
        c = ident(f).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_samp(c).alias(f"v{i}")]
    cells = [
        F.struct(
            F.lit(i).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var")
        )
        for i in range(len(features))
    ]
    return df.groupBy(ident(target).alias("class")).agg(*aggs).select("class", F.inline(F.array(*cells)))


def significance_moments(df: DataFrame, target: str) -> DataFrame:
    """One row per feature with what both tests need; classes are reduced on Spark, however many."""
    require_columns(df, target)
    features = [c for c in columns_where(df, is_number) if c != target]
    df = normalise(df).where(ident(target).isNotNull())
    groups = _class_moments(df, target, features)
    valid = groups.where(F.col("n") > 1)
    overall = valid.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    spread = (
        valid.join(F.broadcast(overall), "feature")  # one row per column
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("n").alias("rows"),
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"),
            F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
            F.min(F.struct("class", "n", "mean", "var")).alias("first"),
            F.max(F.struct("class", "n", "mean", "var")).alias("last"),
        )
    )
    classes = groups.groupBy("feature").agg(F.count(F.lit(1)).alias("classes"))
    names = F.array(*[F.lit(f) for f in features])
    return (
        spread.join(F.broadcast(classes), "feature")
        .withColumn("name", F.element_at(names, F.col("feature") + 1))
        .select("feature", "name", "classes", "groups", "rows", "between", "within", "first", "last")
    )


def feature_significance(df: DataFrame, target: str) -> DataFrame:
    """Welch's t-test for two classes, one-way ANOVA for more, per numeric feature.

    Every distinct target value is a class. The sign of t follows ascending class order.
    """
    if not [c for c in columns_where(df, is_number) if c != target]:
        return df.sparkSession.createDataFrame([], SIGNIFICANCE_SCHEMA)
    rows = []
    for r in significance_moments(df, target).orderBy("feature").collect():  # one row per feature
        if r["classes"] == 2 and r["groups"] == 2:
            rows.append(_welch(r))
        elif r["classes"] > 2 and r["groups"] > 1:
            rows.append(_anova(r))
    return df.sparkSession.createDataFrame(rows, SIGNIFICANCE_SCHEMA)


def _verdict(p: float | None) -> tuple[str, str, str]:
    shown = "nan" if p is None else f"{p:.4e}"
    if p is not None and p < ALPHA:
        return shown, "Yes (p < 0.05)", "Retain in Model"
    return shown, "No (Noise)", "Candidate for Removal"


def _welch(r) -> tuple:
    a, b = r["first"], r["last"]
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    t = df = p = None
    if va + vb > 0:
        t = (a["mean"] - b["mean"]) / math.sqrt(va + vb)
        df = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
        p = t_two_sided(t, df)
    return (
        r["name"], "Independent T-Test", r["classes"], r["rows"], py_round_half_up(t, 3), 1.0 if t is not None else None,
        py_round_half_up(df, 3), *_verdict(p),
    )


def _anova(r) -> tuple:
    df1, df2 = r["groups"] - 1, r["rows"] - r["groups"]
    f = p = None
    if r["within"] and r["within"] > 0:
        f = (r["between"] / df1) / (r["within"] / df2)
        p = f_sf(f, df1, df2)
    return (
        r["name"], "One-Way ANOVA", r["classes"], r["rows"], py_round_half_up(f, 3), float(df1), float(df2), *_verdict(p),
    )


@dataclass(frozen=True)
class FactorModel:
    """Principal components of the standardised columns with eigenvalue at least one."""

    moments: Moments
    eigenvalues: np.ndarray
    shares: np.ndarray
    components: np.ndarray  # factors x columns

    @property
    def factors(self) -> list[str]:
        return [f"Factor_{k + 1}" for k in range(len(self.eigenvalues))]

    def scores(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One linear combination of columns per factor, for the rows without gaps."""
        m = self.moments
        complete = df.dropna("any", subset=[f"`{c}`" for c in (*m.columns, *m.constant)])
        out = []
        for name, weights in zip(self.factors, self.components):
            total = F.lit(0.0)
            for c, w, mean, dev in zip(m.columns, weights, m.means, m.deviations):
                total = total + (ident(c).cast("double") - F.lit(float(mean))) * F.lit(float(w / dev))
            out.append(total.alias(name))
        return complete.select(*[ident(k) for k in keep], *out)

    def loadings(self, df: DataFrame) -> DataFrame:
        rows = [
            (
                c,
                name,
                py_round_half_up(float(self.components[k, j] * math.sqrt(self.eigenvalues[k])), 3),
            )
            for k, name in enumerate(self.factors)
            for j, c in enumerate(self.moments.columns)
        ]
        return df.sparkSession.createDataFrame(rows, "column string, factor string, loading double")

    def summary(self, df: DataFrame) -> DataFrame:
        rows = [
            (name, py_round_half_up(float(e), 3), f"{py_round_half_up(100 * float(s), 1)}%")
            for name, e, s in zip(self.factors, self.eigenvalues, self.shares)
        ]
        return df.sparkSession.createDataFrame(rows, "factor string, eigenvalue double, variance_explained string")


def fit_factors(df: DataFrame, columns: Sequence[str] | None = None) -> FactorModel:
    m = fit_moments(df, columns)
    p = len(m.columns)
    if p < 2:
        raise ValueError("at least two numeric columns with more than one value are needed")
    values, vectors = np.linalg.eigh(m.corr)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    eigenvalues = values * m.n / (m.n - 1)
    keep = max(1, min(int((eigenvalues >= 1.0).sum()), p))
    components = vectors[:, :keep].T.copy()
    for row in components:
        # The sign is arbitrary: the first of the largest loadings is made positive.
        size = np.abs(row)
        if row[int(np.argmax(size >= size.max() - 1e-9))] < 0:
            row *= -1
    return FactorModel(m, eigenvalues[:keep], (values / values.sum())[:keep], components)


def rounded_scores(scores: DataFrame, places: int = 6) -> DataFrame:
    return scores.select(
        *[round_half_up(ident(c), places).alias(c) if c.startswith("Factor_") else ident(c) for c in scores.columns]
    )
