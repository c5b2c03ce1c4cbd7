from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import rounded, table
from tablewright.functions.columns import round_half_up
from tablewright.operators import stats


def _dims(spark, d, n):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"d{i}") for i in range(n)])


def _lineitem(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def corr_lineitem(spark, d):
    return stats.correlation_table(_lineitem(spark, d))


def corr_with_gaps(spark, d):
    li = table(spark, d, "lineitem").select(
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("q"),
        (F.col("l_extendedprice") + F.lit(1000.0) * F.col("l_quantity")).alias("p"),
        F.lit(1.0).alias("one"),
    )
    return stats.correlation_table(li)


def kmo_embeddings(spark, d):
    return stats.kmo_bartlett(_dims(spark, d, 3), ["d0", "d1", "d2"]).withColumn("constant_columns", F.array_join("constant_columns", ","))


def kmo_lineitem(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_quantity",
        (F.col("l_quantity") * 1000 + F.col("l_extendedprice")).alias("a"),
        (F.col("l_quantity") * 1000 + F.col("l_discount") * 100000).alias("b"),
        F.lit(1.0).alias("one"),
    )
    return stats.kmo_bartlett(li).withColumn("constant_columns", F.array_join("constant_columns", ","))


def welch_lineitem(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return stats.feature_significance(li, "l_linestatus")


def anova_lineitem(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
    )
    return stats.feature_significance(li, "l_returnflag")


def anova_many_classes(spark, d):
    """Each order is a class, a good part of them with a single row."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    out = stats.feature_significance(li, "l_orderkey")
    return out.withColumn("p_value", round_half_up(F.col("p_value").cast("double"), 3))


def significance_verdicts(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_returnflag", "l_quantity", F.when(F.col("l_returnflag") == "A", F.col("l_tax") + 1).otherwise(F.col("l_tax")).alias("shifted")
    )
    return stats.feature_significance(li, "l_returnflag").select("feature", "significant", "action")


def factor_two_columns(spark, d):
    return stats.fit_factors(_dims(spark, d, 2), ["d0", "d1"]).summary(table(spark, d, "embeddings"))


def factor_two_loadings(spark, d):
    return stats.fit_factors(_dims(spark, d, 2), ["d0", "d1"]).loadings(table(spark, d, "embeddings"))


def factor_two_scores(spark, d):
    dims = _dims(spark, d, 2)
    return stats.rounded_scores(stats.fit_factors(dims, ["d0", "d1"]).scores(dims, keep=["vec_id"]))


def factor_loadings(spark, d):
    """The loadings of all 64 dimensions on the kept factors."""
    dims = _dims(spark, d, 64)
    return stats.fit_factors(dims, dims.columns[1:]).loadings(dims)


QUERIES = {
    f.__name__: f
    for f in (
        corr_lineitem,
        corr_with_gaps,
        kmo_embeddings,
        kmo_lineitem,
        welch_lineitem,
        anova_lineitem,
        anova_many_classes,
        significance_verdicts,
        factor_two_columns,
        factor_two_loadings,
        factor_two_scores,
        factor_loadings,
    )
}


def _corr_sql(relation: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{a}' AS x, '{b}' AS y, "
        + ("max(1.0::DOUBLE)" if a == b else rounded(f"corr({a}, {b})", 6))
        + " AS r FROM base"
        for a in columns
        for b in columns
    ]
    return f"WITH base AS ({relation}) " + " UNION ALL ".join(parts)


def _erfc(z: str) -> str:
    """The complementary error function of z > 0: a series of positive terms below 2, a continued fraction above."""
    series = (
        f"1 - 2 / sqrt(pi()) * exp(-({z}) * ({z})) * list_sum(list_transform(range(0, 80), "
        f"lambda k: exp((2 * k + 1) * ln({z}) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))))"
    )
    fraction = f"list_reduce([({z})] || list_transform(range(80, 0, -1), lambda k: k::DOUBLE), lambda a, k: ({z}) + k / 2 / a)"
    return f"(CASE WHEN ({z}) < 2 THEN {series} ELSE exp(-({z}) * ({z})) / sqrt(pi()) / {fraction} END)"


_VERDICT = """
    CASE WHEN p < 0.05 THEN 'Yes (p < 0.05)' ELSE 'No (Noise)' END AS significant,
    CASE WHEN p < 0.05 THEN 'Retain in Model' ELSE 'Candidate for Removal' END AS action"""


def _kmo_sql(relation: str, x: str, y: str, z: str, constant: str = "") -> str:
    """Closed forms for three columns: det = 1 + 2abc - a^2 - b^2 - c^2 and first-order partials."""
    return f"""
    WITH base AS ({relation}),
    r AS (SELECT count(*) AS n, corr({x}, {y}) AS a, corr({x}, {z}) AS b, corr({y}, {z}) AS c FROM base),
    k AS (SELECT n, 1 + 2 * a * b * c - a * a - b * b - c * c AS det, a * a + b * b + c * c AS r2,
                 power(a - b * c, 2) / ((1 - b * b) * (1 - c * c)) + power(b - a * c, 2) / ((1 - a * a) * (1 - c * c))
                 + power(c - a * b, 2) / ((1 - a * a) * (1 - b * b)) AS a2 FROM r),
    v AS (SELECT n, {rounded("r2 / (r2 + a2)", 4)} AS kmo, -(n - 1 - 11.0::DOUBLE / 6) * ln(det) AS chi FROM k)
    SELECT n AS num_rows, 3 AS num_columns, '{constant}' AS constant_columns, kmo AS kmo_score,
           format('{{:.4e}}', {_erfc("sqrt(chi / 2)")} + sqrt(2 * chi / pi()) * exp(-chi / 2))::DOUBLE AS bartlett_p_value,
           CASE WHEN kmo >= 0.8 THEN 'Excellent' WHEN kmo >= 0.6 THEN 'Moderate / Suitable' ELSE 'Poor Suitability' END AS kmo_rating,
           {rounded("chi", 2)} AS bartlett_chi_sq, 3 AS bartlett_df,
           CASE WHEN kmo >= 0.55 AND chi > 7.814727903251178 THEN 'Suitable' ELSE 'Unsuitable' END AS clustering_suitability
    FROM v"""


def _welch_sql(feature: str) -> str:
    """The normal deviate of t is exact up to terms of order 1 / df^2."""
    return f"""
    SELECT feature, test, classes, num_rows, {rounded("t", 3)} AS statistic, 1.0::DOUBLE AS df1, {rounded("nu", 3)} AS df2,
           format('{{:.4e}}', p) AS p_value, {_VERDICT}
    FROM (SELECT *, {_erfc("greatest(abs(t), 1e-12) * (1 - 1 / (4 * nu)) / sqrt(2 * (1 + t * t / (2 * nu)))")} AS p FROM (
      SELECT '{feature}' AS feature, 'Independent T-Test' AS test, 2::BIGINT AS classes, na + nb AS num_rows,
             (ma - mb) / sqrt(va / na + vb / nb) AS t,
             power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS nu
      FROM (SELECT count({feature}) FILTER (l_linestatus = 'F') AS na, count({feature}) FILTER (l_linestatus = 'O') AS nb,
                   avg({feature}) FILTER (l_linestatus = 'F') AS ma, avg({feature}) FILTER (l_linestatus = 'O') AS mb,
                   var_samp({feature}) FILTER (l_linestatus = 'F') AS va, var_samp({feature}) FILTER (l_linestatus = 'O') AS vb
            FROM lineitem)))"""


def _anova_sql(cls: str, feature: str, expr: str, p: str = "power(d2 / (d2 + 2 * f), d2 / 2)", shown: str = "format('{:.4e}', p)") -> str:
    """The default tail probability is exact for three classes."""
    return f"""
    SELECT feature, test, classes, num_rows, {rounded("f", 3)} AS statistic, d1 AS df1, d2 AS df2, {shown} AS p_value, {_VERDICT}
    FROM (SELECT *, {p} AS p FROM (
      SELECT '{feature}' AS feature, 'One-Way ANOVA' AS test,
             (SELECT count(DISTINCT {cls}) FROM lineitem) AS classes, sum(n)::BIGINT AS num_rows,
             (sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f,
             (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2
      FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g
            FROM (SELECT {cls} AS c, count(x) AS n, avg(x) AS m, var_samp(x) AS v
                  FROM (SELECT {cls}, {expr} AS x FROM lineitem) GROUP BY 1 HAVING count(x) > 1))))"""


# The cube roots of both variances are normal: good to more digits than are shown for hundreds of classes.
_Z = "((1 - 2 / (9 * d2)) * power(f, 1.0 / 3) - (1 - 2 / (9 * d1))) / sqrt(2 / (9 * d2) * power(f, 2.0 / 3) + 2 / (9 * d1)) / sqrt(2.0)"
_MANY = f"(CASE WHEN {_Z} >= 0 THEN 0.5 * {_erfc(f'greatest({_Z}, 1e-12)')} ELSE 1 - 0.5 * {_erfc(f'greatest(-({_Z}), 1e-12)')} END)"

_D = ", ".join(f"embedding[{i + 1}]::DOUBLE AS d{i}" for i in range(3))
_TWO = f"""
    WITH base AS (SELECT vec_id, {_D} FROM embeddings),
    r AS (SELECT count(*) AS n, corr(d0, d1) AS r, avg(d0) AS m0, avg(d1) AS m1, stddev_pop(d0) AS s0,
                 stddev_pop(d1) AS s1 FROM base)"""

ORACLES = {
    "corr_lineitem": _corr_sql("SELECT * FROM lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "corr_with_gaps": _corr_sql(
        """SELECT l_quantity AS q, l_extendedprice + 1000.0::DOUBLE * l_quantity AS p FROM lineitem WHERE l_orderkey % 7 <> 0""",
        ["q", "p"],
    ),
    "kmo_embeddings": _kmo_sql(f"SELECT {_D} FROM embeddings", "d0", "d1", "d2"),
    "kmo_lineitem": _kmo_sql(
        """SELECT l_quantity, l_quantity * 1000 + l_extendedprice AS a, l_quantity * 1000 + l_discount * 100000 AS b
           FROM lineitem""",
        "l_quantity",
        "a",
        "b",
        "one",
    ),
    "welch_lineitem": " UNION ALL ".join(_welch_sql(f) for f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "anova_lineitem": " UNION ALL ".join(
        _anova_sql("l_returnflag", f, e)
        for f, e in (
            ("l_quantity", "CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END"),
            ("l_extendedprice", "l_extendedprice"),
            ("l_discount", "l_discount"),
        )
    ),
    "anova_many_classes": " UNION ALL ".join(_anova_sql("l_orderkey", f, f, _MANY, rounded("p", 3)) for f in ("l_quantity", "l_discount")),
    "significance_verdicts": " UNION ALL ".join(
        f"SELECT feature, significant, action FROM ({_anova_sql('l_returnflag', f, e)})"
        for f, e in (("l_quantity", "l_quantity"), ("shifted", "CASE WHEN l_returnflag = 'A' THEN l_tax + 1 ELSE l_tax END"))
    ),
    "factor_two_columns": _TWO + f"""
      SELECT 'Factor_1' AS factor, {rounded("(1 + abs(r)) * n / (n - 1)", 3)} AS eigenvalue,
             ({rounded("100 * (1 + abs(r)) / 2", 1)})::VARCHAR || '%' AS variance_explained FROM r""",
    "factor_two_loadings": _TWO + f"""
      SELECT 'd0' AS "column", 'Factor_1' AS factor, {rounded("sqrt((1 + abs(r)) * n / (n - 1) / 2)", 3)} AS loading FROM r
      UNION ALL
      SELECT 'd1', 'Factor_1', {rounded("sign(r) * sqrt((1 + abs(r)) * n / (n - 1) / 2)", 3)} FROM r""",
    "factor_two_scores": _TWO + f"""
      SELECT vec_id, {rounded("((d0 - m0) / s0 + sign(r) * (d1 - m1) / s1) / sqrt(2.0::DOUBLE)", 6)} AS "Factor_1"
      FROM base, r""",
}
