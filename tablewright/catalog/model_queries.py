from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import rounded, table
from tablewright.functions.columns import round_half_up
from tablewright.operators import cluster, knn, metrics, split


def _guessed_quality(spark, d):
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return labels.join(docs, "doc_id").select(
        "lang", "quality", F.when((F.col("n_chars") > 500) & (F.col("toxic") == 0), F.lit(1)).otherwise(F.lit(0)).alias("guess")
    )


def class_metrics(spark, d):
    return metrics.rounded_metrics(metrics.class_metrics(_guessed_quality(spark, d), "quality", "guess"), 6)


def class_metrics_by_lang(spark, d):
    return metrics.rounded_metrics(metrics.class_metrics(_guessed_quality(spark, d), "quality", "guess", "lang"), 6)


def class_metrics_three_classes(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderstatus",
        F.when(F.col("o_totalprice") > 300000, F.lit("F")).when(F.col("o_totalprice") > 100000, F.lit("O")).otherwise(F.lit("X")).alias("guess"),
    )
    return metrics.rounded_metrics(metrics.class_metrics(o, "o_orderstatus", "guess"), 6)


def confusion_orders(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderstatus", F.when(F.col("o_totalprice") > 300000, F.lit("F")).otherwise(F.lit("O")).alias("guess")
    )
    return metrics.confusion(o, "o_orderstatus", "guess")


def _line(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") + F.lit(500.0) * F.col("l_quantity")).alias("price")
    )
    return metrics.predict_line(li, "l_quantity", "price")


def reg_metrics(spark, d):
    return metrics.rounded_metrics(metrics.regression_metrics(_line(spark, d), "actual", "predicted"))


def ols_one_feature(spark, d):
    return metrics.rounded_metrics(metrics.ols_one_feature(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


def residuals(spark, d):
    return metrics.rounded_metrics(metrics.residuals(_line(spark, d)))


def residual_histogram(spark, d):
    return metrics.rounded_metrics(metrics.histogram(metrics.residuals(_line(spark, d))), 3)


def ideal_bounds(spark, d):
    return metrics.rounded_metrics(metrics.ideal_bounds(_line(spark, d)), 3)


def _embedding_split(spark, d):
    e = table(spark, d, "embeddings")
    return split.split_70_15_15(e, key="vec_id")


def knn_neighbours(spark, d):
    e = _embedding_split(spark, d)
    near = knn.nearest_neighbours(
        e.where("split = 'train'"), e.where("split <> 'train'"), "embedding", "vec_id", "label"
    )
    return near.select("query", "neighbour", "rank", round_half_up(F.col("distance"), 6).alias("distance"))


def knn_vote(spark, d):
    e = _embedding_split(spark, d)
    near = knn.nearest_neighbours(
        e.where("split = 'train'"), e.where("split <> 'train'"), "embedding", "vec_id", "label"
    )
    return knn.knn_vote(near)


def _embedding_columns(spark, d, n):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(f"d{i}") for i in range(n)])


def cluster_indices(spark, d):
    e = _embedding_columns(spark, d, 64)
    out = cluster.cluster_indices(e, [f"d{i}" for i in range(64)], "label", cluster.EUCLIDEAN)
    return metrics.rounded_metrics(out.drop("silhouette_kind"), 6)


def silhouette_squared(spark, d):
    e = _embedding_columns(spark, d, 64)
    s = cluster.silhouette_squared(e, [f"d{i}" for i in range(64)], "label")
    return metrics.rounded_metrics(spark.createDataFrame([(s,)], "silhouette double"), 6)


QUERIES = {
    f.__name__: f
    for f in (
        class_metrics,
        class_metrics_by_lang,
        class_metrics_three_classes,
        confusion_orders,
        reg_metrics,
        ols_one_feature,
        residuals,
        residual_histogram,
        ideal_bounds,
        knn_neighbours,
        knn_vote,
        cluster_indices,
        silhouette_squared,
    )
}


def _class_sql(base: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    join = f"AND s.{by} = p.{by}" if by else ""
    tot = f"PARTITION BY {by}" if by else ""
    return f"""
    WITH base AS ({base}),
    s AS (SELECT {g}y AS c, count(*) AS sup, count(*) FILTER (y = p) AS tp FROM base GROUP BY {g}y),
    p AS (SELECT {g}p AS c, count(*) AS called FROM base GROUP BY {g}p),
    f AS (SELECT {'s.' + g if g else ''}sup, tp, 2.0::DOUBLE * tp / (sup + coalesce(called, 0)) AS f1
          FROM s LEFT JOIN p ON s.c = p.c {join})
    SELECT {g}sum(sup)::BIGINT AS n, {rounded("sum(tp) / sum(sup)::DOUBLE", 6)} AS accuracy,
           {rounded("sum(sup * f1) / sum(sup)::DOUBLE", 6)} AS weighted_f1
    FROM f {'GROUP BY ' + by if by else ''}"""


_GUESS = """SELECT d.lang, l.quality AS y, CASE WHEN d.n_chars > 500 AND l.toxic = 0 THEN 1 ELSE 0 END AS p
            FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
_LINE = """
    WITH base AS (SELECT l_quantity AS x, l_extendedprice + 500.0::DOUBLE * l_quantity AS y FROM lineitem),
    fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM base),
    pred AS (SELECT y AS actual, a + b * x AS predicted FROM base, fit),
    res AS (SELECT *, actual - predicted AS r FROM pred)"""
_KNN = """
    WITH ranked AS (SELECT *, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '42')) AS r, count(*) OVER () AS n FROM embeddings),
    parts AS (SELECT vec_id, embedding::DOUBLE[] AS x, label, r <= n - (3 * n + 9) // 10 AS train FROM ranked),
    pairs AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, t.label,
                     DIST AS distance
              FROM parts q, parts t WHERE NOT q.train AND t.train),
    near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM pairs
             QUALIFY rank <= 5)
""".replace("DIST", rounded("list_distance(q.x, t.x)", 9))
_DIMS = ", ".join(f"embedding[{i + 1}]::DOUBLE AS d{i}" for i in range(64))
_D2 = "power(list_distance(a.x, b.x), 2)"
_SIL = """
    pair AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(DIST) AS s, count(*) AS n
             FROM e a, e b GROUP BY 1, 2, 3),
    ab AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS size,
                  sum(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b
           FROM pair GROUP BY 1),
    sil AS (SELECT avg(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM ab)
"""
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"

ORACLES = {
    "class_metrics": _class_sql(_GUESS),
    "class_metrics_by_lang": _class_sql(_GUESS, "lang"),
    "class_metrics_three_classes": _class_sql(
        """SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'X' END AS p
           FROM orders"""
    ),
    "confusion_orders": """
      SELECT o_orderstatus AS actual, CASE WHEN o_totalprice > 300000 THEN 'F' ELSE 'O' END AS predicted, count(*) AS n
      FROM orders GROUP BY 1, 2""",
    "reg_metrics": _LINE + f"""
      SELECT count(*) AS n, {rounded("1 - avg(r * r) / var_pop(actual)", 4)} AS r2, {rounded("avg(r * r)", 4)} AS mse,
             {rounded("avg(abs(r))", 4)} AS mae FROM res""",
    "ols_one_feature": f"""
      SELECT regr_count(l_extendedprice, l_quantity)::BIGINT AS n, {rounded("regr_slope(l_extendedprice, l_quantity)", 4)} AS slope,
             {rounded("regr_intercept(l_extendedprice, l_quantity)", 4)} AS intercept,
             {rounded("regr_r2(l_extendedprice, l_quantity)", 4)} AS r2 FROM lineitem""",
    "residuals": _LINE + f"""
      SELECT {rounded("actual", 4)} AS actual, {rounded("predicted", 4)} AS predicted, {rounded("r", 4)} AS residual FROM res""",
    "residual_histogram": _LINE + f""",
      e AS (SELECT min(r) AS lo, max(r) AS hi, (max(r) - min(r)) / 15.0::DOUBLE AS w FROM res),
      c AS (SELECT least(floor((r - lo) / w), 14)::INTEGER AS bin, count(*) AS n FROM res, e GROUP BY 1)
      SELECT g::INTEGER AS bin, {rounded("lo + g * w", 3)} AS start, {rounded("lo + (g + 1) * w", 3)} AS "end",
             coalesce(n, 0) AS n FROM range(15) t(g) CROSS JOIN e LEFT JOIN c ON c.bin = g""",
    "ideal_bounds": _LINE + f"""
      SELECT {rounded("least(min(actual), min(predicted))", 3)} AS low,
             {rounded("greatest(max(actual), max(predicted))", 3)} AS high FROM pred""",
    "knn_neighbours": _KNN + f"SELECT query, neighbour, rank::INTEGER AS rank, {rounded('distance', 6)} AS distance FROM near",
    "knn_vote": _KNN + """
      SELECT query, label AS prediction FROM (SELECT query, label, count(*) AS v FROM near GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY query ORDER BY v DESC, label) = 1""",
    "cluster_indices": f"""
      WITH {_E}, {_SIL.replace("DIST", "list_distance(a.x, b.x)")},
      long AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM e),
      cen AS (SELECT label, j, avg(v) AS m, count(*) AS n FROM long GROUP BY 1, 2),
      allc AS (SELECT j, avg(v) AS m FROM long GROUP BY 1),
      dist AS (SELECT l.vec_id, l.label, sqrt(sum(power(v - m, 2))) AS d FROM long l JOIN cen USING (label, j) GROUP BY 1, 2),
      s AS (SELECT label, avg(d) AS s, sum(d * d) AS w FROM dist GROUP BY 1),
      gap AS (SELECT a.label AS a, b.label AS b, sqrt(sum(power(a.m - b.m, 2))) AS g
              FROM cen a JOIN cen b ON a.j = b.j AND a.label <> b.label GROUP BY 1, 2),
      db AS (SELECT avg(r) AS v FROM (SELECT gap.a, max((x.s + y.s) / g) AS r FROM gap JOIN s x ON x.label = gap.a
             JOIN s y ON y.label = gap.b GROUP BY 1)),
      bet AS (SELECT sum(n * power(cen.m - allc.m, 2)) AS b FROM cen JOIN allc USING (j)),
      t AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM e)
      SELECT n, k::INTEGER AS k, {rounded("db.v", 6)} AS davies_bouldin,
             {rounded("(b / (k - 1)) / ((SELECT sum(w) FROM s) / (n - k))", 6)} AS calinski_harabasz,
             {rounded("silhouette", 6)} AS silhouette FROM t, db, bet, sil""",
    "silhouette_squared": f"""
      WITH {_E}, {_SIL.replace("DIST", _D2)} SELECT {rounded("silhouette", 6)} AS silhouette FROM sil""",
}
