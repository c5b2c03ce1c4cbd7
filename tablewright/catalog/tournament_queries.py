from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablewright.catalog.tables import rounded, table
from tablewright.functions.columns import round_half_up
from tablewright.operators import boosting, cluster, linkage, lloyd, metrics, models, report, split
from tablewright.plans.advisory import run_advisory


def _orders(spark, d):
    """Orders with a price band as class; the price itself is left out, a noisy trace of it stays."""
    o = table(spark, d, "orders")
    band = F.when(F.col("o_totalprice") > 300000, F.lit("high")).when(F.col("o_totalprice") > 100000, F.lit("mid")).otherwise(F.lit("low"))
    trace = F.col("o_totalprice") + F.pmod(F.col("o_custkey") * 7919, F.lit(100000))
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", trace.alias("trace"), band.alias("band"))


def _two_classes(spark, d):
    return _orders(spark, d).withColumn("band", F.when(F.col("band") == "high", F.lit("high")).otherwise(F.lit("rest")))


def _priced(spark, d):
    o = table(spark, d, "orders")
    price = F.col("o_totalprice") / 1000 + 20 * F.month("o_orderdate")
    return o.select("o_orderkey", F.month("o_orderdate").alias("m"), price.alias("price"))


def _lineitem(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        (F.col("l_extendedprice") / 1000 + F.col("l_quantity")).alias("price"),
    )


CLASSIFIERS = ["Random Forest", "Gradient-Boosted Trees", "Logistic Regression", models.SOFT_VOTING]
THREE_CLASSES = ["Random Forest", "Gradient-Boosted Trees", "Logistic Regression", "Multilayer Perceptron"]
KERNEL_MACHINE = "Support Vector Machine (RBF, landmarks)"


def leaderboard_classifiers(spark, d):
    return models.classification_tournament(_two_classes(spark, d), "band", "o_orderkey", CLASSIFIERS).leaderboard


def leaderboard_three_classes(spark, d):
    return models.classification_tournament(_orders(spark, d), "band", "o_orderkey", THREE_CLASSES).leaderboard


def predictions_three_classes(spark, d):
    """Actual and predicted class of every test row of the winner."""
    return models.classification_tournament(_orders(spark, d), "band", "o_orderkey", ["Logistic Regression"]).holdout


def leaderboard_kernel_machine(spark, d):
    return models.classification_tournament(_two_classes(spark, d), "band", "o_orderkey", [KERNEL_MACHINE]).leaderboard


def leaderboard_neighbours(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.element_at("embedding", i + 1).alias(f"d{i}") for i in range(64)])
    return models.classification_tournament(e, "label", "vec_id", ["K-Nearest Neighbors"]).leaderboard


def boosting_first_trees(spark, d):
    """The first split by second-order gain of prices by month, day and weekday, for the price itself and for three price bands:
    the feature, the last value that goes left, the gain and both leaves (one step of size 1)."""
    o = table(spark, d, "orders")
    x = F.array(*[f("o_orderdate").cast("double") for f in (F.month, F.dayofmonth, F.dayofweek)])
    band = F.when(F.col("o_totalprice") > 300000, 2).when(F.col("o_totalprice") > 100000, 1).otherwise(0)
    rows = o.select(x.alias("x"), (F.col("o_totalprice") / 1000).alias("price"), band.alias("band"))
    out = []
    for loss, y in ((boosting.SQUARES, "price"), (boosting.SOFTMAX, "band")):
        model = boosting.fit(rows.select("x", F.col(y).alias("y")), 3, loss, 3, rounds=1, depth=1, rate=1.0)
        for k, tree in enumerate(model.rounds[0]):
            f = int(tree.feature[0])
            out.append((loss, k, ("month", "day", "weekday")[f], float(model.cuts[f][tree.cut[0]]), float(tree.gain[0]), float(tree.value[1]), float(tree.value[2])))
    found = spark.createDataFrame(out, "loss string, output int, feature string, cut double, gain double, left_leaf double, right_leaf double")
    return found.select("loss", "output", "feature", "cut", *[round_half_up(F.col(c), 5).alias(c) for c in ("gain", "left_leaf", "right_leaf")])


def leaderboard_stacking(spark, d):
    e = table(spark, d, "embeddings").select(
        "vec_id", (F.col("label") < 5).cast("int").alias("half"), *[F.element_at("embedding", i + 1).alias(f"d{i}") for i in range(64)]
    )
    return models.classification_tournament(e, "half", "vec_id", [models.STACKING]).leaderboard


def leaderboard_regressors(spark, d):
    return models.regression_tournament(_lineitem(spark, d), "price").leaderboard


def leaderboard_wide_text(spark, d):
    """Ridge on a text column with more categories than indicator columns are made for; unseen parts set no indicator."""
    li = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("part"),
        "l_quantity", (F.col("l_quantity") * 3 + F.col("l_orderkey") % 7).alias("y"),
    )
    return models.regression_tournament(li, "y", None, ["Ridge Regression (L2)"]).leaderboard


def leaderboard_ols(spark, d):
    return models.regression_tournament(_priced(spark, d), "price", "o_orderkey", ["Linear Regression (OLS)"]).leaderboard


def leaderboard_ridge(spark, d):
    return models.regression_tournament(_priced(spark, d), "price", "o_orderkey", ["Ridge Regression (L2)"]).leaderboard


def leaderboard_top4(spark, d):
    names = ["Linear Regression (OLS)", "Ridge Regression (L2)", "Lasso Regression (L1)"]
    board = models.regression_tournament(_priced(spark, d), "price", "o_orderkey", names).leaderboard
    return report.leaderboard_top(board)


def holdout_residuals(spark, d):
    """Actual, predicted and residual of every test row of the least-squares winner."""
    result = models.regression_tournament(_priced(spark, d), "price", "o_orderkey", ["Linear Regression (OLS)"])
    return metrics.rounded_metrics(metrics.residuals(result.holdout), 5)


def importances_forest(spark, d):
    result = models.classification_tournament(_two_classes(spark, d), "band", "o_orderkey", ["Random Forest"])
    return report.importances_ascending(result.importances)


def importances_ols(spark, d):
    result = models.regression_tournament(_priced(spark, d), "price", "o_orderkey", ["Linear Regression (OLS)"])
    return result.importances


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).alias(f"d{i}") for i in range(64)])


def leaderboard_clusters(spark, d):
    """All candidates, those by linkage on the rows themselves, by the silhouette on true distances, which compares all rows block by block."""
    return cluster.clustering_tournament(_points(spark, d), keep=["vec_id"], distance=cluster.EUCLIDEAN, linkage_on=cluster.ROWS).leaderboard


def leaderboard_clusters_lineitem(spark, d):
    """The same tournament on the largest table, by the silhouette on squared distances."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return cluster.clustering_tournament(li).leaderboard


def cluster_labels(spark, d):
    """The champion's segment of every row."""
    return cluster.clustering_tournament(_points(spark, d), keep=["vec_id"]).labelled.select("vec_id", "Cluster")


def linkage_merges(spark, d):
    """Every merge of the rows by average linkage, in order of height."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    merges = linkage.agglomerate(points, linkage.AVERAGE).table(spark)
    return merges.withColumn("height", round_half_up(F.col("height"), 6))


def segment_scatter(spark, d):
    """Every row's place in the chart and its segment."""
    result = cluster.clustering_tournament(_points(spark, d), keep=["vec_id"])
    scatter = cluster.segment_scatter(result.labelled, result.features)
    return scatter.select(round_half_up(F.col("d0"), 4).alias("d0"), round_half_up(F.col("d1"), 4).alias("d1"), "segment")


def segment_sample(spark, d):
    """The points to draw: a hundred orders of each priority, the same in every run."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return cluster.segment_sample(o, "o_orderpriority", "o_orderkey", rows=100)


KMEANS_STARTS = ((10.0, 20000.0), (25.0, 50000.0), (40.0, 90000.0))


def kmeans_one_move(spark, d):
    """Three centres after one move from given starts, with the sizes and the cost of the assignment before it."""
    points = table(spark, d, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_extendedprice")).alias("x"))
    fit = lloyd.fit_together(points, [np.array(KMEANS_STARTS)], [1])[0]
    rows = [(k, float(a), float(b), fit.cost) for k, (a, b) in enumerate(fit.centres)]
    out = spark.createDataFrame(rows, "centre int, quantity double, price double, cost double")
    return out.select("centre", *[round_half_up(F.col(c), 4).alias(c) for c in ("quantity", "price")],
                      F.floor(F.col("cost") / 1e6).alias("cost_millions"))


def _context_parts(spark, d):
    parts = split.split_70_15_15(_priced(spark, d), key="o_orderkey")
    return {r["split"]: r["n"] for r in split.split_counts(parts).collect()}


def run_context(spark, d):
    result = models.regression_tournament(_priced(spark, d), "price", "o_orderkey", ["Linear Regression (OLS)"])
    return report.run_context(
        spark, result.task, _context_parts(spark, d), result.best_algorithm, result.scores["r2_score"], ["nothing to clean"]
    )


def report_sections(spark, d):
    result = models.regression_tournament(_priced(spark, d), "price", "o_orderkey", ["Linear Regression (OLS)"])
    return report.report_sections(
        spark, result.task, result.best_algorithm, None, "r2_score", ["nothing to clean"], _context_parts(spark, d), 0,
        ["No gate was run."], ["m"],
    )


def report_export(spark, d):
    return report.export_sections(report_sections(spark, d), "business", ["executive_verdict", "strategic_recommendations"])


def report_payload(spark, d):
    """The first rows of two result tables as JSON."""
    orders = table(spark, d, "orders")
    status = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    days = orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return report.prune_to_json({"status": (status, ["o_orderstatus"]), "years": (days, ["y"]), "labelled": (orders, [])})


def advisory_segments(spark, d):
    """Raw customer table to segments in one call; the context row sums it up."""
    return run_advisory(table(spark, d, "customer"), "segment the customers", key="c_custkey").context


def advisory_prices(spark, d):
    """The sections of the report, in order, with the champion and its score."""
    return run_advisory(
        _priced(spark, d), "predict price", key="o_orderkey", candidates=["Linear Regression (OLS)", "Ridge Regression (L2)"]
    ).report


QUERIES = {
    f.__name__: f
    for f in (
        leaderboard_classifiers,
        leaderboard_three_classes,
        predictions_three_classes,
        leaderboard_kernel_machine,
        leaderboard_neighbours,
        boosting_first_trees,
        leaderboard_stacking,
        leaderboard_regressors,
        leaderboard_wide_text,
        leaderboard_ols,
        leaderboard_ridge,
        leaderboard_top4,
        holdout_residuals,
        importances_forest,
        importances_ols,
        leaderboard_clusters,
        leaderboard_clusters_lineitem,
        cluster_labels,
        kmeans_one_move,
        linkage_merges,
        segment_scatter,
        segment_sample,
        run_context,
        report_sections,
        report_export,
        report_payload,
        advisory_segments,
        advisory_prices,
    )
}

_OLS = """
    WITH ranked AS (SELECT month(o_orderdate) AS m, o_totalprice / 1000 + 20 * month(o_orderdate) AS price,
                           row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '42')) AS r, count(*) OVER () AS n FROM orders),
    placed AS (SELECT m, price, CASE WHEN r <= n - (3 * n + 9) // 10 THEN 'train'
                      WHEN r <= n - ((3 * n + 9) // 10 + 1) // 2 THEN 'val' ELSE 'test' END AS split FROM ranked),
    z AS (SELECT avg(m) AS mm, stddev_pop(m) AS sm, avg(price) AS mp, count(*) AS n FROM placed WHERE split = 'train'),
    fit AS (SELECT covar_pop(price, m) / (max(sm) * max(sm)) * max(n) / (max(n) + ALPHA) AS b, max(mp) AS mp, max(mm) AS mm, max(sm) AS sm
            FROM placed, z WHERE split = 'train'),
    res AS (SELECT split, price AS actual, mp + b * (m - mm) AS predicted, price - mp - b * (m - mm) AS e FROM placed, fit),
    score AS (SELECT split, 1 - avg(e * e) / var_pop(actual) AS r2, avg(e * e) AS mse, avg(abs(e)) AS mae FROM res GROUP BY 1)
"""


def _board(name: str, alpha: str) -> str:
    return _OLS.replace("ALPHA", alpha) + f"""
    SELECT 1 AS rank, '{name}' AS algorithm, {rounded("max(r2) FILTER (split = 'val')", 4)} AS val_r2,
           {rounded("max(r2) FILTER (split = 'test')", 4)} AS test_r2, {rounded("max(mse) FILTER (split = 'test')", 4)} AS test_mse,
           {rounded("max(mae) FILTER (split = 'test')", 4)} AS test_mae, 'Winner' AS verdict FROM score"""


_PARTS = """
    t AS (SELECT count(*) AS n, (3 * count(*) + 9) // 10 AS held FROM orders),
    sizes AS (SELECT n - held AS train, held - (held + 1) // 2 AS val, (held + 1) // 2 AS test, n FROM t)
"""


def _share(part: str) -> str:
    return f"'{part} ' || {part}::VARCHAR || ' rows (' || format('{{:.1f}}', 100 * {part} / n::DOUBLE) || '%)'"


_SECTIONS = f"""
    WITH {_PARTS},
    s AS (
      SELECT 'business' AS report, 'executive_verdict' AS section, 0 AS ordinal,
             'Regression: Linear Regression (OLS) was selected with r2_score not available.' AS text
      UNION ALL SELECT 'business', 'segment_insights', 0, 'm is among the strongest drivers.'
      UNION ALL SELECT 'business', 'data_readiness_score', 0, 'High Quality'
      UNION ALL SELECT 'business', 'data_readiness_detail', 0, '0 cells are missing after 1 cleaning steps.'
      UNION ALL SELECT 'business', 'strategic_recommendations', 0, 'Use Linear Regression (OLS) as the reference model.'
      UNION ALL SELECT 'business', 'strategic_recommendations', 1, 'Confirm the result on data collected after this run.'
      UNION ALL SELECT 'business', 'potential_business_risks', 0, 'The distribution of the inputs may change.'
      UNION ALL SELECT 'business', 'potential_business_risks', 1, 'Cohorts should be audited for parity before use.'
      UNION ALL SELECT 'technical', 'architecture_summary', 0, 'Linear Regression (OLS) led the ranking on the validation part.'
      UNION ALL SELECT 'technical', 'data_engineering_audit', 0, 'nothing to clean'
      UNION ALL SELECT 'technical', 'statistical_quality_gates', 0,
                       'Parts: ' || {_share("train")} || ', ' || {_share("val")} || ', ' || {_share("test")} FROM sizes
      UNION ALL SELECT 'technical', 'statistical_quality_gates', 1, 'No gate was run.'
      UNION ALL SELECT 'technical', 'production_monitoring_plan', 0, 'Profile every new batch and compare it with this profile.'
      UNION ALL SELECT 'technical', 'production_monitoring_plan', 1,
                       'Retrain when the holdout score falls below the validation score.')
"""

_COLUMNS = [f"d{i}" for i in range(64)]
_NEIGHBOURS = f"""
    WITH ranked AS (SELECT vec_id, label, {", ".join(f"embedding[{i + 1}]::DOUBLE AS d{i}" for i in range(64))},
                           row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || '42')) AS r,
                           count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    sized AS (SELECT *, CASE WHEN n > 1 THEN (3 * n + 9) // 10 ELSE 0 END AS held FROM ranked),
    placed AS (SELECT *, CASE WHEN r <= n - held THEN 'train' WHEN r <= n - (held + 1) // 2 THEN 'val' ELSE 'test' END AS split FROM sized),
    m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _COLUMNS)} FROM placed WHERE split = 'train'),
    z AS (SELECT vec_id, label, split, [{", ".join(f"({c} - m_{c}) / s_{c}" for c in _COLUMNS)}] AS x FROM placed, m),
    pairs AS (SELECT q.vec_id AS query, q.split, q.label AS y, t.vec_id AS neighbour, t.label,
                     {rounded("list_distance(q.x, t.x)", 9)} AS distance FROM z q, z t WHERE q.split <> 'train' AND t.split = 'train'),
    near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) <= 5),
    votes AS (SELECT query, split, y, label, count(*) AS v FROM near GROUP BY ALL),
    pred AS (SELECT query, split, y, label AS p FROM votes QUALIFY row_number() OVER (PARTITION BY query ORDER BY v DESC, label) = 1),
    sup AS (SELECT split, y AS c, count(*) AS sup, count(*) FILTER (y = p) AS tp FROM pred GROUP BY ALL),
    called AS (SELECT split, p AS c, count(*) AS called FROM pred GROUP BY ALL),
    f AS (SELECT split, sum(sup * 2.0::DOUBLE * tp / (sup + coalesce(called, 0))) / sum(sup)::DOUBLE AS f1,
                 sum(tp) / sum(sup)::DOUBLE AS acc FROM sup LEFT JOIN called USING (split, c) GROUP BY 1)
"""


_TOP = _OLS.replace("ALPHA", "0").split("    res AS")[0].rstrip().rstrip(",") + f""",
    variants AS (SELECT 0 AS o, 'Linear Regression (OLS)' AS algorithm, b, mp, mm FROM fit
      UNION ALL SELECT 1, 'Ridge Regression (L2)', b * n / (n + 1.0::DOUBLE), fit.mp, fit.mm FROM fit, z
      UNION ALL SELECT 2, 'Lasso Regression (L1)', sign(b) * greatest(abs(b * fit.sm) - LASSO, 0) / fit.sm, fit.mp, fit.mm FROM fit),
    res AS (SELECT o, algorithm, split, price AS actual, price - mp - b * (m - mm) AS e FROM placed, variants),
    score AS (SELECT o, algorithm, split, 1 - avg(e * e) / var_pop(actual) AS r2, avg(e * e) AS mse, avg(abs(e)) AS mae FROM res GROUP BY ALL),
    wide AS (SELECT o, algorithm, max(r2) FILTER (split = 'val') AS v, max(r2) FILTER (split = 'test') AS t,
                    max(mse) FILTER (split = 'test') AS mse, max(mae) FILTER (split = 'test') AS mae FROM score GROUP BY ALL),
    board AS (SELECT (row_number() OVER (ORDER BY v DESC, o))::INTEGER AS rank, * FROM wide)
    SELECT rank, algorithm, {rounded("v", 4)} AS val_r2, {rounded("t", 4)} AS test_r2, {rounded("mse", 4)} AS test_mse FROM board
""".replace("LASSO", f"{models.Settings().lasso_alpha}::DOUBLE")

ORACLES = {
    "boosting_first_trees": f"""
      WITH o AS (SELECT month(o_orderdate)::DOUBLE AS month, day(o_orderdate)::DOUBLE AS day, dayofweek(o_orderdate)::DOUBLE + 1 AS weekday,
                        o_totalprice / 1000 AS price,
                        CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS band FROM orders),
      m AS (SELECT avg(price) AS mean FROM o),
      g AS (SELECT 'squares' AS loss, 0 AS output, month, day, weekday, mean - price AS g, 1.0::DOUBLE AS h FROM o, m
            UNION ALL SELECT 'softmax', k, month, day, weekday, 1 / 3::DOUBLE - CASE WHEN band = k THEN 1 ELSE 0 END, 2 / 9::DOUBLE
            FROM o, (VALUES (0), (1), (2)) AS c(k)),
      v AS (SELECT loss, output, f.place, f.name, f.x, sum(g) AS g, sum(h) AS h FROM (
              SELECT loss, output, g, h, unnest([{{'place': 0, 'name': 'month', 'x': month}}, {{'place': 1, 'name': 'day', 'x': day}},
                                                 {{'place': 2, 'name': 'weekday', 'x': weekday}}]) AS f FROM g) GROUP BY ALL),
      s AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY loss, output, name) AS gt,
                   sum(h) OVER (PARTITION BY loss, output, name) AS ht FROM v WINDOW w AS (PARTITION BY loss, output, name ORDER BY x)),
      t AS (SELECT *, 0.5::DOUBLE * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM s
            WHERE hl >= 1 AND ht - hl >= 1)
      SELECT loss, output::INTEGER AS output, name AS feature, x AS cut, {rounded("gain", 5)} AS gain,
             {rounded("-gl / (hl + 1)", 5)} AS left_leaf, {rounded("-(gt - gl) / (ht - hl + 1)", 5)} AS right_leaf FROM t
      QUALIFY row_number() OVER (PARTITION BY loss, output ORDER BY gain DESC, place, x) = 1""",
    "leaderboard_top4": _TOP,
    "segment_sample": """
      SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(':' || o_orderkey)) <= 100""",
    "kmeans_one_move": f"""
      WITH s AS (SELECT * FROM (VALUES {", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(KMEANS_STARTS))}) AS v(centre, a, b)),
      far AS (SELECT l_quantity AS q, l_extendedprice AS p, l.rowid AS r, centre,
                     (l_quantity - a) * (l_quantity - a) + (l_extendedprice - b) * (l_extendedprice - b) AS dd
              FROM (SELECT *, row_number() OVER () AS rowid FROM lineitem) l, s),
      near AS (SELECT r, arg_min(centre, dd) AS centre, any_value(q) AS q, any_value(p) AS p, min(dd) AS dd FROM far GROUP BY r)
      SELECT centre::INTEGER AS centre, {rounded("avg(q)", 4)} AS quantity, {rounded("avg(p)", 4)} AS price,
             floor(sum(sum(dd)) OVER () / 1e6::DOUBLE)::BIGINT AS cost_millions FROM near GROUP BY centre""",
    "leaderboard_neighbours": _NEIGHBOURS + f"""
      SELECT 1 AS rank, 'K-Nearest Neighbors' AS algorithm, {rounded("max(f1) FILTER (split = 'val')", 4)} AS val_f1,
             {rounded("max(f1) FILTER (split = 'test')", 4)} AS test_f1,
             format('{{:.2f}}%', 100 * max(acc) FILTER (split = 'test')) AS test_accuracy, 'Winner' AS verdict FROM f""",
    "leaderboard_ols": _board("Linear Regression (OLS)", "0"),
    "leaderboard_ridge": _board("Ridge Regression (L2)", "1.0::DOUBLE"),
    "holdout_residuals": _OLS.replace("ALPHA", "0") + f"""
      SELECT {rounded("actual", 5)} AS actual, {rounded("predicted", 5)} AS predicted, {rounded("e", 5)} AS residual
      FROM res WHERE split = 'test'""",
    "importances_ols": _OLS.replace("ALPHA", "0")
    + f"SELECT 'm' AS feature, {rounded('abs(b * sm)', 4)} AS importance, 1.0::DOUBLE AS share FROM fit",
    "run_context": _OLS.replace("ALPHA", "0").replace("WITH ranked", f"WITH {_PARTS}, ranked") + f"""
      SELECT 'Regression' AS task, train, val, test, 'Linear Regression (OLS)' AS champion,
             (SELECT {rounded("max(r2) FILTER (split = 'test')", 4)} FROM score) AS score, ['nothing to clean'] AS log FROM sizes""",
    "report_sections": _SECTIONS + "SELECT * FROM s",
    "report_export": _SECTIONS + """
      SELECT *, (CASE section WHEN 'executive_verdict' THEN 1 ELSE 2 END)::INTEGER AS place FROM s
      WHERE section IN ('executive_verdict', 'strategic_recommendations')""",
    "report_payload": """
      WITH a AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 5),
      b AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 5)
      SELECT 'status' AS name, (row_number() OVER (ORDER BY s) - 1)::INTEGER AS ordinal,
             '{"o_orderstatus":"' || s || '","n":' || n::VARCHAR || '}' AS json FROM a
      UNION ALL SELECT 'years', (row_number() OVER (ORDER BY y) - 1)::INTEGER, '{"y":' || y::VARCHAR || ',"n":' || n::VARCHAR || '}' FROM b""",
}
