"""Statistics, rules, metrics, neighbours, clustering and models against closed forms and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import tails
from tablewright.operators import assoc, boosting, cluster, kernel, knn, linkage, lloyd, metrics, models, network, stats


def frame(spark, rows, schema, parts=2):
    return spark.createDataFrame(rows, schema).repartition(parts)


# ---- tails -----------------------------------------------------------------------------------


def test_tails_against_the_library_spark_ships(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for df in (1.0, 2.5, 7.0, 300.0):
        for x in (0.1, 1.0, 5.0, 40.0):
            assert tails.chi2_sf(x, df) == pytest.approx(1 - d.ChiSquaredDistribution(df).cumulativeProbability(x), abs=1e-10)
            assert tails.t_two_sided(x, df) == pytest.approx(2 * d.TDistribution(df).cumulativeProbability(-x), rel=1e-6, abs=1e-12)
            for df2 in (3.0, 50.0, 100000.0):
                want = 1 - d.FDistribution(df, df2).cumulativeProbability(x)
                assert tails.f_sf(x, df, df2) == pytest.approx(want, abs=1e-9)


def test_tails_at_the_ends():
    assert tails.chi2_sf(0, 3) == 1.0 and tails.f_sf(0, 2, 9) == 1.0 and tails.t_two_sided(0, 5) == pytest.approx(1.0)
    assert 0 < tails.chi2_sf(1200, 3) < 1e-250
    assert tails.t_two_sided(2.0, 1e6) == pytest.approx(math.erfc(2.0 / math.sqrt(2)), rel=1e-4)


# ---- statistics ------------------------------------------------------------------------------


def _correlated(spark, n=200):
    rng = random.Random(5)
    rows = []
    for _ in range(n):
        base = rng.gauss(0, 1)
        rows.append((base + rng.gauss(0, 0.3), base + rng.gauss(0, 0.3), base + rng.gauss(0, 0.3), rng.gauss(0, 1)))
    return rows, frame(spark, rows, "a double, b double, c double, d double", 4)


def test_kmo_of_two_columns_is_a_half(spark):
    _, df = _correlated(spark)
    assert stats.kmo_bartlett(df, ["a", "b"]).first()["kmo_score"] == 0.5


def test_kmo_and_bartlett(spark):
    rows, df = _correlated(spark)
    r = np.corrcoef(np.array(rows).T)
    got = stats.kmo_bartlett(df).first()
    chi = -(200 - 1 - (2 * 4 + 5) / 6) * math.log(np.linalg.det(r))
    assert got["bartlett_chi_sq"] == pytest.approx(chi, abs=0.01) and got["bartlett_df"] == 6
    assert 0.6 <= got["kmo_score"] <= 1 and got["clustering_suitability"] == "Suitable"


def test_constant_columns_are_set_aside(spark):
    _, df = _correlated(spark)
    got = stats.kmo_bartlett(df.withColumn("k", F.lit(2.0))).first()
    assert got["constant_columns"] == ["k"] and got["num_columns"] == 4


def test_wide_tables_use_the_vector_correlation(spark, monkeypatch):
    _, df = _correlated(spark)
    want = stats.fit_moments(df).corr
    monkeypatch.setattr(stats, "PAIRWISE_COLUMNS", 2)
    assert np.allclose(stats.fit_moments(df).corr, want)


def test_one_numeric_column_is_an_error(spark):
    with pytest.raises(ValueError):
        stats.kmo_bartlett(frame(spark, [(1.0, True)], "a double, b boolean"))


def test_all_factors_rebuild_the_correlations(spark):
    _, df = _correlated(spark)
    m = stats.fit_moments(df)
    values, vectors = np.linalg.eigh(m.corr)
    assert np.allclose((vectors * values) @ vectors.T, m.corr)
    model = stats.fit_factors(df)
    assert len(model.factors) >= 1 and (model.components[0].max() > 0)
    scores = np.array([list(r) for r in model.scores(df).collect()])
    assert scores.mean(axis=0) == pytest.approx(0, abs=1e-9)
    assert scores[:, 0].var(ddof=1) == pytest.approx(model.eigenvalues[0])


def test_welch_by_hand(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("b", None), (None, 9.0)], "g string, x double")
    r = stats.feature_significance(df, "g").first()
    t = (2 - 5) / math.sqrt(1 / 3 + 2 / 2)
    assert r["test"] == "Independent T-Test" and r["statistic"] == pytest.approx(t, abs=1e-3)


def test_anova_by_hand_leaves_single_rows_out(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 5.0), ("c", 100.0)]
    r = stats.feature_significance(frame(spark, rows, "g string, x double"), "g").first()
    assert (r["test"], r["classes"], r["num_rows"], r["df1"], r["df2"]) == ("One-Way ANOVA", 3, 4, 1.0, 2.0)
    between, within = 2 * (1.5 - 2.75) ** 2 + 2 * (4 - 2.75) ** 2, 0.5 + 2.0
    assert r["statistic"] == pytest.approx(between / (within / 2), abs=1e-3)


def test_no_spread_is_no_verdict(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)]
    r = stats.feature_significance(frame(spark, rows, "g string, x double"), "g").first()
    assert r["statistic"] is None and r["action"] == "Candidate for Removal"


def test_single_class_gives_no_tests(spark):
    assert stats.feature_significance(frame(spark, [("a", 1.0), ("a", 2.0)], "g string, x double"), "g").count() == 0


# ---- association rules -----------------------------------------------------------------------


def _baskets(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.random() < 0.4, rng.choice("pqr")) for _ in range(300)]
    rows = [(a, b, c if a == "a" else True, d) for a, b, c, d in rows]
    return rows, frame(spark, rows, "u string, v string, w boolean, z string", 4)


def _brute(rows, floor):
    counts = {}
    for a, b, c, d in rows:
        items = sorted([f"u_{a}", *([f"v_{b}"] if b else []), *(["w"] if c else []), f"z_{d}"])
        for k in range(1, len(items) + 1):
            for s in itertools.combinations(items, k):
                counts[s] = counts.get(s, 0) + 1
    return {s: n for s, n in counts.items() if n / len(rows) >= floor}


@pytest.mark.parametrize("cube, listed", [(50_000_000, 10_000), (1, 10_000), (50_000_000, 1), (1, 1)])
def test_itemsets_equal_brute_force(spark, monkeypatch, cube, listed):
    monkeypatch.setattr(assoc, "CUBE_ROWS", cube)
    monkeypatch.setattr(assoc, "LISTED_VALUES", listed)
    rows, df = _baskets(spark)
    got = {tuple(r["items"]): r["n"] for r in assoc.frequent_itemsets(df, 0.1).collect()}
    assert got == _brute(rows, 0.1)
    for s, n in got.items():  # support never grows with the itemset
        assert all(got[t] >= n for t in itertools.combinations(s, len(s) - 1) if t)


def test_rules_equal_brute_force(spark):
    rows, df = _baskets(spark)
    sets = _brute(rows, 0.1)
    want = set()
    for s, n in sets.items():
        for k in range(1, len(s)):
            for lhs in itertools.combinations(s, k):
                rhs = tuple(x for x in s if x not in lhs)
                if n / sets[lhs] >= 0.6:
                    want.add((", ".join(lhs), ", ".join(rhs)))
    got = assoc.association_rules(assoc.frequent_itemsets(df, 0.1), 0.6).collect()
    assert {(r["antecedent"], r["consequent"]) for r in got} == want and len(got) == len(want)


def test_no_baskets_give_empty_rules(spark):
    assert assoc.mine_rules(spark.range(5)).count() == 0
    assert assoc.mine_rules(frame(spark, [(None,)], "s string")).count() == 0
    assert assoc.mine_rules(frame(spark, [("a",), ("b",)], "s string")).columns == [
        "antecedent", "consequent", "support", "confidence", "lift",
    ]


# ---- metrics ---------------------------------------------------------------------------------


def test_class_metrics_by_hand(spark):
    df = frame(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "y string, p string")
    r = metrics.class_metrics(df, "y", "p").first()
    assert r["accuracy"] == 0.5 and r["weighted_f1"] == pytest.approx((2 * (2 / 3) + 2 * 0.5) / 4)


def test_regression_metrics_edges(spark):
    r = metrics.regression_metrics(frame(spark, [(2.0, 2.0), (2.0, 2.0)], "y double, p double"), "y", "p").first()
    assert (r["r2"], r["mse"]) == (1.0, 0.0)
    r = metrics.regression_metrics(frame(spark, [(2.0, 3.0), (2.0, 2.0)], "y double, p double"), "y", "p").first()
    assert r["r2"] == 0.0


def test_histogram_of_equal_values(spark):
    rows = metrics.histogram(frame(spark, [(2.0,)] * 3, "residual double")).collect()
    assert len(rows) == 15 and sorted(r["n"] for r in rows)[-2:] == [0, 3]
    assert min(r["start"] for r in rows) == 1.5 and max(r["end"] for r in rows) == pytest.approx(2.5)


def test_histogram_equals_numpy(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0, 2) for _ in range(1000)]
    rows = sorted(metrics.histogram(frame(spark, [(x,) for x in xs], "residual double")).collect())
    assert [r["n"] for r in rows] == list(np.histogram(xs, 15)[0])


# ---- neighbours ------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [(5000, 20000, 5000), (20, 15, 10)])
def test_neighbours_equal_brute_force(spark, limits):
    rng = np.random.default_rng(2)
    # A third of the reference rows are copies of one point; the rest form clumps.
    pts = np.concatenate([np.zeros((100, 3)), rng.normal(0, 1, (100, 3)), rng.normal(6, 0.2, (100, 3))])
    ask = np.concatenate([rng.normal(0, 1, (20, 3)), rng.normal(6, 1, (20, 3)), np.zeros((3, 3))])
    train = frame(spark, [(i, [float(v) for v in p], i % 3) for i, p in enumerate(pts)], "id int, x array<double>, label int", 5)
    asked = frame(spark, [(1000 + i, [float(v) for v in p]) for i, p in enumerate(ask)], "id int, x array<double>", 3)
    got = {}
    for r in knn.nearest_neighbours(train, asked, "x", "id", "label", 5, *limits).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    for i, q in enumerate(ask):
        d = np.floor(np.sqrt(((pts - q) ** 2).sum(axis=1)) * 1e9 + 0.5)
        want = sorted(range(len(pts)), key=lambda j: (d[j], j))[:5]
        assert [got[1000 + i][k + 1] for k in range(5)] == want


def test_fewer_rows_than_neighbours(spark):
    train = frame(spark, [(1, 0.0, "a"), (2, 1.0, "b")], "id int, x double, label string")
    near = knn.nearest_neighbours(train, frame(spark, [(9, 0.9)], "id int, x double"), ["x"], "id", "label", 5)
    assert near.count() == 2 and knn.knn_vote(near).first()["prediction"] == "a"


# ---- clustering ------------------------------------------------------------------------------


def _blobs(n=60):
    rng = np.random.default_rng(4)
    return np.concatenate([rng.normal(c, 0.3, (n // 3, 2)) for c in (0, 5, 10)])


@pytest.mark.parametrize("linkage", cluster.LINKAGES)
def test_linkage_finds_the_blobs(linkage):
    pts = _blobs()
    labels = cluster.merge_linkage(pts, np.ones(len(pts)), linkage, [2, 3])
    assert len(set(labels[2])) == 2
    assert all(len(set(labels[3][i : i + 20])) == 1 for i in (0, 20, 40)) and len(set(labels[3])) == 3


def test_ward_weights_stand_for_copies():
    pts = np.array([[0.0], [1.0], [3.0], [3.9]])
    weights = np.array([5, 5, 1, 1])
    many = np.repeat(pts, weights, axis=0)
    a = cluster.merge_linkage(pts, weights, "ward", [2])[2]
    b = cluster.merge_linkage(many, np.ones(len(many)), "ward", [2])[2]
    assert [a[0] == a[1], a[1] == a[2], a[2] == a[3]] == [b[0] == b[5], b[5] == b[10], b[10] == b[11]]


def test_indices_and_both_silhouettes(spark):
    pts = _blobs()
    df = frame(spark, [(float(p[0]), float(p[1]), i // 20) for i, p in enumerate(pts)], "a double, b double, c int", 4)
    exact = cluster.score_clusters(df, ["a", "b"], "c", cluster.EUCLIDEAN)
    linear = cluster.score_clusters(df, ["a", "b"], "c")
    assert exact["kind"] == "euclidean" and linear["kind"] == "squared euclidean"
    assert exact["davies_bouldin"] == linear["davies_bouldin"] and 0.8 < exact["silhouette"] < linear["silhouette"] <= 1
    assert linear["silhouette"] == pytest.approx(cluster.silhouette_squared(df, ["a", "b"], "c"))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    own = np.arange(len(pts)) // 20
    a = np.array([d[i, own == own[i]].sum() / 19 for i in range(len(pts))])
    b = np.array([min(d[i, own == c].mean() for c in range(3) if c != own[i]) for i in range(len(pts))])
    assert exact["silhouette"] == pytest.approx(np.mean((b - a) / np.maximum(a, b)))
    two = df.select(F.array("a", "b").alias("x"), F.col("c").cast("bigint").alias("c"), (F.col("c") % 2).cast("bigint").alias("e"))
    many = cluster._silhouettes_euclidean(  # several blocks, two candidates
        two, ["c", "e"], [cluster._Clusters(np.arange(k), np.array(n), np.zeros((k, 2)), np.zeros(k)) for k, n in ((3, [20.0] * 3), (2, [40.0, 20.0]))], 7)
    assert many[0] == pytest.approx(exact["silhouette"])
    own = own % 2
    a = np.array([d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1) for i in range(len(pts))])
    b = np.array([d[i, own != own[i]].mean() for i in range(len(pts))])
    assert many[1] == pytest.approx(np.mean((b - a) / np.maximum(a, b)))


def _plain_lloyd(x, centres, moves):
    for _ in range(moves):
        far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        at, cost = far.argmin(axis=1), far.min(axis=1).sum()
        centres = np.array([x[at == k].mean(axis=0) if (at == k).any() else centres[k] for k in range(len(centres))])
    return centres, cost


def test_fits_advance_together(spark):
    """Every candidate moves as it would alone; one whose centre gets no point keeps it."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (0, 3, 7)])
    points = frame(spark, [(p.tolist(),) for p in x], "x array<double>", 5)
    starts = [x[[0, 70, 150]], x[[3, 4]], np.array([[0.0, 0, 0], [900.0, 900, 900]])]
    fits = lloyd.fit_together(points, starts, [4, 1, 3], tolerance=0.0)
    for fit, start, moves in zip(fits, starts, (4, 1, 3)):
        centres, cost = _plain_lloyd(x, start, min(moves, fit.iterations))
        assert fit.centres == pytest.approx(centres) and fit.cost == pytest.approx(cost)
    assert fits[0].iterations <= 4 and [f.iterations for f in fits[1:]] == [1, 2]  # the third has settled before its limit
    labels = lloyd.with_labels(points, {"a": fits[0].centres, "b": fits[1].centres}).collect()
    for r in labels:
        for name, fit in (("a", fits[0]), ("b", fits[1])):
            assert r[name] == ((np.array(r["x"]) - fit.centres) ** 2).sum(axis=1).argmin()


def test_pool_of_starts(spark):
    """Most rows are one point: it is one entry with all their weight, and the far groups are found."""
    rng = np.random.default_rng(5)
    far = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in (20, -30, 60)])
    rows = [([1.0, 1.0],)] * 2_000 + [(p.tolist(),) for p in far]
    points = frame(spark, rows, "x array<double>", 6)
    pool, weights = lloyd.start_pool(points, 2, 4, seed=1)
    assert weights.sum() == len(rows) and len(pool) < 200
    assert weights[(pool == 1.0).all(axis=1)].tolist() == [2_000]
    again, same = lloyd.start_pool(points, 2, 4, seed=1)
    assert np.array_equal(pool, again) and np.array_equal(weights, same)
    start = lloyd.starts_from_pool(pool, weights, 4, seed=3)
    assert sorted(np.round(start[:, 0]).tolist()) == [-30, 1, 20, 60]
    assert len(lloyd.starts_from_pool(pool[:1], weights[:1], 3, seed=3)) == 3


def test_board_equals_plain_scores(spark):
    """Every score of the board from the labels of a plain k-means run to its end, and the champion's labels."""
    pts = _blobs()
    df = frame(spark, [(i, float(p[0]), float(p[1])) for i, p in enumerate(pts)], "id int, a double, b double", 4)
    result = cluster.clustering_tournament(df, max_k=3, keep=["id"], restarts=3, linkages=[], distance=cluster.EUCLIDEAN)
    z = (pts - pts.mean(axis=0)) / pts.std(axis=0)
    got = {r["id"]: r["Cluster"] for r in result.labelled.collect()}
    groups = np.array([got[i] for i in range(len(pts))])
    assert all(len(set(groups[k : k + 20])) == 1 for k in (0, 20, 40)) and len(set(groups)) == 3
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    a = np.array([d[i, groups == groups[i]].sum() / 19 for i in range(len(z))])
    b = np.array([min(d[i, groups == c].mean() for c in range(3) if c != groups[i]) for i in range(len(z))])
    means = np.array([z[groups == c].mean(axis=0) for c in range(3)])
    within = np.array([np.sqrt(((z[groups == c] - means[c]) ** 2).sum(axis=1)).mean() for c in range(3)])
    davies = np.mean([max((within[i] + within[j]) / np.sqrt(((means[i] - means[j]) ** 2).sum()) for j in range(3) if j != i) for i in range(3)])
    between = 20 * (means**2).sum() / 2
    inside = sum(((z[groups == c] - means[c]) ** 2).sum() for c in range(3)) / 57
    first = result.leaderboard.where("rank = 1").first()
    assert first["silhouette"] == pytest.approx(np.mean((b - a) / np.maximum(a, b)), abs=6e-5)
    assert first["davies_bouldin"] == pytest.approx(davies, abs=6e-5)
    assert first["calinski_harabasz"] == pytest.approx(between / inside, abs=6e-3)


@pytest.mark.parametrize("n", [199, 200, 201, 202])
def test_the_tournament_does_not_change_with_the_size(spark, n):
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal(c, 0.3, (n // 3 + 1, 2)) for c in (0, 5, 10)])[:n]
    df = frame(spark, [(float(a), float(b)) for a, b in pts], "a double, b double", 2)
    result = cluster.clustering_tournament(df, max_k=3, restarts=1, linkages=["ward"])
    kinds = {r["silhouette_kind"] for r in result.leaderboard.collect()}
    assert kinds == {cluster.SQUARED} and result.best_k == 3 and result.labelled.count() == n


def test_clustering_tournament(spark):
    pts = _blobs()
    df = frame(spark, [(i, float(p[0]), float(p[1]), "t") for i, p in enumerate(pts)], "id int, a double, b double, s string", 4)
    result = cluster.clustering_tournament(df, max_k=4, keep=["id"], restarts=2)
    board = result.leaderboard.orderBy("rank").collect()
    assert result.best_k == 3 and len(board) == 12 and board[0]["verdict"] == "Selected Champion"
    assert sorted(r["count"] for r in result.labelled.groupBy("Cluster").count().collect()) == [20, 20, 20]
    assert result.labelled.agg(F.round(F.sum("a"), 6)).first()[0] == df.agg(F.round(F.sum("a"), 6)).first()[0]
    scatter = cluster.segment_scatter(result.labelled, result.features)
    assert scatter.columns == ["a", "b", "segment"] and scatter.where("segment like 'Segment %'").count() == 60


def test_clustering_needs_two_numbers(spark):
    with pytest.raises(ValueError):
        cluster.clustering_tournament(frame(spark, [(1.0, "a"), (2.0, "b")], "x double, s string"))


# ---- models ----------------------------------------------------------------------------------

QUICK = models.Settings(trees=5, forest_depth=3, boost_rounds=2, folds=2, logistic_iterations=20, network_iterations=15, svm_iterations=8)


def _classes(spark, n=240):
    rng = random.Random(8)
    rows = [(i, rng.gauss(3 * (i % 2), 1), rng.gauss(0, 1), rng.choice("pq"), "no" if i % 2 else "yes") for i in range(n)]
    return frame(spark, rows, "id int, a double, b double, g string, y string", 4)


def test_classification_tournament_with_all_models(spark):
    result = models.classification_tournament(_classes(spark), "y", "id", settings=QUICK)
    board = result.leaderboard.orderBy("rank").collect()
    assert result.failures.count() == 0 and len(board) == 8 and result.classes == ("no", "yes")
    assert [r["val_f1"] for r in board] == sorted((r["val_f1"] for r in board), reverse=True)
    assert board[0]["verdict"] == "Winner" and board[0]["test_f1"] > 0.75
    assert result.holdout.count() == 36


def test_failures_are_recorded(spark, monkeypatch):
    def broken(train, p, s):
        raise RuntimeError("no luck")

    monkeypatch.setitem(models.CLASSIFIERS, "Random Forest", broken)
    result = models.classification_tournament(_classes(spark, 100), "y", "id", ["Random Forest", "Logistic Regression"], QUICK)
    assert result.best_algorithm == "Logistic Regression"
    assert [(r["algorithm"], r["error"]) for r in result.failures.collect()] == [("Random Forest", "RuntimeError: no luck")]
    with pytest.raises(ValueError):
        models.classification_tournament(_classes(spark, 100), "y", "id", ["Random Forest"], QUICK)


def test_missing_target(spark):
    with pytest.raises(ValueError):
        models.regression_tournament(spark.range(10), "absent")


def test_regression_tournament_with_all_models(spark):
    rng = random.Random(6)
    rows = [(i, x := rng.gauss(0, 1), rng.choice("pq"), 3 * x + rng.gauss(0, 0.1)) for i in range(200)]
    df = frame(spark, rows, "id int, x double, g string, y double", 4)
    result = models.regression_tournament(df, "y", "id", settings=QUICK)
    board = {r["algorithm"]: r for r in result.leaderboard.collect()}
    assert len(board) == 6 and result.failures.count() == 0
    assert board["Linear Regression (OLS)"]["test_r2"] > 0.99 and board["Multilayer Perceptron Regressor"]["test_r2"] > 0.95


def test_ridge_and_lasso_against_closed_forms(spark):
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = x @ np.array([2.0, -1.0]) + rng.normal(0, 0.5, 80)
    df = frame(spark, [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, a double, b double, y double")
    p = models.prepare(df, "y", False, "id")
    train = p.part("train")
    rows = train.select(vector_to_array(models.VEC), models.LABEL).collect()
    z, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    zc, tc = z - z.mean(axis=0), t - t.mean()
    s = models.Settings(ridge_alpha=5.0)
    want = np.linalg.solve(zc.T @ zc + 5.0 * np.eye(2), zc.T @ tc)
    assert models.fit_ridge(train, p, s).importances == pytest.approx(np.abs(want), rel=1e-6)
    w = np.zeros(2)
    for _ in range(500):  # coordinate descent on (1/2n)|t - zw|^2 + 0.1 |w|
        for j in range(2):
            rho = (zc[:, j] @ (tc - zc @ w + zc[:, j] * w[j])) / len(tc)
            w[j] = math.copysign(max(abs(rho) - 0.1, 0), rho) / (zc[:, j] @ zc[:, j] / len(tc))
    assert models.fit_lasso(train, p, s).importances == pytest.approx(np.abs(w), rel=1e-4)
    p.data.unpersist()


def test_rows_without_a_key_get_one(spark):
    df = _classes(spark, 100).drop("id")
    result = models.classification_tournament(df, "y", None, ["Logistic Regression"], QUICK, fit_scope="all")
    assert result.holdout.count() == 16  # 15 percent of each class, rounded up


# ---- wide text ---------------------------------------------------------------------------------


def test_wide_text_goes_through_the_tournament(spark):
    from tablewright.operators import models

    rows = [(i, f"c{i * 7 % 1500}", float(i % 11), float(i * 7 % 1500 % 5) + i % 11) for i in range(3000)]
    df = frame(spark, rows, "id int, c string, x double, y double", 4)
    result = models.regression_tournament(df, "y", "id", ["Ridge Regression (L2)"])
    assert result.failures.count() == 0
    shares = {r["feature"]: r["share"] for r in result.importances.collect()}
    assert set(shares) == {"c", "x"} and sum(shares.values()) == pytest.approx(1, abs=1e-3)


def test_wide_and_narrow_encodings_agree(spark):
    from pyspark.ml.functions import vector_to_array

    from tablewright.operators.features import fit_features

    df = frame(spark, [("b",), ("a",), ("c",), ("b",), (None,), ("d",)] * 3, "c string", 2)
    new = df.union(frame(spark, [("zz",)], "c string"))
    narrow = fit_features(df).transform(new, keep=["c"]).collect()
    model = fit_features(df, max_indicators=2)
    wide = model.transform(new, keep=["c"]).select("c", vector_to_array("c_onehot").alias("v")).collect()
    assert model.slots == [("c", 3)]
    count = lambda rows: sorted((str(r["c"]), sum(r[1:]) if isinstance(r[1], float) else sum(r["v"])) for r in rows)
    assert count(narrow) == count(wide)
    places = {r["c"]: tuple(r["v"]) for r in wide}
    assert len({places[c] for c in "bcd"}) == 3 and set(places["a"]) == set(places[None]) == set(places["zz"]) == {0.0}


# ---- linkage of rows ---------------------------------------------------------------------------


def _same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("name, n", [("ward", 150), ("complete", 150), ("average", 150), ("average", 2_000)])
def test_reciprocal_merges_are_those_of_one_at_a_time(spark, name, n):
    rng = np.random.default_rng(n)
    pts = rng.normal(0, 1, (n, 3)) + rng.choice([0, 2, 5], (n, 1))
    points = frame(spark, [(i, p.tolist()) for i, p in enumerate(pts)], "id long, x array<double>", 4)
    tree = linkage.agglomerate(points, name)
    assert len(tree.merges) == n - 1
    ks = [2, 3, 4, 17, n // 2, n - 5]
    want = cluster.merge_linkage(pts, np.ones(n), name, ks)
    for k in ks:
        got = tree.labels(k)
        assert _same_parts([got[i] for i in range(n)], want[k].tolist())


def test_linkage_of_weighted_points_copies_and_few_rows(spark):
    pts, weights = np.array([[0.0], [1.0], [5.0], [5.5]]), [3.0, 1.0, 2.0, 2.0]
    many = np.repeat(pts, [3, 1, 2, 2], axis=0)
    for name in cluster.LINKAGES:
        heavy = linkage.agglomerate(frame(spark, [(i, p.tolist(), w) for i, (p, w) in enumerate(zip(pts, weights))], "id long, x array<double>, w double"), name)
        copies = linkage.agglomerate(frame(spark, [(i, p.tolist()) for i, p in enumerate(many)], "id long, x array<double>"), name)
        assert [h for *_, h in copies.merges[:4]] == [0.0] * 4
        assert [h for *_, h in copies.merges[4:]] == pytest.approx([h for *_, h in heavy.merges])
    one = linkage.agglomerate(frame(spark, [(7, [1.0])], "id long, x array<double>"), "ward")
    assert one.merges == [] and one.labels(1) == {7: 0}
    assert linkage.agglomerate(frame(spark, [], "id long, x array<double>"), "ward").labels(2) == {}
    with pytest.raises(ValueError):
        linkage.agglomerate(frame(spark, [], "id long, x array<double>"), "single")


def test_tournament_with_linkage_of_rows(spark):
    pts = _blobs()
    df = frame(spark, [(i, float(p[0]), float(p[1])) for i, p in enumerate(pts)], "id int, a double, b double", 4)
    result = cluster.clustering_tournament(df, max_k=3, keep=["id"], restarts=1, linkage_on=cluster.ROWS)
    board = result.leaderboard.collect()
    assert len(board) == 11 and {r["silhouette"] for r in board if r["clusters"] == 3} == {board[0]["silhouette"]}


# ---- boosting ------------------------------------------------------------------------------------


def _plain_boosting(x, y, loss, classes, rounds, depth, rate, ridge):
    """Every cut between different values of every feature tried, row lists per node."""
    k = classes if loss == boosting.SOFTMAX else 1
    start = y.mean() if loss == boosting.SQUARES else 0.0
    raw = np.full((len(y), k), start)

    def grow(rows, g, h, level, out, c):
        best = (0.0, None)
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= 1:
                    gain = 0.5 * (score(left) + score(right) - score(rows))
                    if gain > best[0] * (1 + 1e-9) + 1e-9:
                        best = (gain, (left, right))
        if level == depth or best[1] is None:
            out[rows, c] += -rate * g[rows].sum() / (h[rows].sum() + ridge)
            return
        for part in best[1]:
            grow(part, g, h, level + 1, out, c)

    for _ in range(rounds):
        g, h = boosting.gradients(loss, y, raw)
        step = np.zeros_like(raw)
        for c in range(k):
            grow(np.arange(len(y)), g[:, c], h[:, c], 0, step, c)
        raw += step
    return raw


@pytest.mark.parametrize("loss, classes", [(boosting.SQUARES, 2), (boosting.LOGISTIC, 2), (boosting.SOFTMAX, 3)])
def test_boosting_equals_plain_version(spark, monkeypatch, loss, classes):
    monkeypatch.setattr(boosting, "RENEW_ROUNDS", 2)  # the raw scores are renewed on the way
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (240, 3)).astype(float)  # few frequent values, so that every cut is a candidate
    noise = rng.normal(0, 0.3, 240)
    y = x[:, 0] * 2 + x[:, 1] ** 2 + noise if loss == boosting.SQUARES else np.clip(np.round(x[:, 0] + (x[:, 1] > 0) + noise), 0, classes - 1)
    rows = frame(spark, [(p.tolist(), float(v)) for p, v in zip(x, y)], "x array<double>, y double", 5)
    model = boosting.fit(rows, 3, loss, classes, rounds=5, depth=3, rate=0.3, ridge=1.0)
    got = model.start + model.raw(model.binned(x))
    assert got == pytest.approx(_plain_boosting(x, y, loss, classes, 5, 3, 0.3, 1.0), abs=1e-9)
    p = model.predicted(x)
    assert loss == boosting.SQUARES or p.sum(axis=1) == pytest.approx(1)
    assert np.argmax(model.importances()) in (0, 1) and model.importances()[2] < model.importances()[:2].max()


def test_boosting_of_constant_and_empty_tables(spark):
    rows = frame(spark, [([1.0, 2.0], 3.0)] * 9, "x array<double>, y double")
    model = boosting.fit(rows, 2, boosting.SQUARES, rounds=2, depth=2)
    assert model.predicted(np.array([[1.0, 2.0], [9.0, 9.0]])).ravel().tolist() == [3.0, 3.0] and model.importances().sum() == 0
    none = boosting.fit(rows.limit(0), 2, boosting.SOFTMAX, 3, rounds=1, depth=2)
    assert none.predicted(np.zeros((1, 2))) == pytest.approx(np.full((1, 3), 1 / 3))


def test_boosted_candidates_rank_three_classes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 2))
    c = np.where(x[:, 0] ** 2 + x[:, 1] ** 2 < 0.6, "in", np.where(x[:, 0] > 0, "right", "left"))
    df = frame(spark, [(i, float(a), float(b), str(k)) for i, ((a, b), k) in enumerate(zip(x, c))], "id int, a double, b double, c string", 4)
    result = models.classification_tournament(
        df, "c", "id", ["Gradient-Boosted Trees", "Logistic Regression"], models.Settings(boost_rounds=12, logistic_iterations=30))
    board = result.leaderboard.orderBy("rank").collect()
    assert board[0]["algorithm"] == "Gradient-Boosted Trees" and board[0]["test_f1"] > 0.8 > board[1]["test_f1"]
    assert result.importances.count() == 2


# ---- networks and kernels --------------------------------------------------------------------------


@pytest.mark.parametrize("loss", [network.SOFTMAX, network.SQUARES])
def test_gradient_equals_finite_differences(spark, loss):
    """Of the sums over all rows, as Spark adds them up; rows held out take no part."""
    rng = np.random.default_rng(1)
    x, held = rng.normal(0, 1, (60, 3)), rng.random(60) < 0.3
    y = rng.integers(0, 3, 60).astype(float) if loss == network.SOFTMAX else rng.normal(0, 1, 60)
    sizes = (3, 5, 4, 3 if loss == network.SOFTMAX else 1)
    at = network.start(sizes, 2) + rng.normal(0, 0.1, len(network.start(sizes, 2)))
    rows = frame(spark, [(p.tolist(), float(v), bool(h)) for p, v, h in zip(x, y, held)], "x array<double>, y double, held boolean", 4)
    value, gradient, apart = network._evaluate(rows, at, sizes, loss)

    def plain(parameters, part):
        return network.loss_and_gradient(parameters, sizes, loss, x[part], y[part])[0].sum()

    n = (~held).sum()
    penalised = lambda p: (plain(p, ~held) + 0.5 * network.PENALTY * p @ p) / n
    assert value == pytest.approx(penalised(at)) and apart == pytest.approx(plain(at, held) / held.sum())
    for k in range(0, len(at), 3):
        step = np.zeros(len(at))
        step[k] = 1e-6
        assert gradient[k] == pytest.approx((penalised(at + step) - penalised(at - step)) / 2e-6, abs=1e-6)


def test_network_learns_and_stops_early(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, (600, 2))
    y = np.sin(2 * x[:, 0]) * 40 + 100 + rng.normal(0, 2, 600)
    rows = frame(spark, [(i, p.tolist(), float(v)) for i, (p, v) in enumerate(zip(x, y))], "id long, x array<double>, y double", 4)
    model = network.fit(rows, 2, network.SQUARES, 1, F.col("id"), (16, 8), 120)
    assert 1 - ((model.outputs(x)[:, 0] - y) ** 2).mean() / y.var() > 0.9
    noise = frame(spark, [(i, p.tolist(), float(v)) for i, (p, v) in enumerate(zip(x, rng.normal(0, 1, 600)))], "id long, x array<double>, y double", 4)
    lost = network.fit(noise, 2, network.SQUARES, 1, F.col("id"), (16, 8), 120)
    assert len(lost.losses) < 60  # there is nothing to learn, so the held-out rows stop it


def test_kernel_of_landmarks(spark):
    """Exact with all rows as landmarks, close with some of them, and the tournament's machine beats a line on a circle."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 3))
    rows = frame(spark, [(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>", 4)
    errors = [kernel.fit(rows, F.col("id"), 1 / 3, m, 1).error(x) for m in (20, 80, 300)]
    assert errors[0] > errors[1] > errors[2] and errors[1] < 0.05 and errors[2] < 1e-6
    k = kernel.kernel(x[:5], x[:7], 0.4)
    assert k[2, 6] == pytest.approx(math.exp(-0.4 * ((x[2] - x[6]) ** 2).sum()))
    points = rng.normal(0, 1, (400, 2))
    c = ["in" if p @ p < 1.2 else "out" for p in points]
    df = frame(spark, [(i, float(a), float(b), k) for i, ((a, b), k) in enumerate(zip(points, c))], "id int, a double, b double, c string", 4)
    name = "Support Vector Machine (RBF, landmarks)"
    board = {r["algorithm"]: r for r in models.classification_tournament(df, "c", "id", [name, "Logistic Regression"]).leaderboard.collect()}
    assert board[name]["test_f1"] > 0.9 > board["Logistic Regression"]["test_f1"] + 0.1


def test_segment_sample_is_the_same_for_any_partitioning(spark):
    rows = [(i, None if i % 5 == 0 else f"s{i % 3 if i > 90 else 0}", i % 7) for i in range(400)] + [(7, "s0", 1)] * 3
    df = frame(spark, rows, "id int, segment string, x int")
    got = [sorted(map(tuple, cluster.segment_sample(df.repartition(n), "segment", "id", rows=20).collect()), key=str) for n in (1, 3, 9)]
    assert got[0] == got[1] == got[2]
    sizes = {s: sum(r[1] == s for r in rows) for s in (None, "s0", "s1", "s2")}
    for s, n in sizes.items():
        assert sum(r[1] == s for r in got[0]) == min(n, 20)
    plan = cluster.segment_sample(df, "segment", "id", rows=20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
