"""Steps whose cost per task or scan must not grow faster than the table."""

import random
import re
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright import session
from tablewright.catalog import tournament_queries
from tablewright.operators import boosting, cluster, features, kernel, linkage, lloyd, models, network, text
from tablewright.plans import unstructured


def test_large_tables_get_partitions_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", (10, 100))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20, raising=False)
    rows = session.persisted(spark.range(0, 1000, 1, 1))  # one partition, as a small compressed file gives
    assert rows.rdd.getNumPartitions() == 50
    assert rows.agg(F.sum("id"), F.count("id")).first() == (499500, 1000)
    assert session.spread(spark.range(0, 50, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(0, 5, 1, 1)).rdd.getNumPartitions() == 1


def test_boosting_moves_blocks_and_renews_scores_every_round(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 2)), rng.integers(0, 3, 300).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)
    model = boosting.fit(rows, 2, boosting.SOFTMAX, 3, rounds=3, depth=2)
    table = boosting._prepared(rows, model)
    assert table.count() <= 3  # a row per Arrow batch, not per row
    for first in range(3):  # the trees of one round at a time
        table = boosting._renewed(table, boosting.Model(model.loss, 3, model.start, model.cuts, model.rounds[: first + 1]), first)
    found = np.concatenate([raw for batch in [table.toArrow().combine_chunks().to_batches()] for b in batch for _, _, raw in boosting._blocks(b, 2, 3)])
    assert np.sort(found, axis=0) == pytest.approx(np.sort(model.raw(model.binned(x)), axis=0))


@pytest.mark.parametrize("loss", [boosting.SQUARES, boosting.SOFTMAX])
def test_small_tables_are_fitted_by_one_task_to_the_same_model(spark, monkeypatch, loss):
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 3, 400).astype(float)
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y double").repartition(3)
    jobs, scan, evaluate = [], boosting._histogram, network._evaluate_blocks
    monkeypatch.setattr(boosting, "_histogram", lambda *a: jobs.append("level") or scan(*a))
    monkeypatch.setattr(network, "_evaluate_blocks", lambda *a: jobs.append("step") or evaluate(*a))
    fits = []
    for values in (10_000, 0):
        monkeypatch.setattr(boosting, "TASK_VALUES", values, raising=False)
        monkeypatch.setattr(network, "TASK_VALUES", values, raising=False)
        jobs.clear()
        fits.append((boosting.fit(rows, 3, loss, 3, rounds=3, depth=2), network.fit(rows, 3, loss, 3, F.col("id"), (4,), 5)))
        assert bool(jobs) == (values == 0)
    (trees, net), (trees2, net2) = fits
    assert trees.predicted(x) == pytest.approx(trees2.predicted(x), abs=1e-9) and len(trees.rounds) == 3
    assert all((a.feature == b.feature).all() for p, q in zip(trees.rounds, trees2.rounds) for a, b in zip(p, q, strict=True))
    assert net.losses == pytest.approx(net2.losses, abs=1e-6)


def test_kernel_machine_keeps_rows_not_features(spark, monkeypatch):
    """Hinge loss and penalty are at most those of Spark's machine on the stored features, and what is kept is the rows' own columns."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, 2))
    y = ((x**2).sum(axis=1) + rng.normal(0, 0.3, 500) < 1.2).astype(float)
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y double").repartition(3)
    near = kernel.fit(rows, F.col("id"), 0.5, 40, 1)
    kept, persist = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda self, *a: kept.append(self.columns) or persist(self, *a))
    weights, shift = kernel.machines(rows, near, [1], 50, 1 / 500)[0]
    assert kept == [["x", "y"]]
    z, side = near.features(x), 2 * y - 1
    loss = lambda w, b: np.maximum(1 - side * (z @ w + b), 0).mean() + 0.5 / 500 * ((w * z.std(axis=0, ddof=1)) ** 2).sum()
    stored = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(z, y)], "z array<double>, y double").select(array_to_vector("z").alias("v"), "y")
    plain = LinearSVC(featuresCol="v", labelCol="y", maxIter=50, regParam=1 / 500).fit(stored)
    assert loss(weights, shift) <= 1.02 * loss(plain.coefficients.toArray(), plain.intercept)
    margins = [r[0] for r in rows.orderBy("id").select(near.margins(F.col("x"), [(weights, shift)])).collect()]
    assert np.array(margins)[:, 0] == pytest.approx(z @ weights + shift, abs=1e-8)


def test_tournament_with_features_that_are_not_stored(spark, monkeypatch):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i, float(a), float(b), "in" if a * a + b * b < 1.2 else "out") for i, (a, b) in enumerate(x)], "id long, a double, b double, y string")
    name, scores = "Support Vector Machine (RBF, landmarks)", []
    for stored in (models.STORED_FEATURES, 0):
        monkeypatch.setattr(models, "STORED_FEATURES", stored)
        board = models.classification_tournament(df, "y", "id", [name]).leaderboard.first()
        scores.append((board["val_f1"], board["test_f1"]))
    assert scores[0] == pytest.approx(scores[1], abs=0.05) and min(scores[1]) > 0.85


def test_network_scans_blocks(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame(
        [(r.tolist(), float(r.sum()), bool(i % 4 == 0)) for i, r in enumerate(rng.normal(size=(200, 3)))], "x array<double>, y double, held boolean"
    )
    table = network._blocks(rows, 3)
    assert table.count() <= rows.rdd.getNumPartitions()
    assert table.agg(F.sum("m"), F.sum(F.length("y")), F.sum(F.length("x"))).first() == (150, 200 * 8, 200 * 24)
    assert network._evaluate_blocks(network._blocks(rows.where("not held"), 3), network.start((3, 4, 1), 1), (3, 4, 1), network.SQUARES)[2] > 0


@pytest.mark.parametrize("name", ["ward", "complete", "average"])
def test_merges_without_a_table_of_pairs(spark, monkeypatch, name):
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal(0, 1, (90, 3)) + rng.choice([0, 4], (90, 1)), np.repeat([[9.0, 9.0, 9.0]], 10, axis=0)])
    points = spark.createDataFrame([(i * 3, p.tolist(), 1.0 + i % 2) for i, p in enumerate(pts)], "id long, x array<double>, w double")
    want = linkage.agglomerate(points, name)
    for size, value in (("MAX_ROWS", 50), ("TABLE_CLUSTERS", 12), ("TILE_ROWS", 30), ("CHUNK_ROWS", 8)):
        monkeypatch.setattr(linkage, size, value, raising=False)
    got = linkage.agglomerate(points, name)
    assert [h for *_, h in got.merges] == pytest.approx([h for *_, h in want.merges], abs=1e-9)
    assert [m[:2] for m in got.merges[9:]] == [m[:2] for m in want.merges[9:]]  # the first nine are of equal points
    assert got.labels(4) == want.labels(4)


def test_only_changed_clusters_look_for_their_nearest(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.normal(0, 1, (120, 8)))], "id long, x array<double>")
    searched, search = [], linkage._nearest
    monkeypatch.setattr(linkage, "TABLE_CLUSTERS", 20)
    monkeypatch.setattr(linkage, "_nearest", lambda rows, n, changed, name: searched.append(changed) or search(rows, n, changed, name))
    tree = linkage.agglomerate(points, "average")
    assert len(tree.merges) == 119 and searched[0] == 120
    assert max(searched[1:]) < 120


def test_copies_under_one_id_are_one_cluster(spark):
    rows = [(i, [float(x)]) for i, x in ((1, 0.0), (1, 0.0), (2, 1.0), (3, 5.0), (3, 5.0))]
    tree = linkage.agglomerate(spark.createDataFrame(rows, "id long, x array<double>"), "average")
    assert tree.merges == [(1, 2, 1.0), (1, 3, 4.5)]


def test_board_on_true_distances_merges_the_rows(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(tournament_queries.cluster, "clustering_tournament", lambda df, **how: asked.update(how) or cluster.ClusterResult(df, "", 2, 0, 0, 0, df, ()))
    monkeypatch.setattr(tournament_queries, "_points", lambda spark, d: spark.range(3))
    tournament_queries.leaderboard_clusters(spark, "")
    assert asked["linkage_on"] == cluster.ROWS


def test_euclidean_silhouette_moves_each_pair_of_blocks_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pts = np.concatenate([rng.normal(1000, 1, (97, 3)), np.full((20, 3), 1001.0)])
    own = np.arange(len(pts)) % 3
    df = spark.createDataFrame([(*map(float, p), int(k)) for p, k in zip(pts, own)], "a double, b double, c double, k int")
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    sizes = np.bincount(own)
    a = np.array([d[i, own == own[i]].sum() / (sizes[own[i]] - 1) for i in range(len(pts))])
    b = np.array([min(d[i, own == c].mean() for c in range(3) if c != own[i]) for i in range(len(pts))])
    for name, value in (("LEAST_POINTS", 20), ("TILE", (16, 24))):
        monkeypatch.setattr(cluster, name, value, raising=False)
    sent = []
    join = type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, on=None, how=None: sent.append(on) or join(self, other, on, how))
    found = cluster.score_clusters(df, ["a", "b", "c"], "k", cluster.EUCLIDEAN)["silhouette"]
    assert found == pytest.approx(np.mean((b - a) / np.maximum(a, b)), abs=1e-9)
    assert [on for on in sent if isinstance(on, list)] == [["b", "with"]]  # blocks a and b meet in one task, not in two


def test_large_vectors_have_no_names_in_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, f"c{i % 1500}", float(a) if i % 3 else 0.0, float(i % 7)) for i, a in enumerate(rng.normal(size=4_500))]
    df = spark.createDataFrame(rows, "id long, c string, z double, y double")
    boards, vectors = [], []
    for limit in (features.NAMED_PLACES, 100):
        monkeypatch.setattr(features, "NAMED_PLACES", limit)
        p = models.prepare(df, "y", False, "id")
        found = {r["__key"]: r["__features"] for r in p.data.collect()}
        vectors.append({k: (v.size, v.numNonzeros(), float(v.values.sum())) for k, v in found.items()})
        attributes = p.data.schema["__features"].metadata["ml_attr"]
        assert attributes["num_attrs"] == p.width and ("attrs" in attributes) == (limit > 100)
        boards.append(models.regression_tournament(df, "y", "id", ["Ridge Regression (L2)", "Linear Regression (OLS)"]).leaderboard.drop("rank").collect())
    assert vectors[0].keys() == vectors[1].keys()
    assert all(vectors[0][k] == pytest.approx(vectors[1][k], abs=1e-12) for k in vectors[0])
    assert boards[0] == boards[1]


def test_ridge_on_a_wide_column_is_exact(spark):
    rng = np.random.default_rng(10)
    code = np.concatenate([np.arange(5_500), rng.integers(0, 5_500, 4_000)])
    z = rng.normal(size=len(code))
    y = 100 + 2 * z + code % 7 + rng.normal(size=len(code))
    rows = [(i, f"c{int(c):05d}", float(a), float(b)) for i, (c, a, b) in enumerate(zip(code, z, y))]
    p = models.prepare(spark.createDataFrame(rows, "id long, c string, z double, y double"), "y", False, "id")
    train, fitted = p.part("train"), models.fit_ridge(p.part("train"), p, models.Settings())
    assert len(fitted.importances) == 2 < p.width
    got = {r[models.KEY]: (r["prediction"], r[models.LABEL], r[models.VEC]) for r in fitted.score(train).collect()}
    x = np.zeros((len(got), p.width + 1))
    for line, (_, _, vec) in enumerate(got.values()):
        x[line, 0] = 1
        x[line, 1 + vec.indices] = vec.values
    label = np.array([v[1] for v in got.values()])
    xs, ys = x[:, 1:] - x[:, 1:].mean(axis=0), label - label.mean()
    left = ys - xs @ (xs.T @ np.linalg.solve(xs @ xs.T + np.eye(len(xs)), ys))
    assert label - np.array([v[0] for v in got.values()]) == pytest.approx(left, abs=1e-6)


def test_stacking_fits_folds_side_by_side_and_writes_their_probabilities(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 2), i / 10) for i in range(60)], f"{models.KEY} long, {models.LABEL} double, x double")
    p = models.Prepared(rows, (), ("a", "b"), 60, 0.0, 1)
    met, seen, sizes = threading.Barrier(2), [], []

    def member(train, p, s):
        sizes.append(train.count())
        if len(sizes) <= 2:
            met.wait(60)  # the first two folds wait for each other
        share = F.lit(sizes[-1] / 100.0)
        return models.Fitted(lambda df: df.withColumn("prob", F.array(1 - share, share)).withColumn("prediction", F.lit(0.0)))

    logistic = models.fit_logistic

    def fit_logistic(train, p, s, vec=models.VEC):
        seen.append((train.count(), train._jdf.queryExecution().analyzed().toString()))
        return logistic(train, p, s, vec)

    monkeypatch.setattr(models, "fit_logistic", fit_logistic)
    s = models.Settings(folds=4, parallelism=2)
    whole = models.Fitted(lambda df: df.withColumns({"prob": F.array(F.lit(0.5), F.lit(0.5)), "prediction": F.lit(0.0)}))
    fitted = models.fit_stacking(rows, p, s, [member], [whole])
    assert sum(60 - n for n in sizes) == 60 and len(sizes) == 4
    assert seen[0][0] == 60 and "Union" not in seen[0][1] and "parquet" in seen[0][1]  # a written table, no folds' plans
    assert fitted.score(rows).where("size(prob) = 2").count() == 60


def _topics(records):
    """Plain version: per record (key, texts) the most frequent usable word, the smallest on ties."""
    out = {}
    for key, texts in records.items():
        n = Counter(w for t in texts if t is not None for w in re.split(r"[\W_]+", t.lower()) if len(w) >= 3 and w not in text.STOP_WORDS)
        out[key] = min(n, key=lambda w: (-n[w], w)) if n else None
    return out


def test_topics_of_single_rows_move_no_words(spark, monkeypatch):
    rng = random.Random(11)
    words = ["the", "ab", "Straße", "straße", "zoo", "zoo9", "Über", "dog", "dogs", "cat"]
    rows = [(rng.choice([None, 1, 2, *range(10, 60)]), rng.choice([0, 0, 1]), None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, p int, t string")
    records = defaultdict(list)
    for k, p, t in rows:
        records[k, p].append(t)
    assert 1 < max(map(len, records.values())) and 1 in map(len, records.values())
    got = text.main_topic(df, ["k", "p"], "t").collect()
    assert {(r["k"], r["p"]): r["main_topic"] for r in got} == _topics(records) and len(got) == len(records)
    monkeypatch.setattr(text, "LOCAL_ROWS", 1, raising=False)  # repeated keys as a written table
    assert sorted(map(str, text.main_topic(df, ["k", "p"], "t").collect())) == sorted(map(str, got))
    single = df.dropDuplicates(["k", "p"]).localCheckpoint()
    plan = text.main_topic(single, ["k", "p"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_text_table_joins_topics_for_repeated_keys_alone(spark):
    lines = ["one dog and one dog more than the other dog", "a cat sat on the mat with a cat, said the cat", "short", "nothing here but zebras and zebras again"]
    rows = [(1, "\n".join(lines)), (2, lines[1]), (None, lines[0]), (None, "\n".join([lines[3], lines[1]])), (3, None), (4, lines[0] + "\n" + lines[3])]
    df = spark.createDataFrame(rows, "id long, body string")
    got = Counter((r["key"], r["pos"], r["main_topic"]) for r in unstructured.text_table(df, "id", "body", separator="\n")[0].collect())
    chunks = [(k, p, c) for k, t in rows if t for p, c in enumerate(c for c in t.split("\n") if len(c) > 20)]
    records = defaultdict(list)
    for k, p, c in chunks:
        records[k, p].append(c)
    topics = _topics(records)
    assert got == Counter((k, p, topics[k, p]) for k, p, _ in chunks)
    single = unstructured.text_table(df.where("id is not null"), "id", "body", separator="\n")[0]
    assert "Join" not in single._jdf.queryExecution().executedPlan().toString()


def test_kmeans_scans_blocks_and_adds_up_by_nearest_centre(spark, monkeypatch):
    rng = np.random.default_rng(12)
    pts = np.concatenate([rng.normal(size=(300, 3)), rng.integers(-2, 3, (200, 3)).astype(float)])  # the whole numbers give ties
    points = spark.createDataFrame([(p.tolist(),) for p in pts], "x array<double>").repartition(4)
    blocks = lloyd.packed(points)
    assert blocks.count() <= 4 and blocks.agg(F.sum(F.length("x"))).first()[0] == pts.size * 8
    starts = [pts[:2], pts[300:302], np.array([[0.5, 0, 0], [-0.5, 0, 0], [0.5, 0, 0]]), pts[10:15], pts[310:350]]
    monkeypatch.setattr(lloyd, "DISTANCES_AT_ONCE", 5_000)
    for table in (points, blocks):
        for centres, (sums, sizes, cost) in zip(starts, lloyd._step(table, starts), strict=True):
            far = ((pts[:, None] - centres[None]) ** 2).sum(axis=2)
            assert cost == pytest.approx(far.min(axis=1).sum())
            if not np.isclose(np.sort(far, axis=1)[:, 0], np.sort(far, axis=1)[:, 1], atol=1e-9).any() or len(centres) == 3:
                own = np.round(far, 9).argmin(axis=1)  # the first on ties
                assert sizes.tolist() == np.bincount(own, minlength=len(centres)).tolist()
                assert sums == pytest.approx(np.stack([pts[own == k].sum(axis=0) for k in range(len(centres))]), abs=1e-9)
            assert sizes.sum() == len(pts) and sums.sum(axis=0) == pytest.approx(pts.sum(axis=0))
    odd = spark.createDataFrame([(p.tolist(),) for p in [*pts[:9], np.array([np.nan, 0, 0])]], "x array<double>").coalesce(1)
    sums, sizes, _ = lloyd._step(odd, [pts[:3]])[0]
    far = ((pts[:9, None] - pts[None, :3]) ** 2).sum(axis=2).argmin(axis=1)
    assert sizes.tolist() == (np.bincount(far, minlength=3) + [1, 0, 0]).tolist()  # the first centre has it, the others stay clean
    assert sums[1:] == pytest.approx(np.stack([pts[:9][far == k].sum(axis=0) for k in (1, 2)])) and np.isnan(sums[0, 0])
