"""The quality classifier against a plain version of its shares, strengths, decision and training."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.catalog.tables import table
from tablewright.llm import quality, queries


def plain_decisions(rows, prior):
    """{doc_id: (share, p_bad)} from (doc_id, host, path, evidence), by loops over sites."""
    bad = {i: 1 / (1 + math.exp(-(e + prior))) for i, _, _, e in rows}
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for i, host, path, _ in rows:
        for site in (paths[host, path], hosts[host]):
            site[0] += 1
            site[1] += bad[i]
    mean = sum(bad.values()) / len(bad)

    def strength(sites):
        spread = sum(n * (b / n - m) ** 2 for n, b, m in sites) - sum(m * (1 - m) for _, _, m in sites)
        share = min(max(spread / max(sum(n * m * (1 - m) for n, _, m in sites), 1e-9), 1e-4), 0.5)
        return 1 / share - 1

    k = strength([(n, b, mean) for n, b in hosts.values()])
    above = {h: (b + k * mean) / (n + k) for h, (n, b) in hosts.items()}
    k = strength([(n, b, above[h]) for (h, _), (n, b) in paths.items()])
    share = {s: (b + k * above[s[0]]) / (n + k) for s, (n, b) in paths.items()}
    out = {}
    for i, host, path, e in rows:
        p = min(max(share[host, path], 1e-6), 1 - 1e-6)
        out[i] = (p, 1 / (1 + math.exp(-(e + math.log(p / (1 - p))))))
    return out


def test_query_equals_plain_decisions(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, d).collect()}
    sites = docs.select("doc_id", "source", "lang").collect()
    prior = quality.train(docs, labels, "doc_id", "text", quality.SAMPLE_DOCS).prior
    want = plain_decisions([(r["doc_id"], r["source"], r["lang"], got[r["doc_id"]]["evidence"]) for r in sites], prior)
    assert len(got) == len(want)
    for i, (share, p) in want.items():
        assert got[i]["site_share"] == pytest.approx(share, rel=1e-9) and got[i]["p_bad"] == pytest.approx(p, rel=1e-9)
        assert got[i]["kept"] == (p < quality.REJECT)
    assert {x["kept"] for x in got.values()} == {True, False}


def test_kept_documents_are_those_of_the_query(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels, F.col("source"), F.col("lang")).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in queries.op1_quality(spark, d).filter("kept").collect()}


def test_training_equals_dense_steps():
    """The sparse training against the same steps on a dense matrix of features."""
    rng = np.random.default_rng(7)
    n, names = 400, rng.choice(quality.STYLE_AT, 30, replace=False)
    bad = (rng.random(n) < 0.3).astype(float)
    x = (rng.random((n, 30)) < np.where(bad[:, None] > 0, np.linspace(0.05, 0.6, 30), 0.2)).astype(float)
    flat = np.concatenate([names[x[i] > 0] for i in range(n)])
    model = quality._fit(flat, x.sum(axis=1).astype(int), bad, 60)
    rate, count = bad.mean(), x.sum(axis=0)
    z = (x.T @ bad - count * rate) / np.sqrt(np.maximum(count * rate * (1 - rate), 1e-9))
    used = (count >= quality.LEAST_DOCS) & (np.abs(z) >= quality.LEAST_Z)
    assert 0 < used.sum() < 30
    x = x[:, used]
    w, bias = np.zeros(x.shape[1]), math.log(rate / (1 - rate))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, 61):
        error = bad - 1 / (1 + np.exp(-(x @ w + bias)))
        g, s = x.T @ error - 0.5 * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * s, 0.99 * vb + 0.01 * s * s
        w += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        bias += 0.1 * (mb / (1 - 0.9**k)) / math.sqrt(vb / (1 - 0.99**k) + 1e-12)
    assert model.weights[names[used]] == pytest.approx(w) and model.bias == pytest.approx(bias)
    assert np.count_nonzero(model.weights) == used.sum() and model.prior == pytest.approx(math.log(rate / (1 - rate)))
