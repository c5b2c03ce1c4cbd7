"""The operators against plain versions on the smallest tables, and the pipeline stage by stage."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.catalog.tables import table
from tablewright.llm import langid, mixing, minhash, pii, quality, queries, templates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def variants():
    """Chains and groups of similar texts, with links that a single centre would not find."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out, n = [], 0
    for size in (40, 25, 12, 60):
        base = [word() for _ in range(size * 3)]
        text = list(base)
        for step in range(size):
            if step % 5 == 0:
                text = list(base)
            for _ in range(rng.randrange(1, 9)):
                text[rng.randrange(len(text))] = word()
            out.append((n, " ".join(text)))
            n += 1
            if step % 7 == 0:
                out.append((n, " ".join(text).upper()))
                n += 1
    return out


@pytest.mark.parametrize("width", [1, 2, 5])
def test_minhash_finds_every_link(spark, width):
    rows = variants()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=width)
    want = plain.near_duplicates(rows, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert len(set(c for _, c in want.values())) < len(rows)


def test_estimate_is_near_the_truth(spark):
    rows = variants()
    sig = minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2)
    a, b = sig.filter("doc_id = 0").select("planes"), sig.filter("doc_id > 0 AND doc_id < 10").select("doc_id", F.col("planes").alias("other"))
    first = a.first()["planes"]
    out = b.withColumn("planes", F.array(*[F.lit(x) for x in first])).select("doc_id", minhash.estimate("planes", "other").alias("e"))
    sets = {i: plain.shingles(t, 2) for i, t in rows}
    for r in out.collect():
        truth = len(sets[0] & sets[r["doc_id"]]) / len(sets[0] | sets[r["doc_id"]])
        assert abs(r["e"] - truth) < 0.1


def test_templates_equal_plain_version(documents, texts):
    got = {(r["doc_id"], n) for r in templates.drop_recurring_lines(documents).collect() for n in r["dropped"]}
    want = plain.recurring(texts, long_docs=templates.LONG_DOCS)
    assert got == want and want


def test_pii_base_spans(spark, documents, texts):
    model = pii.train(pii.labelled_table(spark))
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in pii.find(documents, model).collect()}

    def holds(kind, text):
        digits = re.sub("[^0-9]", "", text)
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        if kind == "phone":
            return 8 <= len(digits) <= 15
        doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
        return kind == "email" or 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    for doc, text in texts:
        want = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(pii.PATTERNS[k].pattern, text) if holds(k, m[0])]
        assert found[doc] == want or [s for s in found[doc] if s in want] == want
    assert sum(map(len, found.values())) > 0


def test_field_learns_its_labels(spark):
    table_ = pii.labelled_table(spark)
    model = pii.train(table_)
    right = [[pii.TAGS[t] for t in model.decode([pii.features(r["words"])])[0]] == r["tags"] for r in table_.collect()]
    assert np.mean(right) > 0.95
    # Viterbi against all paths of a short segment
    words = "+1 (212) 555-0147".split()
    scores, _ = model.scores([pii.features(words)])
    best = max(
        ((sum(scores[0, t, y[t]] for t in range(3)) + sum(model.transition[p, q] for p, q in zip((0, *y), (*y, 0))), y)
         for y in np.ndindex(9, 9, 9)), key=lambda x: x[0])[1]
    assert tuple(model.decode([pii.features(words)])[0]) == best


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.held_out_predictions(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.93


def test_language_is_not_learned_from_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    wrong = docs.withColumn("lang", F.when(langid.fold_of() == 2, F.lit("xx")).otherwise(F.col("lang")))
    keys = ["doc_id", "held_out", "lang_pred", "score"]
    assert sorted(map(tuple, langid.held_out_predictions(wrong).select(*keys).collect())) == sorted(
        map(tuple, langid.held_out_predictions(docs).select(*keys).collect())
    )


def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = labels.filter("doc_id % 2 = 0")
    found = quality.classify(docs, half, F.col("source"), F.col("lang")).join(labels, "doc_id").filter("doc_id % 2 = 1").collect()
    good = [r["kept"] for r in found if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.35  # about 30 bad documents to learn from


def test_shares_shrink_sparse_sites(spark):
    from tablewright.llm.store import Scratch

    rows = [("big", "p", 3.0)] * 200 + [("big", "q", -3.0)] * 200 + [("small", "p", 3.0)] + [("clean", "p", -3.0)] * 300
    scored = spark.createDataFrame(rows, "__host string, __path string, __evidence double")
    share = {(r["__host"], r["__path"]): r["share"] for r in quality.site_shares(scored, 0.0, Scratch(spark, "t")).collect()}
    assert share["big", "p"] > 0.85 and share["big", "q"] < 0.1 and share["clean", "p"] < 0.1
    assert share["clean", "p"] < share["small", "p"] < share["big", "p"]  # one document says less than 200


def test_pipeline(spark, documents):
    """Each stage on what the one before kept, against plain versions; then the whole run."""
    steps = dict(corpus_pipeline.STAGES)
    docs = documents
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "source", "text").collect()]
    good = steps["quality classifier"](spark, docs, SF)
    judged = quality.classify(docs, table(spark, SF, "labels"), F.col("source"), F.col("lang"))
    assert sorted(r[0] for r in rows(good)) == sorted(r["doc_id"] for r in judged.filter("kept").collect())
    single = steps["near-duplicates"](spark, good, SF)
    want = plain.near_duplicates([(i, t) for i, _, t in rows(good)], 5)
    assert sorted(r[0] for r in rows(single)) == sorted(i for i, (_, c) in want.items() if i == c)
    clean = steps["decontamination"](spark, single, SF)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = plain.contamination([(i, t) for i, _, t in rows(single)], items)
    assert sorted(r[0] for r in rows(clean)) == sorted(i for i, x in bad.items() if not x[3])
    mixed = steps["mixing"](spark, clean, SF)
    assert mixed.columns == documents.columns
    taken, target, of, size = plain.mix(rows(clean))
    assert Counter(r[0] for r in rows(mixed)) == Counter(taken)
    spent = Counter()
    for i, s, _ in rows(mixed):
        spent[s] += size[i]
    assert all(abs(spent[s] - target[s]) <= 2 * max(size.values()) for s in of)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, _, text in rows(mixed):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_mix_is_the_plain_mix(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "source", "text").collect()]
    taken, target, of, size = plain.mix(rows)
    got = {r["doc_id"]: r for r in mixing.Mix(documents).allotments().collect()}
    source = {i: s for i, s, _ in rows}
    for i, r in got.items():
        assert r["taken"] == size[i] * taken[i] and r["source_size"] == of[source[i]]
        assert abs(r["target"] - target[source[i]]) < 1e-6 * max(1.0, target[source[i]])
