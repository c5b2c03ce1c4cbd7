"""Personal data in texts made to be slow, and the linear searches against the plain patterns."""

import random
import re
import time

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import minhash, pii, wordspans

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SIZE = 2_000_000
PARTS = ["1", "22", "333", ".", "@", "+", "-", " ", "a", "b.c", "%", "(", ")", "x@y.z", "é", "10.0.0.1", "+49 30 901820", "\n", "4111 1111 1111 1111", "_"]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(pii.labelled_table(spark))


def drawn(n):
    rng = random.Random(6)
    return ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(n)]


def test_base_spans_equal_plain_patterns():
    for text in drawn(20_000):
        want = [(k, m.start(), m.end()) for k, kind in enumerate(pii.KINDS) for m in PLAIN[kind].finditer(text) if pii._holds(kind, m[0])]
        assert pii.base_spans(text, 10**9) == want, text


@pytest.mark.parametrize("text", [
    "1" * SIZE, "a" * SIZE + "@", "1." * (SIZE // 2), "3." + "1" * SIZE, "1" + ")" * SIZE, "+1" * (SIZE // 2), "+1" + " " * SIZE,
    "a@" * (SIZE // 2), "a." * (SIZE // 2) + "@b", "(" * SIZE + "1",
], ids=["digits", "letters", "dots", "dot and digits", "brackets", "plus", "blanks", "signs", "local part", "opened"])
def test_two_megabytes_in_seconds(model, text):
    start = time.process_time()
    pii.spans_of(pa.array([text]), model)
    assert time.process_time() - start < 5


def test_long_segments_are_decoded_exactly(model, monkeypatch):
    """The streamed pass over blocks gives the tags of the pass over whole segments."""
    texts = pa.array([t.replace("a", "1") for t in drawn(1_500)])
    want = pii.spans_of(texts, model)
    words = "10.0.0.1 7 +49 30 901820 x@y 4111 1111 1111 1111 5".split() * 9
    whole = model.decode([pii.features(words)])[0]
    monkeypatch.setattr(pii, "LONG_SEGMENT", 4)
    assert pii.spans_of(texts, model) == want
    assert np.array_equal(model.decode_long(words), whole)


def test_long_text_in_segments(monkeypatch):
    """Shingles across segments; the set of a long text doesn't depend on where it is cut."""
    texts = pa.array([None, "", "a", "a b c", "x y z " * 400 + "end", "w" * 900 + " v", " ".join(map(str, range(3_000)))])
    for width in (2, 5):
        want = [s.tolist() for s in minhash.Shingler(width).sets(texts)]
        with monkeypatch.context() as m:
            m.setattr(wordspans.segments, "__defaults__", (100, None))
            assert [s.tolist() for s in minhash.Shingler(width).sets(texts)] == want
        assert list(map(len, want)) == [len(plain.shingles(t.as_py(), width)) for t in texts]


def test_keep_one_by_id_and_text(spark):
    """A row goes only if its own text is represented; other columns may have any name."""
    a, b = " ".join(map(str, range(40))), " ".join(map(str, range(100, 140)))
    rows = [(3, b, "x"), (5, a, "x"), (5, b, "y"), (8, a, "z"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string").withColumnRenamed("__id", "id")
    docs = docs.withColumn("text_hash", F.lit(1)).withColumn("__gone", F.lit(1)).withColumn("c1", F.lit(2))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["id"]) for r in kept.filter("doc_id IS NOT NULL").collect()) == [(3, "x"), (5, "x")]
