"""Mixes of very many sources, and broadcasts that are too large in bytes."""

import plain
import pytest

from tablewright.llm import decontam, mixing


@pytest.mark.parametrize("bucket", [200, 20])
def test_a_range_of_equal_finish_times_is_cut_by_time_and_source(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "HEAVY_BUCKETS", 1)
    monkeypatch.setattr(mixing, "CELLS", 8)
    rows = [(i, f"host{i:05d}", "word " * (1 + i % 7)) for i in range(1500)]
    rows += [(i, "large", "word " * (i % 5)) for i in range(1500, 2500)] + [(2500, None, None), (2501, "", "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    narrowed = []
    plain_step = mixing.Mix._narrowed

    def watched(self, turns, start):
        out = plain_step(self, turns, start)
        narrowed.append((turns.count(), out[0].count()))
        return out

    monkeypatch.setattr(mixing.Mix, "_narrowed", watched)
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.Mix(docs).allotments().collect()}
    want = plain.mix(rows)[0]
    assert {i: taken for i, (_, taken) in got.items()} == {i: got[i][0] * want.get(i, 0) for i in got}
    assert narrowed and narrowed[0][1] <= bucket < narrowed[0][0]


def test_contamination_without_any_broadcast_is_the_same(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, "x " * 50 + item), (2, "short item"), (3, None), (4, "clean words here"), (5, item), (None, item)], "doc_id long, text string"
    )
    bench = spark.createDataFrame([("a", item), ("b", "short item"), ("c", None), ("d", item)], "item_id string, text string")
    fields = ("doc_id", "n_words", "n_hit", "items", "contaminated")

    def found():
        return sorted((str([r[f] for f in fields]) for r in decontam.contamination(docs, bench).collect()))

    small = found()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert not decontam._fits(docs, decontam._bytes("text"))
    assert found() == small and any("True" in r for r in small)
