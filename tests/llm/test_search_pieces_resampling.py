"""Lexical search, pieces and resampling against plain versions and the sentencepiece library."""

import hashlib
import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from tablewright.catalog.tables import table
from tablewright.llm import lexical, pieces, queries, resample, wordspans

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CLASHES = ("n", "item", "rank", "block", "salt", "part", "at", "before", "ids", "__id", "c0", "key", "weight", "kind")
WIDE = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)


def frame(spark, texts, first=0):
    rows = [(first + i, t, *(["x"] * len(CLASHES))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, WIDE)


def odd_texts():
    rng = random.Random(5)
    words = ["Haus", "house", "日本", "a_b", "É", "x" * 90, "7", "the", "of"]
    texts = [None, "", " \t", "?!", "one", "ONE one", "one " * 30, "w" * 300_000, "deep sea fish " * 40_000]
    return texts + [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)] + ["the house of the rising sun " * 9] * 30


@pytest.fixture
def short_segments(monkeypatch):
    monkeypatch.setattr(wordspans.segments, "__defaults__", (64, None))


# ---- words in segments


def test_segments_hold_all_words(short_segments):
    texts = pa.array([*odd_texts()[:7], "long " * 200 + "w" * 300 + " end"])
    got = [[] for _ in texts]
    for row, data, starts, ends, _ in wordspans.LowerWords(1).slices(texts):
        for r, a, b in zip(row, starts, ends):
            got[r].append(data[a:b].tobytes().decode())
    assert got == [plain.alnum_words(t.as_py()) for t in texts]


def test_lookup():
    keys = np.random.default_rng(3).integers(0, 2**63, 5_000, dtype=np.uint64)
    keys[:9] = np.arange(9)  # neighbours and zero
    table_ = wordspans.Lookup.of(keys[:2_500], np.arange(2_500))
    assert table_.find(keys).tolist() == [*range(2_500), *[-1] * 2_500]
    assert wordspans.Lookup.of([], []).find(keys[:20]).tolist() == [-1] * 20


# ---- resampling


def asdict(rows):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows}


@pytest.mark.parametrize("head", [0, 40])
def test_resampling_equals_plain_version(spark, monkeypatch, head):
    """With and without words and pairs in the head: it changes no bucket."""
    monkeypatch.setattr(resample, "HEAD_WORDS", head)
    monkeypatch.setattr(resample, "HEAD_PAIRS", head)
    texts, aims = odd_texts(), ["The house of gold", None, "fish and sea"]
    got = resample.resample(frame(spark, texts), frame(spark, aims)).collect()
    assert asdict(got) == plain.resampled(list(enumerate(texts)), aims)


def test_query_resampling(spark):
    docs = [tuple(r) for r in table(spark, MIDDLE, "documents").select("doc_id", "text").collect()]
    aims = [r["text"] for r in table(spark, MIDDLE, "benchmark").collect()]
    assert asdict(queries.op13_resampling(spark, MIDDLE).collect()) == plain.resampled(docs, aims)


def test_pairs_across_segments(short_segments):
    texts = odd_texts()[:7] + ["long words " * 100]
    nothing = wordspans.Lookup.of([], [])
    got = [[] for _ in texts]
    for row, bucket in resample.Features(nothing, nothing, 10_000).buckets_of(pa.array(texts)):
        for r, b in zip(row.tolist(), bucket.tolist()):
            got[r].append(b)
    want = plain.resampled(list(enumerate(texts)), [])
    assert [len(x) for x in got] == [want[i][0] for i in range(len(texts))]


def test_resampling_empty_and_repeated(spark):
    none = frame(spark, [])
    assert resample.resample(none, none).collect() == []
    text = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(1, text)] * 4 + [(None, text)] * 4, "doc_id long, text string")
    got = resample.resample(docs, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 8
    assert {c for c in resample.draw(frame(spark, [text] * 8), none).columns} == {"doc_id", "text", *CLASHES}
    assert resample.draw(frame(spark, [text] * 8), none).count() == 2


# ---- search


def found(rows):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}


@pytest.mark.parametrize("at_once, width", [(256, 4096), (2, 3)])
def test_search_equals_plain_version(spark, monkeypatch, at_once, width):
    """Ties of thirty equal texts, long texts, items of no term; in one block or several, with wide and narrow tiles."""
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "TILE_TERMS", width)
    texts = odd_texts()
    items = [(0, "The rising sun, the house"), (1, None), (2, "nothing here"), (3, "haus 7"), (4, "É 日本 fish sea")]
    asked = spark.createDataFrame(items, "item_id int, text string")
    got = lexical.search(frame(spark, texts).repartition(5), asked).collect()
    assert found(got) == plain.ranked(list(enumerate(texts)), items)
    assert len(got) == len(found(got))


def test_search_empty(spark):
    none, some = frame(spark, []), frame(spark, ["a b", None])
    named = lambda df: df.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(none, named(some)).collect() == []
    assert lexical.search(some, named(none)).collect() == []
    nulls = spark.createDataFrame([(None, "a"), (5, "a"), (5, "a")], "doc_id long, text string")
    assert [r["doc_id"] for r in lexical.search(nulls, named(some)).orderBy("rank").collect()] == [5, 5, None]


def test_partial_sums_stay_exact():
    weights = np.full(9_000, 26_000)
    width = lexical.tile_terms(weights)
    assert width * 26_000 * 1_000_000 < 2**53
    assert lexical.tile_terms(np.array([2**40])) == 1
    column = np.arange(9_000)
    got = lexical.tile_scores(weights[None, :].astype(float), np.zeros(9_000, int), column, np.full(9_000, 999_999), 1, width)
    assert got.tolist() == [[9_000 * 26_000 * 999_999]]


def test_impacts_beyond_64_bits():
    tf, size = np.array([3, 1]), np.array([10**9, 5])
    n_docs, n_terms = 10**11, 10**14
    want = [10**9 * t // (1000 * t + 8 * (10 + 90 * s * n_docs // n_terms)) for t, s in ((3, 10**9), (1, 5))]
    assert lexical.impacts(tf, size, n_docs, n_terms).tolist() == want


# ---- pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


def hostile(table_):
    rng = random.Random(9)
    signs = ["a", "th", "ing", " ", "  ", "   ", "\n", "\t", "▁", "é", "日", "😀", "́", "_", "0", "<s>", "<0x0A>", "==", "\x00", "①", "ß"]
    names = [p.replace("▁", " ") for p in table_.id_of]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(1_500)]
    texts += ["".join(rng.choices(names, k=rng.randint(1, 20))) for _ in range(1_500)]
    return texts + [c * k for c in ("a", " ", "=", "▁", "é", "①") for k in range(40)] + ["▁ a", "a▁ b", " ▁"]


@pytest.mark.parametrize("limit", [50, 1 << 18])
def test_pieces_equal_library(library, monkeypatch, limit):
    monkeypatch.setattr(wordspans.segments, "__defaults__", (limit, None))
    table_ = pieces.PieceTable(queries.piece_model_path())
    texts = [None, *hostile(table_), "no" * 60_000, "many words and signs " * 9_000]
    got = [np.frombuffer(b"".join(x), table_.kind).tolist() for x in table_.ids_of(pa.array(texts))]
    want = [library.encode(t or "") for t in texts]
    assert got == want
    assert [table_.decode(x) for x in want] == [library.decode(x) for x in want]


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(4)
    kinds = lambda: rng.choice([rng.randrange(3, 259), rng.randrange(32_000), 0, 1, 2])
    table_ = pieces.load(queries.piece_model_path())
    for _ in range(5_000):
        ids = [kinds() for _ in range(rng.randint(0, 12))]
        assert table_.decode(ids) == library.decode(ids), ids


def test_query_pieces(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_pieces(spark, SMALL).collect()}
    for r in table(spark, SMALL, "documents").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        row = got.pop(r["doc_id"])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not got


def test_pieces_round_trip_and_odd_rows(spark, library):
    path = queries.piece_model_path()
    texts = odd_texts()
    docs = frame(spark, texts)
    lists = pieces.encode_texts(docs, path)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_ids(lists, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode_texts(frame(spark, []), path).collect() == []
    twice = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert [r["ids_sha256"] for r in pieces.digests(twice, path).collect()] == [hashlib.sha256(",".join(map(str, library.encode("a"))).encode()).hexdigest()] * 3
    assert pieces.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first()["text"] == ""
