"""What the language dictionaries are learned from, and languages with little text."""

import random

from tablewright.llm import langid


def words(seed, letters):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(150)]


VOCABULARY = {k: words(i, letters) for i, (k, letters) in enumerate({"aa": "abcdefghi", "bb": "fghijklmn", "cc": "mnopqrstu", "dd": "rstuvwabc"}.items())}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


def test_every_text_of_a_language_of_copies_is_learned(spark):
    """Four texts, each in thousands of copies, are learned whole, whatever their hashes."""
    rows = [(text("aa", i), "aa") for i in range(600)] + [(text(k, i), k) for k in ("bb", "cc", "dd") for i in range(4)] * 2_500
    got = langid.learn(spark.createDataFrame(rows, "text string, lang string").repartition(8))
    assert sorted(got) == ["aa", "bb", "cc", "dd"]
    for k in ("bb", "cc", "dd"):
        whole = sum(len(text(k, i)[len(text(k, i)) // 2 - 163 :][:326]) for i in range(4))
        assert len(got[k]) > 0.95 * whole


def test_sample_is_the_smallest_hashes(spark):
    rows = [(text("aa", i, 30), "aa") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = langid.learn(docs, sample_docs=50)["aa"]
    assert langid.learn(docs.unionAll(docs).repartition(5), sample_docs=50)["aa"] == got


def test_one_short_text_leaves_other_languages_their_dictionaries():
    learned = langid.dictionaries_of({k: [langid.folded(text(k, i)) for i in range(200)] for k in ("aa", "bb")})
    foreign = "korvun silta metsaan"
    few = langid.Compressors(learned | {"xx": langid.folded(foreign)})
    cases = [(k, text(k, 1_000 + i, 12)) for k in learned for i in range(100)]
    got = [few.predict(t) for _, t in cases]
    assert sum(g[0] == k for g, (k, _) in zip(got, cases)) >= 180
    assert all(0 < g[1] <= 1 for g in got)
    assert few.predict(foreign)[0] == "xx"


def test_long_dictionaries_keep_their_answers_beside_short_ones():
    slices = {k: b" ".join(langid.folded(text(k, i)) for i in range(n)) for k, n in (("aa", 150), ("bb", 20), ("cc", 5), ("dd", 1))}
    assert len(set(map(len, slices.values()))) == 4
    tools = langid.Compressors(slices)
    right = {k: sum(tools.predict(text(k, 1_000 + i, 40))[0] == k for i in range(100)) for k in slices}
    assert right["aa"] >= 90 and right["bb"] >= 90, right
    # a short one is still found where nothing else fits
    assert tools.predict(text("dd", 0))[0] == "dd"


def test_languages_of_a_few_bytes_are_learned():
    for slices in ([b"x"], [b"yz"], [b"abcdefg"], [b"", b"q"]):
        learned = langid.dictionaries_of({"aa": [langid.folded(text("aa", i)) for i in range(50)], "tiny": slices})
        assert sorted(learned) == ["aa", "tiny"] and len(learned["tiny"]) >= langid.LEAST_BYTES
        assert langid.Compressors(learned).predict("Hello")[0] in learned
    assert sorted(langid.dictionaries_of({"aa": [b"x"], "bb": [b"yz"]})) == ["aa", "bb"]
    assert langid.dictionaries_of({"aa": [b""]}) == {}


def test_a_language_judged_foreign_is_learned():
    """All its slices look like another language, or are copies of its texts; it still can be predicted."""
    aa = [langid.folded(text("aa", i)) for i in range(100)]
    learned = langid.dictionaries_of({"aa": aa, "other": [langid.folded(text("aa", i)) for i in range(200, 204)]})
    assert sorted(learned) == ["aa", "other"]
    assert sorted(langid.dictionaries_of({"aa": aa, "copy": aa[:1]})) == ["aa", "copy"]


def test_many_languages(spark):
    rows = [(f"word{k} " * 3, f"l{k:04d}") for k in range(1_100)]
    learned = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(learned) == 1_100


def test_predictions_equal_plain_compression(spark):
    """With dictionaries of one length: the language whose dictionary leaves the fewest bytes, the first by name on ties."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = langid.learn(docs)
    least = min(map(len, learned.values()))
    learned = {k: v[:least] for k, v in learned.items()}

    def size(plain, dictionary):
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(dict_data=content, level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(tool.compress(plain[i : i + langid.BLOCK])) for i in range(0, len(plain), langid.BLOCK))

    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, learned).collect()}
    for r in docs.limit(60).collect():
        plain = langid.folded(r["text"])
        want = min(sorted(learned), key=lambda k: size(plain, learned[k]))
        assert got[r["doc_id"]] == (want if langid.has_letter(r["text"]) else langid.UNKNOWN)
