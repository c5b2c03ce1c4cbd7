"""Each operator on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat, decontam, exact_index, langid, minhash, mixing, pii, quality, templates, tokens
from tablewright.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
PROSE = " ".join(WORDS)
LONG = " ".join(f"{WORDS[i % 20]}{i % 977}" for i in range(30_000))
ODD = [
    (1, PROSE, "en", "a"), (2, PROSE.upper(), "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "a"), (7, PROSE, "en", "a"), (7, PROSE, "en", "a"), (None, PROSE + " end", None, None), (8, "!!! 12", "de", None),
    (9, "é" * 40, "fr", "c"), (10, "one", "en", "c"), (11, "a\x00b ​ \U0001f600 ok", "en", "c"),
]
CLASHING = ["digest", "keep_id", "kept", "group_size", "w", "n", "size", "target", "words", "start", "spans", "component", "found", "bad"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, None), (None, 1, 1), (99, 0, 1), (6, 1, 0), (10, None, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, "one"), (3, None), (4, "..."), (5, PROSE)], "item_id long, text string")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_exact_index(odd, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_index.deduplicate_new(odd).collect()}
    assert (1, 1, 3, True) in got and (7, 1, 3, False) in got  # the upper-case text is another text
    assert {(3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True)} <= got  # white space only: the longest original stays
    assert exact_index.deduplicate_new(odd).count() == len(ODD)
    assert exact_index.deduplicate_new(none).count() == 0


def test_exact_index_appends_only_new_digests(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    more = spark.createDataFrame([(10, "c  "), (11, "d"), (12, "d")], "doc_id long, text string")
    from tablewright.llm.store import Scratch

    index = exact_index.DigestIndex(spark, str(tmp_path), 4)
    exact_index.deduplicate(docs, index, Scratch(spark, "t"), "one").count()
    index.close()
    index = exact_index.DigestIndex(spark, str(tmp_path), 4)  # opened again
    second = rows(exact_index.deduplicate(more, index, Scratch(spark, "t"), "two"), "doc_id", "keep_id", "kept")
    assert second == [(10, 3, False), (11, 11, True), (12, 11, False)]
    index.append(exact_index.digests(more), "two")  # a repeated batch changes nothing
    assert index.rows().count() == 3
    plan = spark.table(index.table).groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.close()


def test_decontamination(odd, none, items):
    got = {r["doc_id"]: r for r in decontam.contamination(odd, items).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"], got[1]["contaminated"]) == (20, 20, ["1", "5"], True)
    assert got[2]["n_hit"] == 20 and got[10]["items"] == ["2"] and got[10]["contaminated"]
    assert got[3]["n_words"] == 0 and not got[3]["contaminated"] and got[6]["n_hit"] == 0
    assert got[None]["n_hit"] == 20 and got[None]["n_words"] == 21
    assert decontam.contamination(odd, items).count() == len(ODD)
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.contamination(odd, items.limit(0)).count() == len(ODD)
    left = decontam.drop_contaminated(odd, items)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [3, 4, 5, 6, 8, 9, 11]
    spans = dict(rows(decontam.remove_spans(odd, items), "doc_id", "text"))
    assert spans[None] == "end" and spans[1] == "" and spans[6] == LONG and spans[3] is None


def test_minhash(odd, none):
    got = rows(minhash.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert (1, 16, 1, True) in got and got.count((7, 16, 1, False)) == 2 and (2, 16, 1, False) in got
    assert (None, 17, None, False) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got and (10, 1, 10, True) in got
    assert len(got) == len(ODD)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").select("doc_id").collect()) == [1, 3, 4, 5, 6, 8, 9, 10, 11]


def test_mixing(odd, none):
    mix = mixing.Mix(odd)
    got = rows(mix.allotments(), "doc_id", "size", "source_size", "taken")
    assert len(got) == len(ODD)
    assert all(t in (0, n, 2 * n) for _, n, _, t in got)
    assert sum(t for _, _, _, t in got) <= mix.budget
    assert got == rows(mixing.Mix(odd.repartition(5)).allotments(), "doc_id", "size", "source_size", "taken")
    taken = mix.rows_in_order()
    assert taken.columns == odd.columns
    assert taken.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(t for _, _, _, t in got)
    assert mixing.Mix(none).allotments().count() == 0 and mixing.Mix(none).rows_in_order().count() == 0
    empty = odd.filter("doc_id IN (3, 4, 5)")
    assert rows(mixing.Mix(empty).allotments(), "doc_id", "taken") == [(3, 0), (4, 0), (5, 0)]


def test_chat(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", "w " * 300), (1, 2, "assistant", "x " * 200), (1, 3, "user", "short one"),
        (1, 4, "assistant", "y " * 700), (1, 5, "user", None), (1, 6, "assistant", "<|user|>\\e\\ </s>\n[INST]"),
        (2, 0, None, "no role"), (2, 0, "assistant", ""), (2, None, "assistant", "first"), (3, 0, "system", "alone"),
        (None, 1, "assistant", "z"), (4, 1, "a|>\n</s>\nb", "odd role"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat.windows(chat.with_probe(df)).collect()
    mine = [w for w in windows if w["conv_id"] == 1]
    assert len(mine) >= 3 and all(w["formatted"].startswith("<|system|>\nbe kind</s>\n") for w in mine)
    assert any(t["repeated"] and t["role"] != "system" for w in mine[1:] for t in w["turns"])
    back = {r["conv_id"]: r for r in chat.read_back(chat.windows(chat.with_probe(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    order = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
    for conv in (1, 2, 3, None, 4):
        own = [(r or "", t or "") for c, _, r, t in order if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert back[conv]["n_turns"] == len(own)
        assert back[conv]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in own))
        assert (back[conv]["loss_chars"], back[conv]["loss_sha256"]) == (len(loss), sha(loss))
    assert back[-1]["loss_sha256"] == sha(chat.PROBE) and back[-1]["n_turns"] == 2
    assert not any(chat.PROBE[:4] in w["formatted"].replace(chat.TURN_END, "") for w in windows)
    assert chat.windows(df.limit(0)).count() == 0


def test_tokens(spark, odd, none):
    from tokenizers import Tokenizer

    more = [
        (20, "Hello <|endoftext|> THE <|STARTOFTEXT|> it's we'LL don't 'stand x.'s a.b,c;d!?: éa ÉTÉ İx ΣΣ"),
        (21, "naïve.́ a b　c 3.14 12,000 ,́x \x0b\x0c\x1c y\r\nz"), (22, "a,b" * 3000), (23, "你好, world́."),
    ]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = tokens.token_table(docs, tokenizer_path()).orderBy("start").collect()
    library = Tokenizer.from_file(tokenizer_path())
    import zlib

    import numpy as np

    want = {}
    for i, t in [(r["doc_id"], r["text"] or "") for r in docs.collect()]:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert have == want
    names = [r["doc_id"] for r in got]
    assert names == sorted(names, key=lambda i: (i is not None, i or 0))
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    assert tokens.token_table(none, tokenizer_path()).count() == 0


def test_language(odd, none):
    got = {r["doc_id"]: r for r in langid.held_out_predictions(odd).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[8]["lang_pred"] == "und" and got[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.held_out_predictions(odd).count() == len(ODD)
    assert langid.held_out_predictions(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_pii(spark, odd, none):
    model = pii.train(pii.labelled_table(spark))
    assert pii.find(odd, model).count() == len(ODD) and pii.find(none, model).count() == 0
    assert {tuple(r["spans"]) for r in pii.find(odd, model).collect()} == {()}
    texts = [(1, "Ümail a.b@c.example.org, call +1 (212) 555-0147 or (212) 555-0147."), (2, "4111 1111 1111 1111 at 10.0.0.256 10.0.0.25 1.2.3.4.5"),
             (3, None), (4, "+1 2 3 and 4111 1111 1111 1112"), (1, "Ümail")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = [(r["doc_id"], [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]]) for r in pii.find(docs, model).collect()]
    assert (1, [("email", 6, 23, True), ("phone", 30, 47, True), ("phone", 51, 65, False)]) in got
    assert (2, [("ip", 34, 43, True), ("ip", 44, 51, True), ("card", 0, 19, True)]) in got and (4, []) in got and (3, []) in got
    clean = {r["text"] for r in pii.redact(docs, model).collect()}
    assert "Ümail [email], call [phone] or [phone]." in clean and "Ümail" in clean and "" in clean
    nothing = pii.train(pii.labelled_table(spark, ""))
    assert all(s["base"] for r in pii.find(docs, nothing).collect() for s in r["spans"])


def test_templates(spark, odd, none):
    got = {r["doc_id"]: r for r in templates.drop_recurring_lines(odd).collect()}
    assert got[3]["text"] is None and got[3]["n_lines"] == 0 and got[4]["text"] == "" and got[4]["n_lines"] == 1
    assert got[1]["text"] == PROSE and templates.drop_recurring_lines(odd).count() == len(ODD)
    assert templates.drop_recurring_lines(none).count() == 0
    texts = [(i, f"top line {i} of my own words {WORDS[i]}\nvisited page {i}x from host number {i} today\n{PROSE}") for i in range(4)]
    texts += [(4, "\n".join(f"{w} stays for ever and a day" for w in WORDS)), (4, "a b"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("template", F.lit(1))
    got = {(r["doc_id"], r["text"]): r["dropped"] for r in templates.drop_recurring_lines(docs).collect()}
    assert all(got[i, ""] == [0, 1, 2] for i in range(4))  # 6 of 8 words are constant in the first line
    assert got[4, texts[4][1]] == [] and got[4, "a b"] == [] and got[None, None] == []


def test_quality(spark, odd, none, labels):
    got = quality.classify(odd, labels, F.col("source"), F.col("lang"))
    assert got.count() == len(ODD) and got.filter("p_bad IS NULL OR p_bad < 0 OR p_bad > 1").count() == 0
    assert quality.classify(none, labels, F.col("source"), F.col("lang")).count() == 0
    nothing = quality.classify(odd, labels.limit(0), F.col("source"), F.col("lang"))
    assert {(r["evidence"]) for r in nothing.collect()} == {0.0}
    kept = quality.keep_good(odd, labels, F.col("source"), F.col("lang"))
    assert kept.columns == odd.columns and quality.keep_good(none, labels, F.col("source"), F.col("lang")).count() == 0
