"""Lines and templates that the thresholds of three documents alone would keep."""

import re
from collections import defaultdict

import plain
import pyarrow as pa


from tablewright.catalog.tables import table
from tablewright.llm import queries, templates, wordspans

PASSAGE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(templates.LONG_WORDS))


def dropped(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["dropped"] for r in templates.drop_recurring_lines(docs, **options).collect()}


def test_long_line_in_two_documents(spark):
    short, numbers = "six short words stand right here", " ".join("7" * (i + 1) for i in range(templates.LONG_WORDS))
    texts = [f"one\n{PASSAGE}\n{short}\n{numbers}", f"{PASSAGE}\ntwo\n{short}\n{numbers}"]
    texts += [f"copied\n{PASSAGE} again"] * 2 + [f"alone {PASSAGE}"]
    got = dropped(spark, texts, long_docs=templates.LONG_DOCS)
    assert got == {0: [1], 1: [0], 2: [], 3: [], 4: []}  # copies of one text are one text


def test_query_drops_long_lines_of_two_texts(spark):
    d = "/root/testdata/sf0.01"
    holders, place = defaultdict(set), defaultdict(set)
    for r in table(spark, d, "documents").select("doc_id", "text").collect():
        for n, raw in enumerate((r["text"] or "").split("\n")):
            words = tuple("<*>" if re.search("[0-9]", w) else w for w in raw.split())
            if len(words) - words.count("<*>") >= templates.LONG_WORDS:
                holders[words].add(r["text"])
                place[words].add((r["doc_id"], n))
    want = {x for words, texts in holders.items() if len(texts) == 2 for x in place[words]}
    got = {(r["doc_id"], n) for r in queries.op6_line_templates(spark, d).collect() for n in r["dropped"]}
    assert want and want <= got


def test_fields_stay_variable_as_the_table_grows(spark):
    """Names and sections are constant by an absolute count once the table is large; no pair of them is in three documents."""
    line = "Today the notice {} was posted by anna{} in part{} at noon for all readers".format

    def texts(size):
        pairs = [(i, (i * 7 + j) % size) for i in range(size) for j in range(min(size, 4))]
        names = [(chr(97 + i // 26) + chr(97 + i % 26), chr(97 + j // 26) + chr(97 + j % 26)) for i, j in pairs]
        return [line("here", i, j) + f"\nown{k}" for k, (i, j) in enumerate(names)]

    small, large = texts(2), texts(200)
    other = ["Today the notice of our garden club tells of roses and of many other things"] * 5_000  # the leaf's larger template
    for rows in (small, large, large + other, small * 100):
        assert set(map(tuple, dropped(spark, rows).values())) == {(0,)}


def test_template_of_skewed_values(spark):
    """Some values are frequent in themselves, their combinations with others are not."""
    names = [f"name{chr(97 + i)}" for i in range(20)]
    rows = [f"As of today mister {names[i]} meets miss {names[j]} at the old town hall" for i in range(20) for j in range(20) if i * j < 40]
    assert set(map(tuple, dropped(spark, rows).values())) == {(0,)}
    unlike = [f"As of today {' '.join(name + names[i] + names[j] for name in 'abcd')} hall" for i in range(20) for j in range(20)]
    assert set(map(tuple, dropped(spark, unlike).values())) == {()}  # fewer than 70 % constant


def test_query_equals_plain_version(spark):
    """The registered query, with all levels and long lines, drops exactly the lines of the plain version."""
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    want = plain.recurring(rows, long_docs=templates.LONG_DOCS)
    assert {(r["doc_id"], n) for r in queries.op6_line_templates(spark, d).collect() for n in r["dropped"]} == want
    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for options in ({"min_docs": 2, "long_docs": None}, {"min_docs": 4, "min_words": 3, "long_docs": 2}):
        got = {(r["doc_id"], n) for r in templates.drop_recurring_lines(docs, **options).collect() for n in r["dropped"]}
        assert got == plain.recurring(rows, **options)


def test_segments_and_larger_tables(spark, monkeypatch):
    """Long texts in segments, leaves and templates beyond what is sent to every task: the same lines, the same texts."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = docs.unionAll(docs.selectExpr("doc_id + 100000", "concat(text, '\\n', text, '\\n', 'end')")).unionAll(
        spark.createDataFrame([(7_000_000, None), (7_000_001, ""), (7_000_002, "\n\n"), (None, "a\nb")], "doc_id long, text string"))
    want = {r["doc_id"]: tuple(r) for r in templates.drop_recurring_lines(docs).collect()}
    for doc, text in docs.collect():
        kept = [] if text is None else [x for k, x in enumerate(text.split("\n")) if k not in want[doc][4]]
        assert want[doc][1] == (None if text is None else "\n".join(kept)) and want[doc][2] == (0 if text is None else text.count("\n") + 1)
    monkeypatch.setattr(templates, "SENT_TEMPLATES", 0)
    monkeypatch.setattr(templates, "SENT_LEAVES", 0)
    assert {r["doc_id"]: tuple(r) for r in templates.drop_recurring_lines(docs).collect()} == want


def test_lines_of_long_texts(monkeypatch):
    texts = pa.array(["", "a b\n\nc 1\n", None, "x " * 100 + "\n" + "y\n" * 90, "\n", "last"])
    monkeypatch.setattr(wordspans.segments, "__defaults__", (32, None))
    got = [[] for _ in texts]
    for data, lines in templates.Parser().slices(texts):
        for k, row in enumerate(lines.row.tolist()):
            assert lines.number[k] == len(got[row])
            got[row].append(data[lines.start[k] : lines.end[k]].tobytes().decode())
            assert lines.n[k] == len(got[row][-1].split())
    assert got == [(t.as_py() or "").split("\n") for t in texts]
