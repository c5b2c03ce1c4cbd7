"""Text chunking, extraction, readers, report tables and the end-to-end plan."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tablewright.operators import models, report, rules, text
from tablewright.plans import unstructured
from tablewright.plans.advisory import run_advisory
from tablewright.sources import jsonlines, readers, splitcsv


def chunks(spark, body, **kw):
    df = spark.createDataFrame([(1, body)], "id int, t string")
    return [(r["kind"], r["chunk"]) for r in text.chunk_documents(df, "id", "t", **kw).orderBy("pos").collect()]


# ---- chunks ----------------------------------------------------------------------------------


def test_paragraphs_are_stripped_and_filtered(spark):
    body = "   first paragraph that is long enough \n\n short \n\n\n\nsecond paragraph that is long enough"
    assert chunks(spark, body) == [
        ("paragraph", "first paragraph that is long enough"),
        ("paragraph", "second paragraph that is long enough"),
    ]


def test_length_limits(spark):
    assert chunks(spark, "x" * 20) == [("window", "x" * 20)]
    assert chunks(spark, "x" * 21) == [("paragraph", "x" * 21)]
    assert chunks(spark, "x" * 15) == []


def test_long_unbroken_text_is_one_paragraph(spark):
    assert chunks(spark, "y" * 400) == [("paragraph", "y" * 400)]


def test_windows_are_not_stripped(spark):
    body = "\n\n".join(["abcde"] * 100)
    assert [(k, len(c)) for k, c in chunks(spark, body)] == [("window", 350), ("window", 348)]


def test_windows_cover_the_whole_text_unless_told_otherwise(spark):
    body = "\n\n".join(["abcde"] * 1000)
    assert len(chunks(spark, body)) == 20
    assert len(chunks(spark, body, span=text.WINDOW_SPAN)) == 10
    assert len(chunks(spark, body, max_chunks=3)) == 3


def test_empty_and_missing_text(spark):
    assert chunks(spark, "") == [] and chunks(spark, None) == []


def test_other_separators(spark):
    body = "one paragraph of some length.*another paragraph of some length"
    assert len(chunks(spark, body, separator=".*")) == 2


def test_batch_caps_before_dropping_blanks(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, "b"), (4, "c")], "id int, t string")
    assert sorted(r["id"] for r in text.batch(df, "id", "t", cap=3).collect()) == [1, 3]
    assert text.batch(df, "id", "t").count() == 3


# ---- extraction ------------------------------------------------------------------------------


def test_record_contract(spark):
    df = spark.createDataFrame(
        [(1, "Please fix the login error NOW, it is critical and terrible"), (2, "Great, thanks for the fast delivery"), (3, None)],
        "id int, t string",
    )
    rows = {r["id"]: r for r in text.extract_records(df, "t", keep=["id"]).collect()}
    assert (rows[1]["category"], rows[1]["sentiment_score"], rows[1]["urgency"], rows[1]["action_required"]) == ("Technical", -1.0, 3, 1)
    assert (rows[2]["category"], rows[2]["sentiment_score"], rows[2]["urgency"], rows[2]["action_required"]) == ("Delivery", 1.0, 1, 0)
    assert (rows[3]["category"], rows[3]["sentiment_score"], rows[3]["urgency"]) == ("General", 0.0, 1)


def test_urgency_stays_in_range(spark):
    df = spark.createDataFrame([("now " * 50,)], "t string")
    assert text.extract_records(df, "t").first()["urgency"] == 5


def test_main_topic(spark):
    df = spark.createDataFrame([(1, "the cat, the dog and the Dog"), (2, "of to"), (3, "b aaa bbb")], "id int, t string")
    assert {r["id"]: r["main_topic"] for r in text.main_topic(df, ["id"], "t").collect()} == {1: "dog", 2: None, 3: "aaa"}


def test_directive_and_rejects(spark):
    df = spark.createDataFrame([(1, "order 12 paid"), (2, "nothing"), (3, "  ")], "id int, t string")
    out = text.extract_fields(df, "t", {"order": (r"order (\w+)", "int")}, keep=["id", "t"])
    good, bad = text.split_rejects(out, "t", ["order"])
    assert [tuple(r) for r in good.collect()] == [(1, "order 12 paid", 12)]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "no field found", 3: "blank text"}
    with pytest.raises(ValueError):
        text.extract_fields(df, "t", {"x": ("no group", "int")})


def test_ragged_union(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, 7)], "k double, s int")
    c = spark.createDataFrame([(True,)], "flag boolean")
    out = text.union_records(a, b, c)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["double", "string", "boolean"] and out.count() == 3


# ---- sources ---------------------------------------------------------------------------------


def test_csv_types_and_null_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'i,d,b,s,n,m,f\n1,1.5,True,x,NA,1d,inf\nNaN,2,False,"a, ""q""",,2,1\nnull,N/A,None,n/a,NULL,3,2\n', encoding="utf-8"
    )
    df = readers.read_any(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string", "string", "string", "double"]
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, None, None] and [r["d"] for r in rows] == [1.5, 2.0, None]
    assert [r["s"] for r in rows] == ["x", 'a, "q"', None] and [r["n"] for r in rows] == [None] * 3


def test_csv_with_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,s\n1,NA\n2,b\n", encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), schema="i int, s string").collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, "b")]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "197")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _quoted(value):
    if value is None:
        return ""
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\n') or value == "" else value


def test_csv_in_ranges(spark, tmp_path, small_ranges):
    """Quotes, doubled quotes, separators and line breaks across range borders; a value longer than several ranges; two files."""
    rng = random.Random(3)
    parts = ["a", "bc", ",", '"', "\n", " ", '""', "x" * 30, "é", "\n\n", '",', '\n"', "1"]
    want = {}
    for name in ("one", "two"):
        rows = [(str(i), "".join(rng.choices(parts, k=rng.randint(0, 25))) or None, rng.choice(["k", None, "z,z"])) for i in range(120)]
        rows.append(("120", "long, " + "line\n" * 150 + '"', "end"))
        rows += [(str(121 + i), "after", None) for i in range(5)]
        (tmp_path / f"{name}.csv").write_text("id,text,tag\n" + "".join(",".join(map(_quoted, r)) + "\n" for r in rows), encoding="utf-8")
        want[name] = rows
    one = splitcsv.read(spark, str(tmp_path / "one.csv"))
    assert sorted(map(tuple, one.collect())) == sorted(want["one"])
    assert splitcsv._lines(spark, str(tmp_path / "one.csv")).rdd.getNumPartitions() > 20
    both = splitcsv.read(spark, [str(tmp_path / f"{n}.csv") for n in want])
    key = lambda r: (int(r[0]), repr(r))
    assert sorted(map(tuple, both.collect()), key=key) == sorted(want["one"] + want["two"], key=key)
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "two.csv"))
    got = splitcsv.read(spark, str(tmp_path / "two.csv"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_csv_quotes_inside_plain_values_and_carriage_returns(spark, tmp_path, small_ranges):
    text = 'a,b\r\n5" pipe,x\r\n' + '"q\r\nr",y\r\n' + 'it"s,"z""z"\r\n' * 30 + "\n,\nlast,end"
    (tmp_path / "c.csv").write_bytes(text.encode())
    rows = [tuple(r) for r in splitcsv.read(spark, str(tmp_path / "c.csv")).collect()]
    assert sorted(rows, key=repr) == sorted([('5" pipe', "x"), ("q\r\nr", "y"), *[('it"s', 'z"z')] * 30, (None, None), ("last", "end")], key=repr)
    (tmp_path / "e.csv").write_text("a,b\n", encoding="utf-8")
    assert splitcsv.read(spark, str(tmp_path / "e.csv")).collect() == []
    (tmp_path / "s.csv").write_text("a;b\n1;\"2\n;3\"\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "s.csv"), sep=";").collect()] == [(1, "2\n;3")]


def test_json_document_is_flattened(spark, tmp_path):
    (tmp_path / "d.JSON").write_text(json.dumps([{"a": {"b": 1, "c": {"d": "x"}}, "l": [1, 2]}, {"a": {"b": 2}}], indent=1), encoding="utf-8")
    df = readers.read_any(spark, str(tmp_path / "d.JSON"))
    assert set(df.columns) == {"a.b", "a.c.d", "l"}
    assert [r["a.b"] for r in df.collect()] == [1, 2]


def test_json_lines_union_keys_and_quarantine(spark, tmp_path):
    (tmp_path / "d.log").write_text('{"a": 1}\n\n{"b": {"c": 2.5}}\n{"a": null, "z": []}\nnot json\n[1]\n', encoding="utf-8")
    rows, bad = readers.read_json_lines(spark, str(tmp_path / "d.log"))
    assert set(rows.columns) == {"a", "b", "z"} and rows.count() == 3
    assert rows.where("b.c = 2.5").count() == 1
    assert {r["line"] for r in bad.collect()} == {"not json", "[1]"}
    assert set(jsonlines.flatten(rows).columns) == {"a", "b.c", "z"}


def test_json_lines_without_objects(spark):
    with pytest.raises(ValueError):
        jsonlines.parse_json_lines(spark.createDataFrame([("x",)], "line string"), "line")


def test_text_drops_undecodable_bytes(spark, tmp_path):
    (tmp_path / "t.TXT").write_bytes("né\nx".encode() + b"\xff\xfe!")
    assert readers.read_any(spark, str(tmp_path / "t.TXT")).first()["text"] == "né\nx!"


def _png(path, pixels, mode):
    """A PNG of rows of tuples; mode 2 is RGB, 6 is RGBA, 0 is grey."""

    def block(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in pixels)
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, mode, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + block(b"IHDR", head) + block(b"IDAT", zlib.compress(raw)) + block(b"IEND", b""))


def test_image_features(spark, tmp_path):
    import numpy as np

    rgb = [[(10 * (x + y), 5 * x, 250 - y) for x in range(4)] for y in range(3)]
    _png(tmp_path / "rgb.png", rgb, 2)
    _png(tmp_path / "rgba.png", [[(*px, 7) for px in row] for row in rgb], 6)
    _png(tmp_path / "grey.png", [[(x,) for x in (0, 100)]], 0)
    rows = {r["path"].split("/")[-1]: r for r in readers.read_images(spark, str(tmp_path)).collect()}
    a = np.array(rgb, dtype=float)
    for name in ("rgb.png", "rgba.png"):
        r = rows[name]
        assert (r["image_width"], r["image_height"], r["aspect_ratio"]) == (4, 3, 1.333)
        assert r["mean_red_channel"] == pytest.approx(a[:, :, 0].mean()) and r["mean_blue_channel"] == pytest.approx(a[:, :, 2].mean())
        assert r["mean_green_channel"] == pytest.approx(a[:, :, 1].mean()) and r["brightness_std"] == pytest.approx(a.std())
    assert rows["grey.png"]["mean_red_channel"] == 50.0 and rows["grey.png"]["brightness_std"] == 50.0


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read_any(spark, "/nowhere/file.xyz")


def test_hand_off_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "k bigint, s string")
    readers.publish(df, "handed_over", persist=True)
    assert spark.table("handed_over").count() == 2
    assert readers.active_table(df, None) is df and readers.active_table(None, df) is df
    with pytest.raises(ValueError):
        readers.active_table(None, None)
    readers.write_csv(df, str(tmp_path / "out.csv"))
    assert sorted(map(tuple, readers.read_any(spark, str(tmp_path / "out.csv")).collect())) == [(1, 'a "q", b'), (2, None)]
    readers.write_parquet(df, str(tmp_path / "out.parquet"))
    assert readers.read_any(spark, str(tmp_path / "out.parquet")).count() == 2


# ---- report and plan -------------------------------------------------------------------------


def test_report_payload_leaves_bulk_out(spark):
    df = spark.range(9).withColumn("v", F.lit(None).cast("int"))
    out = report.prune_to_json({"ids": (df, ["id"]), "labelled": (df, ["id"])}).orderBy("ordinal").collect()
    assert [r["json"] for r in out] == [f'{{"id":{i},"v":null}}' for i in range(5)]


def test_leaderboard_extract(spark):
    df = spark.createDataFrame([(i, "m", 1.0, 2.0, 3.0, "x") for i in range(6, 0, -1)], "rank int, a string, b double, c double, d double, e string")
    out = report.leaderboard_top(df)
    assert out.columns == ["rank", "a", "b", "c", "d"] and [r["rank"] for r in out.collect()] == [1, 2, 3, 4]


def test_advisory_on_a_sparse_table(spark):
    rows = [(i, float(i % 5) * 3 + (20 if i > 9 else 0), float(i % 3) + (40 if i > 9 else 0), "xy"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, a double, b double, g string")
    out = run_advisory(df, "segment the rows", key="id", sensitive=["g"], outcome="a", max_k=3, restarts=1)
    assert out.grown and out.cleaned.count() == 100
    assert {r["split"]: r["n"] for r in out.split_counts.collect()} == {"train": 70, "val": 15, "test": 15}
    assert out.champion and set(out.gates) == {"kmo_bartlett", "factors", "loadings", "scores"}
    assert "id" not in out.cleaned.columns  # a grown table's key is no feature
    context = out.context.first()
    assert (context["task"], context["train"]) == ("Clustering / Segmentation", 70)
    assert out.parity.count() == 2 and out.report.where("section = 'executive_verdict'").count() == 1
    out.cleaned.unpersist()


def test_advisory_classification(spark):
    rows = [(i, float(i % 2) * 4 + (i % 7) / 7, None if i == 5 else "ab"[i % 2], "p") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x double, churn string, k string")
    out = run_advisory(df, key="id", candidates=["Logistic Regression"], settings=models.Settings(logistic_iterations=20))
    assert out.intent.target == "churn" and out.recipe.drop_columns == ("k",)
    assert out.cleaned.count() == 119 and out.score > 0.9 and out.leaderboard.count() == 1
    assert out.log.where("action = 'drop_rows' and n_affected = 1").count() == 1
    with pytest.raises(ValueError):
        run_advisory(df, task="Regression", target="absent")
    out.cleaned.unpersist()


# ---- JSON layouts ------------------------------------------------------------------------------


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("name", ["a.json", "a.JSON", "a.log"])
def test_json_lines_are_all_read(spark, tmp_path, name):
    path = _file(tmp_path, name, "".join(f'{{"a": {i}, "b": {{"c": "x{i}"}}}}\n' for i in range(10)))
    rows = readers.read_any(spark, path)
    assert sorted(map(tuple, rows.select("a", "`b.c`").collect())) == [(i, f"x{i}") for i in range(10)]


def test_bad_lines_are_kept_apart(spark, tmp_path):
    path = _file(tmp_path, "a.log", '{"a": 1}\n{"a": \n\n{"a": 3}\n[1]\n')
    rows, bad = readers.read_json(spark, path)
    assert sorted(r["a"] for r in rows.collect()) == [1, 3] and sorted(r["line"] for r in bad.collect()) == ['[1]', '{"a": ']
    with pytest.warns(UserWarning, match="2 lines"):
        assert readers.read_any(spark, path).count() == 2
    late = _file(tmp_path, "b.log", 'started\n{"a": 1}\n{"a": 2}\n')
    rows, bad = readers.read_json(spark, late)
    assert rows.count() == 2 and bad.count() == 1


@pytest.mark.parametrize("text", ['{\n "a": 1,\n "b": {"c": "x"}\n}\n', '[\n {"a": 1,\n  "b": {"c": "x"}}\n]', '[{"a": 1, "b": {"c": "x"}}]',
                                  '{"a": 1, "b": {"c": "x"}}'])
def test_json_documents(spark, tmp_path, text):
    rows, bad = readers.read_json(spark, _file(tmp_path, "a.json", text))
    assert list(map(tuple, rows.select("a", "`b.c`").collect())) == [(1, "x")] and (bad is None or bad.count() == 0)


def test_json_without_objects_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_any(spark, _file(tmp_path, "a.json", "no json\nat all\n"))
    with pytest.raises(ValueError):
        readers.read_any(spark, _file(tmp_path, "b.json", "\n"))


def test_csv_with_line_breaks_comes_back(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted"'), (2, " blanks "), (3, "plain")]
    path = str(tmp_path / "t.csv")
    readers.write_csv(spark.createDataFrame(rows, "id bigint, t string"), path)
    assert sorted(map(tuple, readers.read_any(spark, path).collect())) == rows


def test_texts_become_a_table_and_its_advisory(spark):
    line = "please fix order {} today the delivery was {} and the refund of {} is late"
    rows = [(i, "\n\n".join(line.format(10 * i + j, ("great", "bad", "slow")[(i + j) % 3], i) for j in range(3))) for i in range(40)]
    rows += [(40, None), (41, "short"), (None, "no number stands in this long paragraph")]
    df = spark.createDataFrame(rows, "id int, body string").repartition(4)
    out = unstructured.run_text_advisory(
        df, "id", "body", directive={"number": (r"order ([0-9]+)", "int")}, task=rules.REGRESSION, target="sentiment_score",
        candidates=["Linear Regression (OLS)"], min_rows=10,
    )
    records = {(r["key"], r["pos"]): r for r in out.records.collect()}
    assert set(records) == {(i, j) for i in range(40) for j in range(3)}
    assert all(r["number"] == 10 * i + j and r["category"] == "Delivery" for (i, j), r in records.items())
    assert [(r["key"], r["reason"]) for r in out.rejects.collect()] == [(None, "no field found")]
    assert out.advisory.champion == "Linear Regression (OLS)" and out.advisory.report.count() > 0
    with pytest.raises(ValueError):
        unstructured.text_table(df, "id", "body", directive={"category": ("(x)", "string")})
