"""Hand-computed cases for profile, cleaning, features, split, order statistics and parity."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions.columns import normalise, py_round_half_up, round_half_up
from tablewright.functions.counts import is_present, key_counts, modes, smallest
from tablewright.functions.ranks import exact_medians
from tablewright.operators import clean, features, parity, profile, profile_state, rules, split, synth


def frame(spark, rows, schema, parts=1):
    return spark.createDataFrame(rows, schema).repartition(parts)


# ---- profile ---------------------------------------------------------------------------------


def test_profile_counts_nan_as_null_and_bool_as_numeric(spark):
    df = frame(spark, [(1.0, True, "b"), (float("nan"), False, "a"), (None, None, "a")], "x double, y boolean, z string")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert (rows["x"]["null_count"], rows["x"]["null_pct"], rows["x"]["unique_values"]) == (2, 66.67, 1)
    assert (rows["y"]["min"], rows["y"]["max"]) == (0.0, 1.0)
    assert rows["z"]["sample_values"] == ["a", "b"] and rows["z"]["min"] is None
    assert rows["x"]["num_rows"] == 3


def test_profile_of_empty_table(spark):
    rows = profile.profile(frame(spark, [], "x int, y string")).collect()
    assert [(r["column"], r["num_rows"], r["unique_values"], r["sample_values"]) for r in sorted(rows)] == [
        ("x", 0, 0, []),
        ("y", 0, 0, []),
    ]


def test_profile_of_arrays_and_odd_names(spark):
    df = frame(spark, [([1, 2], 1), ([1, 2], 2)], "`a.b` array<int>, `c d` int")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert rows["a.b"]["unique_values"] == 1 and rows["a.b"]["sample_values"] == ["[1,2]"]
    assert rows["c d"]["unique_values"] == 2


def test_map_columns_are_rejected(spark):
    with pytest.raises(ValueError):
        normalise(spark.sql("select map('a', 1) as m"))


def test_smallest_values_and_key_counts_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "", "b" * 9, f"t{rng.randrange(40)}"]), rng.choice([None, -1.5, 2.0, float(rng.randrange(9))]), None)
            for _ in range(500)]
    df = frame(spark, rows, "t string, x double, none int", parts=7)
    got = smallest(df, df.columns, 3).first()
    for i in range(2):
        values = sorted({r[i] for r in rows if r[i] is not None})
        assert list(got[i]) == [str(v) for v in values[:3]]
    assert list(got[2]) == []
    counts = key_counts(df, df.columns)
    for i in range(3):
        mine = counts.where(F.col("pos") == i)
        assert mine.where(is_present(counts)).count() == len({r[i] for r in rows if r[i] is not None})
        assert mine.agg(F.sum("n")).first()[0] == 500


def test_profile_moves_no_text_through_the_exchange(spark):
    df = frame(spark, [("x" * 5000, 1), ("y" * 5000, 2), (None, 3)], "t string, k int", parts=3)
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert rows["t"]["unique_values"] == 2 and rows["t"]["null_count"] == 1
    assert [v[0] for v in rows["t"]["sample_values"]] == ["x", "y"]
    counts = key_counts(df, df.columns)
    assert not any("string" in kind for _, kind in counts.dtypes)


def test_states_of_batches_merge_to_the_profile_of_the_whole(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.gauss(50, 20) if i % 11 else None, f"name {rng.randrange(3000)}", i % 3 == 0) for i in range(20000)]
    df = frame(spark, rows, "k long, x double, t string, b boolean", parts=5)
    path = str(tmp_path / "states")
    for batch in range(4):
        profile_state.add_batch(df.where(F.col("k") % 4 == batch), path, f"b{batch}")
    profile_state.add_batch(df.where("k % 4 = 2"), path, "b2")  # repeated after a failure
    got = {r["column"]: r for r in profile_state.merged(profile_state.read_batches(spark, path)).collect()}
    want = {r["column"]: r for r in profile.profile(df).collect()}
    for name, w in want.items():
        g = got[name]
        for field in ("position", "dtype", "num_rows", "null_count", "null_pct", "min", "max"):
            assert g[field] == w[field], (name, field)
        assert abs(g["unique_estimate"] - w["unique_values"]) <= max(1, 0.07 * w["unique_values"])
    for name, place in (("k", 0), ("x", 1)):
        values = sorted(r[place] for r in rows if r[place] is not None)
        for share, value in zip(profile_state.QUANTILES, got[name]["quantiles"]):
            assert abs(sum(v <= value for v in values) / len(values) - share) < 0.03
    assert got["t"]["quantiles"] is None
    two = profile_state.merged(profile_state.read_batches(spark, path, ["b0", "b1"])).first()
    assert two["num_rows"] == 10000


def test_states_of_empty_batches_and_of_changing_columns(spark, tmp_path):
    path = str(tmp_path / "states")
    profile_state.add_batch(frame(spark, [], "x int, y string"), path, "a")
    profile_state.add_batch(frame(spark, [(1.5, None), (float("nan"), None)], "x double, z int"), path, "b")
    got = {r["column"]: r for r in profile_state.merged(profile_state.read_batches(spark, path)).collect()}
    assert got["x"]["dtype"] == "double" and got["x"]["null_count"] == 1 and got["x"]["max"] == 1.5
    assert got["y"]["null_count"] == got["y"]["num_rows"] == 2 and got["z"]["quantiles"] is None
    with pytest.raises(ValueError):
        profile_state.add_batch(frame(spark, [(1,)], "x int"), path, "a/b")


# ---- order statistics ------------------------------------------------------------------------


@pytest.mark.parametrize("values, expected", [([1, 2, 3, 4], 2.5), ([5], 5.0), ([3, 1, 2], 2.0), ([7, 7, 7, 1], 7.0)])
def test_median(spark, values, expected):
    df = frame(spark, [(v,) for v in values], "x int")
    assert exact_medians(df, ["x"]) == {"x": expected}


def test_median_of_nothing(spark):
    assert exact_medians(frame(spark, [(None,)], "x double"), ["x"]) == {"x": None}


@pytest.mark.parametrize("accuracy, bracket", [(10_000, 2_000_000), (20, 50), (5, 10)])
def test_median_narrows_to_the_exact_value(spark, accuracy, bracket):
    rng = random.Random(3)
    plain = [rng.gauss(0, 1) for _ in range(4001)]
    hot = [0.25] * 1500 + [rng.uniform(0, 1) for _ in range(2500)]  # one value holds a third of the rows
    heavy = [1.0] * 2000 + [2.0 + i for i in range(2001)]
    rows = list(zip(plain, hot + [None], heavy))
    got = exact_medians(frame(spark, rows, "a double, b double, c double", 7), ["a", "b", "c"], accuracy, bracket)
    assert got["a"] == sorted(plain)[2000]
    s = sorted(hot)
    assert got["b"] == (s[1999] + s[2000]) / 2
    assert got["c"] == sorted(heavy)[2000]


def test_mode_ties_go_to_the_smallest(spark):
    df = frame(spark, [("b", 2, None), ("a", 1, None), ("b", 2, None), ("a", 1, None)], "s string, i int, n string")
    assert modes(df, ["s", "i", "n"]) == {"s": "a", "i": 1}


# ---- cleaning --------------------------------------------------------------------------------


def test_negative_then_median(spark):
    df = frame(spark, [(-1,), (2,), (4,)], "x int")
    out, log = clean.clean(df, clean.CleaningRecipe(replace_negatives_with_null=("x",), impute_median=("x",)))
    assert sorted(r[0] for r in out.collect()) == [2.0, 3.0, 4.0]
    assert [(r["action"], r["n_affected"], r["fill_value"]) for r in log.orderBy("step").collect()] == [
        ("negative_to_null", 1, None),
        ("impute_median", 1, "3.0"),
    ]


def test_median_of_whole_numbers_stays_fractional(spark):
    out, _ = clean.clean(frame(spark, [(1,), (2,), (None,)], "x int"), clean.CleaningRecipe(impute_median=("x",)))
    assert sorted(r[0] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_clean_log_rules(spark):
    df = frame(spark, [(1, "a", None), (2, None, None), (None, "a", None)], "x int, s string, e string")
    recipe = clean.CleaningRecipe(
        replace_negatives_with_null=("x", "s"), impute_median=("s", "gone"), impute_mode=("s", "e"),
        drop_rows_with_nulls_in=("x", "s"), drop_columns=("e", "gone"),
    )
    out, log = clean.clean(df, recipe)
    assert out.columns == ["x", "s"] and sorted(map(tuple, out.collect())) == [(1, "a"), (2, "a")]
    got = [(r["action"], r["column"], r["n_affected"]) for r in log.orderBy("step").collect()]
    assert got == [("impute_mode", "s", 1), ("drop_rows", "x", 1), ("drop_rows", "s", 0), ("drop_column", "e", 0)]


def test_rows_are_dropped_by_the_first_missing_column(spark):
    df = frame(spark, [(None, None), (1, None), (None, 2), (3, 4)], "a int, b int")
    _, log = clean.clean(df, clean.CleaningRecipe(drop_rows_with_nulls_in=("b", "a")))
    assert [(r["column"], r["n_affected"]) for r in log.orderBy("step").collect()] == [("b", 2), ("a", 1)]


def test_mode_fill_of_dates_keeps_the_type(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-02'), (timestamp_ntz'2024-01-02'), (null) as t(d)")
    out, _ = clean.clean(df, clean.CleaningRecipe(impute_mode=("d",)))
    assert out.schema["d"].dataType.simpleString() == "timestamp_ntz"
    assert out.where("d = timestamp_ntz'2024-01-02'").count() == 3


# ---- rules -----------------------------------------------------------------------------------


def _columns(*rows):
    return [rules.ColumnProfile(*r) for r in rows]


def test_intent_rules():
    cols = _columns(("id", "bigint", 100, 0, 100), ("Status", "string", 100, 0, 3), ("price", "double", 100, 0, 90))
    assert rules.infer_intent(cols).target == "Status"
    assert rules.infer_intent(cols, "Segment the users").task == rules.CLUSTERING
    assert rules.infer_intent(cols, "forecast price") == rules.Intent(rules.REGRESSION, "price", "the goal names price")
    assert rules.infer_intent(_columns(("a", "int", 10, 0, 5))).target is None
    with pytest.raises(ValueError):
        rules.resolve_task("Ranking")
    assert rules.resolve_task(None) == rules.CLUSTERING


def test_recipe_rules():
    cols = _columns(
        ("id", "bigint", 100, 0, 100), ("const", "string", 100, 0, 1), ("x", "double", 100, 5, 90),
        ("s", "string", 100, 5, 9), ("y", "string", 100, 2, 2), ("age", "int", 100, 0, 40),
    )
    r = rules.derive_recipe(cols, "y")
    assert r.drop_columns == ("id", "const") and r.impute_mode == ("s",)
    assert r.impute_median == ("x", "age") and r.replace_negatives_with_null == ("age",)
    assert r.drop_rows_with_nulls_in == ("y",)


# ---- features --------------------------------------------------------------------------------


def test_weekday_counts_monday_as_zero(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' as d")
    row = features.fit_features(df).transform(df).first()
    assert (row["d_year"], row["d_month"], row["d_day"], row["d_dayofweek"]) == (2024.0, 1.0, 1.0, 0.0)


def test_empty_and_useless_tables_give_a_bias(spark):
    empty = frame(spark, [], "x int")
    assert features.fit_features(empty).transform(empty).columns == [features.BIAS]
    ids = frame(spark, [(f"id{i}",) for i in range(60)], "s string")
    out = features.fit_features(ids).transform(ids)
    assert out.columns == [features.BIAS] and out.count() == 60
    hollow = frame(spark, [(None,)], "x double")
    assert features.fit_features(hollow).transform(hollow).first()[0] == 1.0


def test_indicators(spark):
    df = frame(spark, [("b", True, 1), ("a", None, None), (None, False, 3)], "s string, f boolean, x int")
    model = features.fit_features(df)
    assert model.columns == ["x", "f", "s_b"]
    assert sorted(map(tuple, model.transform(df).collect())) == [(1.0, 1.0, 1.0), (2.0, 0.0, 0.0), (3.0, 0.0, 0.0)]


def test_unparsed_dates_take_the_default(spark):
    df = frame(spark, [("2024-01-02",), ("2024/02/03",), ("bad",)], "order_date string")
    rows = sorted(tuple(r) for r in features.fit_features(df).transform(df).collect())
    assert rows == [(2024.0, 1.0, 2.0, 1.0), (2024.0, 2.0, 3.0, 5.0), (2026.0, 1.0, 1.0, 0.0)]


def test_few_parsed_dates_stay_text(spark):
    df = frame(spark, [("2024-01-02",), ("x",), ("y",)], "order_date string")
    assert features.fit_features(df).date_texts == ()


def test_wide_column_turns_into_a_sparse_vector(spark):
    df = frame(spark, [(f"v{i:02d}",) for i in range(12)] * 5 + [(None,)], "s string")
    model = features.fit_features(df, max_indicators=10)
    rows = model.transform(df, keep=["s"]).collect()
    assert model.columns == [] and model.vectors == ["s_onehot"]
    for r in rows:
        v = r["s_onehot"]
        assert v.size == 11 and sum(v.toArray()) == (0.0 if r["s"] in (None, "v00") else 1.0)


def test_constant_column_keeps_its_scale(spark):
    df = frame(spark, [(0.1, 1.0), (0.1, 3.0), (0.1, 5.0)], "c double, x double")
    rows = features.fit_standardiser(df, ["c", "x"]).transform(df).collect()
    assert all(abs(r["c"]) < 1e-12 for r in rows)
    assert py_round_half_up(max(r["x"] for r in rows), 6) == 1.224745


def test_label_codes(spark):
    df = frame(spark, [("b",), ("a",), (None,)], "y string")
    assert {r["y"]: r["label_code"] for r in features.label_encode(df, "y").collect()} == {"a": 0, "b": 1, None: -1}


# ---- split -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n, sizes", [(100, (70, 15, 15)), (101, (70, 15, 16)), (1, (1, 0, 0)), (7, (4, 1, 2))])
@pytest.mark.parametrize("parts", [1, 7])
def test_split_sizes(spark, n, sizes, parts):
    out = split.split_70_15_15(spark.range(n).repartition(parts), key="id")
    got = {r["split"]: r["n"] for r in split.split_counts(out).collect()}
    assert tuple(got.get(p, 0) for p in ("train", "val", "test")) == sizes


def test_split_does_not_depend_on_partitions(spark):
    one = {r["id"]: r["split"] for r in split.split_70_15_15(spark.range(500).repartition(1), key="id").collect()}
    seven = {r["id"]: r["split"] for r in split.split_70_15_15(spark.range(500).repartition(7), key="id").collect()}
    other = {r["id"]: r["split"] for r in split.split_70_15_15(spark.range(500), key="id", seed=7).collect()}
    assert one == seven and one != other


def test_stratified_split(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 1, F.lit("y")).when(F.col("id") < 100, F.lit("x")).alias("c"))
    out = split.split_70_15_15(df, key="id", stratify="c")
    got = {(r["c"], r["split"]): r["n"] for r in out.groupBy("c", "split").agg(F.count("*").alias("n")).collect()}
    assert got[("y", "train")] == 1 and ("y", "test") not in got
    assert [got[("x", p)] for p in ("train", "val", "test")] == [69, 15, 15]
    assert [got[(None, p)] for p in ("train", "val", "test")] == [70, 15, 15]


def test_copies_split_exactly(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("v")).repartition(5)
    out = split.split_70_15_15(df)
    got = {r["split"]: r["n"] for r in split.split_counts(out).collect()}
    assert got == {"train": 2100, "val": 450, "test": 450}
    assert out.groupBy("v").count().exceptAll(df.groupBy("v").count()).count() == 0


def test_many_classes_split_by_join(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_LOCAL_CUTS", 3)
    df = spark.range(400).withColumn("c", F.col("id") % 4)
    out = split.split_70_15_15(df, key="id", stratify="c")
    got = {(r["c"], r["split"]): r["n"] for r in out.groupBy("c", "split").agg(F.count("*").alias("n")).collect()}
    assert all(got[(c, p)] == s for c in range(4) for p, s in (("train", 70), ("val", 15), ("test", 15)))


@pytest.mark.parametrize("limit", [100_000, 3])
def test_copies_within_classes_split_exactly(spark, monkeypatch, limit):
    monkeypatch.setattr(split, "MAX_LOCAL_CUTS", limit)
    rows = spark.range(1200).select((F.col("id") % 6).alias("c"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7).alias("v"))
    out = split.split_70_15_15(rows.repartition(5), stratify="c")
    got = {(r["c"], r["split"]): r["n"] for r in out.groupBy("c", "split").agg(F.count("*").alias("n")).collect()}
    assert all(got[(c, p)] == s for c in range(6) for p, s in (("train", 140), ("val", 30), ("test", 30)))
    assert out.drop("split").exceptAll(rows).count() == 0


def test_whole_words_decide(spark):
    from tablewright.operators import rules

    assert not rules.never_negative("account_balance") and not rules.never_negative("percentage_change")
    assert not rules.never_negative("l_discount") and rules.never_negative("l_quantity") and rules.never_negative("unitPrice")
    assert not rules.never_negative("amount_diff") and rules.never_negative("Ages")
    cols = _columns(("id", "int", 10, 0, 10), ("m", "int", 10, 0, 5), ("segment_code", "string", 100, 0, 4))
    assert rules.infer_intent(cols, "identify the drivers").target != "id"
    assert rules.infer_intent(cols, "which customers leave").target != "m"
    assert rules.infer_intent(cols, "predict segment_code").target == "segment_code"
    assert rules.infer_intent(cols, "predict id").target != "id"
    assert rules.infer_intent(cols, "find segments").task == rules.CLUSTERING


def test_tails_at_many_degrees_of_freedom():
    import math

    from tablewright.functions.tails import chi2_sf, f_sf, t_two_sided

    normal = math.erfc(0.5 / math.sqrt(2))
    assert t_two_sided(0.5, 1e13) == pytest.approx(normal, rel=1e-9) and t_two_sided(0.5, 1e15) == pytest.approx(normal, rel=1e-9)
    assert f_sf(2, 4, 1e12) == pytest.approx(5 * math.exp(-4), rel=1e-9)  # four chi-square degrees in the limit
    assert chi2_sf(10, 4) == pytest.approx(6 * math.exp(-5), rel=1e-12)
    assert f_sf(3, 2, 50) == pytest.approx((50 / 56) ** 25, rel=1e-12)
    assert t_two_sided(2.0, 10) == pytest.approx(f_sf(4.0, 1, 10), rel=1e-12)
    for a, b in ((1.9e5, 2.1e5), (0.99e9, 1.01e9)):  # no step where the method changes
        assert t_two_sided(1.7, a) == pytest.approx(t_two_sided(1.7, b), rel=1e-5)
        assert f_sf(1.3, 300, a) == pytest.approx(f_sf(1.3, 300, b), rel=1e-2)
        assert f_sf(1 + 3 / math.sqrt(a), a, a) == pytest.approx(f_sf(1 + 3 / math.sqrt(b), b, b), rel=1e-2)


def test_dense_row_index(spark):
    out = split.dense_row_index(spark.range(1000).repartition(7).where("id % 3 = 0"))
    assert sorted(r["row_index"] for r in out.collect()) == list(range(334))


# ---- synthesis -------------------------------------------------------------------------------


@pytest.mark.parametrize("kinds", [2, 63, 64, 65, 200])
def test_categories_are_redrawn_in_one_way(spark, kinds):
    """A drawn value is that of a row, whose place depends on the seed and the column alone, however many values there are."""
    rows = [(i, f"v{i % kinds:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, name string").coalesce(1)
    new = synth.synthesise(df, 1_000, 900, seed=5)[0].where("is_synthetic")
    same = synth.synthesise(df.withColumn("name", F.col("k").cast("string")), 1_000, 900, seed=5)[0].where("is_synthetic")
    drawn = [r["name"] for r in new.collect()]
    assert [f"v{int(r['name']) % kinds:03d}" for r in same.collect()] == drawn and len(set(drawn)) > min(kinds, 200) * 0.9


def _tiny(spark):
    rows = [(i, float(i) if i % 4 else None, f"n{i}", "ab"[i % 2]) for i in range(20)]
    return frame(spark, rows, "k int, x double, name string, g string")


def test_sparse_table_grows(spark):
    out, grown = synth.synthesise(_tiny(spark))
    new = out.where("is_synthetic")
    assert grown and out.count() == 100 and new.count() == 80
    assert {r[0] for r in new.select("g").distinct().collect()} <= {"a", "b"}
    assert {r[0] for r in new.select("name").distinct().collect()} <= {f"n{i}" for i in range(20)}
    assert new.where("abs(k) > 30").count() == 0
    assert 0 < new.where("x is null").count() < 50


def test_growth_is_reproducible_and_independent_of_partitions(spark):
    a = synth.synthesise(_tiny(spark).coalesce(1).sortWithinPartitions("k"))[0].collect()
    b = synth.synthesise(_tiny(spark).coalesce(1).sortWithinPartitions("k"))[0].collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_joint_growth_keeps_rows_together(spark):
    out, _ = synth.synthesise(_tiny(spark), joint=True)
    pairs = {(r["name"], r["g"]) for r in _tiny(spark).collect()}
    assert {(r["name"], r["g"]) for r in out.where("is_synthetic").collect()} <= pairs


def test_large_pool_is_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(synth, "SMALL_TABLE", 5)
    out, _ = synth.synthesise(_tiny(spark).withColumn("g", F.when(F.col("k") > 5, F.col("g"))))
    new = out.where("is_synthetic")
    assert new.count() == 80 and new.where("g is null").count() == 0


def test_large_table_stays(spark):
    out, grown = synth.synthesise(spark.range(30).withColumn("x", F.rand(1)))
    assert not grown and out.count() == 30 and out.where("is_synthetic").count() == 0


# ---- parity ----------------------------------------------------------------------------------


def test_parity_null_outcome_stays_in_the_denominator(spark):
    df = frame(spark, [("a", 1), ("a", None), ("a", 1), ("b", 1), (None, 1)], "g string, o int")
    rows = {r["cohort"]: r for r in parity.parity_audit(df, "g", "o").collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["rate"] == 0.6667 and rows["a"]["n"] == 3
    assert rows["a"]["violation"] and rows["a"]["ratio"] == 0.667


def test_parity_zero_benchmark(spark):
    df = frame(spark, [("a", 0), ("b", 0)], "g string, o int")
    rows = parity.parity_audit(df, "g", "o", favorable=1).collect()
    assert {r["ratio"] for r in rows} == {1.0} and not any(r["violation"] for r in rows)
    assert parity.parity_verdict(df, "g", "o", favorable=1).first()["status"] == "PASS"


def test_parity_edge_ratio_passes(spark):
    rows = [("a", 1)] * 100 + [("b", 1)] * 3998 + [("b", 0)] * 1002
    verdict = parity.parity_verdict(frame(spark, rows, "g string, o int"), "g", "o").first()
    assert verdict["status"] == "PASS" and verdict["benchmark_cohort"] == "a"


def test_parity_default_is_the_mode_for_text(spark):
    df = frame(spark, [("a", "y"), ("a", "x"), ("b", "y"), ("b", "x")], "g string, o string")
    assert parity.parity_verdict(df, "g", "o").first()["favorable"] == "x"


def test_parity_without_cohorts_and_missing_column(spark):
    df = frame(spark, [(None, 1)], "g string, o int")
    assert parity.parity_verdict(df, "g", "o").first()["status"] == "ERROR"
    with pytest.raises(ValueError):
        parity.parity_audit(df, "g", "absent")


def test_parity_reads_the_table_once(spark, tmp_path):
    frame(spark, [("a", 1), ("b", 0)], "g string, o int").write.parquet(str(tmp_path / "t"))
    out = parity.parity_audit(spark.read.parquet(str(tmp_path / "t")), "g", "o")
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") <= 1


def test_rounding_is_floor_based(spark):
    df = frame(spark, [(0.7995,), (1.005,), (float("nan"),), (None,)], "x double")
    got = {r[0] for r in df.select(round_half_up(F.col("x"), 3)).collect()}
    assert got == {0.8, 1.005, None}
