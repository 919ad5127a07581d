from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prepaudit.operators import clean, encode, impute, profile, scale


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_placeholders_and_white_space(spark):
    df = spark.createDataFrame([(" ?", "\t a b \n"), ("x", "N/A"), (None, "")], "a string, b string")
    assert rows(clean.placeholders_to_null(df, ["?", "N/A"])) == [(None, "a b"), ("x", None), (None, "")]


def test_differs_keeps_nulls(spark):
    df = spark.createDataFrame([("O",), (None,), ("F",)], "c string")
    assert rows(clean.keep_rows(df, clean.differs(F.col("c"), "O"))) == [(None,), ("F",)]


def test_fixed_bins_are_right_open(spark):
    df = spark.createDataFrame([(0,), (24,), (25,), (100,), (-1,), (None,)], "a int")
    got = rows(df.select(clean.fixed_bins(F.col("a"), [0, 25, 100], ["young", "old"])))
    assert [g[0] for g in got] == ["young", "young", "old", None, None, None]
    with pytest.raises(ValueError):
        clean.fixed_bins(F.col("a"), [0, 1], ["a", "b"])


def test_required_columns_fail_before_any_job(spark):
    with pytest.raises(ValueError, match="y"):
        clean.require_columns(spark.range(1), ["id", "y"])


def test_duration_reads_text_leniently_and_rounds_down(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00", "2020-01-03 09:00:00"), ("2020-01-02", "2020-01-01 23:00:00"),
                                ("soon", "2020-01-01")], "a string, b string")
    stage = clean.DurationDays(startCol="a", endCol="b", outputCol="days")
    assert rows(stage.transform(df)) == [(1.0,), (-1.0,), (None,)]


def test_duration_ignores_clock_changes(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2020-03-07 00:00:00", "2020-03-09 00:00:00")], "a string, b string")
        typed = df.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in df.columns])
        for frame in (df, typed):
            assert rows(clean.DurationDays(startCol="a", endCol="b").transform(frame)) == [(2.0,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_tokens_and_rare_values(spark):
    df = spark.createDataFrame([("Braund, Mr. Owen",), ("no mark",)], "n string")
    assert rows(df.select(clean.token_between(F.col("n"), ",", "."))) == [("Mr",), (None,)]
    many = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    assert sorted(rows(clean.keep_frequent(many, "c", 2))) == [("Rare",), ("a",), ("a",), ("a",)]


def test_recode_in_one_column_or_everywhere(spark):
    df = spark.createDataFrame([("Medium", "Medium")], "a string, b string")
    assert rows(clean.recode(df, "Medium", "Low", ["a"])) == [("Low", "Medium")]
    assert rows(clean.recode(df, "Medium", "Low")) == [("Low", "Low")]


def test_generalise_hides_rare_groups(spark):
    df = spark.createDataFrame([("x", "p")] * 5 + [("y", "p"), ("z", "q")], "a string, b string")
    sizes = clean.group_sizes(clean.generalise(df, ["a", "b"], 2), ["a", "b"])
    assert sorted(rows(sizes)) == [("anon", "anon", 1), ("anon", "p", 1), ("x", "p", 5)]


def test_fills_by_strategy(spark):
    df = spark.createDataFrame([(1.0, 4.0, "b", None), (None, None, None, None), (3.0, 1.0, "a", None), (8.0, 2.0, None, 1)],
                               "m double, d double, t string, c int")
    got = impute.fit_fills(df, {"m": "mean", "d": "median", "t": "mode", "c": ("constant", 9)}).first()
    assert tuple(got) == (4.0, 2.0, "a", 9)
    with pytest.raises(ValueError):
        impute.fit_fills(df, {"m": "guess"})


def test_mode_keeps_the_type_of_its_column(spark):
    df = spark.createDataFrame([(2**60 + 1,), (2**60 + 1,), (2**60 + 3,), (None,)], "x long")
    filled = impute.impute(df, {"x": "mode"})
    assert filled.dtypes == [("x", "bigint")] and rows(filled)[-1] == (2**60 + 1,)


def test_mode_of_numbers_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(5.0,), (2.0,), (2.0,), (5.0,), (None,)], "x double")
    assert impute.fit_fills(df, {"x": "mode"}).first()["x"] == 2.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=6))
def test_test_rows_never_change_a_fill(spark, extra):
    train = [("train", 1.0, "a"), ("train", 5.0, "b"), ("train", None, "b")]
    df = spark.createDataFrame(train + [("test", x, "zz") for x in extra], "split string, x double, t string")
    filled = impute.impute(df, {"x": "median", "t": "mode"}, F.col("split") == "train")
    assert sorted(r["x"] for r in filled.filter("split = 'train'").collect()) == [1.0, 3.0, 5.0]


def test_regression_imputation_recovers_a_line(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1 if i % 5 else None) for i in range(50)], "a double, b double")
    got = impute.impute_regression(df, ["a", "b"], rounds=3)
    worst = got.agg(F.max(F.abs(F.col("b") - 2 * F.col("a") - 1))).first()[0]
    assert worst < 1e-6 and got.columns == ["a", "b"]


def test_label_codes_and_unseen_values(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    codes = encode.label_codes(train, "c")
    assert sorted(rows(codes)) == [("a", 0), ("b", 1)]
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    assert sorted(rows(encode.ordinal_encode(new, "c", codes, "k"))) == [("a", 0), ("z", -1)]
    with pytest.raises(PySparkException, match="unseen value"):
        encode.label_encode(new, "c", codes, "k").collect()


def test_one_hot_variants(spark):
    df = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")
    assert rows(encode.one_hot(df, "c", ["a", "b"])) == [(1, 0), (0, 1), (0, 0), (0, 0)]
    assert encode.one_hot(df, "c", ["a", "b"], drop_first=True).columns == ["c_b"]


def test_aligning_fills_and_drops(spark):
    df = spark.createDataFrame([(1, 2)], "b int, extra int")
    assert rows(encode.align_columns(df, ["a", "b"])) == [(0, 1)]


def test_bins_clamp_to_the_fitted_range(spark):
    df = spark.createDataFrame([("train", 0.0), ("train", 10.0), ("test", -5.0), ("test", 99.0), ("test", 5.0)],
                               "split string, x double")
    got = encode.uniform_bins(df, "x", 4, "bin", F.col("split") == "train").select("bin")
    assert [r[0] for r in rows(got)] == [0, 3, 0, 3, 2]


def test_scaling_without_spread_and_zero_rows(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, 0.0)], "a double, b double")
    for method in scale.FITS:
        assert rows(scale.scale(df, ["a"], method)) == [(0.0, 0.0), (0.0, 0.0)]
    both = spark.createDataFrame([(3.0, 4.0), (0.0, 0.0)], "a double, b double")
    assert rows(scale.normalise_rows(both, ["a", "b"])) == [(0.6, 0.8), (0.0, 0.0)]
    vectors = both.select(F.array("a", "b").alias("v")).select(scale.normalise_vector(F.col("v")))
    assert [list(r[0]) for r in vectors.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_featurise_is_fitted_on_train_rows_only(spark):
    df = spark.createDataFrame([("train", 1.0, "a", 7), ("train", 3.0, "b", 7), ("test", None, "new", 7)],
                               "split string, x double, c string, other int")
    spec = encode.Features(numeric=["x"], categorical=["c"], keep=["split"])
    got = encode.featurise(df, spec, F.col("split") == "train")
    assert rows(got) == [("train", -1.0, 1, 0), ("train", 1.0, 0, 1), ("test", 0.0, 0, 0)]
    through = encode.featurise(df, encode.Features(numeric=["x"], remainder="passthrough", scaler=None))
    assert "other" in through.columns


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 4.0), (None, 2.0)], "c string, x double")
    assert sorted(rows(profile.value_shares(df, "c"))) == [("a", 2, 0.67), ("b", 1, 0.33)]
    assert dict((r[0], r[1]) for r in rows(profile.null_profile(df))) == {"c": 1, "x": 1}
    assert (None, 1) in rows(profile.group_counts(df, "c"))
    shares = profile.value_shares(df.withColumn("k", F.lit(1)), "c", None, ["k"])
    assert sorted((r["c"], r["share"]) for r in shares.collect()) == [("a", 2 / 3), ("b", 1 / 3)]
    assert rows(profile.info(df)) == [("c", "string", 3), ("x", "double", 3)]
    assert rows(profile.shape(df)) == [(4, 2)]
    flag = profile.imbalance(spark.createDataFrame([(0,)] * 9 + [(1,)], "y int"), "y").first()
    assert flag["imbalanced"] and flag["classes"] == 2
    summary = profile.describe_by(df, ["x"]).first()
    assert (summary["count"], summary["min"], summary["q50"], summary["max"]) == (3, 1.0, 2.0, 4.0)


def test_rollup_to_a_constant_loses_all_detail(spark):
    df = spark.createDataFrame([("a", "all"), ("b", "all")], "c string, r string")
    got = {r["side"]: (r["distinct_values"], round(r["entropy"], 6)) for r in profile.granularity(df, "c", "r").collect()}
    assert got == {"before": (2, 0.693147), "after": (1, 0.0)}


def test_the_regression_query_iterates(spark, tmp_path, monkeypatch):
    """The registered query leaves the number of rounds to the operator, which goes through the columns more than once."""
    import inspect

    from prepaudit.plans import tabular
    spark.createDataFrame([(1, 1, 2.0, 3.0, 0.05)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    original, given = impute.impute_regression, {}
    monkeypatch.setattr(tabular.impute, "impute_regression", lambda df, columns, **options: given.update(options) or df)
    tabular.impute_regression(spark, str(tmp_path))
    assert given.get("rounds", inspect.signature(original).parameters["rounds"].default) >= 2


def test_wide_categories_stay_one_column(spark):
    df = spark.createDataFrame([(i, f"v{i % 9}", "a" if i % 2 else "b", i < 30) for i in range(40)], "id int, wide string, small string, known boolean")
    spec = encode.Features(numeric=[], categorical=["wide", "small"], scaler=None, keep=["id"], widest=5)
    out = encode.featurise(df, spec, F.col("known"))
    assert out.columns == ["id", "wide__place", "small_a", "small_b"]
    assert {r["wide__place"] for r in out.collect()} == set(range(9))
    assert encode.category_lists(df, ["wide", "small"], 5) == {"wide": None, "small": ["a", "b"]}
    with pytest.raises(ValueError, match="more than 5"):
        encode.categories(df, "wide", 5)


def test_empty_mapping_gives_nulls(spark):
    assert spark.range(2).select(clean.map_values(F.col("id"), {}).alias("x")).filter("x IS NOT NULL").count() == 0
