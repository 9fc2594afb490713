import random
from collections import Counter
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from datasonde.operators import columns as C
from datasonde.operators import frequency
from datasonde.operators.frequency import distinct_counts, first_texts, modes, top_values


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_moments_match_pandas(spark, frame):
    rng = np.random.default_rng(0)
    a, b = rng.gamma(1.0, 3.0, 400), rng.normal(10, 2, 400)
    df = spark.createDataFrame([(float(x), float(y), 7) for x, y in zip(a, b)], "a double, b double, c int")
    got = by_column(C.numeric_moments(df))
    for name, values in (("a", a), ("b", b)):
        s = pd.Series(values)
        assert got[name]["mean"] == pytest.approx(s.mean())
        assert got[name]["std"] == pytest.approx(s.std())
        assert got[name]["skew"] == pytest.approx(s.skew())
        assert got[name]["kurtosis"] == pytest.approx(s.kurtosis())
    assert (got["c"]["skew"], got["c"]["kurtosis"], got["c"]["std"]) == (0.0, 0.0, 0.0)


def test_numeric_extras(make):
    df = make("x double", x=[0.0, -1.0, 2.0, 3.0, 2.0, None])
    row = by_column(C.numeric_moments(df))["x"]
    assert (row["n"], row["n_zeros"], row["n_negative"]) == (5, 1, 1)
    assert by_column(modes(df, ["x"]))["x"]["mode"] == 2.0


def test_short_columns_have_no_skew(make):
    row = by_column(C.numeric_moments(make("x double", x=[1.0, 2.0])))["x"]
    assert row["skew"] is None and row["kurtosis"] is None


def test_mode_takes_the_smallest_on_ties(make):
    assert by_column(modes(make("x long", x=[5, 5, 3, 3, 9]), ["x"]))["x"]["mode"] == 3.0


def test_nan_counts_as_missing(make):
    df = make("x double, s string", x=[1.0, float("nan"), None], s=["a", None, "b"])
    got = by_column(C.missing_counts(df))
    assert (got["x"]["n_missing"], got["x"]["pct_missing"]) == (2, 66.67)
    assert got["s"]["n_missing"] == 1
    assert by_column(distinct_counts(df))["x"]["n_unique"] == 1


def test_distinct_counts_stay_exact_above_2_to_53(make):
    big = 2**53
    df = make("x long", x=[big, big + 1, big + 2, big])
    assert by_column(distinct_counts(df))["x"]["n_unique"] == 3


def test_iqr_outliers(make):
    df = make("x double, y double", x=[14.0, 7.0, 90.0, 12.0, 9.0, 15.0, 10.0], y=[3.0] * 6 + [8.0])
    row = by_column(C.outlier_stats(df, ["x", "y"]))
    assert (row["x"]["lower"], row["x"]["upper"]) == (2.0, 22.0)
    assert (row["x"]["n_outliers"], row["x"]["pct_outliers"]) == (1, 14.29)
    assert (row["y"]["lower"], row["y"]["n_outliers"]) == (None, 0)  # no spread, no fences
    assert [r["value"] for r in C.outlier_examples(df, ["x"]).collect()] == [90.0]


def test_outlier_examples_are_farthest_first_and_repeat(make):
    values = [float(v) for v in range(26)] + [1000.0, 1005.0, 1005.0, 1004.0]
    found = C.outlier_examples(make("x double", x=values), ["x"]).orderBy("rank").collect()
    assert [r["value"] for r in found] == [1005.0, 1005.0, 1004.0]


def test_outlier_columns_report_both_shares(make):
    df = make("x double", x=[14.0, None, 7.0, 90.0, 12.0, None, 9.0, 15.0, 10.0])
    row = C.outlier_columns(df).first()
    assert (row["n_outliers"], row["pct_outliers"], row["pct_rows"], row["examples"]) == (1, 14.29, 11.11, [90.0])


def test_datetime_span(make):
    df = make("d timestamp_ntz", d=[datetime(2024, 1, 1), datetime(2024, 1, 3, 12), None])
    row = by_column(C.datetime_spans(df))["d"]
    assert (row["min"], row["max"], row["n_valid"], row["span_days"]) == ("2024-01-01 00:00:00", "2024-01-03 12:00:00", 2, 2.5)
    assert C.datetime_spans(df.limit(1)).first()["span_days"] is None


def test_top_values_break_ties_by_text(make):
    df = make("s string, b boolean", s=["b", "a", "c", "c", None], b=[True, True, False, None, True])
    got = [(r["column"], r["rank"], r["value"], r["cnt"]) for r in top_values(df, ["s", "b"], 2).collect()]
    assert sorted(got) == [("b", 1, "True", 3), ("b", 2, "False", 1), ("s", 1, "c", 2), ("s", 2, "a", 1)]


def test_long_texts_are_counted_whole(make):
    head = "x" * 500
    df = make("s string", s=[head + "1", head + "2", head + "1", "short", head + "1"])
    assert by_column(distinct_counts(df))["s"]["n_unique"] == 3
    top = top_values(df, ["s"], 2).orderBy("rank").collect()
    assert [(r["value"], r["cnt"]) for r in top] == [(head + "1", 3), ("short", 1)]


def test_quantiles_of_all_types(make):
    from decimal import Decimal

    df = make("i int, d decimal(10,2), f float", i=[1, 2, 3, 4], d=[Decimal("1.50"), Decimal("2.50"), None, None], f=[0.5, 1.5, 2.5, 3.5])
    got = by_column(C.column_quantiles(df, ["i", "d", "f"]))
    assert (got["i"]["median"], got["d"]["median"], got["f"]["p25"]) == (2.5, 2.0, 1.25)


def test_profile_of_a_table_without_numbers(make):
    df = make("s string", s=["a", "b"])
    assert C.numeric_profile(df).collect() == []
    assert C.outlier_columns(df).collect() == []
    assert C.datetime_spans(df).collect() == []
    assert [r["column"] for r in C.column_summaries(df).collect()] == ["s"]


def test_detail_covers_all_columns_unless_a_caller_limits_it(spark):
    df = spark.range(3).selectExpr(*[f"id as c{i}" for i in range(104)], "cast(null as double) as last")
    assert C.numeric_moments(df).count() == 105
    assert C.numeric_moments(df, max_columns=100).count() == 100
    assert by_column(C.missing_counts(df))["last"]["pct_missing"] == 100.0


def test_odd_column_names(make):
    df = make("`a.b` double, `it's` string", **{"a.b": [1.0, 2.0, 9.0], "it's": ["x", "x", "y"]})
    assert by_column(C.numeric_moments(df))["a.b"]["mean"] == 4.0
    assert by_column(C.column_quantiles(df, ["a.b"]))["a.b"]["median"] == 2.0
    assert top_values(df, ["it's"], 1).first()["value"] == "x"


def test_approximations_are_close(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id % 50 as string) as s", "double(id) as x")
    got = by_column(C.approximate_distinct(df, ["id", "s"]))
    assert got["s"]["n_unique"] == pytest.approx(50, abs=5) and got["id"]["n_unique"] == pytest.approx(20_000, rel=0.2)
    assert by_column(C.approximate_quantiles(df, ["x"]))["x"]["median"] == pytest.approx(10_000, abs=5)


@pytest.mark.parametrize("steps", [(128, 1024, 8192, 65_536), (128, 140), (128,)])
def test_tied_texts_with_one_head_are_settled_by_longer_prefixes(spark, monkeypatch, steps):
    """Short and long texts, heads shared by many, ties that end within or beyond the prefixes."""
    monkeypatch.setattr(frequency, "PREFIX_STEPS", steps)
    rng = random.Random(6)
    head, far = "<html>" + "h" * 150, "<html>" + "h" * 150 + "x" * 900
    texts = [head + str(rng.randrange(10**6)) for _ in range(400)] + [far + str(rng.randrange(10**6)) for _ in range(200)]
    texts += [head, head, far, "<html>", "z", "z", head + "twice", head + "twice"]
    df = spark.createDataFrame([(t, t[::-1]) for t in texts], "a string, b string").repartition(4)
    for k in (1, 3, 8, 50):
        got = [(r["column"], r["rank"], r["value"], r["cnt"]) for r in top_values(df, ["a", "b"], k).collect()]
        for name, column in (("a", texts), ("b", [t[::-1] for t in texts])):
            counts = sorted(Counter(column).items(), key=lambda c: (-c[1], c[0]))[:k]
            assert sorted(g[1:] for g in got if g[0] == name) == [(i, v, n) for i, (v, n) in enumerate(counts, 1)]


def test_first_texts_are_distinct_before_they_are_ranked(spark):
    df = spark.createDataFrame([(f"v{i % 3}", None if i % 2 else f"w{i}") for i in range(3000)], "a string, b string").repartition(4)
    rows = first_texts(df, ["a", "b"], 5).collect()
    assert sorted((r["position"], r["rank"], r["value"]) for r in rows) == [(0, 1, "v0"), (0, 2, "v1"), (0, 3, "v2")] + [(1, i, v) for i, v in enumerate(sorted(f"w{i}" for i in range(0, 3000, 2))[:5], 1)]
