import math

import numpy as np
import pandas as pd
import pytest

from datasonde.operators import charts as V


def numbers(spark, n=500):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(5, 2, n - 3), [40.0, 41.0, -30.0]])
    return x, spark.createDataFrame([(float(v), 3) for v in x] + [(None, 3)], "x double, k int")


def test_histogram_matches_numpy(spark, frame):
    x, df = numbers(spark)
    got = frame(V.histogram(df), "bin")
    counts, edges = np.histogram(x, bins=30)
    assert set(got["column"]) == {"x"}  # a constant has no bins
    np.testing.assert_array_equal(got["cnt"], counts)
    np.testing.assert_allclose(got["low"], edges[:-1])
    np.testing.assert_allclose(got["high"], edges[1:])


def test_values_on_an_edge_match_numpy(spark, frame):
    x = [i / 10 for i in range(31)]
    got = frame(V.histogram(spark.createDataFrame([(v,) for v in x], "x double")), "bin")
    np.testing.assert_array_equal(got["cnt"], np.histogram(x, bins=30)[0])


def test_density_matches_the_formula(spark, frame):
    x, df = numbers(spark)
    got = frame(V.density(df), "point")
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi)) for g in grid]
    np.testing.assert_allclose(got["x"], grid)
    np.testing.assert_allclose(got["density"], want, atol=1e-14)


def test_box(spark):
    x, df = numbers(spark)
    row = V.chart_box(df).first()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert (row["p25"], row["p75"]) == (pytest.approx(q1), pytest.approx(q3))
    assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
    assert row["n_fliers"] == len(x) - len(inside)


def test_each_category_column_is_listed_once(make):
    df = make("b boolean, s string, u string", b=[True, False, True], s=["x", "y", "y"], u=["1", "1", "1"])
    rows = [(r["column"], r["value"], r["share"]) for r in V.chart_categories(df).where("rank = 1").collect()]
    assert sorted(rows) == [("b", "True", 0.6667), ("s", "y", 0.6667)]


def test_missing_chart(make):
    df = make("a int, b int, c int", a=[1, None, None], b=[None, None, None], c=[1, 2, 3])
    assert [tuple(r) for r in V.chart_missing(df).collect()] == [("a", 2, 66.7, 2), ("b", 3, 100.0, 1)]


def test_scatter_samples_strong_pairs(spark):
    df = spark.range(5000).selectExpr("id as k", "double(id) as x", "2.0D * id as y", "rand(7) as z")
    got = V.chart_scatter(df, key=["k"], points=100)
    pairs = {(r["col_a"], r["col_b"]): r["count"] for r in got.groupBy("col_a", "col_b").count().collect()}
    assert pairs == {("k", "x"): 100, ("k", "y"): 100, ("x", "y"): 100}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.chart_scatter(df.repartition(7), key=["k"], points=100).collect()))


def trend(spark, days, n=60):
    step = days / n
    return spark.range(n + 1).selectExpr(
        f"cast(timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * {step * 86400}) as timestamp_ntz) as at",
        "double(id) as v",
        "if(id % 2 = 0, null, double(id)) as w",
    )


@pytest.mark.parametrize("days, rule", [(30, "D"), (90, "D"), (400, "W"), (1095, "W"), (1200, "MS")])
def test_trend_buckets_match_pandas(spark, frame, days, rule):
    df = trend(spark, days)
    rows = frame(df)
    want = rows.set_index(pd.to_datetime(rows["at"]))[["v", "w"]].astype(float).resample(rule).mean().dropna(how="all")
    got = frame(V.chart_time_trend(df)).pivot(index="bucket", columns="column", values="mean").astype(float)
    assert list(got.index) == [d.strftime("%Y-%m-%d") for d in want.index]
    np.testing.assert_allclose(got["v"], want["v"])
    np.testing.assert_allclose(got["w"], want["w"])


def test_no_trend_without_dates_or_buckets(spark):
    assert V.chart_time_trend(spark.range(5)).collect() == []
    one = spark.range(9).selectExpr("timestamp_ntz'2024-01-01 00:00:00' as at", "double(id) as v")
    assert V.chart_time_trend(one).collect() == []


def test_grouped_box_and_heatmap_without_material(spark):
    assert V.chart_grouped_box(spark.range(5)).collect() == []
    assert [tuple(r) for r in V.chart_heatmap(spark.range(5)).collect()] == [("id", "id", 1.0)]
    assert V.histogram(spark.sql("select 'x' as s")).collect() == []
