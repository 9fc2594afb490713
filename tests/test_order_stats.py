import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from datasonde.functions.values import grouped
from datasonde.operators import order_stats as O

PROBS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


@pytest.fixture
def tiny_buckets(monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(O, "EDGES", 8)


def skewed(n=3000):
    """A third of the rows hold one value, the rest spread over many scales."""
    rng = np.random.default_rng(3)
    spread = np.round(np.exp(rng.normal(0, 4, n - n // 3)), 6) * rng.choice([-1, 1], n - n // 3)
    return np.concatenate([np.full(n // 3, 2.5), spread])


def tables(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "value double").repartition(4)
    return rows, grouped(rows.selectExpr("0 as side", "value"), ["side", "value"], cnt="count(*)")


@pytest.mark.parametrize("bucketed", [False, True])
def test_quantiles_match_numpy(spark, bucketed, tiny_buckets):
    values = skewed()
    rows, freq = tables(spark, values)
    buckets = O.plan_buckets(rows, len(values)) if bucketed else O.RangeBuckets()
    assert buckets.single != bucketed
    got = O.quantiles(freq, ["side"], PROBS, buckets).first()
    assert got["n"] == len(values)
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


@pytest.mark.parametrize("bucketed", [False, True])
def test_average_ranks_match_pandas(spark, frame, bucketed, tiny_buckets):
    values = skewed(900)
    rows, freq = tables(spark, values)
    buckets = O.plan_buckets(rows, len(values)) if bucketed else O.RangeBuckets()
    got = frame(O.average_ranks(freq, ["side"], buckets), "value")
    ranked = pd.Series(values).rank()
    expected = pd.DataFrame({"value": values, "rank": ranked}).drop_duplicates().sort_values("value")
    np.testing.assert_allclose(got["rank"], expected["rank"])
    assert (got["rank"] * got["cnt"]).sum() == pytest.approx(len(values) * (len(values) + 1) / 2)


def test_no_bucket_is_crowded(spark, tiny_buckets):
    values = skewed()
    rows, freq = tables(spark, values)
    buckets = O.plan_buckets(rows, len(values))
    sizes = buckets.place(freq).groupBy("bucket").count()
    assert sizes.agg({"count": "max"}).first()[0] < freq.count() / 4


def test_columns_on_different_scales_get_their_own_buckets(spark, tiny_buckets):
    rng = np.random.default_rng(8)
    columns = {0: rng.random(400), 1: rng.normal(1e9, 5e7, 400), 2: np.full(400, 7.0), 3: -np.exp(rng.normal(0, 9, 400))}
    rows = spark.createDataFrame([(p, float(v)) for p, vs in columns.items() for v in vs], "position int, value double")
    buckets = O.plan_keyed_buckets(rows, "position", 400)
    freq = grouped(rows, ["position", "value"], cnt="count(*)")
    got = {r["position"]: r for r in O.quantiles(freq, ["position"], PROBS, buckets).collect()}
    for p, values in columns.items():
        for name, q in PROBS.items():
            assert got[p][name] == pytest.approx(np.quantile(values, q), rel=1e-12)
    largest = buckets.place(freq).groupBy("position", "bucket").count().groupBy("position").agg({"count": "max"})
    assert all(n <= 400 / 4 for _, n in largest.collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9), min_size=2, max_size=40), st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=6, unique=True))
def test_any_edges_give_exact_results(spark, values, edges):
    _, freq = tables(spark, values)
    buckets = O.RangeBuckets(tuple(sorted(edges)), 4)
    got = O.quantiles(freq, ["side"], {"median": 0.5, "p75": 0.75}, buckets).first()
    assert got["median"] == pytest.approx(np.quantile(values, 0.5), rel=1e-9, abs=1e-6)
    assert got["p75"] == pytest.approx(np.quantile(values, 0.75), rel=1e-9, abs=1e-6)


def awkward(kind, n=12_000):
    rng = np.random.default_rng(11)
    if kind == "heavy tails":
        return np.exp(rng.normal(0, 5, n)) * rng.choice([-1, 1], n)
    centres = rng.choice([0.0, 1.0, 1e6, 1e6 + 1e-3, -1e12], n)
    return centres + rng.normal(0, 1e-6, n) * np.maximum(1, np.abs(centres)) ** 0.5


@pytest.mark.parametrize("kind", ["heavy tails", "clusters"])
@pytest.mark.parametrize("keyed", [False, True])
def test_no_bucket_holds_more_than_four_times_its_share(spark, monkeypatch, kind, keyed):
    values = awkward(kind)
    monkeypatch.setattr(O, "EDGES", 8)
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", len(values) // 60)
    rows = spark.createDataFrame([(p, float(v)) for p in (0, 1) for v in values * (1 + p)], "position int, value double").repartition(4)
    rows = rows if keyed else rows.where("position = 0")
    buckets = O.plan_keyed_buckets(rows, "position", len(values)) if keyed else O.plan_buckets(rows.select("value"), len(values))
    assert buckets.fine
    freq = grouped(rows, ["position", "value"], cnt="count(*)")
    sizes = [r["count"] for r in buckets.place(freq).groupBy("position", "bucket").count().collect()]
    assert max(sizes) <= 4 * O.ROWS_PER_BUCKET and sum(sizes) == freq.count()
    for r in O.quantiles(freq, ["position"], PROBS, buckets).collect():
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(np.quantile(values * (1 + r["position"]), p), rel=1e-12)
