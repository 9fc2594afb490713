import uuid

import numpy as np
import pandas as pd
import pytest

from datasonde.operators import gram, order_stats
from datasonde.operators import relations as R
from datasonde.operators.relations import cramers_v_pairs, low_cardinality_columns


def table(spark, pdf):
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    schema = ", ".join(f"{c} {'string' if pdf[c].dtype == object else 'double'}" for c in pdf)
    return spark.createDataFrame(rows, schema).repartition(3)


def matrix(pairs):
    return {(r["col_a"], r["col_b"]): r["stat"] for r in pairs.collect()}


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 3, 600)
    pdf = pd.DataFrame({"a": x, "b": x * 2 + rng.normal(0, 2, 600), "c": rng.integers(0, 4, 600).astype(float), "d": np.exp(rng.normal(0, 1, 600))})
    pdf["k"] = 5.0
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::5, "d"] = np.nan
    pdf.loc[:200, "c"] = 1.0  # a third of the rows hold one value
    return pdf


def test_pearson_matches_pandas(spark, numbers):
    got, want = matrix(R.pearson_pairs(table(spark, numbers))), numbers.corr()
    for (a, b), r in got.items():
        assert r is None if "k" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert {(r["col_a"], r["col_b"]): r["n"] for r in R.pearson_pairs(table(spark, numbers)).collect()}[("b", "d")] == len(numbers[["b", "d"]].dropna())


@pytest.mark.parametrize("gaps, few, hot", [(True, 0, 200), (True, 0, 2), (True, 0, 100_000), (False, 10_000, 200), (False, 0, 200), (False, 0, 2), (False, 0, 100_000)])
def test_spearman_matches_pandas(spark, numbers, monkeypatch, gaps, few, hot):
    """The same ranks whether values are broadcast, hot or joined."""
    monkeypatch.setattr(R, "FEW_VALUES", few)
    monkeypatch.setattr(R, "HOT_SHARE", hot)
    monkeypatch.setattr(gram, "HOT_SHARE", hot)
    numbers = numbers if gaps else numbers.fillna(3.0)
    got, want = matrix(R.spearman_pairs(table(spark, numbers))), numbers.corr(method="spearman")
    assert len(got) == 10
    for (a, b), r in got.items():
        assert r is None if "k" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-9)


def wide(rng, n, k):
    """Columns that hang together, some with gaps, one constant, one of whole numbers above 2^53."""
    base = rng.normal(0, 1, (n, 3))
    pdf = pd.DataFrame({f"c{i:02}": base[:, i % 3] * rng.normal(1, 0.2) + rng.normal(0, 0.5 + i % 4, n) for i in range(k)})
    for i in range(0, k, 2):
        pdf.loc[rng.random(n) < 0.02 * (i + 1) / k * 10, f"c{i:02}"] = np.nan
    pdf["c03"] = np.round(pdf["c03"], 1)
    pdf["c05"] = 7.0
    return pdf


def rows_and_stages(spark, run):
    """The rows that ``run`` makes, and how many stages (scans and shuffles) that took."""
    tracker = spark.sparkContext.statusTracker()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    result = run().collect()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return result, len(set(stages))


def test_forty_columns_with_gaps_are_ranked_in_as_many_stages_as_six(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "ROWS_PER_BUCKET", 40)
    rng = np.random.default_rng(8)
    stages = {}
    for k in (6, 40):
        pdf = wide(rng, 150, k)
        df = table(spark, pdf)
        rows, stages[k] = rows_and_stages(spark, lambda: R.spearman_pairs(df))
        want = pdf.corr(method="spearman")
        assert len(rows) == k * (k - 1) // 2
        for r in rows:
            expected = want.loc[r["col_a"], r["col_b"]]
            assert r["n"] == len(pdf[[r["col_a"], r["col_b"]]].dropna())
            assert r["stat"] is None if np.isnan(expected) else r["stat"] == pytest.approx(expected, abs=1e-9)
    assert stages[40] <= stages[6] + 1


def test_a_hundred_columns_are_correlated_in_one_scan(spark):
    pdf = wide(np.random.default_rng(9), 200, 100)
    pdf.loc[5, "c08"] = np.inf
    df = table(spark, pdf)
    _, few = rows_and_stages(spark, lambda: R.pearson_pairs(df.select(*df.columns[:40])))
    rows, many = rows_and_stages(spark, lambda: R.pearson_pairs(df))
    assert many == few  # one scan for the means, one for all products
    want = pdf.replace([np.inf], np.nan).corr()
    for r in rows:
        expected = want.loc[r["col_a"], r["col_b"]]
        if "c08" in (r["col_a"], r["col_b"]):
            other = r["col_b"] if r["col_a"] == "c08" else r["col_a"]
            assert (r["stat"] is None) == (not np.isnan(pdf[other][5]) or np.isnan(expected))
        elif np.isnan(expected):
            assert r["stat"] is None
        else:
            assert r["stat"] == pytest.approx(expected, abs=1e-9)
    assert len(rows) == 4950 and len(R.pearson_pairs(df.where("false")).collect()) == 4950


def test_ranks_of_whole_numbers_and_decimals_with_gaps(spark):
    big = 2**53
    rows = [(big + i, None if i % 4 == 0 else 100 - i, float(i * i), f"{i}.25") for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b int, c float, d string").selectExpr("a", "b", "c", "cast(d as decimal(12,2)) as d")
    got = matrix(R.spearman_pairs(df))
    assert {k: round(v, 9) for k, v in got.items()} == {("a", "b"): -1.0, ("a", "c"): 1.0, ("a", "d"): 1.0, ("b", "c"): -1.0, ("b", "d"): -1.0, ("c", "d"): 1.0}


def test_thresholds_and_order(spark):
    x = np.arange(100.0)
    pdf = pd.DataFrame({"a": x, "b": -x, "c": x**3, "d": np.tile([0.0, 1.0], 50)})
    top = [tuple(r) for r in R.top_pearson(table(spark, pdf)).collect()]
    assert [t[:2] for t in top] == [("a", "b"), ("a", "c"), ("b", "c")] and top[0][2] == -1.0
    spearman = [tuple(r) for r in R.top_spearman(table(spark, pdf)).collect()]
    assert spearman == [("a", "b", -1.0), ("a", "c", 1.0), ("b", "c", -1.0)]


def test_one_numeric_column_has_no_pairs(spark):
    df = spark.range(5)
    assert R.top_pearson(df).collect() == [] and R.top_spearman(df).collect() == []
    assert R.top_cramers_v(df).collect() == [] and R.category_effects(df).collect() == []


def expected_v(x, y):
    t = pd.crosstab(x, y).to_numpy(float)
    n, (r, k) = t.sum(), t.shape
    e = np.outer(t.sum(1), t.sum(0)) / n
    phi2 = max(0.0, ((t - e) ** 2 / e).sum() / n - (k - 1) * (r - 1) / (n - 1))
    return np.sqrt(phi2 / (min(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1))


@pytest.mark.parametrize("joint", [1_000_000, 0])
def test_cramers_v(spark, monkeypatch, joint):
    monkeypatch.setattr(R, "MAX_JOINT_GROUPS", joint)
    rng = np.random.default_rng(1)
    a = rng.choice(["x", "y", "z"], 300)
    b = np.where(rng.random(300) < 0.8, a, "x").astype(object)
    b[::9] = None
    pdf = pd.DataFrame({"a": a.astype(object), "b": b, "c": np.array([f"t{i}" for i in range(300)], dtype=object)})
    df = table(spark, pdf)
    counts = low_cardinality_columns(df)
    assert counts == [("a", 3), ("b", 3)]  # c has too many values
    both = pdf[pdf["b"].notna()]
    got = cramers_v_pairs(df, counts).first()
    assert got["stat"] == pytest.approx(expected_v(both["a"], both["b"])) and got["n"] == len(both)
    assert R.top_cramers_v(df).first()["cramers_v"] == pytest.approx(expected_v(both["a"], both["b"]), abs=5e-4)


def test_forty_category_columns_in_one_scan(spark):
    """780 tables whose joint groups are too many to fold: counted in the tasks, missing values left out."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 5, 600)
    pdf = pd.DataFrame({f"c{i:02}": [f"v{(b + (rng.random() < 0.1 * (i % 7)) * rng.integers(0, 5)) % 5}" for b in base] for i in range(40)}, dtype=object)
    pdf.loc[::11, "c04"] = None
    df = table(spark, pdf).repartition(5)
    counts = low_cardinality_columns(df)
    assert len(counts) == 40 and R.joint_groups(counts) > R.MAX_JOINT_GROUPS
    got = {(r["i"], r["j"], r["a"], r["b"]): r["cnt"] for r in R.pair_counts(df, counts).collect()}
    for i, j in ((0, 1), (4, 17), (3, 39), (38, 39)):
        t = pd.crosstab(pdf.iloc[:, i], pdf.iloc[:, j])
        want = {(i, j, a, b): t.loc[a, b] for a in t.index for b in t.columns if t.loc[a, b]}
        assert {k: n for k, n in got.items() if k[:2] == (i, j)} == want
    assert len({k[:2] for k in got}) == 780


@pytest.mark.parametrize("joint", [1_000_000, 0])
def test_category_effects(spark, monkeypatch, joint):
    monkeypatch.setattr(R, "MAX_JOINT_GROUPS", joint)
    rng = np.random.default_rng(4)
    grp = rng.choice(["x", "y"], 100).astype(object)
    pdf = pd.DataFrame({"grp": grp, "rare": np.array(["one"] * 98 + ["two"] * 2, dtype=object), "sales": np.where(grp == "x", 200.0, 100.0) + rng.normal(0, 1, 100)})
    pdf.loc[3, "sales"] = np.nan
    got = R.category_effects(table(spark, pdf)).orderBy("group_rank").collect()
    means = pdf.groupby("grp")["sales"].mean()
    assert [(r["category"], r["numeric"], r["group"]) for r in got] == [("grp", "sales", "x"), ("grp", "sales", "y")]
    assert got[0]["mean"] == round(means["x"], 4)
    assert got[0]["spread"] == pytest.approx((means["x"] - means["y"]) / pdf["sales"].std(), abs=5e-4)
    assert sum(r["cnt"] for r in got) == 99
