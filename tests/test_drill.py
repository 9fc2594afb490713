import re
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from datasonde.operators import drill as G
from datasonde.operators import intents as N
from datasonde.operators import investigate as X
from datasonde.operators.frequency import top_values


def part(df, name):
    return [r.asDict() for r in df.where(f"part = '{name}'").orderBy("rank").collect()]


def test_correlation(make):
    a, b = [2.0, 7.0, 3.5, 11.0, 6.0, None], [1.0, 9.0, 2.0, 30.0, 4.0, 5.0]
    row = G.correlation_check(make("a double, b double", a=a, b=b), "a", "b").first()
    both = pd.DataFrame({"a": a, "b": b}, dtype=float).dropna()
    assert (row["n"], row["low_n"]) == (5, True)
    assert row["pearson_r"] == pytest.approx(both.a.corr(both.b), abs=1e-4)
    assert row["spearman_r"] == pytest.approx(both.a.rank().corr(both.b.rank()), abs=1e-4)


@pytest.mark.parametrize("a, said", [([8.0, 8.0, 8.0], "two distinct values"), ([8.0, None, None], "two complete rows")])
def test_correlations_that_are_undefined_are_errors(make, a, said):
    result = G.run_tool(make("a double, b double", a=a, b=[4.0, 5.0, 6.0]), "correlation_check", {"column_a": "a", "column_b": "b"})
    assert not result.ok and said in result.error and result.table is None


def test_group_gap(make):
    df = make("kind string, score double", kind=["oak", "ash", "ash", "elm", "oak"], score=[9.0, 1.0, 2.0, 30.0, 11.0])
    got = G.group_compare(df, "score", "kind")
    gap = part(got, "gap")[0]
    assert (gap["category"], gap["low_category"], gap["mean"]) == ("elm", "ash", 28.5)
    assert sorted(g["category"] for g in part(got, "group")) == ["ash", "elm", "oak"]
    assert part(got, "overall")[0]["median"] == 9.0


def test_twelve_groups_are_shown_and_the_gap_is_among_them(make):
    teams = [f"team {chr(97 + i)}" for i in range(15)]
    got = G.group_compare(make("team string, points double", team=teams, points=[3.0 * i for i in range(15)]), "points", "team")
    shown = part(got, "group")
    assert [g["category"] for g in shown] == teams[:12] and {g["std"] for g in shown} == {None}  # one value has no deviation
    gap = part(got, "gap")[0]
    assert (gap["category"], gap["low_category"], gap["mean"]) == ("team l", "team a", 33.0)


def test_single_group_has_no_gap(make):
    assert part(G.group_compare(make("team string, points double", team=["t"] * 3, points=[4.0, 5.0, 9.0]), "points", "team"), "gap") == []


def test_missingness_split(make):
    df = make("depth double, probe string", depth=[None, 4.0, None, None, 8.0, 9.0], probe=["p", "p", "p", "q", "q", "q"])
    row = G.missingness_analysis(df, "depth").first()
    assert (row["n_missing"], row["pct_missing"]) == (3, 50.0)
    assert (row["split_column"], row["category"], row["rate"]) == ("probe", "p", 66.67)
    assert row["gap"] == pytest.approx(66.67 - 50, abs=0.01)  # beyond the share of the whole column


def test_missingness_without_gaps_or_candidates(make):
    row = G.missingness_analysis(make("note string, serial long", note=["unknown", "-", "fine", "N/A"], serial=[5, 6, 7, 8]), "note").first()
    assert (row["n_missing"], row["split_column"]) == (0, None) and row["n_sentinel"] >= 2


def test_value_scan(make):
    got = G.value_scan(make("code string", code=["zz9", "k", "k", None, "k", "mm"]), "code")
    shape = part(got, "shape")[0]
    assert (shape["value"], shape["n_unique"], shape["min_length"], shape["max_length"]) == ("string", 3, 1, 3)
    assert [(t["value"], t["cnt"]) for t in part(got, "top")] == [("k", 3), ("mm", 1), ("zz9", 1)]


def test_outliers_and_what_shifts(make):
    load = [20.0, 22.0, 24.0, 26.0, 28.0, 30.0, 32.0, 90.0]
    heat = [4.0] * 7 + [14.0]
    got = G.outlier_inspect(make("load double, heat double", load=load, heat=heat), "load")
    low, high = np.percentile(load, [25, 75])
    bounds, shift = part(got, "bounds")[0], part(got, "comparison")[0]
    assert (bounds["lower"], bounds["upper"]) == (low - 1.5 * (high - low), high + 1.5 * (high - low))
    assert (bounds["n_outliers"], bounds["pct_outliers"]) == (1, 12.5)
    assert [e["value"] for e in part(got, "example")] == [90.0]
    assert (shift["column"], shift["mean_outliers"], shift["mean_rest"], shift["shift_pct"]) == ("heat", 14.0, 4.0, 250.0)


def test_five_examples(make):
    values = [float(v % 12) for v in range(48)] + [-300.0, -310.0, 400.0, 410.0, 420.0, 430.0, 440.0]
    got = G.outlier_inspect(make("load double", load=values), "load")
    assert part(got, "bounds")[0]["n_outliers"] == 7
    assert [e["value"] for e in part(got, "example")] == [440.0, 430.0, 420.0, 410.0, 400.0]


def test_no_fences_without_spread(make):
    bounds = part(G.outlier_inspect(make("load double", load=[6.0] * 14 + [7.5, 90.0]), "load"), "bounds")[0]
    assert (bounds["lower"], bounds["n_valid"], bounds["n_outliers"]) == (None, 16, 0)


def test_outliers_of_a_column_without_values_are_an_error(make):
    result = G.run_tool(make("load double, heat double", load=[None, None], heat=[4.0, 5.0]), "outlier_inspect", {"column": "load"})
    assert not result.ok and "no values" in result.error and result.table is None


@pytest.fixture(scope="module")
def visits(make):
    days = ["2023-11-28", "2023-11-30", "2023-12-31", "2024-01-01", "2024-07-09"]
    return make("seen timestamp_ntz, guest string, nights long", seen=[datetime.fromisoformat(d) for d in days], guest=list("vwxyz"), nights=[2, 4, 9, 1, 5])


@pytest.mark.parametrize(
    "freq, first, periods",
    [("M", ("2023-11", 2, 3.0), 4), ("W", ("2023-11-27/2023-12-03", 2, 3.0), 4), ("D", ("2023-11-28", 1, 2.0), 5), ("Q", ("2023Q4", 3, 5.0), 3), ("Y", ("2023", 3, 5.0), 2)],
)
def test_time_slice(visits, freq, first, periods):
    row = G.time_slice(visits, "seen", freq).orderBy("rank").first()
    assert (row["period"], row["n"], row["mean"]) == first and row["n_periods"] == periods


@pytest.mark.parametrize(
    "name, args, said",
    [
        ("cluster", {}, "unknown tool"),
        ("value_scan", {"column": "room"}, "not found"),
        ("outlier_inspect", {}, "needs the argument"),
        ("time_slice", {"date_column": "seen", "zoom": 2}, "unexpected argument"),
        ("value_scan", {"column": ["guest"]}, "not found"),
        ("value_scan", 17, "must be an object"),
        ("outlier_inspect", {"column": "guest"}, "must be numeric"),
        ("group_compare", {"numeric_column": "nights", "categorical_column": "nights"}, "must be"),
        ("time_slice", {"date_column": "nights"}, "must be datetime"),
        ("time_slice", {"date_column": "seen", "freq": "decade"}, "freq must be one of"),
    ],
)
def test_bad_calls_are_error_values(visits, name, args, said):
    result = G.run_tool(visits, name, args)
    assert not result.ok and said in result.error and result.table is None


def test_good_call(visits):
    assert G.run_tool(visits, "time_slice", {"date_column": "seen"}).table.count() == 4


def pumps(spark):
    """Sixty readings of three pumps; four of them are far out, and flow follows speed."""
    return spark.range(60).selectExpr(
        "id as reading",
        "case when id in (4, 19, 34, 49) then 900.0D + id else 12.0D + id % 7 end as pressure",
        "double(id * 3) as speed",
        "id * 6.5D + id % 4 as flow",
        "element_at(array('old', 'old', 'new', 'spare', 'old'), cast(id % 5 as int) + 1) as pump",
    )


def test_unprompted_findings(spark):
    found = X.auto_investigate(pumps(spark)).orderBy("step").collect()
    assert [r["tool"] for r in found] == ["outlier_inspect", "correlation_check", "group_compare"]
    assert found[0]["column_a"] == "pressure" and "4 IQR outlier(s)" in found[0]["summary"]


def test_anomaly_drilldown(spark):
    rows = X.anomaly_drilldown(pumps(spark)).collect()
    assert [(r["column"], r["n_outliers"], r["category_column"]) for r in rows] == [("pressure", 4, "pump")]
    assert rows[0]["gap"] == pytest.approx(rows[0]["high_mean"] - rows[0]["low_mean"], abs=1e-4)
    assert X.anomaly_drilldown(spark.range(8)).collect() == []


# -- intents -------------------------------------------------------------------

SHOPS = ["quay"] * 9 + ["mill"] * 7 + [None] * 2 + ["arch"] * 2
PRICES = [4.0 + 0.5 * i for i in range(16)] + [None] * 4


@pytest.fixture(scope="module")
def sales(make):
    return make("ticket long, price double, minutes long, shop string", ticket=list(range(500, 520)), price=PRICES, minutes=[3 * i + 1 for i in range(20)], shop=SHOPS)


def test_direct_answers(sales):
    known = [p for p in PRICES if p is not None]
    missing = {r["column"]: (r["n_missing"], r["pct_missing"], r["n_rows"]) for r in N.ask_missing(sales, ["price", "shop", "ticket", "minutes"]).collect()}
    assert missing == {"price": (4, 20.0, 20), "shop": (2, 10.0, 20), "ticket": (0, 0.0, 20), "minutes": (0, 0.0, 20)}
    stats = N.ask_stats(sales, ["shop", "price"]).first()
    assert (stats["column"], stats["mean"], stats["min"], stats["max"], stats["n"]) == ("price", sum(known) / 16, 4.0, 11.5, 16)
    unique = [(r["value"], r["cnt"], r["n_unique"]) for r in N.ask_unique(sales, "shop").orderBy("rank").collect()]
    assert unique == [("quay", 9, 3), ("mill", 7, 3), ("arch", 2, 3)]
    pair = N.ask_correlation(sales, "price", "minutes").first()
    assert (pair["value"], pair["n"]) == (1.0, 16)
    facts = {r["fact"]: r["value"] for r in N.ask_rows(sales, duplicates=True, missing=True).collect()}
    assert facts == {"n_rows": 20, "n_columns": 4, "duplicate_rows": 0, "rows_with_missing": 4}
    assert tuple(N.ask_dtype(sales, "shop").first()) == ("shop", "string", "categorical", 18)
    assert N.ask_duplicates(sales).first()["duplicate_rows"] == 0


def test_filtered_answers_use_the_filter(sales):
    from datasonde.plans.engine import run_plan

    mill = {"op": "=", "column": "shop", "value": "mill"}
    prices = [p for p, s in zip(PRICES, SHOPS) if s == "mill" and p is not None]
    assert run_plan(sales, {"aggregate": "mean", "column": "price", "filters": mill}).table.first()["value"] == sum(prices) / len(prices)
    total = run_plan(sales, {"aggregate": "sum", "column": "price", "filters": mill}).table.first()
    assert (total["value"], total["n_used"]) == (sum(prices), 7)
    both = {"op": "and", "children": [mill, {"op": ">", "column": "price", "value": 9}]}
    assert run_plan(sales, {"aggregate": "count", "filters": both}).table.first()["value"] == len([p for p in prices if p > 9])


def test_catalog(sales):
    rows = {r["column"]: (r["kind"], r["sample"]) for r in N.schema_catalog(sales).collect()}
    assert rows["price"] == ("numeric", "min 4.0, max 11.5")
    assert rows["shop"] == ("text", "'arch', 'mill', 'quay'")


def test_catalog_and_tops_order_long_texts_by_the_whole_text(make):
    texts = ["long and alike " * 20 + f"{i:04d}" for i in (31, 7, 25, 0, 12, 39, 18, 4)]
    df = make("t string", t=texts)
    first = sorted(texts)[:5]
    assert [r["value"] for r in top_values(df, ["t"], 5).orderBy("rank").collect()] == first
    assert [t[-4:] for t in re.findall(r"\d{4}", N.schema_catalog(df).first()["sample"])] in ([], [t[-4:] for t in first])
