from datetime import UTC, datetime

import pytest

from datasonde.plans.dates import resolve_token
from datasonde.plans.engine import run_plan
from datasonde.plans.filters import predicate
from datasonde.plans.validate import plan_errors
from datasonde.plans.windows import conjunction, date_window

NOW = datetime(2025, 8, 13, 9, 30, tzinfo=UTC)  # a Wednesday


def leaf(op, column, value):
    return {"op": op, "column": column, "value": value}


@pytest.fixture(scope="module")
def parcels(make):
    sent = ["2025-08-01", "2025-07-31", "2025-08-12", "2025-08-13", "2025-06-30", "2024-11-05", "2025-08-20"]
    return make(
        "depot string, weight double, sent timestamp_ntz, fragile boolean",
        depot=["lake", "lake", "lake", "dune", "dune", "peak", "peak"],
        weight=[12.5, 7.5, 40.0, 3.0, None, 22.0, 5.0],
        sent=[datetime.fromisoformat(d) for d in sent],
        fragile=[True, None, False, True, True, False, None],
    )


def scalar(df, plan, **kw):
    result = run_plan(df, plan, now=NOW, **kw)
    assert result.ok, result.error
    return result.table.first()


def count(df, filters, **kw):
    return scalar(df, {"aggregate": "count", "filters": filters}, **kw)["value"]


STARTS = {
    "day": "2025-08-13",
    "last_day": "2025-08-12",
    "week": "2025-08-11",
    "last_week": "2025-08-04",
    "month": "2025-08-01",
    "last_month": "2025-07-01",
    "quarter": "2025-07-01",
    "last_quarter": "2025-04-01",
    "year": "2025-01-01",
    "last_year": "2024-01-01",
    "last_7_days": "2025-08-07",
}


@pytest.mark.parametrize("name", STARTS)
def test_tokens_are_starts_of_periods(name):
    assert resolve_token(f"@{name}_start", now=NOW) == datetime.fromisoformat(STARTS[name]).replace(tzinfo=UTC)


def test_the_present_is_a_token():
    assert resolve_token("@now", now=NOW) == NOW


def test_tokens_keep_wall_clock_across_a_clock_change():
    offsets = {token: resolve_token(token, tz="Europe/Berlin", now=NOW).isoformat()[10:] for token in ("@year_start", "@day_start")}
    assert offsets == {"@year_start": "T00:00:00+01:00", "@day_start": "T00:00:00+02:00"}


def test_unknown_token_and_zone():
    with pytest.raises(ValueError, match="unknown date token"):
        resolve_token("@fortnight_start", now=NOW)
    with pytest.raises(ValueError, match="unknown timezone"):
        resolve_token("@now", tz="Atlantis/Harbour", now=NOW)


def test_equality_and_explanation(parcels):
    result = run_plan(parcels, {"aggregate": "mean", "column": "weight", "filters": leaf("=", "depot", "lake")}, now=NOW)
    assert tuple(result.table.first()) == (20.0, 3, 3)
    assert result.interpretation == "mean of `weight` | where `depot` = 'lake'"
    assert result.n_matched() == 3


def test_in_and_comparison(parcels):
    node = {"op": "and", "children": [{"op": "in", "column": "depot", "values": ["lake", "peak"]}, leaf(">=", "weight", 12)]}
    assert scalar(parcels, {"aggregate": "sum", "column": "weight", "filters": node})["value"] == 12.5 + 40 + 22


def test_missing_passes_not_equal_and_not_in(parcels):
    assert count(parcels, leaf("!=", "weight", 3)) == 6
    assert count(parcels, {"op": "not in", "column": "weight", "values": [3, 5]}) == 5
    assert count(parcels, {"op": "not", "child": leaf(">", "weight", 10)}) == 4
    assert count(parcels, leaf(">", "weight", 0)) == 6


def test_not_between_and_missing(parcels):
    august = {"op": "between", "column": "sent", "low": "2025-08-01", "high": "2025-08-31"}
    assert count(parcels, august) == 4
    assert count(parcels, {"op": "and", "children": [{"op": "not", "child": august}, {"op": "is null", "column": "weight"}]}) == 1


def test_tree(parcels):
    either = {"op": "or", "children": [leaf("=", "depot", "dune"), leaf(">", "weight", 20)]}
    assert count(parcels, {"op": "and", "children": [either, {"op": "not null", "column": "weight"}]}) == 3


def test_relative_date_is_explained(parcels):
    result = run_plan(parcels, {"aggregate": "count", "filters": leaf(">=", "sent", "@month_start")}, now=NOW)
    assert result.table.first()["value"] == 4
    assert "@month_start=2025-08-01" in result.interpretation


def test_nan_is_missing(make):
    df = make("x double", x=[2.5, float("nan"), None, -4.0])
    assert count(df, leaf(">", "x", -10)) == 2
    assert count(df, {"op": "is null", "column": "x"}) == 2
    assert count(df, {"op": "not", "child": leaf(">=", "x", 2)}) == 3
    assert tuple(scalar(df, {"aggregate": "mean", "column": "x"})) == (-0.75, 4, 2)


def test_booleans(parcels):
    assert count(parcels, leaf("=", "fragile", "yes")) == 3
    assert count(parcels, leaf("!=", "fragile", "true")) == 4
    assert not run_plan(parcels, {"aggregate": "count", "filters": leaf("=", "fragile", "a little")}).ok


def test_instants_are_compared_in_the_query_zone(spark):
    df = spark.sql("select timestamp'2025-08-13 01:00:00+00:00' as at")
    midnight = leaf(">=", "at", "2025-08-13")
    assert {tz: count(df, midnight, tz=tz) for tz in ("UTC", "America/Sao_Paulo", "Asia/Tokyo")} == {"UTC": 1, "America/Sao_Paulo": 0, "Asia/Tokyo": 1}
    assert count(df, leaf(">=", "at", "2025-08-13T01:00:00Z"), tz="America/Sao_Paulo") == 1


def test_groups(parcels):
    plan = {"aggregate": "sum", "column": "weight", "group_by": ["depot"]}
    rows = [tuple(r) for r in run_plan(parcels, plan, now=NOW).table.collect()]
    assert rows == [("dune", 3.0, 1, 2, False), ("lake", 60.0, 3, 3, False), ("peak", 27.0, 2, 2, False)]


def test_grouped_count_nonnull_and_null_keys(make):
    df = make("k string, v double", k=["q", None, "q", "r", None], v=[None, 1.0, 8.0, None, 2.0])
    result = run_plan(df, {"aggregate": "count_nonnull", "column": "v", "group_by": ["k"]})
    assert [tuple(r) for r in result.table.collect()] == [("q", 1, 1, 2, False), ("r", 0, 0, 1, False)]
    assert result.n_matched() == 5


def test_more_groups_than_shown(spark):
    df = spark.range(93).selectExpr("concat('g', lpad(cast(id % 31 as string), 2, '0')) as k", "id as v")
    rows = run_plan(df, {"aggregate": "count", "group_by": ["k"]}).table.collect()
    assert [r["k"] for r in rows] == [f"g{i:02d}" for i in range(20)] and all(r["truncated"] and r["n"] == 3 for r in rows)
    every = run_plan(df, {"aggregate": "count", "group_by": ["k"]}, max_groups=None).table.collect()
    assert len(every) == 31 and not any(r["truncated"] for r in every)


def test_keys_may_be_called_like_results(make):
    df = make("value string, n string, n_rows string, truncated long", value=["a", "a", "b"], n=["x", "x", "y"], n_rows=["u", "u", "u"], truncated=[1, 2, 3])
    plan = {"aggregate": "sum", "column": "truncated", "group_by": ["value", "n", "n_rows"]}
    result = run_plan(df, plan)
    assert result.ok, result.error
    assert result.table.columns == ["value_", "n_", "n_rows_", "value", "n", "n_rows", "truncated"]
    assert [tuple(r) for r in result.table.collect()] == [("a", "x", "u", 3, 2, 2, False), ("b", "y", "u", 3, 1, 1, False)]


def test_sums_beyond_64_bits(make):
    df = make("k string, v long", k=["a", "a", "a"], v=[2**63 - 1] * 3)
    assert int(scalar(df, {"aggregate": "sum", "column": "v"})["value"]) == 3 * (2**63 - 1)
    grouped = run_plan(df, {"aggregate": "sum", "column": "v", "group_by": ["k"]}).table.first()
    assert int(grouped["value"]) == 3 * (2**63 - 1)


def test_empty_sum_is_zero_and_mean_is_null(parcels):
    nothing = leaf(">", "weight", 1_000)
    assert tuple(scalar(parcels, {"aggregate": "sum", "column": "weight", "filters": nothing})) == (0.0, 0, 0)
    assert scalar(parcels, {"aggregate": "mean", "column": "weight", "filters": nothing})["value"] is None


def counting(filters):
    return {"aggregate": "count", "filters": filters}


BAD_PLANS = [
    (42, "must be an object"),
    ({"aggregate": "stddev", "column": "weight"}, "aggregate must be one of"),
    ({"aggregate": "max", "column": "mass"}, "not found"),
    ({"aggregate": "sum", "column": "depot"}, "numeric"),
    ({"aggregate": "count", "column": "sent"}, "'count' counts matching rows"),
    (counting(leaf("<", "weight", "heavy")), "must be a number"),
    (counting(leaf("<=", "weight", False)), "must be a number"),
    (counting(leaf("<", "depot", 3)), "numeric or datetime"),
    (counting(leaf("<", "sent", "next tuesday")), "ISO 8601"),
    (counting({"op": "or", "children": [leaf("=", "depot", "peak")]}), "at least two"),
    (counting({"op": "not in", "column": "depot", "values": []}), "non-empty"),
    (counting({"op": "in", "column": "depot", "values": list("pq") * 30}), "at most 50"),
    (counting({"op": "matches", "column": "depot", "value": "l.*"}), "unknown filter op"),
    ({"aggregate": "count", "group_by": ["courier"]}, "not found"),
    ({"aggregate": "count", "group_by": ["depot", "weight", "sent", "fragile"]}, "at most 3"),
]


@pytest.mark.parametrize("plan, said", BAD_PLANS)
def test_bad_plans_are_error_values(parcels, plan, said):
    assert any(said in e for e in plan_errors(plan, parcels.schema))
    result = run_plan(parcels, plan, now=NOW)
    assert not result.ok and said in result.error and result.table is None


def test_too_many_nodes(parcels):
    wide = {"op": "and", "children": [{"op": "not null", "column": "sent"}] * 40}
    assert any("exceeds" in e for e in plan_errors(counting(wide), parcels.schema))


def test_top_level_leaves_reach_the_reader(parcels):
    both = {"op": "and", "children": [leaf(">", "weight", 5), leaf("=", "depot", "lake")]}
    assert "coalesce" not in predicate(both, parcels.schema)
    assert "coalesce" in predicate({"op": "not", "child": both}, parcels.schema)


def test_text_literals_are_quoted(make):
    df = make("s string", s=["o'clock", "c:\\dir", "plain"])
    assert count(df, leaf("=", "s", "o'clock")) == 1
    assert count(df, {"op": "in", "column": "s", "values": ["c:\\dir", "'--"]}) == 1


WINDOWS = [
    ("last_period", {"unit": "month"}, 1),
    ("this_period", {"unit": "month"}, 4),
    ("since_last", {"unit": "month"}, 5),
    ("last_days", {"days": 2}, 3),
    ("between", {"start": "2025-08-01", "end": "2025-08-31"}, 4),
    ("after", {"start": "2025-08-13"}, 1),
    ("before", {"start": "2025-06-30"}, 1),
    ("since", {"start": "2025-06-30"}, 6),
]


@pytest.mark.parametrize("kind, arguments, expected", WINDOWS)
def test_date_windows(parcels, kind, arguments, expected):
    assert count(parcels, conjunction(date_window(parcels, kind, **arguments))) == expected


def test_date_window_without_dates(make):
    assert date_window(make("x int", x=[1]), "since", start="2025-01-01") == []


def test_filters_are_pushed_to_parquet(parcels, tmp_path):
    path = str(tmp_path / "parcels")
    parcels.write.parquet(path)
    spark = parcels.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet(path)
    node = {"op": "and", "children": [leaf(">", "weight", 10), leaf(">=", "sent", "@month_start"), leaf("!=", "depot", "dune")]}
    result = run_plan(df, {"aggregate": "count_nonnull", "column": "weight", "filters": node}, now=NOW)
    scan = next(s.split("PushedFilters")[1] for s in result.table._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in s)
    for pushed in ("GreaterThan(weight,10.0)", "GreaterThanOrEqual(sent,2025-08-01T00:00)", "Not(EqualTo(depot,dune))"):
        assert pushed in scan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ReadSchema: struct<depot:string,weight:double,sent:timestamp_ntz>" in scan
    assert result.table.first()["value"] == 2
