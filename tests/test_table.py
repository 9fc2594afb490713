import pytest

from datasonde.operators import table as T
from datasonde.operators.charts import histogram
from datasonde.operators.columns import column_quantiles, numeric_moments
from datasonde.operators.relations import category_effects


def test_shape_counts_everything_not_numeric_as_categorical(make):
    df = make("a int, b string, c boolean, d timestamp_ntz", a=[1], b=["x"], c=[True], d=[None])
    assert tuple(T.table_shape(df).first()) == (1, 4, 1, 3)


def test_duplicates_treat_nulls_as_equal(make):
    df = make("a double, b string", a=[1.0, 1.0, None, None, float("nan"), 2.0], b=["x", "x", None, None, None, "x"])
    assert tuple(T.duplicate_rows(df).first()) == (6, 3)


def test_duplicates_of_fixed_width_rows(make):
    df = make("a double, b int", a=[0.0, -0.0, 1.0, None, float("nan")], b=[1, 1, 1, 2, 2])
    assert T.duplicate_rows(df).first()["duplicate_rows"] == 2


def test_duplicates_keep_null_apart_from_its_spelling(make):
    df = make("a string, b string", a=["null", None, "x", None], b=[None, "null", None, "x"])
    assert T.duplicate_rows(df).first()["duplicate_rows"] == 0


def test_duplicates_differ_in_the_last_digit(spark):
    df = spark.sql(
        "select 'x' as s, timestamp_ntz'2024-01-01 00:00:00.000001' as a, timestamp'2024-01-01 00:00:00' as b, 0.1D as d union all "
        "select 'x', timestamp_ntz'2024-01-01 00:00:00.000002', timestamp'2024-01-01 00:00:00', 0.1D union all "
        "select 'x', timestamp_ntz'2024-01-01 00:00:00.000001', timestamp'2024-01-01 00:00:00.000001', 0.1D union all "
        "select 'x', timestamp_ntz'2024-01-01 00:00:00.000001', timestamp'2024-01-01 00:00:00', 0.10000000000000002D"
    )
    assert T.duplicate_rows(df).first()["duplicate_rows"] == 0
    assert T.duplicate_rows(df.union(df)).first()["duplicate_rows"] == 4


def test_duplicates_of_nested_rows(spark):
    df = spark.sql("select array(1, 2) as a, map('k', 1) as m union all select array(1, 2), map('k', 1) union all select array(2), map('k', 1)")
    assert T.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_constant_columns_include_empty_ones(make):
    df = make("a int, b string, c int", a=[1, 1, 1], b=[None, None, None], c=[1, 2, 3])
    assert {r["column"]: r["n_unique"] for r in T.constant_columns(df).collect()} == {"a": 1, "b": 0}


def test_missing_worst_first(make):
    df = make("a int, b int, c int", a=[1, None, None], b=[None, None, None], c=[1, 2, 3])
    assert [tuple(r) for r in T.all_missing(df).collect()] == [("b", 3, 100.0), ("a", 2, 66.67)]
    assert T.top_missing(df, 1).count() == 1


def test_co_missing(make):
    df = make("a double, b double, c int", a=[1.0, None, None, None], b=[2.0, None, None, 3.0], c=[1, 2, 3, 4])
    assert [tuple(r) for r in T.co_missing_pairs(df).collect()] == [("a", "b", 2, 50.0)]
    assert T.fully_empty_rows(df).first()["fully_empty_rows"] == 0
    assert T.co_missing_pairs(df.select("c")).collect() == []


def test_fully_empty_rows(make):
    df = make("a double, b string", a=[None, float("nan"), 1.0], b=[None, None, None])
    assert tuple(T.fully_empty_rows(df).first()) == (3, 2, 3)


def test_sample_cells_are_short_text(make):
    df = make("k int, t string, x double", k=[2, 1, 3], t=["b", "long" * 30, None], x=[None, 1.0, 2.5])
    rows = [tuple(r) for r in T.sample_rows(df, ["k"], n=2).collect()]
    assert rows == [("1", ("long" * 30)[:40], "1.0"), ("2", "b", None)]


def test_id_like(spark):
    df = spark.range(50).selectExpr(
        "id as seq", "concat('u', id) as uid", "rand(1) as val", "id % 5 as rep", "49 - id as falling", "id * 2 as gaps"
    )
    found = {r["column"]: r["reason"] for r in T.id_like(df).collect()}
    assert found == {"seq": "sequential integer", "uid": "unique per row", "falling": "sequential integer", "gaps": "unique per row"}
    ordered = {r["column"]: r["reason"] for r in T.id_like(df, order_by="seq").collect()}
    assert ordered == {"seq": "sequential integer", "uid": "unique per row", "falling": "unique per row", "gaps": "sequential integer"}


def test_id_like_needs_ten_rows_and_no_duplicates(spark):
    assert T.id_like(spark.range(9)).collect() == []
    assert T.id_like(spark.range(20).union(spark.range(1))).collect() == []


def test_order_check_across_buckets(spark, monkeypatch):
    from datasonde.operators import order_stats as O

    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 10)
    df = spark.range(500).selectExpr("id as k", "id as up", "if(id = 400, 0, id) as dip").repartition(5)
    assert T.is_non_decreasing(df, "k", "up")
    assert not T.is_non_decreasing(df, "k", "dip")


def test_order_keys_keep_their_type_repeat_and_may_be_missing(spark, make):
    far = spark.range(20).selectExpr(f"{10**18}L + id as k", "100 - id as down")
    assert not T.is_non_decreasing(far, "k", "down")
    repeated = spark.range(1000).selectExpr("id div 500 as k", "id as v")
    assert T.is_non_decreasing(repeated, "k", "v")
    gaps = make("k long, v long", k=[1, 2, None, 3], v=[5, 6, 0, 7])
    assert T.is_non_decreasing(gaps, "k", "v")


@pytest.mark.parametrize("rows", [10, 2_000_000])
def test_missing_keys_and_infinities_do_not_depend_on_the_buckets(spark, monkeypatch, rows):
    from datasonde.operators import order_stats as O

    monkeypatch.setattr(O, "ROWS_PER_BUCKET", rows)
    df = spark.range(50).selectExpr("if(id % 7 = 0, null, id) as k", "id as up", "double('Infinity') as far", "double(id) as x")
    assert T.is_non_decreasing(df, "k", "up")
    found = {r["column"]: r["median"] for r in column_quantiles(df, ["far", "x"]).collect()}
    assert found == {"far": float("inf"), "x": 24.5}


def test_co_missing_looks_at_every_column(spark):
    df = spark.range(40).selectExpr(*[f"if(id % {i + 2} = 0, null, id) as c{i}" for i in range(35)])
    assert T.co_missing_pairs(df, limit=1000).count() == 35 * 34 // 2
    assert T.co_missing_pairs(df, limit=1000, max_columns=30).count() == 30 * 29 // 2


def test_infinities_do_not_become_nan(make):
    n = 30
    df = make("x double, y double, g string", x=[float("inf"), *map(float, range(n - 1))], y=[float(i * i) for i in range(n)], g=["a", "b", "c"] * 10)
    moments = {r["column"]: r for r in numeric_moments(df).collect()}
    assert moments["x"]["std"] is None and moments["x"]["skew"] is None and moments["y"]["std"] is not None
    assert {r["numeric"] for r in category_effects(df).collect()} <= {"y"}
    bins = [r["cnt"] for r in histogram(df.select("x")).collect()]
    assert sum(bins) == n - 1 and max(bins) == 1


def test_rows_with_many_gaps_make_no_rows_each(spark):
    """Each row misses all but one of 60 columns; patterns differ, pairs are counted in the tasks."""
    width, n = 60, 900
    df = spark.range(n).repartition(4).selectExpr(*[f"if(id % {width} = {i}, id, null) as c{i:02}" for i in range(width)])
    got = [tuple(r) for r in T.co_missing_pairs(df, limit=2000).collect()]
    assert len(got) == width * (width - 1) // 2
    assert got[0] == ("c00", "c01", n - 2 * n // width, round((n - 2 * n // width) * 100 / n, 2))
    assert [g[:2] for g in got] == [(f"c{i:02}", f"c{j:02}") for i in range(width) for j in range(i + 1, width)]


def test_no_pair_of_gaps(make):
    assert T.co_missing_pairs(make("a int, b int", a=[1, None], b=[2, 3])).collect() == []
    assert T.co_missing_pairs(make("a int, b int", a=[1, None], b=[None, 3])).collect() == []
