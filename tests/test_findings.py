import pytest

from datasonde.operators.findings import insights, recommendations


def rules(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["rule"], []).append((r["column_a"], r["column_b"], r["metric"], r["value"]))
    return out


@pytest.fixture(scope="module")
def messy(spark):
    """An orders export of 550 rows with every common fault, rebuilt from its description."""
    clean = spark.range(540).selectExpr(
        "id as order_id",
        "date_format(date_add(date'2024-01-01', cast(id % 300 as int)), if(id % 2 = 0, 'dd/MM/yyyy', 'MMM d, yyyy')) as order_date",
        "case when id % 3 = 0 then 'North' when id % 3 = 1 then 'north' else 'South' end as customer_region",
        "case when id % 2 = 0 then 'web' else 'store' end as channel",
        "case when id % 5 = 0 then '  ' else concat('note ', id % 40) end as notes",
        "if(id % 68 = 0, -999.0D, double(id % 20)) as discount_pct",
        "if(id % 36 < 5, null, double(id % 10)) as delivery_days",
        "if(id % 50 = 0, 40000.0D, 100.0D + id % 37) as amount_usd",
        "1000.0D + id * 3 as revenue",
        "400.0D + id * 2 + id % 7 as cost",
    )
    return clean.union(clean.where("order_id < 10"))


def test_messy_orders(messy):
    found = rules(insights(messy))
    assert ("n_rows", 550.0) in [m[2:] for m in found["shape"]]
    assert ("duplicate_rows", 10.0) in [m[2:] for m in found["shape"]]
    assert [m[0] for m in found["missing"]] == ["delivery_days"]
    flagged = {(m[0], m[2]) for m in found["quality"]}
    assert ("order_date", "dates_as_text") in flagged and ("customer_region", "mixed_case") in flagged
    assert not any(column == "channel" for column, _ in flagged)
    assert ("revenue", "cost") in [m[:2] for m in found["corr"]]
    assert "id_like" not in found  # duplicates rule identifiers out
    advice = rules(recommendations(messy))
    assert advice["dedup"] == [(None, None, "duplicate_rows", 10.0)]
    assert ("revenue", "cost") in [m[:2] for m in advice["collinear"]]
    assert {m[2].split(":")[0] for m in advice["quality"]} == {"whitespace", "dates_as_text", "sentinels", "mixed_case", "numeric_sentinel"}
    assert "clean" not in advice


def test_clean_table(spark):
    df = spark.range(200).selectExpr("double(id % 50) + 0.25D as v", "if(id < 50, 'a', if(id < 120, 'b', 'c')) as k", "concat('t', id % 4) as q")
    assert rules(recommendations(df)) == {"clean": [(None, None, "recommendations", 0.0)]}
    assert rules(insights(df))["missing"] == [(None, None, "columns_with_missing", 0.0)]


def test_rank_without_line(spark):
    df = spark.range(1, 60).selectExpr("double(id) as x", "power(id / 59.0D, 120) as y")
    assert [m[:2] for m in rules(insights(df))["nonlinear"]] == [("x", "y")]


def test_imbalance_and_many_values(spark):
    df = spark.range(100).selectExpr("concat('u', id) as name", "if(id < 90, 'web', 'store') as channel", "id < 95 as ok")
    found = rules(insights(df))
    assert found["imbalance"] == [("channel", None, "web", 0.9), ("ok", None, "True", 0.95)]
    assert found["high_card"] == [("name", None, "n_unique", 100.0)]


def test_group_effects(spark):
    df = spark.range(90).selectExpr("case id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as g", "double(id % 3) * 100 + id % 5 as v")
    found = rules(insights(df))["group_effect"]
    assert [(m[0], m[1], m[2]) for m in found] == [("v", "g", "min_mean"), ("v", "g", "max_mean")]
    assert rules(recommendations(df))["group_level"][0][:2] == ("v", "g")
