"""Filters, plan aggregates and date windows."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from datasonde.functions.values import union_all
from datasonde.plans.engine import run_plan
from datasonde.plans.windows import conjunction, date_window
from datasonde_queries.registry import register, tidy
from datasonde_queries.views import over, table

NOW = datetime(1998, 3, 30, 12, tzinfo=UTC)  # a Monday


def leaf(op: str, column: str, value: object) -> dict:
    return {"op": op, "column": column, "value": value}


def result_of(df, plan: dict, tz: str = "UTC"):
    result = run_plan(df, plan, tz, NOW)
    if not result.ok:
        raise ValueError(result.error)
    return result.table


def plan_query(name: str, source: str, plan: dict, where: str, digits: int | None = None) -> None:
    """An ungrouped plan against its SQL; ``where`` is two-valued SQL."""

    def run(spark, sf):
        out = result_of(table(spark, sf, source), plan)
        return out if digits is None else tidy(out, value=digits)

    aggregate, column = plan["aggregate"], plan.get("column")
    sql = {
        "count": "count(*)",
        "count_nonnull": f"count({column})",
        "sum": f"coalesce(sum({column}), 0)",
        "mean": f"avg({column})",
        "min": f"min({column})",
        "max": f"max({column})",
    }[aggregate]
    value = sql if digits is None else f"round_even(cast({sql} as double), {digits})"
    used = "count(*)" if aggregate == "count" else f"count({column})"
    register(name, run, over(source, f"select {value} as value, count(*) as n_matched, {used} as n_used from v where {where}"))


def several(name: str, source: str, label: str, cases: list[tuple[str, dict, str]]) -> None:
    """One row per case (label, value): counting plans side by side."""

    def run(spark, sf):
        df = table(spark, sf, source)
        return union_all(
            result_of(df, {"aggregate": "count", "filters": node}).selectExpr(f"'{case}' as {label}", "value")
            for case, node, _ in cases
        )

    sql = "\nunion all ".join(
        f"select '{case}' as {label}, count(*) as value from v where {where}" for case, _, where in cases
    )
    register(name, run, over(source, sql))


# -- filters -------------------------------------------------------------------

plan_query(
    "filter_eq",
    "orders_gaps",
    {"aggregate": "mean", "column": "o_totalprice", "filters": leaf("=", "o_orderpriority", "1-URGENT")},
    "o_orderpriority = '1-URGENT'",
    4,
)
plan_query(
    "filter_ne",
    "orders_gaps",
    {"aggregate": "count_nonnull", "column": "o_totalprice", "filters": leaf("!=", "o_orderpriority", "1-URGENT")},
    "o_orderpriority is distinct from '1-URGENT'",
)
plan_query(
    "filter_cmp",
    "orders_gaps",
    {
        "aggregate": "sum",
        "column": "o_totalprice",
        "filters": {"op": "and", "children": [leaf(">", "o_totalprice", 100000), leaf("<=", "o_totalprice", 300000.5)]},
    },
    "o_totalprice > 100000 and o_totalprice <= 300000.5",
    2,
)
plan_query(
    "filter_in",
    "orders_gaps",
    {
        "aggregate": "count",
        "filters": {"op": "in", "column": "o_orderpriority", "values": ["1-URGENT", "2-HIGH"]},
    },
    "o_orderpriority in ('1-URGENT', '2-HIGH')",
)
plan_query(
    "filter_not_in",
    "orders_gaps",
    {
        "aggregate": "count",
        "filters": {"op": "not in", "column": "o_orderpriority", "values": ["1-URGENT", "2-HIGH"]},
    },
    "o_orderpriority is null or o_orderpriority not in ('1-URGENT', '2-HIGH')",
)
plan_query(
    "filter_between",
    "orders_gaps",
    {
        "aggregate": "mean",
        "column": "o_totalprice",
        "filters": {"op": "between", "column": "o_totalprice", "low": 50000, "high": 150000},
    },
    "o_totalprice between 50000 and 150000",
    4,
)
several(
    "filter_null",
    "orders_gaps",
    "test",
    [
        ("price missing", {"op": "is null", "column": "o_totalprice"}, "o_totalprice is null"),
        ("price present", {"op": "not null", "column": "o_totalprice"}, "o_totalprice is not null"),
        ("priority missing", {"op": "is null", "column": "o_orderpriority"}, "o_orderpriority is null"),
    ],
)
_between = {"op": "between", "column": "o_totalprice", "low": 50000, "high": 400000}
plan_query(
    "filter_tree",
    "orders_gaps",
    {
        "aggregate": "count",
        "filters": {
            "op": "and",
            "children": [
                {"op": "not", "child": _between},
                {
                    "op": "or",
                    "children": [
                        leaf("=", "o_orderstatus", "F"),
                        {"op": "not", "child": leaf("=", "o_orderpriority", "5-LOW")},
                        {"op": "is null", "column": "o_totalprice"},
                    ],
                },
            ],
        },
    },
    "not coalesce(o_totalprice between 50000 and 400000, false) and "
    "(o_orderstatus = 'F' or not coalesce(o_orderpriority = '5-LOW', false) or o_totalprice is null)",
)

# token: the date it stands for on NOW
TOKENS = {
    "@now": "1998-03-30 12:00:00",
    "@day_start": "1998-03-30",
    "@week_start": "1998-03-30",
    "@month_start": "1998-03-01",
    "@quarter_start": "1998-01-01",
    "@year_start": "1998-01-01",
    "@last_day_start": "1998-03-29",
    "@last_week_start": "1998-03-23",
    "@last_month_start": "1998-02-01",
    "@last_quarter_start": "1997-10-01",
    "@last_year_start": "1997-01-01",
    "@last_7_days_start": "1998-03-24",
}
several(
    "filter_date_token",
    "orders",
    "token",
    [(t, leaf(">=", "o_orderdate", t), f"o_orderdate >= timestamp '{at}'") for t, at in TOKENS.items()],
)
several(
    "filter_iso_date",
    "orders",
    "literal",
    [
        ("day", leaf("<", "o_orderdate", "1996-07-01"), "o_orderdate < timestamp '1996-07-01'"),
        ("month", leaf(">=", "o_orderdate", "1996-07"), "o_orderdate >= timestamp '1996-07-01'"),
        ("basic", leaf("=", "o_orderdate", "19980105"), "o_orderdate = timestamp '1998-01-05'"),
        ("time", leaf(">", "o_orderdate", "1999-12-31T23:59:59"), "o_orderdate > timestamp '1999-12-31 23:59:59'"),
        ("offset", leaf(">=", "o_orderdate", "2000-01-01T00:00:00+02:00"), "o_orderdate >= timestamp '2000-01-01'"),
    ],
)
several(
    "filter_bool",
    "orders_flags",
    "literal",
    [
        ("true", leaf("=", "is_large", True), "is_large"),
        ("yes", leaf("=", "is_large", "yes"), "is_large"),
        ("zero", leaf("=", "is_large", "0"), "not is_large"),
        ("not no", leaf("!=", "is_large", "no"), "is_large"),
    ],
)

# window: (arguments, SQL)
WINDOWS = {
    "last 30 days": (("last_days", {"days": 30}), "o_orderdate >= timestamp '1998-03-01'"),
    "last month": (
        ("last_period", {"unit": "month"}),
        "o_orderdate >= timestamp '1998-02-01' and o_orderdate < timestamp '1998-03-01'",
    ),
    "last week": (
        ("last_period", {"unit": "week"}),
        "o_orderdate >= timestamp '1998-03-23' and o_orderdate < timestamp '1998-03-30'",
    ),
    "this quarter": (("this_period", {"unit": "quarter"}), "o_orderdate >= timestamp '1998-01-01'"),
    "since last year": (("since_last", {"unit": "year"}), "o_orderdate >= timestamp '1997-01-01'"),
    "since this month": (("since_this", {"unit": "month"}), "o_orderdate >= timestamp '1998-03-01'"),
    "since a date": (("since", {"start": "1999-06-01"}), "o_orderdate >= timestamp '1999-06-01'"),
    "between dates": (
        ("between", {"start": "1996-01-01", "end": "1996-12-31"}),
        "o_orderdate between timestamp '1996-01-01' and timestamp '1996-12-31'",
    ),
    "after a date": (("after", {"start": "1996-12-31"}), "o_orderdate > timestamp '1996-12-31'"),
    "before a date": (("before", {"start": "1996-12-31"}), "o_orderdate < timestamp '1996-12-31'"),
}


def _windows(spark, sf):
    df = table(spark, sf, "orders")
    rows = []
    for label, ((kind, arguments), _) in WINDOWS.items():
        node = conjunction(date_window(df, kind, **arguments))
        rows.append(result_of(df, {"aggregate": "count", "filters": node}).selectExpr(f"'{label}' as period", "value"))
    return union_all(rows)


register(
    "date_window",
    _windows,
    "\nunion all ".join(
        f"select '{label}' as period, count(*) as value from orders where {where}" for label, (_, where) in WINDOWS.items()
    ),
)

# -- checks --------------------------------------------------------------------

# plan: its error, None for one that runs
CHECKED = [
    ("good", {"aggregate": "sum", "column": "o_totalprice"}, None),
    ("unknown metric", {"aggregate": "mean", "column": "nope"}, "metric column 'nope' not found"),
    ("mean of text", {"aggregate": "mean", "column": "o_orderstatus"}, "aggregate 'mean' needs a numeric column"),
    ("count of a column", {"aggregate": "count", "column": "o_custkey"}, "'count' counts matching rows and takes no column"),
    (
        "text for a number",
        {"aggregate": "count", "filters": leaf(">", "o_totalprice", "big")},
        "column 'o_totalprice' is numeric; 'big' must be a number",
    ),
    (
        "ordered text",
        {"aggregate": "count", "filters": leaf("<", "o_orderstatus", "F")},
        "'<' needs a numeric or datetime column, 'o_orderstatus' is neither",
    ),
    (
        "four keys",
        {"aggregate": "count", "group_by": ["o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey"]},
        "'group_by' takes at most 3 columns",
    ),
]


def _plan_errors(spark, sf):
    df = table(spark, sf, "orders")
    rows = []
    for label, plan, _ in CHECKED:
        result = run_plan(df, plan, now=NOW)
        if result.ok:
            rows.append(result.table.selectExpr(f"'{label}' as plan", "true as ok", "cast(null as string) as error", "n_matched"))
        else:
            bad = spark.createDataFrame([(label, False, result.error, None)], "plan string, ok boolean, error string, n_matched bigint")
            rows.append(bad)
    return union_all(rows)


def _quoted(text: str | None) -> str:
    return "cast(null as varchar)" if text is None else "'" + text.replace("'", "''") + "'"


register(
    "plan_errors",
    _plan_errors,
    "\nunion all ".join(
        f"select '{label}' as plan, {str(error is None).lower()} as ok, {_quoted(error)} as error, "
        + ("count(*) as n_matched from orders" if error is None else "cast(null as bigint) as n_matched")
        for label, _, error in CHECKED
    ),
)

# -- aggregates ----------------------------------------------------------------

_recent = leaf(">=", "o_orderdate", "@last_year_start")
_recent_sql = "o_orderdate >= timestamp '1997-01-01'"
plan_query("plan_scalar", "orders_gaps", {"aggregate": "mean", "column": "o_totalprice", "filters": _recent}, _recent_sql, 4)
plan_query("plan_count", "orders_gaps", {"aggregate": "count", "filters": _recent}, _recent_sql)
plan_query("plan_count_nonnull", "orders_gaps", {"aggregate": "count_nonnull", "column": "o_orderpriority"}, "true")
plan_query("plan_mean", "lineitem", {"aggregate": "mean", "column": "l_extendedprice"}, "true", 4)


def _sums(spark, sf):
    df = table(spark, sf, "orders_gaps")
    whole = result_of(df, {"aggregate": "sum", "column": "o_totalprice"}).selectExpr("'all' as rows", "*")
    none = {"op": "and", "children": [leaf("<", "o_totalprice", 0), _recent]}
    empty = result_of(df, {"aggregate": "sum", "column": "o_totalprice", "filters": none}).selectExpr("'none' as rows", "*")
    return tidy(whole.unionByName(empty), value=2)


register(
    "plan_sum",
    _sums,
    over(
        "orders_gaps",
        "select 'all' as rows, round_even(sum(o_totalprice), 2) as value, count(*) as n_matched, count(o_totalprice) as n_used from v\n"
        "union all select 'none', coalesce(round_even(sum(o_totalprice), 2), 0.0::double), count(*), count(o_totalprice) from v "
        f"where o_totalprice < 0 and {_recent_sql}",
    ),
)


def _extremes(spark, sf):
    df = table(spark, sf, "orders_gaps")
    parts = []
    for aggregate in ("min", "max"):
        number = result_of(df, {"aggregate": aggregate, "column": "o_totalprice"})
        parts.append(number.selectExpr(f"'{aggregate} price' as what", "cast(bround(value, 2) as string) as value", "n_used"))
        date = result_of(df, {"aggregate": aggregate, "column": "o_orderdate"})
        parts.append(date.selectExpr(f"'{aggregate} date' as what", "date_format(value, 'yyyy-MM-dd') as value", "n_used"))
        text = result_of(df, {"aggregate": aggregate, "column": "o_orderpriority"})
        parts.append(text.selectExpr(f"'{aggregate} priority' as what", "value", "n_used"))
    return union_all(parts)


register(
    "plan_min_max",
    _extremes,
    over(
        "orders_gaps",
        "\nunion all ".join(
            f"select '{f} price' as what, cast(round_even({f}(o_totalprice), 2) as varchar) as value, count(o_totalprice) as n_used from v "
            f"union all select '{f} date', strftime({f}(o_orderdate), '%Y-%m-%d'), count(o_orderdate) from v "
            f"union all select '{f} priority', {f}(o_orderpriority), count(o_orderpriority) from v"
            for f in ("min", "max")
        ),
    ),
)


def _plan_group(spark, sf):
    plan = {
        "aggregate": "mean",
        "column": "o_totalprice",
        "filters": {"op": "and", "children": [_recent, leaf("!=", "o_orderstatus", "P")]},
        "group_by": ["o_orderstatus", "o_orderpriority"],
    }
    return tidy(result_of(table(spark, sf, "orders_gaps"), plan), value=4)


PLAN_GROUP_SQL = over(
    "orders_gaps",
    "select o_orderstatus, o_orderpriority, round_even(avg(o_totalprice), 4) as value, count(o_totalprice) as n, "
    f"count(*) as n_rows, false as truncated from v where {_recent_sql} and o_orderstatus is distinct from 'P' "
    "and o_orderpriority is not null group by 1, 2",
)
register("plan_group", _plan_group, PLAN_GROUP_SQL)


def _plan_group_counts(spark, sf):
    plan = {"aggregate": "count_nonnull", "column": "o_totalprice", "group_by": ["o_orderpriority"]}
    return result_of(table(spark, sf, "orders_gaps"), plan)


register(
    "plan_group_count_nonnull",
    _plan_group_counts,
    over(
        "orders_gaps",
        "select o_orderpriority, count(o_totalprice) as value, count(o_totalprice) as n, count(*) as n_rows, "
        "false as truncated from v where o_orderpriority is not null group by 1",
    ),
)


def _plan_group_top(spark, sf):
    plan = {"aggregate": "sum", "column": "l_quantity", "group_by": ["l_suppkey", "l_returnflag"]}
    return tidy(result_of(table(spark, sf, "lineitem"), plan), value=2)


register(
    "plan_group_top20",
    _plan_group_top,
    "with g as (select cast(l_suppkey as varchar) as l_suppkey, l_returnflag, round_even(sum(l_quantity), 2) as value, "
    "count(l_quantity) as n, count(*) as n_rows from lineitem group by 1, 2)\n"
    "select *, (select count(*) from g) > 20 as truncated from g order by l_suppkey, l_returnflag limit 20",
)


# what a plan says it computes: (plan, time zone, the sentence, its rows in SQL)
EXPLAINED = [
    (
        {"aggregate": "mean", "column": "o_totalprice", "filters": leaf("=", "o_orderstatus", "F")},
        "UTC",
        "mean of `o_totalprice` | where `o_orderstatus` = 'F'",
        "o_orderstatus = 'F'",
    ),
    (
        {
            "aggregate": "count",
            "filters": {
                "op": "and",
                "children": [
                    leaf(">=", "o_orderdate", "@last_month_start"),
                    {"op": "not", "child": {"op": "in", "column": "o_orderpriority", "values": ["1-URGENT", "5-LOW"]}},
                ],
            },
        },
        "Asia/Tokyo",
        "count of matching rows | where (`o_orderdate` >= 1998-02-01 00:00:00+09:00 and not (`o_orderpriority` in ('1-URGENT', '5-LOW')))"
        " | [Asia/Tokyo; @last_month_start=1998-02-01T00:00:00+09:00]",
        "o_orderdate >= timestamp '1998-02-01' and (o_orderpriority is null or o_orderpriority not in ('1-URGENT', '5-LOW'))",
    ),
    (
        {
            "aggregate": "sum",
            "column": "o_totalprice",
            "group_by": ["o_orderstatus", "o_orderpriority"],
            "filters": {
                "op": "or",
                "children": [
                    {"op": "between", "column": "o_totalprice", "low": 1000, "high": 50000.5},
                    {"op": "is null", "column": "o_orderpriority"},
                ],
            },
        },
        "UTC",
        "sum of `o_totalprice` | where (`o_totalprice` between 1000 and 50000.5 or `o_orderpriority` is null)"
        " | grouped by `o_orderstatus`, `o_orderpriority`",
        "(o_totalprice between 1000 and 50000.5 or o_orderpriority is null) and o_orderstatus is not null and o_orderpriority is not null",
    ),
]


def plan_explanation(spark, sf):
    """The sentence of each plan beside the number of rows that the plan used."""
    df = table(spark, sf, "orders_gaps")
    said = []
    for plan, tz, *_ in EXPLAINED:
        result = run_plan(df, plan, tz, NOW)
        n = "n_rows" if "group_by" in plan else "n_matched"
        said.append(result.table.selectExpr(f"sum({n}) as n_rows").withColumn("explanation", F.lit(result.interpretation)))
    return union_all(said)


register(
    "plan_explanation",
    plan_explanation,
    over(
        "orders_gaps",
        "\nunion all ".join(
            f"select count(*) as n_rows, '{text.replace(chr(39), chr(39) * 2)}' as explanation from v where {where}" for _, _, text, where in EXPLAINED
        ),
    ),
)
