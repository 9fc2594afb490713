"""Sources and sinks."""

from __future__ import annotations

from datasonde.functions.shared import shared_folder
from datasonde.functions.values import union_all
from datasonde.sources import parts as P
from datasonde.sources import sinks as K
from datasonde.sources import tables as S
from datasonde_queries.profile import (
    GAPS_COLUMNS,
    PCT_MISSING,
    completeness_sql,
    cramers_sql,
    effects_sql,
    id_like_sql,
    issues_sql,
    pearson_sql,
    pii_scan_sql,
    spearman_sql,
    strongest_sql,
    top_sql,
)
from datasonde_queries.registry import each, query
from datasonde_queries.views import over, table

YEARS = range(1995, 2002)
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority"
ORDER_SELECT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "date_format(o_orderdate, 'yyyy-MM-dd') as o_orderdate", "o_orderpriority"]


def order_parts(spark, sf) -> dict:
    """All orders, one part per year, and a part without rows."""
    orders = table(spark, sf, "orders")
    parts = {str(y): orders.where(f"year(o_orderdate) = {y}") for y in YEARS}
    return {**parts, "blank": orders.where("false")}


@query(
    "scan_csv",
    "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, case when c_custkey % 9 = 0 then null else c_acctbal end as c_acctbal, "
    "case when c_custkey % 4 = 0 then null else c_mktsegment end as c_mktsegment, c_acctbal < 0 as in_debt from customer",
)
def scan_csv(spark, sf):
    path = f"{shared_folder(spark)}/customer.csv"
    table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "c_name",
        "c_nationkey",
        "if(c_custkey % 9 = 0, 'n/a', cast(c_acctbal as string)) as c_acctbal",
        "if(c_custkey % 4 = 0, 'NULL', c_mktsegment) as c_mktsegment",
        "c_acctbal < 0 as in_debt",
    ).write.csv(path, header=True)
    return S.read_table(spark, path)


@query("combine_parts", f"select cast(year(orders.o_orderdate) as varchar) as sheet, {ORDER_COLUMNS} from orders")
def combine_parts(spark, sf):
    combined, _ = P.combine_parts(order_parts(spark, sf))
    return combined.selectExpr("sheet", *ORDER_SELECT)


@query(
    "select_part",
    "select 'by name' as how, o_orderkey, o_totalprice from orders where year(o_orderdate) = 1997 union all "
    "select 'by index', o_orderkey, o_totalprice from orders where year(o_orderdate) = 1995 union all "
    "select 'from the end', o_orderkey, o_totalprice from orders where year(o_orderdate) = 2001",
)
def select_part(spark, sf):
    parts = order_parts(spark, sf)
    wanted = {"by name": "1997", "by index": 0, "from the end": -2}
    return union_all(P.select_part(parts, w).selectExpr(f"'{how}' as how", "o_orderkey", "o_totalprice") for how, w in wanted.items())


@query(
    "list_parts",
    "select y - 1995 as position, cast(y as varchar) as part, (select count(*) from orders where year(o_orderdate) = y) as n_rows "
    "from (select unnest(range(1995, 2002)) as y) union all select 7, 'blank', 0",
)
def list_parts(spark, sf):
    parts = order_parts(spark, sf)
    sizes = union_all(df.selectExpr(f"'{name}' as part", "count(*) as n_rows") for name, df in parts.items())
    return P.parts_table(spark, parts).join(sizes, "part")


@query("skip_empty_parts", "select o_orderkey, o_totalprice, false as has_origin, 'skipped empty part ''blank''' as warning from orders")
def skip_empty_parts(spark, sf):
    orders = table(spark, sf, "orders")
    combined, warnings = P.combine_parts({"all": orders, "blank": orders.where("false")})
    has_origin = str(P.PART_COLUMN in combined.columns).lower()
    said = "; ".join(warnings).replace("'", "\\'")
    return combined.selectExpr("o_orderkey", "o_totalprice", f"{has_origin} as has_origin", f"'{said}' as warning")


@query(
    "infer_datetimes",
    "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as day, 'timestamp_ntz' as day_type, strftime(o_orderdate, '%Y%m%d') as basic, "
    "'timestamp_ntz' as basic_type, case when o_orderkey = (select max(o_orderkey) from orders) then 'not a date' else strftime(o_orderdate, '%Y-%m-%d') end as mixed, "
    "'string' as mixed_type, strftime(o_orderdate - interval 2 hour, '%Y-%m-%d %H:%M:%S') as zoned, 'timestamp' as zoned_type from orders",
)
def infer_datetimes(spark, sf):
    orders = table(spark, sf, "orders")
    last = orders.selectExpr("max(o_orderkey) as k").first()["k"]
    text = "date_format(o_orderdate, 'yyyy-MM-dd')"
    written = orders.selectExpr(
        "o_orderkey",
        f"{text} as day",
        "date_format(o_orderdate, 'yyyyMMdd') as basic",
        f"if(o_orderkey = {last}, 'not a date', {text}) as mixed",
        f"concat({text}, 'T00:00:00+02:00') as zoned",
    )
    return S.infer_datetimes(written).selectExpr(
        "o_orderkey",
        "date_format(day, 'yyyy-MM-dd HH:mm:ss') as day",
        "typeof(day) as day_type",
        "date_format(basic, 'yyyyMMdd') as basic",
        "typeof(basic) as basic_type",
        "mixed",
        "typeof(mixed) as mixed_type",
        "date_format(zoned, 'yyyy-MM-dd HH:mm:ss') as zoned",
        "typeof(zoned) as zoned_type",
    )


@query("row_budget", "select least(count(*), 10001) as n_read, count(*) > 10000 as exceeded from lineitem")
def row_budget(spark, sf):
    return S.row_budget(table(spark, sf, "lineitem"), 10_000).selectExpr("count(*) as n_read", "count(*) > 10000 as exceeded")


@query(
    "input_guards",
    "select 'whole' as input, cast(null as varchar) as problem, count(*) as n_rows from orders union all "
    "select 'blank', 'input contains no data rows', 0 union all "
    "select 'over budget', case when count(*) > 1000 then 'input has more than 1,000 rows' end, count(*) from orders",
)
def input_guards(spark, sf):
    orders = table(spark, sf, "orders")
    cases = {"whole": (orders, None), "blank": (orders.where("false"), None), "over budget": (orders, 1000)}
    rows = []
    for name, (df, max_rows) in cases.items():
        problem = S.check_input(df, max_rows)
        shown = f"'{problem}'" if problem else "cast(null as string)"
        rows.append(df.selectExpr(f"'{name}' as input", f"{shown} as problem", "count(*) as n_rows"))
    return union_all(rows)


@query("preview_rows", f"select {ORDER_COLUMNS} from orders order by orders.o_orderkey limit 100")
def preview_rows(spark, sf):
    return S.preview(table(spark, sf, "orders"), ["o_orderkey"]).selectExpr(*ORDER_SELECT)


@query(
    "profile_sink",
    over(
        "orders_gaps",
        "with m as (" + each(f"select '{{c}}' as \"column\", count(*) - count({{c}}) as n_missing, {PCT_MISSING} as pct_missing, count(distinct {{c}}) as n_unique from v", c=GAPS_COLUMNS) + ")\n"
        "select 'missing' as section, \"column\", n_missing as n, pct_missing as pct from m union all select 'distinct', \"column\", n_unique, null from m\n"
        "union all select 'duplicates', null, (select count(*) from v) - (select count(*) from (select distinct * from v)), null\n"
        "union all select 'empty_rows', null, count(*), null from v where " + " or ".join(f"{c} is null" for c in GAPS_COLUMNS) + "\n"
        "union all select 'co_missing', 'o_totalprice+o_orderpriority', count(*), null from v where o_totalprice is null and o_orderpriority is null",
    ),
)
def profile_sink(spark, sf):
    """A whole profile written as JSON, and some of its sections read back."""
    tables = K.profile_tables(table(spark, sf, "orders_gaps"), order_by=["o_orderkey"])
    written = dict(zip(tables, K.write_profile(tables, shared_folder(spark), run_id="1")))
    none = "cast(null as double)"
    read = {
        "missing": ("column string, n_missing bigint, pct_missing double", "column", "n_missing", "pct_missing"),
        "distinct": ("column string, n_unique bigint", "column", "n_unique", none),
        "duplicates": ("duplicate_rows bigint", "cast(null as string)", "duplicate_rows", none),
        "empty_rows": ("rows_with_missing bigint", "cast(null as string)", "rows_with_missing", none),
        "co_missing": ("col_a string, col_b string, cnt bigint", "concat(col_a, '+', col_b)", "cnt", none),
    }
    return union_all(
        spark.read.schema(schema).json(written[section]).selectExpr(f"'{section}' as section", f"{column} as column", f"{n} as n", f"{pct} as pct")
        for section, (schema, column, n, pct) in read.items()
    )


@query(
    "scan_csv_breaks",
    "select c_custkey, case when c_custkey % 3 = 0 then c_name || chr(10) || '\"' || c_mktsegment || '\", ' || chr(10) || 'x' else c_name end as c_name, "
    "case when c_custkey % 5 = 0 then null else c_acctbal end as c_acctbal, case when c_custkey % 7 = 0 then chr(10) || ',' else c_mktsegment end as \"two\nlines\" from customer",
)
def scan_csv_breaks(spark, sf):
    """Cells with quotes, commas and line breaks, and a header with one, in several files."""
    path = f"{shared_folder(spark)}/customer.csv"
    table(spark, sf, "customer").repartition(3, "c_custkey").selectExpr(
        "c_custkey",
        "if(c_custkey % 3 = 0, concat(c_name, '\\n\"', c_mktsegment, '\", \\nx'), c_name) as c_name",
        "if(c_custkey % 5 = 0, 'NA', cast(c_acctbal as string)) as c_acctbal",
        "if(c_custkey % 7 = 0, '\\n,', c_mktsegment) as `two\nlines`",
    ).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.read_table(spark, path)


@query(
    "byte_guard",
    "select 'one byte' as allowed, true as refused, count(*) as n_rows from orders union all select 'a petabyte', false, count(*) from orders",
)
def byte_guard(spark, sf):
    orders = table(spark, sf, "orders")
    limits = {"one byte": 1, "a petabyte": 10**15}
    refused = {name: str("the limit is" in (S.check_input(orders, max_bytes=n) or "")).lower() for name, n in limits.items()}
    return union_all(orders.selectExpr(f"'{name}' as allowed", f"{said} as refused", "count(*) as n_rows") for name, said in refused.items())


NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
CATEGORIES = ["o_orderstatus", "o_orderpriority"]
QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
MOMENTS = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "skew": "skewness({c})", "kurtosis": "kurtosis({c})"}
KINDS = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "categorical"}


def long_sql(section: str, item: str, stats: dict[str, str], source: str, said: str = "null") -> str:
    """(section, item, stat, value, said): a row for each statistic of each row of ``source``."""
    return "\nunion all ".join(
        f"select '{section}' as section, cast({item} as varchar) as item, '{stat}' as stat, round_even(cast({value} as double), 4) + 0.0::double as value, "
        f"cast({said} as varchar) as said from ({source})"
        for stat, value in stats.items()
    )


def long_rows(section: str, df, item: str, stats: dict[str, str], said: str = "null"):
    cells = ", ".join(f"struct('{stat}' as stat, bround(cast({value} as double), 4) + 0.0D as value)" for stat, value in stats.items())
    return df.selectExpr(f"'{section}' as section", f"cast({item} as string) as item", f"inline(array({cells}))", f"cast({said} as string) as said")


PAIR = "col_a || '+' || col_b"
COLUMN = '"column"'
SECTIONS_SQL = "\nunion all ".join(
    [
        *[long_sql("column_types", f"'{c}'", {"n_valid": f"(select count({c}) from v)"}, "select 1", f"'{kind}'") for c, kind in KINDS.items()],
        *[long_sql("quantiles", f"'{c}'", {q: f"(select quantile_cont({c}::double, {p}) from v)" for q, p in QUANTILES.items()}, "select 1") for c in NUMBERS],
        *[long_sql("modes", f"'{c}'", {"mode": c}, f"select {c} from v where {c} is not null group by {c} order by count(*) desc, {c} limit 1") for c in NUMBERS],
        *[long_sql("moments", f"'{c}'", {m: f"(select {sql.format(c=c)} from v)" for m, sql in MOMENTS.items()}, "select 1") for c in NUMBERS],
        *[long_sql("moments", f"'{c}'", {"n_zeros": f"count(case when {c} = 0 then 1 end)", "n_negative": f"count(case when {c} < 0 then 1 end)"}, "select * from v") for c in NUMBERS],
        long_sql("shape", "'table'", {"n_rows": "n", "n_columns": "6", "n_numeric_columns": "3", "n_categorical_columns": "3"}, "select count(*) as n from v"),
        long_sql("top_values", COLUMN, {"rank": "rank", "cnt": "cnt"}, top_sql("v", CATEGORIES, 5), "value"),
        long_sql("datetime_spans", "'o_orderdate'", {"n_valid": "count(o_orderdate)", "span_days": "date_diff('day', min(o_orderdate), max(o_orderdate))"}, "select * from v", "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S')"),
        long_sql("pearson", PAIR, {"pearson_r": "pearson_r"}, strongest_sql(pearson_sql(NUMBERS), 0.3, "pearson_r")),
        long_sql("spearman", PAIR, {"spearman_r": "spearman_r"}, strongest_sql(spearman_sql(NUMBERS), 0.5, "spearman_r")),
        long_sql("cramers_v", PAIR, {"cramers_v": "cramers_v"}, strongest_sql(cramers_sql(CATEGORIES), 0.3, "cramers_v")),
        long_sql("category_effects", "category || '+' || numeric || '+' || \"group\"", {"rank": "rank", "spread": "spread", "group_rank": "group_rank", "mean": "mean", "cnt": "cnt"}, effects_sql(cats=CATEGORIES, nums=NUMBERS)),
        long_sql("id_like", COLUMN, {"found": "1"}, id_like_sql("v", NUMBERS[:2], CATEGORIES), "reason"),
        long_sql("quality", COLUMN, {"hits": "hits", "total": "total"}, issues_sql(CATEGORIES), '"check"'),
        long_sql("pii", COLUMN, {"cnt": "cnt", "pct": "pct"}, pii_scan_sql(CATEGORIES), "kind"),
        long_sql("health", "'table'", {"completeness": "round_even(score, 0)", "uniqueness": "100", "consistency": "100", "validity": "100"}, completeness_sql(GAPS_COLUMNS)),
        long_sql("sample", "o_orderkey", {"o_custkey": "o_custkey", "o_totalprice": "o_totalprice"}, "select * from v order by v.o_orderkey limit 5", "o_orderpriority"),
    ]
)


@query("profile_sink_sections", over("orders_gaps", SECTIONS_SQL))
def profile_sink_sections(spark, sf):
    """Sixteen more sections of a written profile, read back in long form."""
    tables = K.profile_tables(table(spark, sf, "orders_gaps"), order_by=["o_orderkey"])
    written = dict(zip(tables, K.write_profile(tables, shared_folder(spark), run_id="1")))

    def rows(section: str, item: str, stats: list[str], said: str = "null"):
        read = spark.read.schema(tables[section].schema).json(written[section])
        return long_rows(section, read, item, {s: {"found": "1"}.get(s, s) for s in stats}, said)

    pair = "concat(col_a, '+', col_b)"
    return union_all(
        [
            rows("column_types", "column", ["n_valid"], "kind"),
            rows("quantiles", "column", list(QUANTILES)),
            rows("modes", "column", ["mode"]),
            rows("moments", "column", [*MOMENTS, "n_zeros", "n_negative"]),
            rows("shape", "'table'", ["n_rows", "n_columns", "n_numeric_columns", "n_categorical_columns"]),
            rows("top_values", "column", ["rank", "cnt"], "value"),
            rows("datetime_spans", "column", ["n_valid", "span_days"], "min"),
            rows("pearson", pair, ["pearson_r"]),
            rows("spearman", pair, ["spearman_r"]),
            rows("cramers_v", pair, ["cramers_v"]),
            rows("category_effects", "concat(category, '+', numeric, '+', `group`)", ["rank", "spread", "group_rank", "mean", "cnt"]),
            rows("id_like", "column", ["found"], "reason"),
            rows("quality", "column", ["hits", "total"], "check"),
            rows("pii", "column", ["cnt", "pct"], "kind"),
            rows("health", "'table'", ["completeness", "uniqueness", "consistency", "validity"]),
            rows("sample", "o_orderkey", ["o_custkey", "o_totalprice"], "o_orderpriority"),
        ]
    )
