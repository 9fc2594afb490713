"""Drill-through operators, composites and intent aggregates."""

from __future__ import annotations

from datasonde.operators import drill as G
from datasonde.operators import intents as N
from datasonde.operators import investigate as X
from datasonde.functions.values import union_all
from datasonde_queries.profile import (
    BANDS,
    GAPS_COLUMNS,
    PCT_MISSING,
    PCT_OUT,
    cramers_sql,
    effects_sql,
    judged_sql,
    strongest_sql,
)
from datasonde_queries.registry import each, query, register, tidy
from datasonde_queries.views import over, table

RANKS = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double"


# -- drill-through -------------------------------------------------------------


@query(
    "inv_correlation",
    over(
        "lineitem_money_gaps",
        "with c as (select l_extendedprice as a, revenue as b from v where l_extendedprice is not null and revenue is not null),\n"
        f"r as (select {RANKS.format(c='a')} as ra, {RANKS.format(c='b')} as rb from c)\n"
        "select 'l_extendedprice' as column_a, 'revenue' as column_b, (select round_even(corr(a, b), 4) from c) as pearson_r, "
        "(select round_even(corr(ra, rb), 4) from r) as spearman_r, (select count(*) from c) as n, (select count(*) from c) < 30 as low_n",
    ),
)
def inv_correlation(spark, sf):
    return G.correlation_check(table(spark, sf, "lineitem_money_gaps"), "l_extendedprice", "revenue")


def group_compare_sql(source: str, number: str, category: str) -> str:
    """A WITH list ending in ``shown``: the twelve largest groups, rounded."""
    return (
        f"g as (select {category} as category, count(*) as n, round_even(avg({number}), 4) as mean, "
        f"round_even(quantile_cont({number}::double, 0.5), 4) as median, round_even(stddev_samp({number}), 4) as std "
        f"from {source} where {number} is not null and {category} is not null group by 1),\n"
        "shown as (select *, row_number() over (order by n desc, category) as rank from g qualify rank <= 12)"
    )


@query(
    "inv_group_compare",
    over(
        "orders_gaps",
        "with " + group_compare_sql("v", "o_totalprice", "o_orderpriority") + "\n"
        "select 'group' as part, rank, category, cast(null as varchar) as low_category, n, mean, median, std from shown\n"
        "union all select 'overall', null, null, null, count(o_totalprice), round_even(avg(o_totalprice), 4), "
        "round_even(quantile_cont(o_totalprice, 0.5), 4), round_even(stddev_samp(o_totalprice), 4) from v\n"
        "union all select 'gap', null, (select category from shown order by mean desc, rank limit 1), "
        "(select category from shown order by mean, rank limit 1), null, round_even(max(mean) - min(mean), 4), null, null from shown",
    ),
)
def inv_group_compare(spark, sf):
    return G.group_compare(table(spark, sf, "orders_gaps"), "o_totalprice", "o_orderpriority")


@query(
    "inv_group_compare_many",
    "with " + group_compare_sql("part", "p_retailprice", "p_name") + "\n"
    "select 'group' as part, rank, category, cast(null as varchar) as low_category, n, mean, median, std from shown\n"
    "union all select 'overall', null, null, null, count(p_retailprice), round_even(avg(p_retailprice), 4), "
    "round_even(quantile_cont(p_retailprice, 0.5), 4), round_even(stddev_samp(p_retailprice), 4) from part\n"
    "union all select 'gap', null, (select category from shown order by mean desc, rank limit 1), "
    "(select category from shown order by mean, rank limit 1), null, round_even(max(mean) - min(mean), 4), null, null from shown",
)
def inv_group_compare_many(spark, sf):
    return G.group_compare(table(spark, sf, "part"), "p_retailprice", "p_name")




@query(
    "inv_missingness",
    over(
        "orders_gaps",
        "with r as ("
        + each(
            "select '{c}' as split_column, {c} as category, count(*) as n, count(case when o_orderpriority is null then 1 end) * 100.0::double / count(*) as raw, "
            "(select count(case when o_orderpriority is null then 1 end) * 100.0::double / count(*) from v) as overall from v where {c} is not null group by {c}",
            c=["o_orderstatus"],
        )
        + "),\nw as (select *, abs(raw - overall) as d from r qualify row_number() over (partition by split_column order by abs(raw - overall) desc, category) = 1)\n"
        "select 'o_orderpriority' as \"column\", (select count(*) from v) as n_rows, (select count(*) - count(o_orderpriority) from v) as n_missing, "
        "(select round_even((count(*) - count(o_orderpriority)) * 100.0::double / count(*), 2) from v) as pct_missing, 0::bigint as n_sentinel, "
        "row_number() over (order by round_even(d, 2) desc, split_column) as split_rank, split_column, category, n, round_even(raw, 2) as rate, round_even(d, 2) as gap "
        "from w where d > 0",
    ),
)
def inv_missingness(spark, sf):
    return G.missingness_analysis(table(spark, sf, "orders_gaps"), "o_orderpriority")


NONE = "cast(null as double)"


@query(
    "inv_value_scan",
    "select 'shape' as part, cast(null as bigint) as rank, 'string' as value, cast(null as bigint) as cnt, count(distinct p_name) as n_unique, "
    f"{NONE} as min, {NONE} as max, {NONE} as mean, min(length(p_name)) as min_length, max(length(p_name)) as max_length from part\n"
    "union all select 'top', rank, p_name, cnt, null, null, null, null, null, null from (select p_name, count(*) as cnt, "
    "row_number() over (order by count(*) desc, p_name) as rank from part group by 1) where rank <= 8",
)
def inv_value_scan(spark, sf):
    return G.value_scan(table(spark, sf, "part"), "p_name")


@query(
    "inv_value_scan_numeric",
    "select 'shape' as part, cast(null as bigint) as rank, 'double' as value, cast(null as bigint) as cnt, count(distinct l_quantity) as n_unique, "
    "round_even(min(l_quantity), 4) as min, round_even(max(l_quantity), 4) as max, round_even(avg(l_quantity), 4) as mean, "
    "cast(null as bigint) as min_length, cast(null as bigint) as max_length from lineitem\n"
    "union all select 'top', rank, cast(l_quantity as varchar), cnt, null, null, null, null, null, null from (select l_quantity, count(*) as cnt, "
    "row_number() over (order by count(*) desc, cast(l_quantity as varchar)) as rank from lineitem group by 1) where rank <= 8",
)
def inv_value_scan_numeric(spark, sf):
    return G.value_scan(table(spark, sf, "lineitem"), "l_quantity")


def _empty_cells(names: str, kind: str) -> str:
    return ", ".join(f"cast(null as {kind}) as {n}" for n in names.split())


def outliers_sql(source: str, c: str, others: list[str]) -> str:
    compared = "\nunion all ".join(
        f"select 'comparison' as part, {i + 1} as rank, '{o}' as \"column\", {_empty_cells('value lower upper', 'double')}, "
        f"{_empty_cells('n_valid n_outliers', 'bigint')}, {_empty_cells('pct_outliers', 'double')}, round_even(mo, 4) as mean_outliers, "
        "round_even(mr, 4) as mean_rest, round_even((mo - mr) / abs(nullif(mr, 0)) * 100, 2) as shift_pct from "
        f"(select avg(case when {c} < f.lower or {c} > f.upper then {o} end) as mo, avg(case when {c} >= f.lower and {c} <= f.upper then {o} end) as mr "
        f"from {source}, (select max(lower) as lower, max(upper) as upper from j) f)"
        for i, o in enumerate(others)
    )
    return (
        "with " + judged_sql(source, [c]) + "\n"
        f"select 'bounds' as part, cast(null as bigint) as rank, '{c}' as \"column\", cast(null as double) as value, round_even(max(lower), 4) as lower, "
        f"round_even(max(upper), 4) as upper, max(n) as n_valid, count(case when out then 1 end) as n_outliers, {PCT_OUT} as pct_outliers, "
        f"{_empty_cells('mean_outliers mean_rest shift_pct', 'double')} from j\n"
        f"union all select 'example', row_number() over (order by abs(x - median) desc, x) as rk, '{c}', round_even(x, 6), "
        "null, null, null, null, null, null, null, null from j where out qualify rk <= 5\n"
        f"union all {compared}"
    )


@query("inv_outliers", outliers_sql("documents", "n_chars", ["doc_id"]))
def inv_outliers(spark, sf):
    return G.outlier_inspect(table(spark, sf, "documents"), "n_chars")


LABELS = {
    "d": "strftime(p, '%Y-%m-%d')",
    "w": "strftime(p, '%Y-%m-%d') || '/' || strftime(p + interval 6 day, '%Y-%m-%d')",
    "m": "strftime(p, '%Y-%m')",
    "q": "strftime(p, '%Y') || 'Q' || quarter(p)",
    "y": "strftime(p, '%Y')",
}
UNITS = {"d": "day", "w": "week", "m": "month", "q": "quarter", "y": "year"}
for _freq, _label in LABELS.items():
    register(
        f"inv_time_slice_{_freq}",
        lambda spark, sf, freq=_freq.upper(): G.time_slice(table(spark, sf, "orders"), "o_orderdate", freq),
        f"with s as (select date_trunc('{UNITS[_freq]}', o_orderdate) as p, count(*) as n, round_even(avg(o_orderkey), 4) as mean from orders group by 1)\n"
        f"select row_number() over (order by n desc, p) as rank, {_label} as period, n, mean, (select count(*) from s) as n_periods from s qualify rank <= 10",
    )


@query(
    "run_tool",
    "select 0 as call, 'correlation_check' as tool, cast(null as varchar) as error, least(count(*), 1) as n_rows from orders\n"
    "union all select 1, 'group_compare', null, count(distinct o_orderstatus) + 2 from orders\n"
    "union all select 2, 'group_compare', 'column ''o_orderstatus'' is categorical, ''numeric_column'' must be numeric', null\n"
    "union all select 3, 'value_scan', 'column ''nope'' not found', null\n"
    "union all select 4, 'time_slice', 'freq must be one of [''D'', ''M'', ''Q'', ''W'', ''Y''], got ''H''', null\n"
    "union all select 5, 'forecast', 'unknown tool ''forecast''; expected one of [''correlation_check'', ''group_compare'', "
    "''missingness_analysis'', ''outlier_inspect'', ''time_slice'', ''value_scan'']', null",
)
def run_tool(spark, sf):
    """Dispatch by name: what ran and what was refused."""
    df = table(spark, sf, "orders")
    calls = [
        ("correlation_check", {"column_a": "o_custkey", "column_b": "o_totalprice"}),
        ("group_compare", {"numeric_column": "o_totalprice", "categorical_column": "o_orderstatus"}),
        ("group_compare", {"numeric_column": "o_orderstatus", "categorical_column": "o_orderstatus"}),
        ("value_scan", {"column": "nope"}),
        ("time_slice", {"date_column": "o_orderdate", "freq": "H"}),
        ("forecast", {}),
    ]
    parts = []
    for i, (name, args) in enumerate(calls):
        result = G.run_tool(df, name, args)
        if result.ok:
            parts.append(result.table.selectExpr(f"{i} as call", f"'{name}' as tool", "cast(null as string) as error", "count(*) as n_rows"))
        else:
            parts.append(spark.createDataFrame([(i, name, result.error, None)], "call int, tool string, error string, n_rows bigint"))
    return union_all(parts)


# -- composites ----------------------------------------------------------------


# The choices and the sentences in SQL; no numeric pair of the documents is correlated.
DOCUMENT_EFFECT = effects_sql(1, 1, ["lang", "source"], ["doc_id", "n_chars"], "documents")


def _gap_sql(n: str, c: str) -> str:
    return (
        f"select '{n}' as numeric, '{c}' as category, summary from (with {group_compare_sql('documents', n, c)}\n"
        "select concat('mean differs by ', cast(round_even(max(mean) - min(mean), 4) as varchar), ' between ', "
        "(select category from shown order by mean desc, rank limit 1), ' and ', "
        "(select category from shown order by mean, rank limit 1)) as summary from shown)"
    )


@query(
    "auto_investigate",
    "with " + judged_sql("documents", ["n_chars"]) + ",\n"
    f"e as ({DOCUMENT_EFFECT}),\n"
    "gaps as (" + "\nunion all ".join(_gap_sql(n, c) for n in ("doc_id", "n_chars") for c in ("lang", "source")) + ")\n"
    "select 1 as step, 'outlier_inspect' as tool, 'n_chars' as column_a, cast(null as varchar) as column_b, "
    f"concat(count(case when out then 1 end), ' IQR outlier(s) in n_chars (', cast({PCT_OUT} as varchar), '% of ', max(n), ' non-null values), bounds [', "
    "cast(round_even(max(lower), 4) as varchar), ', ', cast(round_even(max(upper), 4) as varchar), ']') as summary from j\n"
    "union all select 3, 'group_compare', e.numeric, e.category, gaps.summary from e join gaps on e.numeric = gaps.numeric and e.category = gaps.category",
)
def auto_investigate(spark, sf):
    return X.auto_investigate(table(spark, sf, "documents"))


@query(
    "anomaly_drilldown",
    "with " + judged_sql("events", ["value"]) + ",\n" + group_compare_sql("events", "value", "event_type") + "\n"
    f"select 'value' as \"column\", (select count(case when out then 1 end) from j) as n_outliers, (select {PCT_OUT} from j) as pct_outliers, "
    "'event_type' as category_column, (select category from shown order by mean desc, rank limit 1) as high_group, max(mean) as high_mean, "
    "(select category from shown order by mean, rank limit 1) as low_group, min(mean) as low_mean, round_even(max(mean) - min(mean), 4) as gap from shown",
)
def anomaly_drilldown(spark, sf):
    return X.anomaly_drilldown(table(spark, sf, "events"))


# -- intents -------------------------------------------------------------------


@query(
    "ask_missing",
    over(
        "orders_gaps",
        each(
            f"select '{{c}}' as \"column\", count(*) - count({{c}}) as n_missing, {PCT_MISSING} as pct_missing, count(*) as n_rows from v",
            c=["o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey"],
        ),
    ),
)
def ask_missing(spark, sf):
    return N.ask_missing(table(spark, sf, "orders_gaps"), ["o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey"])


@query(
    "ask_rows",
    over(
        "orders_gaps",
        "select 'n_rows' as fact, count(*) as value from v union all select 'n_columns', 6 union all "
        "select 'duplicate_rows', (select count(*) from v) - (select count(*) from (select distinct * from v)) union all "
        "select 'rows_with_missing', count(*) from v where " + " or ".join(f"{c} is null" for c in GAPS_COLUMNS),
    ),
)
def ask_rows(spark, sf):
    return N.ask_rows(table(spark, sf, "orders_gaps"), duplicates=True, missing=True)


@query(
    "ask_stats",
    over(
        "orders_gaps",
        each(
            'select \'{c}\' as "column", max({c})::double as max, min({c})::double as min, round_even(avg({c}), 4) as mean, count({c}) as n from v',
            c=["o_totalprice", "o_custkey"],
        ),
    ),
)
def ask_stats(spark, sf):
    return tidy(N.ask_stats(table(spark, sf, "orders_gaps"), ["o_totalprice", "o_orderstatus", "o_custkey"]), mean=4)


@query(
    "ask_unique",
    "select * from (select row_number() over (order by count(*) desc, p_brand) as rank, p_brand as value, count(*) as cnt, "
    "(select count(distinct p_brand) from part) as n_unique from part group by p_brand) where rank <= 8",
)
def ask_unique(spark, sf):
    return N.ask_unique(table(spark, sf, "part"), "p_brand")


@query(
    "ask_correlation",
    over(
        "lineitem_money_gaps",
        "select 'pearson_r' as measure, round_even(corr(l_extendedprice, revenue), 3) as value, "
        "count(case when l_extendedprice is not null and revenue is not null then 1 end) as n from v",
    ),
)
def ask_correlation(spark, sf):
    return N.ask_correlation(table(spark, sf, "lineitem_money_gaps"), "l_extendedprice", "revenue")


@query(
    "ask_correlation_lookup",
    over(
        "lineitem_bands",
        f"select 'cramers_v' as measure, cramers_v as value, cast(null as bigint) as n from ({strongest_sql(cramers_sql(BANDS), 0.3, 'cramers_v')}) "
        "where col_a in ('band', 'half') and col_b in ('band', 'half')",
    ),
)
def ask_correlation_lookup(spark, sf):
    return N.ask_correlation(table(spark, sf, "lineitem_bands"), "half", "band")


@query("ask_dtype", "select 'o_orderdate' as \"column\", 'timestamp_ntz' as dtype, 'datetime' as kind, count(o_orderdate) as n_valid from orders")
def ask_dtype(spark, sf):
    return N.ask_dtype(table(spark, sf, "orders"), "o_orderdate")


@query("ask_duplicates", "select count(*) as n_rows, count(*) - (select count(*) from (select distinct text, source from documents)) as duplicate_rows from documents")
def ask_duplicates(spark, sf):
    return N.ask_duplicates(table(spark, sf, "documents").select("text", "source"))


def _first_values(c: str) -> str:
    return f"(select string_agg('''' || x || '''', ', ' order by x) from (select distinct {c} as x from orders order by x limit 5))"


@query(
    "schema_catalog",
    "select 0 as position, 'o_orderkey' as \"column\", 'numeric' as kind, concat('min ', min(o_orderkey), ', max ', max(o_orderkey)) as sample from orders\n"
    "union all select 1, 'o_custkey', 'numeric', concat('min ', min(o_custkey), ', max ', max(o_custkey)) from orders\n"
    f"union all select 2, 'o_orderstatus', 'text', {_first_values('o_orderstatus')}\n"
    "union all select 3, 'o_totalprice', 'numeric', concat('min ', cast(min(o_totalprice) as varchar), ', max ', cast(max(o_totalprice) as varchar)) from orders\n"
    "union all select 4, 'o_orderdate', 'datetime', concat(strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'), ' .. ', strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')) from orders\n"
    f"union all select 5, 'o_orderpriority', 'text', {_first_values('o_orderpriority')}",
)
def schema_catalog(spark, sf):
    return N.schema_catalog(table(spark, sf, "orders"))


