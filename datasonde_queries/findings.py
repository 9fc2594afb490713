"""Insight and recommendation rules."""

from __future__ import annotations

from datasonde.functions.fixed_values import CHECK_ADVICE
from datasonde.operators import findings as I
from datasonde_queries.profile import (
    BANDS,
    EMPTY_SQL,
    EVENT_NUMBERS,
    GAPS_COLUMNS,
    MONEY,
    PCT_MISSING,
    PII_COLUMNS,
    TEXT_COLUMNS,
    TIME_TEXT,
    cramers_sql,
    effects_sql,
    id_like_sql,
    issues_sql,
    judged_sql,
    pearson_sql,
    pii_scan_sql,
    spearman_sql,
    strongest_sql,
)
from datasonde_queries.registry import register, tidy
from datasonde_queries.views import over, table


def rule(key: str, run, source: str, rows: str, order: str, limit: int | None = None, **cells: str) -> None:
    """A rule against SQL: ``rows`` numbered by ``order``, shaped like a finding."""
    name = key.split("_", 1)[1]
    a, b = cells.get("a", '"column"'), cells.get("b", "null")
    sql = (
        f"select '{name}' as rule, rank, cast({a} as varchar) as column_a, cast({b} as varchar) as column_b, {cells['metric']} as metric, "
        f"round_even(cast({cells['value']} as double), 4) as value from (select *, row_number() over (order by {order}) as rank from ({rows}))"
    )
    if limit:
        sql += f" where rank <= {limit}"
    if cells.get("keep"):
        sql += f" {'and' if limit else 'where'} {cells['keep']}"

    register(key, lambda spark, sf: tidy(run(I.Profile(table(spark, sf, source))), value=4), over(source, sql))


def placed(columns: list[str], select: str, source: str = "v") -> str:
    """``select`` once per column with its name and position."""
    return "\nunion all ".join(
        f"select '{c}' as \"column\", {i} as position, " + select.replace("{c}", c) + f" from {source}" for i, c in enumerate(columns)
    )


# -- insights ------------------------------------------------------------------

rule(
    "insight_shape",
    I.insight_shape,
    "orders_gaps",
    "select 1 as spot, 'n_rows' as fact, count(*) as n from v union all select 2, 'n_columns', 6 union all select 3, 'n_numeric_columns', 3 union all "
    "select 4, 'n_categorical_columns', 3 union all select 5, 'duplicate_rows', (select count(*) from v) - (select count(*) from (select distinct * from v))",
    "spot",
    a="null",
    metric="fact",
    value="n",
)
_missing = f"select * from ({placed(GAPS_COLUMNS, f'count(*) - count({{c}}) as n_missing, {PCT_MISSING} as pct')}) where n_missing > 0"
rule("insight_missing", I.insight_missing, "orders_gaps", _missing, "pct desc, position", 5, metric="'pct_missing'", value="pct")
CONST = ["c_custkey", "c_name", "c_acctbal", "c_constant", "c_empty"]
_constant = f"select * from ({placed(CONST, 'count(distinct {c}) as n_unique')}) where n_unique <= 1"
rule("insight_constant", I.insight_constant, "customer_const", _constant, "position", metric="'n_unique'", value="n_unique")
_skew = f"select * from ({placed(MONEY, 'skewness({c}) as skew')}) where abs(skew) >= 1"
rule("insight_skew", I.insight_skew, "lineitem_money", _skew, "abs(skew) desc, position", 5, metric="'skew'", value="skew")
_outliers = (
    "select * from (with " + judged_sql("events", EVENT_NUMBERS) + "\n"
    'select "column", count(case when out then 1 end) as n_out, round_even(count(case when out then 1 end) * 100.0::double / max(n_rows), 2) as pct from j group by 1) where n_out > 0'
)
rule("insight_outliers", I.insight_outliers, "events", _outliers, 'n_out desc, "column"', 5, metric="'pct_rows'", value="pct")
_pearson = strongest_sql(pearson_sql(MONEY), 0.3, "pearson_r")
_spearman = strongest_sql(spearman_sql(MONEY), 0.5, "spearman_r")
_cramers = strongest_sql(cramers_sql(BANDS), 0.3, "cramers_v")


def pair_rule(key: str, run, source: str, pairs: str, stat: str, at_least: float, limit: int) -> None:
    rule(
        key,
        run,
        source,
        f"select * from ({pairs}) where abs({stat}) >= {at_least}",
        f"abs({stat}) desc, col_a, col_b",
        limit,
        a="col_a",
        b="col_b",
        metric=f"'{stat}'",
        value=stat,
    )


pair_rule("insight_corr", I.insight_corr, "lineitem_money", _pearson, "pearson_r", 0.5, 5)
EVENTS_TEXT = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_cardinality = "select * from (" + placed(EVENTS_TEXT, "count(distinct {c}) as n_unique") + ") where n_unique > 50 and \"column\" in ('event_type', 'props')"
rule("insight_high_card", I.insight_high_card, "events", _cardinality, "position", 5, metric="'n_unique'", value="n_unique")
_imbalance = "\nunion all ".join(
    f"select '{c}' as \"column\", {i} as position, value, share from (select {text} as value, count(*)::double / (select count(*) from v) as share, "
    f"row_number() over (order by count(*) desc, {text}) as r from v group by {c}) where r = 1 and share > 0.8 and share < 1"
    for i, (c, text) in enumerate(
        [
            ("is_large", "case when is_large then 'True' else 'False' end"),
            ("channel", "channel"),
            ("is_gift", "case when is_gift then 'True' else 'False' end"),
        ]
    )
)
rule("insight_imbalance", I.insight_imbalance, "orders_flags", _imbalance, "position", 5, metric="value", value="share")
_ids = f"select *, case \"column\" when 'c_custkey' then 0 else 1 end as position from ({id_like_sql('v', ['c_custkey', 'c_nationkey'], ['c_name', 'c_mktsegment'])})"
rule("insight_id_like", I.insight_id_like, "customer", _ids, "position", 5, metric="reason", value="null")
_issues = issues_sql(TEXT_COLUMNS)
rule("insight_quality", I.insight_quality, "customer_text", _issues, "position, check_order", 5, metric='"check"', value="hits")
_pii = pii_scan_sql(PII_COLUMNS)
rule("insight_pii", I.insight_pii, "customer_pii", _pii, 'cnt desc, "column"', 5, metric="label", value="cnt")
_empty = f"select * from ({EMPTY_SQL}) where fully_empty_rows > 0"
rule(
    "insight_empty_rows", I.insight_empty_rows, "orders_sparse", _empty, "fully_empty_rows",
    a="null", metric="'fully_empty_rows'", value="fully_empty_rows",
)
_span = (
    "select 'ts' as \"column\", concat(" + TIME_TEXT.replace("{v}", "min(ts)") + ", ' → ', " + TIME_TEXT.replace("{v}", "max(ts)")
    + ") as span, round_even((epoch_us(max(ts)) - epoch_us(min(ts)))::double / 86400000000, 2) as days from v"
)
rule("insight_time_span", I.insight_time_span, "events", _span, '"column"', 3, metric="span", value="days")
_nonlinear = (
    f"select s.* from ({_spearman}) s left join ({_pearson}) p on least(s.col_a, s.col_b) = least(p.col_a, p.col_b) "
    "and greatest(s.col_a, s.col_b) = greatest(p.col_a, p.col_b) where coalesce(abs(pearson_r), 0) < 0.3"
)
rule(
    "insight_nonlinear", I.insight_nonlinear, "lineitem_money", _nonlinear, "abs(spearman_r) desc, col_a, col_b", 5,
    a="col_a", b="col_b", metric="'spearman_r'", value="spearman_r",
)
pair_rule("insight_assoc", I.insight_assoc, "lineitem_bands", _cramers, "cramers_v", 0.5, 5)
_effects = f"select rank as spot, category, numeric, min(mean) as low, max(mean) as high from ({effects_sql()}) where spread >= 0.5 and rank <= 3 group by 1, 2, 3"
rule(
    "insight_group_effect",
    I.insight_group_effect,
    "lineitem_bands",
    f"select spot, category, numeric, 'min_mean' as fact, low as v from ({_effects}) union all select spot, category, numeric, 'max_mean', high from ({_effects})",
    "spot, fact desc",
    a="numeric",
    b="category",
    metric="fact",
    value="v",
)

# -- recommendations -----------------------------------------------------------

_duplicates = (
    "select * from (select (select count(*) from v) - (select count(*) from (select distinct * from v)) as duplicate_rows) where duplicate_rows > 0"
)
rule("rec_dedup", I.rec_dedup, "orders_sparse", _duplicates, "duplicate_rows", a="null", metric="'duplicate_rows'", value="duplicate_rows")
rule("rec_pii", I.rec_pii, "customer_pii", _pii, 'cnt desc, "column"', 5, metric="label", value="cnt")
SPARSE = ["o_totalprice", "o_orderpriority", "o_orderstatus"]
_sparse = f"select * from ({placed(SPARSE, f'count(*) - count({{c}}) as n_missing, {PCT_MISSING} as pct')}) where n_missing > 0"
rule(
    "rec_drop_missing", I.rec_drop_missing, "orders_sparse", _sparse, "pct desc, position", 10,
    metric="'pct_missing'", value="pct", keep="pct > 30",
)
rule("rec_transform", I.rec_transform, "lineitem_money", _skew, "position", 6, metric="'skew'", value="skew")
pair_rule("rec_collinear", I.rec_collinear, "lineitem_money", _pearson, "pearson_r", 0.8, 4)
rule("rec_constant", I.rec_constant, "customer_const", _constant, "position", metric="'n_unique'", value="n_unique")
rule(
    "rec_empty_rows", I.rec_empty_rows, "orders_sparse", _empty, "fully_empty_rows",
    a="null", metric="'fully_empty_rows'", value="fully_empty_rows",
)
_advice = " ".join(f"when '{check}' then '{text}'" for check, text in CHECK_ADVICE)
rule(
    "rec_quality",
    I.rec_quality,
    "customer_text",
    f'select * from ({_issues}) qualify row_number() over (partition by "check" order by position) = 1',
    "position, check_order",
    metric=f"concat(\"check\", ': ', case \"check\" {_advice} end)",
    value="hits",
)
rule("rec_id_like", I.rec_id_like, "customer", _ids, "position", 4, metric="reason", value="null")
rule("rec_high_card", I.rec_high_card, "events", _cardinality, "position", 4, metric="'n_unique'", value="n_unique")
pair_rule("rec_redundant", I.rec_redundant, "lineitem_bands", _cramers, "cramers_v", 0.8, 4)
rule(
    "rec_group_level",
    I.rec_group_level,
    "lineitem_bands",
    f"select distinct rank as spot, category, numeric, spread from ({effects_sql()}) where spread >= 1.5",
    "spot",
    3,
    a="numeric",
    b="category",
    metric="'spread'",
    value="spread",
)

# Clean: no duplicates, gaps, skew, correlation, identifiers or many-valued text.
_clean = (
    "select 'clean' as rule, 1::bigint as rank, cast(null as varchar) as column_a, cast(null as varchar) as column_b, 'recommendations' as metric, 0.0::double as value "
    "from (select count(*) as n, count(distinct (o_custkey, o_totalprice, o_orderstatus, o_orderpriority)) as d, abs(skewness(o_custkey)) as s1, "
    "abs(skewness(o_totalprice)) as s2, abs(corr(o_custkey, o_totalprice)) as r, count(distinct o_custkey) as u, count(distinct o_orderstatus) as k1, "
    "count(distinct o_orderpriority) as k2 from v) where n = d and s1 < 1 and s2 < 1 and r < 0.8 and u < n and k1 between 2 and 50 and k2 between 2 and 50"
)


def _clean_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return I.rec_clean(I.Profile(orders))


register("rec_clean", _clean_orders, over("orders", _clean))
# Everything said about the events: the rules that fire there, as one result.
_event_skew = f"select * from ({placed(EVENT_NUMBERS, 'skewness({c}) as skew')}) where abs(skew) >= 1"
# rule: (rows, order, column, metric, value)
_event_rules = {
    "shape": (
        "select 1 as spot, 'n_rows' as fact, count(*) as n from v union all select 2, 'n_columns', 6 union all select 3, 'n_numeric_columns', 3 "
        "union all select 4, 'n_categorical_columns', 3 union all select 5, 'duplicate_rows', (select count(*) from v) - (select count(*) from (select distinct * from v))",
        "spot",
        "null",
        "fact",
        "n",
    ),
    "missing": (
        f"select * from (select sum(n_missing) as n_missing from ({placed(EVENTS_TEXT, 'count(*) - count({c}) as n_missing')})) where n_missing = 0",
        "n_missing",
        "null",
        "'columns_with_missing'",
        "n_missing",
    ),
    "skew": (_event_skew, "abs(skew) desc, position", '"column"', "'skew'", "skew"),
    "outliers": (_outliers, 'n_out desc, "column"', '"column"', "'pct_rows'", "pct"),
    "high_card": (_cardinality, "position", '"column"', "'n_unique'", "n_unique"),
    "id_like": (
        f"select *, case \"column\" when 'event_id' then 0 else 1 end as position from ({id_like_sql('v', ['event_id', 'user_id'], ['ts', 'event_type', 'props'])})",
        "position",
        '"column"',
        "reason",
        "null",
    ),
    "time_span": (_span, '"column"', '"column"', "span", "days"),
    "transform": (_event_skew, "position", '"column"', "'skew'", "skew"),
}


def _event_sql(*names: str) -> str:
    parts = []
    for name in names:
        rows, order, a, metric, value = _event_rules[name]
        parts.append(
            f"select '{name}' as rule, row_number() over (order by {order}) as rank, cast({a} as varchar) as column_a, cast(null as varchar) as column_b, "
            f"cast({metric} as varchar) as metric, round_even(cast({value} as double), 4) as value from ({rows})"
        )
    return over("events", "\nunion all ".join(parts))


register(
    "insights",
    lambda spark, sf: tidy(I.insights(table(spark, sf, "events")), value=4),
    _event_sql("shape", "missing", "skew", "outliers", "high_card", "id_like", "time_span"),
)
register(
    "recommendations",
    lambda spark, sf: tidy(I.recommendations(table(spark, sf, "events")), value=4),
    _event_sql("transform", "id_like", "high_card"),
)
