"""Chart aggregates."""

from __future__ import annotations

from datasonde.operators import charts as V
from datasonde_queries.profile import BAND_NUMBERS, BANDS, GAPS_COLUMNS, MONEY_GAPS, effects_sql, pearson_sql, top_sql
from datasonde_queries.registry import each, query, tidy
from datasonde_queries.views import over, table


@query(
    "chart_missing",
    over(
        "orders_gaps",
        'select "column", n_missing, pct_missing, case when w <= 3 then w end as worst from (select *, row_number() over (order by n_missing desc, position) as w from ('
        + "\nunion all ".join(
            f"select {i} as position, '{c}' as \"column\", count(*) - count({c}) as n_missing, round_even((count(*) - count({c})) * 100.0::double / count(*), 1) as pct_missing from v"
            for i, c in enumerate(GAPS_COLUMNS)
        )
        + ") where n_missing > 0)",
    ),
)
def chart_missing(spark, sf):
    return V.chart_missing(table(spark, sf, "orders_gaps"))


HIST = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]


def histogram_sql(source: str, columns: list[str]) -> str:
    return "\nunion all ".join(
        f"select '{c}' as \"column\", s.bin, lo + s.bin * ((hi - lo) / 30) as low, case when s.bin = 29 then hi else lo + (s.bin + 1) * ((hi - lo) / 30) end as high, "
        f"coalesce(cnt, 0) as cnt from (select min({c})::double as lo, max({c})::double as hi from {source}), (select unnest(range(30))::integer as bin) s left join "
        "(select case when x < lo + b * w then b - 1 when x >= lo + (b + 1) * w and b < 29 then b + 1 else b end as bin, count(*) as cnt from "
        f"(select x, lo, (hi - lo) / 30 as w, least(floor((x - lo) / (hi - lo) * 30)::integer, 29) as b from (select {c}::double as x, "
        f"min({c}) over ()::double as lo, max({c}) over ()::double as hi from {source}) where x is not null) group by 1) h on h.bin = s.bin"
        for c in columns
    )


@query(
    "chart_histogram",
    over("lineitem_sentinel", f'select "column", bin, round_even(low, 6) as low, round_even(high, 6) as high, cnt from ({histogram_sql("v", HIST)})'),
)
def chart_histogram(spark, sf):
    return tidy(V.histogram(table(spark, sf, "lineitem_sentinel")), low=6, high=6)


@query(
    "chart_kde",
    'select "column", point, round_even(x, 6) as x, round_even(density, 9) as density from ('
    + "\nunion all ".join(
        f"select '{c}' as \"column\", p.point, max(lo + p.point * step) as x, sum(cnt * exp(-0.5 * ((lo + p.point * step - value) / h) * ((lo + p.point * step - value) / h))) "
        "/ (max(n) * max(h) * sqrt(2 * pi())) as density from "
        f"(select {c}::double as value, count(*) as cnt from events group by 1), (select min({c})::double as lo, (max({c}) - min({c})) / 199.0::double as step, "
        f"stddev_samp({c}) * power(count(*), -0.2) as h, count(*) as n from events), (select unnest(range(200))::integer as point) p group by p.point"
        for c in ("event_id", "user_id", "value")
    )
    + ")",
)
def chart_kde(spark, sf):
    return tidy(V.density(table(spark, sf, "events")), x=6, density=9)


def box_sql(rows: str, keys: str) -> str:
    """Box statistics of (keys…, x)."""
    return (
        f"with d as ({rows}),\n"
        f"q as (select {keys}, count(*) as n, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as med, quantile_cont(x, 0.75) as q3 from d group by all)\n"
        f"select {keys}, max(n) as n, round_even(max(q1), 6) as p25, round_even(max(med), 6) as median, round_even(max(q3), 6) as p75, "
        "round_even(least(min(case when x >= q1 - 1.5 * (q3 - q1) then x end), max(q1)), 6) as whisker_low, "
        "round_even(greatest(max(case when x <= q3 + 1.5 * (q3 - q1) then x end), max(q3)), 6) as whisker_high, "
        "count(case when x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) then 1 end) as n_fliers, "
        "round_even(count(case when q1 <> q3 and (x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) then 1 end) * 100.0::double / max(n), 2) as pct_outliers "
        f"from d join q using ({keys}) group by {keys}"
    )


BOX_DIGITS = {c: 6 for c in ("p25", "median", "p75", "whisker_low", "whisker_high")}


@query("chart_box", over("lineitem_sentinel", box_sql(each('select \'{c}\' as "column", {c}::double as x from v where {c} is not null', c=HIST), '"column"')))
def chart_box(spark, sf):
    return tidy(V.chart_box(table(spark, sf, "lineitem_sentinel")), **BOX_DIGITS)


@query(
    "chart_categories",
    over(
        "orders_flags",
        "select *, round_even(cnt::double / (select count(*) from v), 4) as share from ("
        + top_sql("(select case when is_large then 'True' else 'False' end as is_large, channel, case when is_gift then 'True' else 'False' end as is_gift from v)", ["is_large", "channel", "is_gift"], 12)
        + ")",
    ),
)
def chart_categories(spark, sf):
    return V.chart_categories(table(spark, sf, "orders_flags"))


@query(
    "chart_heatmap",
    over(
        "lineitem_money_gaps",
        f"with p as ({pearson_sql(MONEY_GAPS)})\n"
        "select col_a, col_b, round_even(stat, 3) as r from p union all select col_b, col_a, round_even(stat, 3) from p union all "
        + each("select '{c}', '{c}', 1.0::double", c=MONEY_GAPS),
    ),
)
def chart_heatmap(spark, sf):
    return tidy(V.chart_heatmap(table(spark, sf, "lineitem_money_gaps")), r=3)


@query(
    "chart_scatter",
    "with o as (select o_orderkey, o_custkey, o_totalprice, o_totalprice * 0.19::double as tax from orders)\n"
    "select 'o_totalprice' as col_a, 'tax' as col_b, round_even(o_totalprice, 4) as x, round_even(tax, 4) as y from o order by md5(cast(o_orderkey as varchar)), x, y limit 2000",
)
def chart_scatter(spark, sf):
    priced = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "o_totalprice", "o_totalprice * 0.19D as tax")
    return tidy(V.chart_scatter(priced, key=["o_orderkey"]), x=4, y=4)


def _grouped_rows() -> str:
    return "\nunion all ".join(
        f"select '{c}' as category, '{n}' as numeric, {c} as \"group\", {n}::double as x from v where {c} is not null and {n} is not null "
        f"and exists (select 1 from e where e.category = '{c}' and e.numeric = '{n}')"
        for c in BANDS
        for n in BAND_NUMBERS
    )


@query(
    "chart_grouped_box",
    over("lineitem_bands", f"with e as ({effects_sql(3, 1)}),\n" + box_sql(_grouped_rows(), 'category, numeric, "group"')[5:]),
)
def chart_grouped_box(spark, sf):
    return tidy(V.chart_grouped_box(table(spark, sf, "lineitem_bands")), **BOX_DIGITS)


def trend_sql(source: str, at: str, columns: list[str], label: str) -> str:
    return each(f"select {label} as bucket, '{{c}}' as \"column\", round_even(avg({{c}}), 4) as mean from {source} where {at} is not null group by 1", c=columns)


@query("chart_time_trend", trend_sql("events", "ts", ["event_id", "user_id", "value"], "strftime(date_trunc('day', ts), '%Y-%m-%d')"))
def chart_time_trend(spark, sf):
    return tidy(V.chart_time_trend(table(spark, sf, "events")), mean=4)


@query("chart_time_trend_month", trend_sql("orders", "o_orderdate", ["o_orderkey", "o_custkey", "o_totalprice"], "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"))
def chart_time_trend_month(spark, sf):
    return tidy(V.chart_time_trend(table(spark, sf, "orders")), mean=4)


_YEARLY = "(select o_totalprice, o_custkey, timestamp '2024-01-01' + to_days(floor(date_diff('day', date '1995-01-01', o_orderdate) / 4)::integer) as day from orders)"


@query("chart_time_trend_week", trend_sql(_YEARLY, "day", ["o_totalprice", "o_custkey"], "strftime(date_trunc('week', day) + interval 6 day, '%Y-%m-%d')"))
def chart_time_trend_week(spark, sf):
    """The order dates drawn four times closer together, so that weeks apply."""
    days = "cast(floor(datediff(o_orderdate, date'1995-01-01') / 4) as int)"
    closer = table(spark, sf, "orders").selectExpr(
        "o_totalprice", "o_custkey", f"cast(date_add(date'2024-01-01', {days}) as timestamp_ntz) as day"
    )
    return tidy(V.chart_time_trend(closer), mean=4)
