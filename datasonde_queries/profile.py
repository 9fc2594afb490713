"""Column and whole-table profile, relationships, quality, personal data, health."""

from __future__ import annotations

from itertools import combinations

from datasonde.functions.fixed_values import PII_KINDS, SENTINEL_STRINGS
from datasonde.operators import columns as C
from datasonde.operators import health as H
from datasonde.operators import quality as Q
from datasonde.operators import relations as R
from datasonde.operators import table as T
from datasonde.operators.frequency import distinct_counts, modes
from datasonde.functions.kinds import NUMERIC, names_of
from datasonde_queries.registry import each, query, register, tidy
from datasonde_queries.views import over, table

LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_COLUMNS = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
GAPS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

PCT_MISSING = "round_even((count(*) - count({c})) * 100.0::double / count(*), 2)"


# -- columns -------------------------------------------------------------------


@query("col_missing", over("orders_gaps", each(f"select '{{c}}' as \"column\", count(*) - count({{c}}) as n_missing, {PCT_MISSING} as pct_missing, count(*) as n_rows from v", c=GAPS_COLUMNS)))
def col_missing(spark, sf):
    return C.missing_counts(table(spark, sf, "orders_gaps")).drop("position")


@query("col_n_unique", each('select \'{c}\' as "column", count(distinct {c}) as n_unique, count(*) - count({c}) as n_missing, count(*) as n_rows from lineitem', c=LINEITEM_COLUMNS))
def col_n_unique(spark, sf):
    return distinct_counts(table(spark, sf, "lineitem")).drop("position")


@query(
    "col_moments",
    each(
        'select \'{c}\' as "column", count({c}) as n, round_even(avg({c}), 6) as mean, round_even(stddev_samp({c}), 6) as std, '
        "min({c})::double as min, max({c})::double as max from lineitem",
        c=LINEITEM_NUMBERS,
    ),
)
def col_moments(spark, sf):
    return tidy(C.numeric_moments(table(spark, sf, "lineitem")).select("column", "n", "mean", "std", "min", "max"), mean=6, std=6)


@query(
    "col_quantiles",
    each(
        'select \'{c}\' as "column", count({c}) as n, '
        + ", ".join(
            f"round_even(quantile_cont({{c}}::double, {p}), 6) as {name}" for name, p in C.PROFILE_QUANTILES.items()
        )
        + " from lineitem",
        c=LINEITEM_NUMBERS,
    ),
)
def col_quantiles(spark, sf):
    return tidy(C.column_quantiles(table(spark, sf, "lineitem"), LINEITEM_NUMBERS).drop("position"), **{k: 6 for k in C.PROFILE_QUANTILES})


@query(
    "col_skew_kurt",
    over(
        "lineitem_money",
        each(
            'select \'{c}\' as "column", round_even(skewness({c}), 6) as skew, round_even(kurtosis({c}), 6) as kurtosis from v',
            c=["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue", "charge", "peak"],
        ),
    ),
)
def col_skew_kurt(spark, sf):
    return tidy(C.numeric_moments(table(spark, sf, "lineitem_money")).select("column", "skew", "kurtosis"), skew=6, kurtosis=6)


@query(
    "col_mode",
    each(
        '(select \'{c}\' as "column", {c}::double as mode from lineitem group by {c} order by count(*) desc, {c} limit 1)',
        c=LINEITEM_NUMBERS,
    ),
)
def col_mode(spark, sf):
    return modes(table(spark, sf, "lineitem"), LINEITEM_NUMBERS).drop("position")


@query(
    "col_zero_neg",
    over(
        "lineitem_sentinel",
        each(
            'select \'{c}\' as "column", count(case when {c} = 0 then 1 end) as n_zeros, count(case when {c} < 0 then 1 end) as n_negative from v',
            c=["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"],
        ),
    ),
)
def col_zero_neg(spark, sf):
    return C.numeric_moments(table(spark, sf, "lineitem_sentinel")).select("column", "n_zeros", "n_negative")


EVENT_NUMBERS = ["event_id", "user_id", "value"]


def fences_sql(source: str, c: str) -> str:
    """One row (column, n, lower, upper, median) of a numeric column; no fences at zero IQR."""
    return (
        f"select '{c}' as \"column\", count({c}) as n, quantile_cont({c}::double, 0.25) as q1, "
        f"quantile_cont({c}::double, 0.5) as median, quantile_cont({c}::double, 0.75) as q3 from {source}"
    )


def judged_sql(source: str, columns: list[str]) -> str:
    """A WITH list ending in ``j``: (column, x, n, n_rows, median, lower, upper, out)."""
    values = each(f'select \'{{c}}\' as "column", {{c}}::double as x, (select count(*) from {source}) as n_rows from {source} where {{c}} is not null', c=columns)
    fences = "\nunion all ".join(fences_sql(source, c) for c in columns)
    return (
        f"x as ({values}),\nf as ({fences}),\n"
        'j as (select x."column", x, n, n_rows, median, case when q1 <> q3 then q1 - 1.5 * (q3 - q1) end as lower, '
        "case when q1 <> q3 then q3 + 1.5 * (q3 - q1) end as upper, "
        'coalesce(x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1), false) and q1 <> q3 as out from x join f using ("column"))'
    )


PCT_OUT = "round_even(count(case when out then 1 end) * 100.0::double / max(n), 2)"


@query(
    "col_outlier_count",
    over(
        "lineitem_sentinel",
        "with " + judged_sql("v", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]) + "\n"
        'select "column", max(n) as n, round_even(max(lower), 6) as lower, round_even(max(upper), 6) as upper, '
        f"round_even(max(median), 6) as median, count(case when out then 1 end) as n_outliers, {PCT_OUT} as pct_outliers from j group by 1",
    ),
)
def col_outlier_count(spark, sf):
    df = table(spark, sf, "lineitem_sentinel")
    return tidy(C.outlier_stats(df, names_of(df, NUMERIC)).drop("position"), lower=6, upper=6, median=6)


EXAMPLES_SQL = (
    'select "column", row_number() over (partition by "column" order by abs(x - median) desc, x) as rank, '
    "round_even(x, 6) as value from j where out qualify rank <= {k}"
)


@query("col_outlier_examples", "with " + judged_sql("events", EVENT_NUMBERS) + "\n" + EXAMPLES_SQL.format(k=3))
def col_outlier_examples(spark, sf):
    return C.outlier_examples(table(spark, sf, "events"), EVENT_NUMBERS).drop("position")


@query(
    "outlier_columns",
    "with " + judged_sql("events", EVENT_NUMBERS) + ",\n"
    f"e as ({EXAMPLES_SQL.format(k=3)})\n"
    f'select j."column", count(case when out then 1 end) as n_outliers, {PCT_OUT} as pct_outliers, '
    "round_even(count(case when out then 1 end) * 100.0::double / max(n_rows), 2) as pct_rows, "
    "max(e1.value) as example_1, max(e2.value) as example_2, max(e3.value) as example_3 "
    'from j join e e1 on j."column" = e1."column" and e1.rank = 1 join e e2 on j."column" = e2."column" and e2.rank = 2 '
    'join e e3 on j."column" = e3."column" and e3.rank = 3 group by 1',
)
def outlier_columns(spark, sf):
    found = C.outlier_columns(table(spark, sf, "events"))
    return found.selectExpr("*", *[f"get(examples, {i}) as example_{i + 1}" for i in range(3)]).drop("examples")


TIME_TEXT = (
    "strftime({v}, '%Y-%m-%d %H:%M:%S') || case when extract(microsecond from {v}) % 1000000 = 0 then '' "
    "else strftime({v}, '.%f') end"
)


@query(
    "col_datetime_span",
    'select \'ts\' as "column", ' + TIME_TEXT.replace("{v}", "min(ts)") + " as min, " + TIME_TEXT.replace("{v}", "max(ts)") + " as max, "
    "count(ts) as n_valid, round_even((epoch_us(max(ts)) - epoch_us(min(ts)))::double / 86400000000, 2) as span_days from events",
)
def col_datetime_span(spark, sf):
    return C.datetime_spans(table(spark, sf, "events")).drop("position")


def top_sql(source: str, columns: list[str], k: int) -> str:
    return each(
        'select * from (select \'{c}\' as "column", row_number() over (order by count(*) desc, cast({c} as varchar)) as rank, '
        f"cast({{c}} as varchar) as value, count(*) as cnt from {source} where {{c}} is not null group by {{c}}) where rank <= {k}",
        c=columns,
    )


@query("col_top_values", top_sql("documents", ["text", "lang", "source"], 5).replace("cast(text as varchar)) as rank", "case when strlen(text) > 128 then left(text, 128) || sha256(text) else text end) as rank"))
def col_top_values(spark, sf):
    return C.category_tops(table(spark, sf, "documents")).drop("position")


KINDS = {
    "l_orderkey": ("bigint", "numeric"), "l_partkey": ("bigint", "numeric"), "l_suppkey": ("bigint", "numeric"),
    "l_linenumber": ("int", "numeric"), "l_quantity": ("double", "numeric"), "l_extendedprice": ("double", "numeric"),
    "l_discount": ("double", "numeric"), "l_tax": ("double", "numeric"), "l_returnflag": ("string", "categorical"),
    "l_linestatus": ("string", "categorical"), "l_shipdate": ("timestamp_ntz", "datetime"),
}


@query(
    "col_types",
    "\nunion all ".join(
        f"select '{c}' as \"column\", '{dtype}' as dtype, '{kind}' as kind, count({c}) as n_valid from lineitem"
        for c, (dtype, kind) in KINDS.items()
    ),
)
def col_types(spark, sf):
    return C.column_types(table(spark, sf, "lineitem")).drop("position")


def _summary(c: str) -> str:
    numbers = {"mean": f"avg({c})", "median": f"quantile_cont({c}::double, 0.5)", "std": f"stddev_samp({c})", "skew": f"skewness({c})"}
    return ", ' · ', ".join(f"'{name} ', cast(round_even({sql}, 4) as varchar)" for name, sql in numbers.items())


@query(
    "col_summaries",
    "\nunion all ".join(
        f"select {i} as position, '{c}' as \"column\", concat({_summary(c)}) as summary from events"
        for i, c in ((0, "event_id"), (2, "user_id"), (4, "value"))
    )
    + "\nunion all select 1, 'ts', concat(" + TIME_TEXT.replace("{v}", "min(ts)") + ", ' → ', " + TIME_TEXT.replace("{v}", "max(ts)")
    + ", ' (', cast(round_even((epoch_us(max(ts)) - epoch_us(min(ts)))::double / 86400000000, 2) as varchar), ' days)') from events"
    + "".join(
        f"\nunion all select {i}, '{c}', concat('top: ', value, ' (', cnt, ')') from ({top_sql('events', [c], 1)})"
        for i, c in ((3, "event_type"), (5, "props"))
    ),
)
def col_summaries(spark, sf):
    return C.column_summaries(table(spark, sf, "events"))


# -- opt-in approximations -----------------------------------------------------


@query("approx_n_unique")
def approx_n_unique(spark, sf):
    df = table(spark, sf, "lineitem")
    return C.approximate_distinct(df, df.columns)


@query("approx_quantiles")
def approx_quantiles(spark, sf):
    return C.approximate_quantiles(table(spark, sf, "lineitem"), LINEITEM_NUMBERS)


# -- whole table ---------------------------------------------------------------


@query("table_shape", "select count(*) as n_rows, 11::bigint as n_columns, 8::bigint as n_numeric_columns, 3::bigint as n_categorical_columns from lineitem")
def table_shape(spark, sf):
    return T.table_shape(table(spark, sf, "lineitem"))


DUPLICATES_SQL = "select count(*) as n_rows, count(*) - (select count(*) from (select distinct text, lang from documents)) as duplicate_rows from documents"


@query("duplicate_rows", DUPLICATES_SQL)
def duplicate_rows(spark, sf):
    return T.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


@query("duplicate_rows_numeric", "select count(*) as n_rows, count(*) - (select count(*) from (select distinct l_quantity, l_discount, l_tax, l_shipdate from lineitem)) as duplicate_rows from lineitem")
def duplicate_rows_numeric(spark, sf):
    return T.duplicate_rows(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_shipdate"))


@query("constant_columns", over("customer_const", "select * from (" + each('select \'{c}\' as "column", count(distinct {c}) as n_unique from v', c=["c_custkey", "c_name", "c_acctbal", "c_constant", "c_empty"]) + ") where n_unique <= 1"))
def constant_columns(spark, sf):
    return T.constant_columns(table(spark, sf, "customer_const"))


TOP_MISSING_SQL = "select * from (" + each(f"select '{{c}}' as \"column\", count(*) - count({{c}}) as n_missing, {PCT_MISSING} as pct_missing from v", c=GAPS_COLUMNS) + ") where n_missing > 0 order by pct_missing desc limit 10"


@query("top_missing", over("orders_gaps", TOP_MISSING_SQL))
def top_missing(spark, sf):
    return T.top_missing(table(spark, sf, "orders_gaps"))


@query(
    "sample_rows",
    "select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus, "
    "cast(o_totalprice as varchar) as o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, "
    "left(o_orderpriority, 40) as o_orderpriority from orders order by orders.o_orderkey limit 5",
)
def sample_rows(spark, sf):
    return T.sample_rows(table(spark, sf, "orders"), ["o_orderkey"])


EMPTY_SQL = (
    "select count(*) as n_rows, count(case when o_totalprice is null and o_orderpriority is null and o_orderstatus is null then 1 end) as fully_empty_rows, "
    "count(case when o_totalprice is null or o_orderpriority is null or o_orderstatus is null then 1 end) as rows_with_missing from v"
)


@query("fully_empty_rows", over("orders_sparse", EMPTY_SQL))
def fully_empty_rows(spark, sf):
    return T.fully_empty_rows(table(spark, sf, "orders_sparse"))


@query(
    "co_missing_pairs",
    over(
        "orders_sparse",
        "select * from ("
        + "\nunion all ".join(
            f"select '{a}' as col_a, '{b}' as col_b, count(case when {a} is null and {b} is null then 1 end) as cnt, "
            f"round_even(count(case when {a} is null and {b} is null then 1 end) * 100.0::double / count(*), 2) as pct_of_rows from v"
            for a, b in combinations(["o_totalprice", "o_orderpriority", "o_orderstatus"], 2)
        )
        + ") where cnt > 0 order by cnt desc limit 5",
    ),
)
def co_missing_pairs(spark, sf):
    return T.co_missing_pairs(table(spark, sf, "orders_sparse"))


def id_like_sql(source: str, integers: list[str], others: list[str], dense: str = "max({c}) - min({c}) + 1 = count({c})") -> str:
    whole = each(f'select \'{{c}}\' as "column", count(distinct {{c}}) as d, count(*) as n, {dense} as sequential from {source}', c=integers)
    rest = each(f'select \'{{c}}\' as "column", count(distinct {{c}}) as d, count(*) as n, false as sequential from {source}', c=others)
    return (
        f'select "column", case when sequential then \'sequential integer\' else \'unique per row\' end as reason '
        f"from ({whole}\nunion all {rest}) where d = n and n >= 10"
    )


@query("id_like", id_like_sql("customer", ["c_custkey", "c_nationkey"], ["c_name", "c_mktsegment"]))
def id_like(spark, sf):
    return T.id_like(table(spark, sf, "customer")).drop("position")


@query(
    "id_like_ordered",
    "with s as (select event_id < lag(event_id) over (order by ts, event_id) as falls from events)\n"
    + id_like_sql("events", ["event_id", "user_id"], ["ts", "event_type", "props"], "not (select bool_or(coalesce(falls, false)) from s)"),
)
def id_like_ordered(spark, sf):
    return T.id_like(table(spark, sf, "events"), order_by="ts").drop("position")


# -- relationships -------------------------------------------------------------

MONEY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue", "charge", "peak"]
MONEY_GAPS = ["l_quantity", "l_extendedprice", "l_discount", "revenue", "peak"]


def pearson_sql(columns: list[str], source: str = "v") -> str:
    """(i, j, col_a, col_b, stat) of every pair; DuckDB skips incomplete pairs itself."""
    return "\nunion all ".join(
        f"select {i} as i, {j} as j, '{columns[i]}' as col_a, '{columns[j]}' as col_b, corr({columns[i]}, {columns[j]}) as stat from {source}"
        for i, j in combinations(range(len(columns)), 2)
    )


def spearman_sql(columns: list[str], source: str = "v") -> str:
    """Average ranks over each pair's complete rows, then Pearson."""
    rank = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double"
    return "\nunion all ".join(
        f"select {i} as i, {j} as j, '{columns[i]}' as col_a, '{columns[j]}' as col_b, corr(a, b) as stat from (select "
        f"{rank.format(c=columns[i])} as a, {rank.format(c=columns[j])} as b from {source} "
        f"where {columns[i]} is not null and {columns[j]} is not null)"
        for i, j in combinations(range(len(columns)), 2)
    )


def strongest_sql(pairs: str, threshold: float, name: str, limit: int = 10) -> str:
    return (
        f"select col_a, col_b, round_even(stat, 3) as {name} from ({pairs}) where abs(stat) >= {threshold} "
        f"order by abs(round_even(stat, 3)) desc, i, j limit {limit}"
    )


@query(
    "pearson_matrix",
    over(
        "lineitem_money_gaps",
        f"with p as ({pearson_sql(MONEY_GAPS)})\n"
        "select col_a, col_b, round_even(stat, 6) as r from p union all select col_b, col_a, round_even(stat, 6) from p union all "
        + each("select '{c}', '{c}', 1.0::double", c=MONEY_GAPS),
    ),
)
def pearson_matrix(spark, sf):
    return tidy(R.pearson_matrix(table(spark, sf, "lineitem_money_gaps")), r=6)


TOP_PEARSON_SQL = strongest_sql(pearson_sql(MONEY), 0.3, "pearson_r")
TOP_SPEARMAN_SQL = strongest_sql(spearman_sql(MONEY), 0.5, "spearman_r")


@query("top_pearson", over("lineitem_money", TOP_PEARSON_SQL))
def top_pearson(spark, sf):
    return R.top_pearson(table(spark, sf, "lineitem_money"))


@query("top_pearson_strongest", over("lineitem_money", strongest_sql(pearson_sql(MONEY), 0.0, "pearson_r", 5)))
def top_pearson_strongest(spark, sf):
    return R.top_pearson(table(spark, sf, "lineitem_money"), threshold=0.0, limit=5)


@query("top_spearman", over("lineitem_money", TOP_SPEARMAN_SQL))
def top_spearman(spark, sf):
    return R.top_spearman(table(spark, sf, "lineitem_money"))


@query("top_spearman_gaps", over("lineitem_money_gaps", strongest_sql(spearman_sql(MONEY_GAPS), 0.05, "spearman_r")))
def top_spearman_gaps(spark, sf):
    return R.top_spearman(table(spark, sf, "lineitem_money_gaps"), threshold=0.05)


BANDS = ["l_returnflag", "l_linestatus", "band", "half", "side", "price_band"]


def chi_square_sql(columns: list[str], source: str = "v") -> str:
    """(i, j, col_a, col_b, n, r, k, chi2) from observed and expected counts."""
    return "\nunion all ".join(
        f"select {i} as i, {j} as j, '{columns[i]}' as col_a, '{columns[j]}' as col_b, max(n) as n, count(distinct a) as r, count(distinct b) as k, "
        "(select sum((coalesce(c2.cnt, 0) - ra.s * rb.s / t.n) * (coalesce(c2.cnt, 0) - ra.s * rb.s / t.n) / (ra.s * rb.s / t.n)) from "
        f"(select {columns[i]} as a, count(*)::double as s from {source} where {columns[i]} is not null and {columns[j]} is not null group by 1) ra cross join "
        f"(select {columns[j]} as b, count(*)::double as s from {source} where {columns[i]} is not null and {columns[j]} is not null group by 1) rb cross join "
        f"(select count(*)::double as n from {source} where {columns[i]} is not null and {columns[j]} is not null) t left join "
        f"(select {columns[i]} as a, {columns[j]} as b, count(*)::double as cnt from {source} group by 1, 2) c2 on c2.a = ra.a and c2.b = rb.b) as chi2 "
        f"from (select {columns[i]} as a, {columns[j]} as b, count(*) over () as n from {source} where {columns[i]} is not null and {columns[j]} is not null)"
        for i, j in combinations(range(len(columns)), 2)
    )


def cramers_sql(columns: list[str], source: str = "v") -> str:
    return (
        "select *, case when n >= 2 and r >= 2 and k >= 2 and least(r2 - 1, k2 - 1) > 0 "
        "then sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / least(r2 - 1, k2 - 1)) else 0 end as stat from "
        "(select *, r - (r - 1) * (r - 1) / (n - 1)::double as r2, k - (k - 1) * (k - 1) / (n - 1)::double as k2 "
        f"from ({chi_square_sql(columns, source)}))"
    )


@query("chi_square", over("lineitem_bands", f"select col_a, col_b, n, round_even(chi2, 4) as chi2 from ({chi_square_sql(BANDS)})"))
def chi_square(spark, sf):
    df = table(spark, sf, "lineitem_bands")
    pairs = R.cramers_v_pairs(df, R.low_cardinality_columns(df))
    return tidy(pairs.select("col_a", "col_b", "n", "chi2"), chi2=4)


@query("cramers_v", over("lineitem_bands", f"select col_a, col_b, n, round_even(stat, 4) as v from ({cramers_sql(BANDS)})"))
def cramers_v(spark, sf):
    df = table(spark, sf, "lineitem_bands")
    pairs = R.cramers_v_pairs(df, R.low_cardinality_columns(df))
    return tidy(pairs.selectExpr("col_a", "col_b", "n", "stat as v"), v=4)


TOP_CRAMERS_SQL = strongest_sql(cramers_sql(BANDS), 0.3, "cramers_v")


@query("top_cramers_v", over("lineitem_bands", TOP_CRAMERS_SQL))
def top_cramers_v(spark, sf):
    return R.top_cramers_v(table(spark, sf, "lineitem_bands"))


BAND_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def effects_sql(limit: int = 8, groups: int = 8, cats: list[str] = BANDS, nums: list[str] = BAND_NUMBERS, source: str = "v") -> str:
    """(rank, category, numeric, spread, group_rank, group, mean, cnt)."""
    means = "\nunion all ".join(
        f"select {ci} as ci, {ni} as ni, '{c}' as category, '{n}' as numeric, {c} as \"group\", avg({n}) as mean, count({n}) as cnt, "
        f"(select stddev_samp({n}) from {source}) as std from {source} where {c} is not null and {n} is not null group by {c}"
        for ci, c in enumerate(cats)
        for ni, n in enumerate(nums)
    )
    return (
        f"with m as ({means}),\n"
        "s as (select *, (max(mean) over w - min(mean) over w) / std as raw, count(*) over w as g, min(cnt) over w as smallest from m "
        "window w as (partition by category, numeric)),\n"
        "r as (select *, round_even(raw, 3) as spread, row_number() over (partition by category, numeric order by abs(mean) desc, \"group\") as group_rank, "
        "dense_rank() over (order by round_even(raw, 3) desc, ci, ni) as rank from s where g >= 2 and smallest >= 3 and raw > 0)\n"
        f'select rank, category, numeric, spread, group_rank, "group", round_even(mean, 4) as mean, cnt from r where rank <= {limit} and group_rank <= {groups}'
    )


@query("category_effects", over("lineitem_bands", effects_sql()))
def category_effects(spark, sf):
    return R.category_effects(table(spark, sf, "lineitem_bands"))


# -- quality -------------------------------------------------------------------

TEXT_COLUMNS = ["balance_text", "segment", "joined", "c_name"]
SENTINEL_SQL = ", ".join(f"'{s}'" for s in SENTINEL_STRINGS)
NUMBER_SQL = r"regexp_matches(replace({c}, ',', ''), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Inf|INF|infinity|Infinity)$')"
DATE_SQL = r"(regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?)?$') and try_cast({c} as timestamp) is not null)"


def text_counts_sql(columns: list[str], source: str = "v") -> str:
    """(column, position, n, nonblank, padded, numbers, dates, sentinels, example, n_raw, n_lower)."""
    s = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return "\nunion all ".join(
        f"select '{c}' as \"column\", {i} as position, count(raw) as n, count(case when s <> '' then 1 end) as nonblank, "
        f"count(case when raw <> s or s = '' then 1 end) as padded, count(case when {NUMBER_SQL.format(c='s')} then 1 end) as numbers, "
        f"count(case when {DATE_SQL.format(c='s')} then 1 end) as dates, count(case when lower(s) in ({SENTINEL_SQL}) then 1 end) as sentinels, "
        f"min(case when lower(s) in ({SENTINEL_SQL}) and s <> '' then s end) as example, count(distinct s) as n_raw, count(distinct lower(s)) as n_lower "
        f"from (select {c} as raw, {s.format(c=c)} as s from {source})"
        for i, c in enumerate(columns)
    )


# check: (condition, hits, total, example)
CHECK_SQL = {
    "whitespace": ("padded > 0", "padded", "n", "null"),
    "numeric_as_text": ("nonblank >= 2 and numbers >= 2 and numbers::double / nonblank >= 0.6", "numbers", "nonblank", "null"),
    "dates_as_text": ("nonblank >= 3 and dates::double / nonblank >= 0.6", "dates", "nonblank", "null"),
    "sentinels": ("sentinels > 0", "sentinels", "n", "example"),
    "mixed_case": ("n_lower < n_raw", "n_raw", "n_lower", "null"),
}


def issues_sql(columns: list[str], source: str = "v", checks: tuple[str, ...] = tuple(CHECK_SQL)) -> str:
    """(check, column, position, check_order, hits, total, example) of every issue."""
    return f"select * from (with t as ({text_counts_sql(columns, source)})\n" + "\nunion all ".join(
        f"select '{check}' as \"check\", \"column\", position, {list(CHECK_SQL).index(check) + 1} as check_order, {hits} as hits, {total} as total, "
        f"cast({example} as varchar) as example from t where {condition}"
        for check, (condition, hits, total, example) in CHECK_SQL.items()
        if check in checks
    ) + ")"


def _check(name: str, check: str, run) -> None:
    register(
        name,
        lambda spark, sf: run(table(spark, sf, "customer_text")).select("check", "column", "hits", "total", "example"),
        over("customer_text", f'select "check", "column", hits, total, example from ({issues_sql(TEXT_COLUMNS, checks=(check,))})'),
    )


_check("dq_whitespace", "whitespace", lambda df: Q.text_issues(df, "whitespace"))
_check("dq_numeric_as_text", "numeric_as_text", lambda df: Q.text_issues(df, "numeric_as_text"))
_check("dq_dates_as_text", "dates_as_text", lambda df: Q.text_issues(df, "dates_as_text"))
_check("dq_sentinels", "sentinels", lambda df: Q.text_issues(df, "sentinels"))
_check("dq_mixed_case", "mixed_case", Q.mixed_case)


@query(
    "dq_numeric_sentinel",
    over(
        "lineitem_sentinel",
        "select 'numeric_sentinel' as \"check\", * from ("
        + each('select \'{c}\' as "column", count(case when {c} in (-999, -9999) then 1 end) as hits, count({c}) as total from v', c=["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])
        + ") where hits > 0",
    ),
)
def dq_numeric_sentinel(spark, sf):
    return Q.numeric_sentinel(table(spark, sf, "lineitem_sentinel")).select("check", "column", "hits", "total")


@query("dq_all", over("customer_text", f'select "check", "column", hits, total, example from ({issues_sql(TEXT_COLUMNS)})'))
def dq_all(spark, sf):
    return Q.quality_issues(table(spark, sf, "customer_text")).select("check", "column", "hits", "total", "example")


@query("dq_whole_texts", f'select "check", "column", hits, total, example from ({issues_sql(["text", "lang", "source"], "documents")})')
def dq_whole_texts(spark, sf):
    return Q.quality_issues(table(spark, sf, "documents")).select("check", "column", "hits", "total", "example")


# -- personal data -------------------------------------------------------------

PII_COLUMNS = ["email", "ssn", "card", "ip", "phone", "half_email", "c_mktsegment"]


def pii_counts_sql(columns: list[str], source: str = "v") -> str:
    tests = ", ".join(f"count(case when regexp_matches(s, '{pattern}') then 1 end) as {kind}" for kind, _, pattern in PII_KINDS)
    return "\nunion all ".join(
        f"select '{c}' as \"column\", {i} as position, count(*) as n, {tests} "
        f"from (select regexp_replace({c}, '^\\s+|\\s+$', '', 'g') as s from {source} where {c} is not null) where s <> ''"
        for i, c in enumerate(columns)
    )


def pii_scan_sql(columns: list[str], source: str = "v") -> str:
    kind = " ".join(f"when {k}::double / n >= 0.6 then '{k}'" for k, _, _ in PII_KINDS)
    label = " ".join(f"when '{k}' then '{text}'" for k, text, _ in PII_KINDS)
    cnt = " ".join(f"when '{k}' then {k}" for k, _, _ in PII_KINDS)
    return (
        f'select "column", position, kind, case kind {label} end as label, case kind {cnt} end as cnt, '
        f"round_even((case kind {cnt} end) * 100.0::double / n, 1) as pct from "
        f"(select *, case {kind} end as kind from ({pii_counts_sql(columns, source)}) where n >= 3) where kind is not null"
    )


for _kind, _name in (("email", "pii_email"), ("ssn", "pii_ssn"), ("credit_card", "pii_credit_card"), ("ip_address", "pii_ip"), ("phone", "pii_phone")):
    register(
        _name,
        lambda spark, sf, kind=_kind: Q.pii_kind(table(spark, sf, "customer_pii"), kind),
        over(
            "customer_pii",
            f"select \"column\", '{_kind}' as kind, n, {_kind} as cnt, round_even({_kind} * 100.0::double / n, 1) as pct "
            f"from ({pii_counts_sql(PII_COLUMNS)}) where {_kind} > 0",
        ),
    )


@query("pii_scan", over("customer_pii", f'select "column", kind, label, cnt, pct from ({pii_scan_sql(PII_COLUMNS)})'))
def pii_scan(spark, sf):
    return Q.pii_scan(table(spark, sf, "customer_pii"))


# -- health --------------------------------------------------------------------


def completeness_sql(columns: list[str], source: str = "v") -> str:
    pct = each(f"select {PCT_MISSING} as pct from {source}", c=columns)
    return f"select greatest(0, 100 - (avg(pct) + max(pct)) / 2) as score from ({pct})"


@query("health_completeness", over("orders_gaps", f"select 'completeness' as component, round_even(score, 4) as score from ({completeness_sql(GAPS_COLUMNS)})"))
def health_completeness(spark, sf):
    return tidy(H.completeness(C.missing_counts(table(spark, sf, "orders_gaps"))), score=4)


@query("health_uniqueness", f"select 'uniqueness' as component, round_even(greatest(0, 100 - 100.0::double * duplicate_rows / n_rows), 4) as score from ({DUPLICATES_SQL})")
def health_uniqueness(spark, sf):
    return tidy(H.uniqueness(T.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))), score=4)


def flagged_sql(issues: str, checks: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{c}'" for c in checks)
    return f'select count(distinct "column") from ({issues}) where "check" in ({listed})'


_ISSUES = issues_sql(TEXT_COLUMNS)
_FORMAT = flagged_sql(_ISSUES, ("whitespace", "mixed_case"))
_VALID = flagged_sql(_ISSUES, ("numeric_as_text", "dates_as_text", "sentinels", "numeric_sentinel"))


@query("health_consistency", over("customer_text", f"select 'consistency' as component, greatest(0, 100 - 15.0::double * ({_FORMAT})) as score"))
def health_consistency(spark, sf):
    df = table(spark, sf, "customer_text")
    return H.consistency(Q.quality_issues(df), T.constant_columns(df))


@query("health_validity", over("customer_text", f"select 'validity' as component, greatest(0, 100 - 15.0::double * ({_VALID})) as score"))
def health_validity(spark, sf):
    return H.validity(Q.quality_issues(table(spark, sf, "customer_text")))


HEALTH_COLUMNS = ["c_custkey", *TEXT_COLUMNS]


@query(
    "health_score",
    over(
        "customer_text",
        f"with p as (select ({completeness_sql(HEALTH_COLUMNS)}) as completeness, 100.0::double as uniqueness, "
        f"greatest(0, 100 - 15.0::double * ({_FORMAT})) as consistency, greatest(0, 100 - 15.0::double * ({_VALID})) as validity, "
        f'(select count(distinct "column") from ({_ISSUES})) as flagged),\n'
        "s as (select *, round_even((completeness * 40 + uniqueness * 20 + consistency * 20 + validity * 20) / 100, 0)::bigint as score from p),\n"
        "g as (select *, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade from s)\n"
        "select score, grade, round_even(completeness, 0)::bigint as completeness, round_even(uniqueness, 0)::bigint as uniqueness, "
        "round_even(consistency, 0)::bigint as consistency, round_even(validity, 0)::bigint as validity, "
        "concat('Grade ', grade, ' (', score, '/100): ', flagged, ' of 5 columns with quality issues.') as verdict from g",
    ),
)
def health_score(spark, sf):
    return H.health_score(table(spark, sf, "customer_text"))
