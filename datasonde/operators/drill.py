"""Drill-through operators: one question about one or two columns each.

Every operator returns a DataFrame; ``run_tool`` adds name and argument checks
and turns anything wrong into an error value.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.functions.fixed_values import LOW_CARDINALITY
from datasonde.functions.kinds import (
    BOOLEAN,
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    column_info,
    column_infos,
    text_literal,
)
from datasonde.functions.moments import sample_deviation
from datasonde.functions.periods import UNITS, period_label, period_start
from datasonde.functions.values import (
    as_text,
    grouped,
    is_sentinel,
    number_literal,
    percent,
    rounded,
    strip,
    union_all,
)
from datasonde.operators.columns import outlier_stats
from datasonde.operators.frequency import distinct_counts, first_k, top_values
from datasonde.operators.order_stats import plan_buckets, quantiles
from datasonde.operators.relations import low_cardinality_counts, pearson_pairs, spearman_pairs

MAX_GROUPS = 12
MAX_TOP_VALUES = 8
MAX_EXAMPLES = 5
MAX_SPLITS = 3
MAX_PERIODS = 10
LOW_N = 30


def correlation_check(df: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """One row: Pearson and Spearman on complete rows, n, and a caution below 30 rows.

    An error without two complete rows, or where a column has one value in all of them.
    """
    pair = [column_a, column_b]
    pearson = pearson_pairs(df, pair).selectExpr("i", "j", "n", f"{rounded('stat', 4)} as pearson_r")
    known = pearson.first()  # one row
    if known["n"] < 2:
        raise ValueError(f"a correlation needs two complete rows, there are {known['n']}")
    if known["pearson_r"] is None:
        raise ValueError("a correlation needs two distinct values in both columns")
    spearman = spearman_pairs(df, pair).selectExpr("i", "j", f"{rounded('stat', 4)} as spearman_r")
    return pearson.join(spearman, ["i", "j"]).selectExpr(
        f"{text_literal(column_a)} as column_a", f"{text_literal(column_b)} as column_b", "pearson_r", "spearman_r", "n", f"n < {LOW_N} as low_n"
    )


# The rank that stands for all rows together.
TOTAL = -1


def group_compare(df: DataFrame, numeric_column: str, categorical_column: str) -> DataFrame:
    """Rows per group (part 'group'), over all values ('overall') and the widest gap ('gap').

    (part, rank, category, low_category, n, mean, median, std, n_groups); in the gap
    row ``category`` and ``low_category`` are the groups and ``mean`` their distance.
    Two passes: one groups the rows and, as a grouping set, all of them; the groups shown and
    the total come to the driver. The other counts values within the groups shown and the rest,
    from which the medians of groups and total are taken.
    """
    number, label = column_info(df, numeric_column), column_info(df, categorical_column)
    rows = df.selectExpr(f"{as_text(label.value, label.data_type)} as category", f"{number.number} as value").where(
        "value is not null"
    )
    summed = rows.rollup("category").agg(
        *[F.expr(f"{sql} as {name}") for name, sql in {"n": "count(*)", "mean": "avg(value)", "std": sample_deviation("value"), "total": "grouping(category)"}.items()]
    )
    ordered = summed.where("total = 1 or category is not null").orderBy(F.desc("total"), F.desc("n"), "category")
    found = ordered.limit(MAX_GROUPS + 1).collect()  # the total and 12 groups
    known = df.sparkSession.createDataFrame(
        [(i if i else TOTAL, r["category"], r["n"], r["mean"], r["std"]) for i, r in enumerate(found)],
        "rank bigint, category string, n bigint, mean double, std double",
    )
    n_rows = found[0]["n"] if found else 0
    shown = known.where("category is not null").selectExpr("category", "rank")
    freq = grouped(rows.join(F.broadcast(shown), "category", "left"), ["rank", "value"], cnt="count(*)")  # 12 rows are sent
    twice = freq.selectExpr(f"inline(array(struct(rank, value, cnt), struct({TOTAL}L as rank, value, cnt)))").where("rank is not null")
    buckets = plan_buckets(rows.select("value"), n_rows)
    medians = quantiles(grouped(twice, ["rank", "value"], cnt="sum(cnt)"), ["rank"], {"median": 0.5}, buckets).drop("n")
    groups = known.join(medians, "rank").selectExpr("rank", "category", "n", *[f"{rounded(c, 4)} as {c}" for c in ("mean", "median", "std")])
    none, no_number = "cast(null as string)", "cast(null as double)"
    group_rows = groups.selectExpr(
        f"if(rank = {TOTAL}, 'overall', 'group') as part", f"nullif(rank, {TOTAL}L) as rank", "category", f"{none} as low_category", "n", "mean", "median", "std"
    )
    means = known.where(f"rank <> {TOTAL}").selectExpr("rank", "category", f"{rounded('mean', 4)} as mean")
    ends = means.selectExpr("max(struct(mean, -rank, category)) as high", "min(struct(mean, rank, category)) as low", "count(*) as k")
    gap_row = ends.where("k >= 2").selectExpr(
        "'gap' as part",
        "cast(null as bigint) as rank",
        "high.category as category",
        "low.category as low_category",
        "cast(null as bigint) as n",
        f"{rounded('high.mean - low.mean', 4)} as mean",
        f"{no_number} as median",
        f"{no_number} as std",
    )
    return union_all([group_rows, gap_row])


def missingness_analysis(df: DataFrame, column: str) -> DataFrame:
    """How often a column is missing and the categories where that differs most.

    One row per split (up to three), or a single row without one: (column, n_rows,
    n_missing, pct_missing, n_sentinel, split_rank, split_column, category, n, rate, gap).
    """
    target = column_info(df, column)
    gone = f"({target.value}) is null"
    placeholder = f"count_if({is_sentinel(strip(target.value))})" if target.kind == CATEGORICAL else "0L"
    head = df.selectExpr(
        f"{text_literal(column)} as column",
        "count(*) as n_rows",
        f"count_if({gone}) as n_missing",
        f"{percent(f'count_if({gone})', 'count(*)')} as pct_missing",
        f"{placeholder} as n_sentinel",
    )
    near = low_cardinality_counts(df, (BOOLEAN, CATEGORICAL, DATETIME), 1, LOW_CARDINALITY)
    infos = [column_info(df, name) for name, _ in near if name != column]
    if not infos:
        return head.selectExpr(
            "*",
            "cast(null as bigint) as split_rank",
            "cast(null as string) as split_column",
            "cast(null as string) as category",
            "cast(null as bigint) as n",
            "cast(null as double) as rate",
            "cast(null as double) as gap",
        )
    cells = ", ".join(
        f"struct({text_literal(c.name)} as split_column, {as_text(c.value, c.data_type)} as category)" for c in infos
    )
    rates = grouped(
        df.selectExpr(f"{gone} as gone", f"inline(array({cells}))"),
        ["split_column", "category"],
        n="count(*)",
        gone="count_if(gone)",
    )
    overall = "sum(gone) over (partition by split_column) * 100D / sum(n) over (partition by split_column)"
    judged = rates.selectExpr("*", f"{overall} as overall", "gone * 100D / n as raw_rate").where("category is not null")
    widest = first_k(judged.selectExpr("*", "abs(raw_rate - overall) as raw_gap"), "split_column", "raw_gap desc, category", 1)
    found = widest.where("raw_gap > 0").selectExpr(
        "split_column", "category", "n", f"{rounded('raw_rate', 2)} as rate", f"{rounded('raw_gap', 2)} as gap"
    )
    order = "row_number() over (partition by 0 order by gap desc, split_column)"  # one row per split column
    splits = found.selectExpr(f"{text_literal(column)} as column", f"cast({order} as bigint) as split_rank", "*").where(
        f"split_rank <= {MAX_SPLITS}"
    )
    return head.join(splits, "column", "left")


def value_scan(df: DataFrame, column: str) -> DataFrame:
    """Inventory of one column: its 'shape' and its 'top' values.

    (part, rank, value, cnt, n_unique, min, max, mean, min_length, max_length)
    """
    info = column_info(df, column)
    number = info.kind == NUMERIC
    text = info.kind == CATEGORICAL

    def when(applies: bool, sql: str, kind: str) -> str:
        return sql if applies else f"cast(null as {kind})"

    measured = df.selectExpr(
        f"{text_literal(column)} as column",
        f"{when(number, rounded(f'min({info.value})', 4), 'double')} as min",
        f"{when(number, rounded(f'max({info.value})', 4), 'double')} as max",
        f"{when(number, rounded(f'avg({info.value})', 4), 'double')} as mean",
        f"{when(text, f'cast(min(length({info.value})) as bigint)', 'bigint')} as min_length",
        f"{when(text, f'cast(max(length({info.value})) as bigint)', 'bigint')} as max_length",
    )
    shape = measured.join(distinct_counts(df, [column]).select("column", "n_unique"), "column").selectExpr(
        "'shape' as part",
        "cast(null as bigint) as rank",
        f"'{info.dtype}' as value",
        "cast(null as bigint) as cnt",
        "n_unique",
        "min",
        "max",
        "mean",
        "min_length",
        "max_length",
    )
    top = top_values(df, [column], MAX_TOP_VALUES).selectExpr(
        "'top' as part",
        "rank",
        "value",
        "cnt",
        "cast(null as bigint) as n_unique",
        *[f"cast(null as double) as {c}" for c in ("min", "max", "mean")],
        *[f"cast(null as bigint) as {c}" for c in ("min_length", "max_length")],
    )
    return union_all([shape, top])


OUTLIER_SCHEMA = (
    "part string, rank bigint, column string, value double, lower double, upper double, "
    "n_valid bigint, n_outliers bigint, pct_outliers double, mean_outliers double, mean_rest double, shift_pct double"
)


def outlier_inspect(df: DataFrame, column: str, comparisons: int | None = None) -> DataFrame:
    """IQR outliers of one column and what else shifts with them.

    Parts: 'bounds' (fences, count, share), 'example' (five values farthest from the
    median) and 'comparison' (means of the other numeric columns, or of the first
    ``comparisons``, in the outlier rows and in the rest). An error without a value.
    """
    info = column_info(df, column)
    known = outlier_stats(df, [column]).first()  # one row
    spark = df.sparkSession
    if known is None or not known["n"]:
        raise ValueError(f"column {column!r} has no values")
    if known["lower"] is None:
        n = known["n"]
        return spark.createDataFrame([("bounds", None, column, None, None, None, n, 0, 0.0, None, None, None)], OUTLIER_SCHEMA)
    lower, upper, median = (number_literal(known[k]) for k in ("lower", "upper", "median"))
    bounds = spark.createDataFrame(
        [("bounds", None, column, None, known["lower"], known["upper"], known["n"], known["n_outliers"], known["pct_outliers"], None, None, None)],
        OUTLIER_SCHEMA,
    ).withColumns({c: F.expr(rounded(c, 4)) for c in ("lower", "upper")})
    empty = {f.name: f"cast(null as {f.dataType.simpleString()})" for f in bounds.schema.fields}

    def shaped(found: DataFrame, **cells: str) -> DataFrame:
        return found.selectExpr(*[f"{sql} as {name}" for name, sql in {**empty, **cells}.items()])

    v = info.number
    outside = df.selectExpr(f"{v} as value").where(f"value < {lower} or value > {upper}")
    counted = grouped(outside, ["value"], cnt="count(*)").selectExpr("1 as side", "*", f"abs(value - {median}) as distance")
    far = first_k(counted, "side", "distance desc, value", MAX_EXAMPLES).drop("rank")
    copies = far.selectExpr("side", "value", "distance", f"explode(sequence(1, cast(least(cnt, {MAX_EXAMPLES}) as int))) as copy")
    ranked = first_k(copies, "side", "distance desc, value, copy", MAX_EXAMPLES)
    examples = shaped(ranked, part="'example'", rank="cast(rank as bigint)", column=text_literal(column), value=rounded("value", 6))

    others = [c for c in column_infos(df, NUMERIC) if c.name != column][:comparisons]
    if not others or not known["n_outliers"]:
        return union_all([bounds, examples])
    out, rest = f"({v} < {lower} or {v} > {upper})", f"({v} >= {lower} and {v} <= {upper})"
    means = df.selectExpr(
        *[f"avg(if({out}, {c.number}, null)) as o{i}" for i, c in enumerate(others)],
        *[f"avg(if({rest}, {c.number}, null)) as r{i}" for i, c in enumerate(others)],
    )
    cells = ", ".join(f"struct({i + 1} as rank, {text_literal(c.name)} as column, o{i} as o, r{i} as r)" for i, c in enumerate(others))
    compared = shaped(
        means.selectExpr(f"inline(array({cells}))"),
        part="'comparison'",
        rank="cast(rank as bigint)",
        column="column",
        mean_outliers=rounded("o", 4),
        mean_rest=rounded("r", 4),
        shift_pct=rounded("try_divide(o - r, abs(r)) * 100", 2),
    )
    return union_all([bounds, examples, compared])


def time_slice(df: DataFrame, date_column: str, freq: str = "M") -> DataFrame:
    """(rank, period, n, mean, n_periods): the ten busiest calendar periods.

    ``mean`` is that of the first numeric column, null where there is none.
    """
    first = next(iter(column_infos(df, NUMERIC)), None)
    at = column_info(df, date_column)
    rows = df.where(f"{at.value} is not null").selectExpr(
        f"{period_start(at.value, freq)} as start", f"{first.number if first else 'cast(null as double)'} as v"
    )
    sliced = grouped(rows, ["start"], n="count(*)", mean=rounded("avg(v)", 4))  # one row per calendar period
    ranked = sliced.selectExpr(
        "cast(row_number() over (partition by 0 order by n desc, start) as bigint) as rank",
        f"{period_label('start', freq)} as period",
        "n",
        "mean",
        "count(*) over (partition by 0) as n_periods",
    )
    return ranked.where(f"rank <= {MAX_PERIODS}")


# -- dispatch ------------------------------------------------------------------


@dataclass(frozen=True)
class ToolResult:
    ok: bool
    error: str | None = None
    table: DataFrame | None = None


# name: (operator, argument → kinds of column it accepts)
TOOLS = {
    "correlation_check": (correlation_check, {"column_a": (NUMERIC,), "column_b": (NUMERIC,)}),
    "group_compare": (
        group_compare,
        {"numeric_column": (NUMERIC,), "categorical_column": (BOOLEAN, CATEGORICAL, DATETIME)},
    ),
    "missingness_analysis": (missingness_analysis, {"column": ()}),
    "value_scan": (value_scan, {"column": ()}),
    "outlier_inspect": (outlier_inspect, {"column": (NUMERIC,)}),
    "time_slice": (time_slice, {"date_column": (DATETIME,)}),
}


def run_tool(df: DataFrame, name: str, args: dict) -> ToolResult:
    """Run a drill-through operator by name; bad input is an error value, never an exception."""
    if name not in TOOLS:
        return ToolResult(False, f"unknown tool {name!r}; expected one of {sorted(TOOLS)}")
    problem = _argument_error(df, name, args)
    if problem:
        return ToolResult(False, problem)
    try:
        return ToolResult(True, None, TOOLS[name][0](df, **args))
    except Exception as crash:  # an operator failing on odd data is reported, not raised
        return ToolResult(False, f"tool {name!r} failed: {crash}")


def _argument_error(df: DataFrame, name: str, args: object) -> str | None:
    operator, columns = TOOLS[name]
    if not isinstance(args, dict):
        return f"the arguments of {name!r} must be an object"
    allowed = set(inspect.signature(operator).parameters) - {"df"}
    unexpected = sorted(set(args) - allowed)
    if unexpected:
        return f"unexpected argument {unexpected[0]!r} for {name!r}"
    for argument, kinds in columns.items():
        if argument not in args:
            return f"{name!r} needs the argument {argument!r}"
        column = args[argument]
        if not isinstance(column, str) or column not in df.columns:
            return f"column {column!r} not found"
        kind = column_info(df, column).kind
        if kinds and kind not in kinds:
            return f"column {column!r} is {kind}, {argument!r} must be {' or '.join(kinds)}"
    if name == "time_slice" and args.get("freq", "M") not in UNITS:
        return f"freq must be one of {sorted(UNITS)}, got {args['freq']!r}"
    return None
