"""Per-column profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasonde.functions.kinds import (
    BOOLEAN,
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    ColumnInfo,
    column_infos,
    text_literal,
)
from datasonde.functions.moments import sample_deviation, sample_kurtosis, sample_skewness
from datasonde.functions.values import datetime_text, finite, grouped, number_literal, percent, rounded, union_all
from datasonde.operators.frequency import (
    POSITION,
    first_k,
    modes,
    named,
    no_columns,
    numeric_frequencies,
    top_values,
)
from datasonde.operators.order_stats import (
    IS_OUTLIER,
    QUARTILES,
    RangeBuckets,
    plan_buckets,
    plan_keyed_buckets,
    quantiles,
    with_fences,
)

# Columns aggregated in one pass; beyond so many, another pass reads only its own columns.
COLUMNS_PER_PASS = 1_000

PROFILE_QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}

# Measures of one column by name, as SQL aggregates.
Measure = Callable[[ColumnInfo], dict[str, str]]


def profiled(df: DataFrame, *kinds: str, max_columns: int | None = None) -> list[ColumnInfo]:
    """The columns given a detailed profile: all of the kinds, or those among the first ``max_columns``."""
    return [c for c in column_infos(df, *kinds) if max_columns is None or c.position < max_columns]


def per_column(df: DataFrame, infos: list[ColumnInfo], measure: Measure) -> DataFrame:
    """One row per column from plain aggregates: (position, column, measures…).

    A single pass with map-side aggregation; only one row leaves each task.
    """
    if not infos:
        none = no_columns(df, T.DoubleType())
        return per_column(none, column_infos(none), measure).where("false")
    parts = []
    for i in range(0, len(infos), COLUMNS_PER_PASS):
        group = [(c, measure(c)) for c in infos[i : i + COLUMNS_PER_PASS]]
        wide = df.selectExpr(*[f"{sql} as m{c.position}_{k}" for c, m in group for k, sql in m.items()])
        rows = ", ".join(
            f"struct({c.position} as position, {text_literal(c.name)} as column, "
            + ", ".join(f"m{c.position}_{k} as {k}" for k in m)
            + ")"
            for c, m in group
        )
        parts.append(wide.selectExpr(f"inline(array({rows}))"))
    return union_all(parts)


def missing_counts(df: DataFrame, infos: list[ColumnInfo] | None = None) -> DataFrame:
    """(position, column, n_missing, pct_missing, n_rows) of every column, nested ones too."""
    counted = per_column(
        df,
        infos if infos is not None else column_infos(df),
        lambda c: {"n_rows": "count(*)", "n_valid": f"count({c.value})"},
    )
    missing = "n_rows - n_valid"
    return counted.selectExpr(
        "position", "column", f"{missing} as n_missing", f"{percent(missing, 'n_rows')} as pct_missing", "n_rows"
    )


def column_types(df: DataFrame) -> DataFrame:
    """(position, column, dtype, kind, n_valid) of every column."""
    return per_column(
        df,
        column_infos(df),
        lambda c: {
            "dtype": f"max({text_literal(c.dtype)})",
            "kind": f"max('{c.kind}')",
            "n_valid": f"count({c.value})",
        },
    )


def numeric_cells(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """(position, v double): one row per cell of the numeric columns.

    Heavy aggregates run over cells grouped by column: the generated code stays the
    same size for any number of columns, and each task still emits a row per column.
    """
    if not infos:
        df = no_columns(df, T.DoubleType())
        infos = column_infos(df)
    numbers = df.selectExpr(*[f"{c.number} as `{c.position}`" for c in infos])
    cells = numbers.unpivot([], [f"`{c.position}`" for c in infos], "position", "v")
    return cells.selectExpr(f"{POSITION} as position", "v")


def numeric_moments(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """(position, column, n, mean, std, min, max, skew, kurtosis, n_zeros, n_negative)."""
    cells = numeric_cells(df, profiled(df, NUMERIC, max_columns=max_columns))
    measured = grouped(
        cells,
        ["position"],
        n="count(v)",
        mean=finite("avg(v)"),
        std=finite(sample_deviation("v")),
        min=finite("min(v)"),
        max=finite("max(v)"),
        skew=finite(sample_skewness("v")),
        kurtosis=finite(sample_kurtosis("v")),
        n_zeros="count_if(v = 0)",
        n_negative="count_if(v < 0)",
    )
    return named(df, measured)


def numeric_buckets(df: DataFrame, names: list[str]) -> RangeBuckets:
    """Range buckets of each numeric column, from one scan of those columns."""
    infos = column_infos(df, names=names)
    if not infos:
        return RangeBuckets()
    return plan_keyed_buckets(numeric_cells(df, infos).withColumnRenamed("v", "value"), "position", df.count())


def pooled_buckets(df: DataFrame, names: list[str]) -> RangeBuckets:
    """Range buckets shared by the groups of one or a few numeric columns."""
    infos = column_infos(df, names=names)
    return plan_buckets(numeric_cells(df, infos).selectExpr("v as value").where("value is not null"), df.count())


def column_quantiles(
    df: DataFrame, names: list[str], probs: dict[str, float] = PROFILE_QUANTILES, buckets: RangeBuckets | None = None
) -> DataFrame:
    """(position, column, n, quantiles…), exact, linear between neighbours."""
    buckets = buckets or numeric_buckets(df, names)
    return named(df, quantiles(numeric_frequencies(df, names), ["position"], probs, buckets))


def approximate_quantiles(
    df: DataFrame, names: list[str], probs: dict[str, float] = PROFILE_QUANTILES, accuracy: int = 10_000
) -> DataFrame:
    """(position, column, n, quantiles…) from a mergeable sketch: one pass, no shuffle of values."""
    return per_column(
        df,
        column_infos(df, names=names),
        lambda c: {
            "n": f"count({c.value})",
            **{k: f"percentile_approx({c.number}, {p!r}D, {accuracy})" for k, p in probs.items()},
        },
    )


def approximate_distinct(df: DataFrame, names: list[str], rsd: float = 0.05) -> DataFrame:
    """(position, column, n_unique) from a mergeable sketch of the values' hashes."""
    if not names:
        df, names = no_columns(df, T.StringType()), ["none"]
    infos = column_infos(df, names=names)
    hashes = df.selectExpr(
        *[f"if(({c.value}) is null, null, xxhash64({c.value})) as `{c.position}`" for c in infos]
    ).unpivot([], [f"`{c.position}`" for c in infos], "position", "h")
    cells = hashes.selectExpr(f"{POSITION} as position", "h")
    return named(df, grouped(cells, ["position"], n_unique=f"approx_count_distinct(h, {rsd!r}D)"))


def judged_values(df: DataFrame, names: list[str], buckets: RangeBuckets | None = None) -> DataFrame:
    """(position, value, cnt, n, quartiles, fences, out): the frequency table against its fences."""
    buckets = buckets or numeric_buckets(df, names)
    freq = numeric_frequencies(df, names)
    fences = with_fences(quantiles(freq, ["position"], QUARTILES, buckets))
    # one row per column: broadcast, or every value of a column would meet in one task
    return freq.join(F.broadcast(fences), "position").selectExpr("*", f"{IS_OUTLIER} as out")


def outlier_stats(df: DataFrame, names: list[str], buckets: RangeBuckets | None = None) -> DataFrame:
    """(position, column, n, lower, upper, median, n_outliers, pct_outliers) per numeric column.

    The fences, one row per column, are computed first; the rows outside them are then
    counted in a plain pass, without a shuffle of values.
    """
    buckets = buckets or numeric_buckets(df, names)
    fences = with_fences(quantiles(numeric_frequencies(df, names), ["position"], QUARTILES, buckets))
    known = [tuple(r) for r in fences.select("position", "n", "lower", "upper", "median").collect()]
    bounds = {position: (lower, upper) for position, _, lower, upper, _ in known if lower is not None}

    def outside(c: ColumnInfo) -> dict[str, str]:
        if c.position not in bounds:
            return {"n_outliers": "count_if(false)"}
        low, high = map(number_literal, bounds[c.position])
        return {"n_outliers": f"count_if({c.number} < {low} or {c.number} > {high})"}

    rows = df.sparkSession.createDataFrame(known, "position int, n bigint, lower double, upper double, median double")
    counts = per_column(df, column_infos(df, names=names), outside).select("position", "n_outliers")
    found = rows.join(F.broadcast(counts), "position")  # one row per column
    return named(df, found.selectExpr("*", f"{percent('n_outliers', 'n')} as pct_outliers"))


def outlier_examples(df: DataFrame, names: list[str], k: int = 3, buckets: RangeBuckets | None = None) -> DataFrame:
    """(position, column, rank, value): outliers farthest from the median, repeats included."""
    far = judged_values(df, names, buckets).where("out").selectExpr(
        "position", "value", "cnt", "abs(value - median) as distance"
    )
    distinct = first_k(far, "position", "distance desc, value", k).drop("rank")
    repeated = distinct.selectExpr(
        "position", "value", "distance", f"explode(sequence(1, cast(least(cnt, {k}) as int))) as copy"
    )
    ranked = first_k(repeated, "position", "distance desc, value, copy", k)
    return named(df, ranked.selectExpr("position", "cast(rank as bigint) as rank", f"{rounded('value', 6)} as value"))


def outlier_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Numeric columns with outliers, most first, with the share of values and of rows."""
    infos = [c for c in profiled(df, NUMERIC) if names is None or c.name in names]
    names = [c.name for c in infos]
    buckets = numeric_buckets(df, names)
    stats = outlier_stats(df, names, buckets).where("n_outliers > 0")
    rows = missing_counts(df, infos).select("position", "n_rows")
    shown = grouped(  # three rows per column
        outlier_examples(df, names, 3, buckets),
        ["position"],
        examples="transform(sort_array(collect_list(struct(rank, value))), e -> e.value)",
    )
    found = stats.join(rows, "position").join(shown, "position")
    return (
        found.selectExpr(
            "position",
            "column",
            "n_outliers",
            "pct_outliers",
            f"{percent('n_outliers', 'n_rows')} as pct_rows",
            "examples",
        )
        .orderBy("n_outliers", "position", ascending=[False, True])
        .drop("position")
    )


def datetime_spans(df: DataFrame) -> DataFrame:
    """(position, column, min, max, n_valid, span_days) of datetime columns."""

    def measure(c: ColumnInfo) -> dict[str, str]:
        low, high = f"cast(min({c.value}) as timestamp_ntz)", f"cast(max({c.value}) as timestamp_ntz)"
        days = f"timestampdiff(MICROSECOND, {low}, {high}) / 86400000000D"
        return {
            "min": datetime_text(low),
            "max": datetime_text(high),
            "n_valid": f"count({c.value})",
            "span_days": f"if(count({c.value}) >= 2, {rounded(days, 2)}, null)",
        }

    infos = profiled(df, DATETIME)
    if not infos:
        df = no_columns(df, T.TimestampNTZType())
        return per_column(df, column_infos(df), measure).where("false")
    return per_column(df, infos, measure)


def category_tops(df: DataFrame, k: int = 5) -> DataFrame:
    """(position, column, rank, value, cnt) of boolean and text columns."""
    return top_values(df, [c.name for c in profiled(df, BOOLEAN, CATEGORICAL)], k)


def numeric_profile(df: DataFrame) -> DataFrame:
    """Everything known about each numeric column, one row per column."""
    names = [c.name for c in profiled(df, NUMERIC)]
    buckets = numeric_buckets(df, names)
    outliers = outlier_stats(df, names, buckets).select("position", "lower", "upper", "n_outliers", "pct_outliers")
    return (
        numeric_moments(df)
        .join(column_quantiles(df, names, PROFILE_QUANTILES, buckets).drop("n", "column"), "position", "left")
        .join(modes(df, names).drop("column"), "position", "left")
        .join(outliers, "position", "left")
        .orderBy("position")
    )


def column_summaries(df: DataFrame) -> DataFrame:
    """(position, column, summary): one line per profiled column."""
    numeric = numeric_profile(df).selectExpr(
        "position",
        "column",
        "concat_ws(' · ', concat('mean ', bround(mean, 4)), concat('median ', bround(median, 4)), "
        "concat('std ', bround(std, 4)), concat('skew ', bround(skew, 4))) as summary",
    )
    dates = datetime_spans(df).selectExpr(
        "position", "column", "concat(min, ' → ', max, coalesce(concat(' (', span_days, ' days)'), '')) as summary"
    )
    others = profiled(df, BOOLEAN, CATEGORICAL)
    tops = top_values(df, [c.name for c in others], 1).selectExpr("position", "concat('top: ', value, ' (', cnt, ')') as top")
    places = per_column(df, others, lambda c: {"n": "count(*)"})
    texts = places.join(tops, "position", "left").selectExpr("position", "column", "coalesce(top, '—') as summary")
    return union_all([numeric, dates, texts]).orderBy("position")
