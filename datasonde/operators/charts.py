"""The aggregates behind charts; every table is small enough to draw, none is drawn here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.functions.fixed_values import LOW_CARDINALITY
from datasonde.functions.kinds import (
    BOOLEAN,
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    ColumnInfo,
    column_info,
    column_infos,
    quoted,
    text_literal,
)
from datasonde.functions.values import as_text, finite, grouped, number_literal, percent, rounded, union_all
from datasonde.operators.columns import missing_counts, numeric_buckets, per_column, pooled_buckets
from datasonde.operators.frequency import named, numeric_frequencies, top_values
from datasonde.operators.order_stats import QUARTILES, RangeBuckets, quantiles, with_fences
from datasonde.operators.relations import category_effects, low_cardinality_counts, pearson_matrix, top_pearson

MAX_CATEGORY_BARS = 12
MAX_SCATTER_POINTS = 2000
MAX_SCATTER_PAIRS = 3
SCATTER_MIN_R = 0.4
MAX_GROUPED_PAIRS = 3
BINS = 30
GRID_POINTS = 200
# A normal kernel this many bandwidths away is below double precision.
KERNEL_REACH = 9


def chart_missing(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct_missing, worst): fewest first; the worst three are numbered."""
    counted = missing_counts(df).where("n_missing > 0")
    return (
        counted.selectExpr(
            "position",
            "column",
            "n_missing",
            f"{percent('n_missing', 'n_rows', 1)} as pct_missing",
            "cast(row_number() over (partition by 0 order by n_missing desc, position) as bigint) as worst",
        )  # one row per column
        .selectExpr("position", "column", "n_missing", "pct_missing", "if(worst <= 3, worst, null) as worst")
        .orderBy("n_missing", "position")
        .drop("position")
    )


def varying_columns(df: DataFrame, limit: int | None = None) -> list[dict]:
    """Range, spread and count of the numeric columns that vary, or of the first ones (driver-side, one row each).

    Of finite values: an infinite one has no place on a chart.
    """
    facts = per_column(
        df,
        column_infos(df, NUMERIC),
        lambda c: {
            "low": f"min({finite(c.number)})",
            "high": f"max({finite(c.number)})",
            "std": f"stddev_samp({finite(c.number)})",
            "n": f"count({finite(c.number)})",
        },
    )
    known = facts.where("low < high").orderBy("position").collect()
    return [r.asDict() for r in known[:limit]]


def histogram(df: DataFrame, bins: int = BINS, columns: int | None = None) -> DataFrame:
    """(column, bin, low, high, cnt): equal-width bins of the numeric columns, or of the first ``columns``.

    Bins are counted inside each task, so only bins leave it. Infinite values are in no bin.
    """
    facts = varying_columns(df, columns)
    if not facts:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, cnt bigint")
    infos = {c.name: c for c in column_infos(df, NUMERIC)}
    values = df.selectExpr(*[f"{finite(infos[f['column']].number)} as v{i}" for i, f in enumerate(facts)])
    cells = []
    for i, f in enumerate(facts):
        low, high = number_literal(f["low"]), number_literal(f["high"])
        cells.append(f"struct({i} as i, v{i} as v, {low} as lo, {high} as hi)")
    long = values.selectExpr(f"inline(array({', '.join(cells)}))").where("v is not null")
    placed = long.selectExpr(
        "i",
        "v",
        "lo",
        f"(hi - lo) / {bins} as width",
        f"least(cast(floor((v - lo) / (hi - lo) * {bins}) as int), {bins - 1}) as b",
    )
    # the edges decide where the division falls just beside one
    settled = placed.selectExpr(
        "i", f"case when v < lo + b * width then b - 1 when v >= lo + (b + 1) * width and b < {bins - 1} then b + 1 else b end as bin"
    )
    counted = grouped(settled, ["i", "bin"], cnt="count(*)")
    spine = df.sparkSession.createDataFrame(
        [(i, f["column"], f["low"], f["high"]) for i, f in enumerate(facts)], "i int, column string, lo double, hi double"
    ).selectExpr("i", "column", "lo", "hi", f"explode(sequence(0, {bins - 1})) as bin")
    return spine.join(counted, ["i", "bin"], "left").selectExpr(
        "column",
        "bin",
        f"lo + bin * ((hi - lo) / {bins}) as low",
        f"if(bin = {bins - 1}, hi, lo + (bin + 1) * ((hi - lo) / {bins})) as high",
        "coalesce(cnt, 0L) as cnt",
    )


def density(df: DataFrame, points: int = GRID_POINTS, columns: int | None = None, reach: float = KERNEL_REACH) -> DataFrame:
    """(column, point, x, density): Gaussian kernel density with Scott's bandwidth.

    Every value is used. Each one only reaches the grid points its kernel can
    change, so the work per value shrinks as the bandwidth does with more rows: those
    ``reach`` bandwidths away, beyond which a kernel is below double precision. Tasks add
    kernels up on a grid of their own; the grids alone are shuffled, however many values differ.
    """
    facts = [f for f in varying_columns(df, columns) if f["std"]]
    if not facts:
        return df.sparkSession.createDataFrame([], "column string, point int, x double, density double")
    known = df.sparkSession.createDataFrame(
        [(f["position"], f["low"], f["high"], f["std"] * f["n"] ** -0.2, f["n"]) for f in facts],
        "position int, lo double, hi double, h double, n bigint",
    ).withColumn("step", F.expr(f"(hi - lo) / {points - 1}"))
    infos = {c.name: c for c in column_infos(df, NUMERIC)}
    values = df.selectExpr(*[f"{finite(infos[f['column']].number)} as v{i}" for i, f in enumerate(facts)])
    grids = [(f["position"], f["low"], (f["high"] - f["low"]) / (points - 1), f["std"] * f["n"] ** -0.2) for f in facts]
    parts = values.mapInArrow(_kernel_sums(grids, points, reach), "position int, point int, s double")
    summed = grouped(parts, ["position", "point"], s="sum(s)")
    spine = known.selectExpr("position", "lo", "step", "h", "n", f"explode(sequence(0, {points - 1})) as point")
    drawn = spine.join(summed, ["position", "point"], "left").selectExpr(
        "position", "point", "lo + point * step as x", "coalesce(s, 0D) / (n * h * sqrt(2 * pi())) as density"
    )
    return named(df, drawn).drop("position")


def _kernel_sums(grids: list[tuple[int, float, float, float]], points: int, reach: float):
    """Sums of kernels at the points of each column's grid (position, low, step, bandwidth), over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(grids), points))
        for batch in batches:
            for total, column, (_, low, step, h) in zip(totals, batch.columns, grids):
                v = column.to_numpy(zero_copy_only=False).astype(np.float64)
                v, cnt = np.unique(v[~np.isnan(v)], return_counts=True)
                first = np.maximum(np.ceil((v - reach * h - low) / step), 0).astype(np.int64)
                last = np.minimum(np.floor((v + reach * h - low) / step), points - 1).astype(np.int64)
                while len(v):
                    z = (low + first * step - v) / h
                    total += np.bincount(first, cnt * np.exp(-0.5 * z * z), points)
                    first = first + 1
                    more = first <= last
                    v, cnt, first, last = v[more], cnt[more], first[more], last[more]
        if totals.any():
            place = np.repeat([g[0] for g in grids], points)
            at = np.tile(np.arange(points), len(grids))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(at, pa.int32()), pa.array(totals.ravel())], ["position", "point", "s"])

    return run


def box_stats(freq: DataFrame, keys: list[str], buckets: RangeBuckets) -> DataFrame:
    """(keys…, n, p25, median, p75, whisker_low, whisker_high, n_fliers, pct_outliers).

    The keys are a column or one of the 20 groups of a column pair, so their
    quartiles are few enough to broadcast.
    """
    spread = with_fences(quantiles(freq, keys, QUARTILES, buckets)).selectExpr(
        "*", "p25 - 1.5D * (p75 - p25) as reach_low", "p75 + 1.5D * (p75 - p25) as reach_high"
    )
    judged = freq.join(F.broadcast(spread), keys)
    counted = grouped(
        judged,
        keys,
        n="max(n)",
        p25="max(p25)",
        median="max(median)",
        p75="max(p75)",
        whisker_low="least(min(if(value >= reach_low, value, null)), max(p25))",
        whisker_high="greatest(max(if(value <= reach_high, value, null)), max(p75))",
        n_fliers="sum(if(value < reach_low or value > reach_high, cnt, 0))",
        outside="sum(if(coalesce(value < lower or value > upper, false), cnt, 0))",
    )
    return counted.selectExpr(
        *keys, "n", "p25", "median", "p75", "whisker_low", "whisker_high", "n_fliers", f"{percent('outside', 'n')} as pct_outliers"
    )


def chart_box(df: DataFrame, columns: int | None = None) -> DataFrame:
    """Box statistics of the numeric columns that vary, or of the first ``columns``."""
    names = [f["column"] for f in varying_columns(df, columns)]
    stats = box_stats(numeric_frequencies(df, names), ["position"], numeric_buckets(df, names))
    return named(df, stats).drop("position")


def chart_categories(df: DataFrame, columns: int | None = None) -> DataFrame:
    """(column, rank, value, cnt, share): bars of the category columns, or of the first ``columns``.

    Columns of 2..20 distinct values and varying booleans, each once, in table order.
    """
    near = low_cardinality_counts(df, (BOOLEAN, CATEGORICAL), 2, LOW_CARDINALITY)
    names = [n for n, _ in near][:columns]
    bars = top_values(df, names, MAX_CATEGORY_BARS)
    rows = missing_counts(df, column_infos(df, names=names)).select("position", "n_rows")
    return bars.join(rows, "position").selectExpr(
        "column", "rank", "value", "cnt", f"{rounded('cnt / n_rows', 4)} as share"
    )


def chart_heatmap(df: DataFrame, columns: int | None = None) -> DataFrame:
    """(col_a, col_b, r): the full matrix of the numeric columns that vary, or of the first ``columns``."""
    return pearson_matrix(df, [f["column"] for f in varying_columns(df, columns)])


def chart_scatter(df: DataFrame, key: list[str] | None = None, points: int = MAX_SCATTER_POINTS) -> DataFrame:
    """(col_a, col_b, x, y): a sample of the strongest pairs with |r| >= 0.4.

    The sample is the rows with the smallest MD5 of their key, so it is the same on
    every run and does not follow the order of the rows.
    """
    found = [p for p in top_pearson(df).collect() if abs(p["pearson_r"]) >= SCATTER_MIN_R][:MAX_SCATTER_PAIRS]
    if not found:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, x double, y double")
    infos = column_infos(df) if key is None else [column_info(df, k) for k in key]
    spread = "md5(concat_ws('|', " + ", ".join(f"cast({quoted(c.name)} as string)" for c in infos) + "))"
    parts = []
    for pair in found:
        a, b = column_info(df, pair["col_a"]), column_info(df, pair["col_b"])
        rows = df.selectExpr(f"{a.number} as x", f"{b.number} as y", f"{spread} as at").where("x is not null and y is not null")
        shown = rows.orderBy("at", "x", "y").limit(points)
        parts.append(shown.selectExpr(f"{text_literal(a.name)} as col_a", f"{text_literal(b.name)} as col_b", "x", "y"))
    return union_all(parts)


def chart_grouped_box(df: DataFrame) -> DataFrame:
    """Box statistics per group for the three widest category effects."""
    effects = category_effects(df, MAX_GROUPED_PAIRS, 1).orderBy("rank").collect()  # three rows
    if not effects:
        return df.sparkSession.createDataFrame(
            [],
            "category string, numeric string, group string, n bigint, p25 double, median double, p75 double, "
            "whisker_low double, whisker_high double, n_fliers bigint, pct_outliers double",
        )
    cells = []
    for e in effects:
        cat, num = column_info(df, e["category"]), column_info(df, e["numeric"])
        cells.append(
            f"struct({text_literal(cat.name)} as category, {text_literal(num.name)} as numeric, "
            f"{as_text(cat.value, cat.data_type)} as group, {num.number} as value)"
        )
    long = df.selectExpr(f"inline(array({', '.join(cells)}))").where("group is not null and value is not null")
    keys = ["category", "numeric", "group"]
    buckets = pooled_buckets(df, sorted({e["numeric"] for e in effects}))
    return box_stats(grouped(long, [*keys, "value"], cnt="count(*)"), keys, buckets)


def chart_time_trend(df: DataFrame, columns: int | None = None) -> DataFrame:
    """(bucket, column, mean): means per day, week or month of the first datetime column.

    Days up to a span of 90 days, weeks (labelled by their Sunday) up to three years,
    months beyond; buckets without any value are left out. Of the numeric columns that
    vary, or of the first ``columns``.
    """
    empty = df.sparkSession.createDataFrame([], "bucket string, column string, mean double")
    dates = column_infos(df, DATETIME)
    names = [f["column"] for f in varying_columns(df, columns)] if dates else []
    if not names:
        return empty
    at: ColumnInfo = dates[0]
    when = f"cast({at.value} as timestamp_ntz)"
    span = df.selectExpr(
        f"count({at.value}) as n", f"timestampdiff(MICROSECOND, min({when}), max({when})) / 86400000000D as days"
    ).first()
    if span["n"] < 3:
        return empty
    unit = "day" if span["days"] <= 90 else "week" if span["days"] <= 3 * 365 else "month"
    start = f"cast(date_trunc('{unit}', {when}) as timestamp_ntz)"
    label = f"{start} + interval 6 days" if unit == "week" else start
    infos = {c.name: c for c in column_infos(df, names=names)}
    rows = df.where(f"{at.value} is not null").selectExpr(
        f"date_format({label}, 'yyyy-MM-dd') as bucket", *[f"{infos[n].number} as v{i}" for i, n in enumerate(names)]
    )
    means = grouped(rows, ["bucket"], **{f"m{i}": f"avg(v{i})" for i in range(len(names))})
    some = " or ".join(f"m{i} is not null" for i in range(len(names)))
    kept = means.where(some).selectExpr("*", "count(*) over (partition by 0) as buckets").where("buckets >= 2")
    cells = ", ".join(f"struct({text_literal(n)} as column, m{i} as mean)" for i, n in enumerate(names))
    return kept.selectExpr("bucket", f"inline(array({cells}))")
