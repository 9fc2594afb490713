"""Whole-table profile: shape, duplicates, missing patterns, identifiers, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from datasonde.functions.fixed_values import MIN_ID_ROWS
from datasonde.functions.kinds import (
    NESTED,
    NUMERIC,
    SCALAR_KINDS,
    column_info,
    column_infos,
    is_floating,
    is_integral,
    names_of,
    quoted,
    text_literal,
)
from datasonde.functions.values import as_text, grouped, percent
from datasonde.operators.columns import missing_counts, per_column
from datasonde.operators.frequency import distinct_counts
from datasonde.operators.gram import together_missing
from datasonde.operators.order_stats import plan_buckets


# JSON keeps milliseconds unless told otherwise.
EXACT_TIMES = "map('timestampFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSSXXX', 'timestampNTZFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSS')"


def table_shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, n_numeric_columns, n_categorical_columns (all others)."""
    numeric = len(names_of(df, NUMERIC))
    return df.selectExpr("count(*) as n_rows").selectExpr(
        "n_rows",
        f"{len(df.columns)}L as n_columns",
        f"{numeric}L as n_numeric_columns",
        f"{len(df.columns) - numeric}L as n_categorical_columns",
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows and duplicate_rows, the repeats of an earlier identical row.

    Rows of fixed-width columns are grouped as they are. Rows holding texts or
    nested values are grouped by a SHA-256 of the whole row, so the shuffle moves
    32 bytes per row however long the texts are. Copies collapse before it.
    """
    infos = column_infos(df)
    if all(_fixed_width(c.data_type) for c in infos):
        keyed = df.selectExpr(*[f"{c.value} as k{c.position}" for c in infos])
    else:
        # adding 0.0 turns -0.0 into 0.0, which grouping by the columns does too
        cells = [f"{c.value} + 0D" if is_floating(c.data_type) else quoted(c.name) for c in infos]
        named = ", ".join(f"{cell} as c{i}" for i, cell in enumerate(cells))
        keyed = df.selectExpr(f"unhex(sha2(to_json(struct({named}), {EXACT_TIMES}), 256)) as k")
    copies = grouped(keyed, keyed.columns, copies="count(*)")
    return copies.selectExpr(
        "coalesce(sum(copies), 0L) as n_rows", "coalesce(sum(copies - 1), 0L) as duplicate_rows"
    )


def _fixed_width(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def constant_columns(df: DataFrame) -> DataFrame:
    """(column, n_unique) of columns with at most one distinct value."""
    return distinct_counts(df).where("n_unique <= 1").select("column", "n_unique")


def all_missing(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct_missing) of columns with missing values, worst first."""
    counted = missing_counts(df).where("n_missing > 0")
    return counted.orderBy("pct_missing", "position", ascending=[False, True]).select(
        "column", "n_missing", "pct_missing"
    )


def top_missing(df: DataFrame, limit: int = 10) -> DataFrame:
    return all_missing(df).limit(limit)


def sample_rows(df: DataFrame, order_by: list[str], n: int = 5, width: int = 40) -> DataFrame:
    """The first rows by ``order_by`` as text, each cell cut to ``width`` characters."""
    cells = []
    for c in column_infos(df):
        shown = f"cast({quoted(c.name)} as string)" if c.kind == NESTED else as_text(c.value, c.data_type)
        cells.append(f"left({shown}, {width}) as {quoted(c.name)}")
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n).selectExpr(*cells)


def fully_empty_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows, fully_empty_rows and rows_with_missing (any value missing)."""
    empty = [f"({c.value}) is null" for c in column_infos(df)]
    return df.selectExpr(
        "count(*) as n_rows",
        f"count_if({' and '.join(empty)}) as fully_empty_rows",
        f"count_if({' or '.join(empty)}) as rows_with_missing",
    )


def co_missing_pairs(df: DataFrame, limit: int = 5, max_columns: int | None = None) -> DataFrame:
    """(col_a, col_b, cnt, pct_of_rows) of columns missing together, most rows first.

    Of all columns with gaps, or of the first ``max_columns``. Every task multiplies the marks
    of its rows, batch by batch, into one count per pair, so a row makes no rows however many
    of its values are missing.
    """
    gaps = missing_counts(df).where("n_missing > 0").orderBy("position")
    found = gaps.select("column", "n_rows").collect()[:max_columns]  # one row per column
    infos = [column_info(df, r["column"]) for r in found]
    n_rows = found[0]["n_rows"] if found else 0
    if len(infos) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, cnt bigint, pct_of_rows double")
    listed = f"array({', '.join(text_literal(c.name) for c in infos)})"
    counted = together_missing(df.selectExpr(*[f"({c.value}) is null as m{i}" for i, c in enumerate(infos)]))
    ordered = counted.orderBy("cnt", "i", "j", ascending=[False, True, True])
    return ordered.limit(limit).selectExpr(
        f"element_at({listed}, i + 1) as col_a",
        f"element_at({listed}, j + 1) as col_b",
        "cnt",
        f"{percent('cnt', f'{n_rows}L')} as pct_of_rows",
    )


def id_like(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(position, column, reason) of columns that identify rows rather than carry signal.

    An integer column is "sequential integer" when it never decreases in the order
    of ``order_by`` or, without an order, when it has no gaps.
    """
    infos = [c for c in column_infos(df, *SCALAR_KINDS) if c.kind != NUMERIC or is_integral(c.data_type)]
    unique = distinct_counts(df, [c.name for c in infos]).where(f"n_unique = n_rows and n_rows >= {MIN_ID_ROWS}")

    def dense(c) -> str:
        if not is_integral(c.data_type):
            return "max(cast(null as boolean))"
        v = f"cast({c.value} as decimal(20,0))"
        return f"max({v}) - min({v}) + 1 = count({v})"

    # only a column that is unique in each row is read along the order
    asked = {r["column"] for r in unique.select("column").collect()} if order_by is not None else set()

    def rising(c) -> str:
        holds = c.name in asked and is_integral(c.data_type) and is_non_decreasing(df, order_by, c.name)
        return f"max({str(holds).lower()})"

    shape = per_column(df, infos, lambda c: {"sequential": dense(c) if order_by is None else rising(c)})
    reason = "if(sequential, 'sequential integer', 'unique per row') as reason"
    return unique.drop("column").join(shape, "position").selectExpr("position", "column", reason).orderBy("position")


def is_non_decreasing(df: DataFrame, order_by: str, column: str) -> bool:
    """Whether ``column`` never falls along ``order_by`` (a number or a timestamp).

    Rows of one key are in the order of the column, so each key is folded to its extremes
    before the shuffle; rows without a key have no place in the order and are left out.
    Neighbouring keys, in their own type, are compared inside range buckets, then the
    buckets' extremes in turn.
    """
    info = column_info(df, order_by)
    key = info.value if info.kind == NUMERIC else f"unix_micros(cast({info.value} as timestamp))"
    rows = df.selectExpr(f"{key} as key", f"{quoted(column)} as v").where("key is not null and v is not null")
    folded = grouped(rows, ["key"], low="min(v)", high="max(v)").selectExpr("*", "cast(key as double) as value")
    buckets = plan_buckets(folded, df.count())
    steps = buckets.place(folded).selectExpr(
        "bucket", "low", "high", "coalesce(lag(high) over (partition by bucket order by key) > low, false) as falls"
    )
    ends = grouped(steps, ["bucket"], falls="max(falls)", low="min(low)", high="max(high)")  # one row per bucket
    across = ends.selectExpr("falls or coalesce(lag(high) over (partition by 0 order by bucket) > low, false) as falls")
    return not across.selectExpr("max(falls) as falls").first()["falls"]
