"""The aggregates behind direct questions about a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from datasonde.functions.kinds import (
    BOOLEAN,
    CATEGORICAL,
    DATETIME,
    NESTED,
    NUMERIC,
    column_info,
    column_infos,
)
from datasonde.functions.values import as_text, datetime_text, grouped, rounded, union_all
from datasonde.operators.columns import column_types, missing_counts, per_column
from datasonde.operators.frequency import (
    distinct_counts,
    first_texts,
    no_columns,
    top_values,
)
from datasonde.operators.relations import pearson_pairs, top_cramers_v, top_pearson, top_spearman
from datasonde.operators.table import duplicate_rows, fully_empty_rows

MAX_VALUES = 8
CATALOG_VALUES = 5


def ask_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, pct_missing, n_rows) of the columns asked for."""
    infos = [column_info(df, c) for c in columns]
    return missing_counts(df, infos).select("column", "n_missing", "pct_missing", "n_rows")


def ask_rows(df: DataFrame, duplicates: bool = False, missing: bool = False) -> DataFrame:
    """(fact, value): rows and columns, optionally duplicates and rows with a gap."""
    facts = [df.selectExpr("count(*) as n").selectExpr(f"inline(array(struct('n_rows' as fact, n as value), struct('n_columns' as fact, {len(df.columns)}L as value)))")]
    if duplicates:
        facts.append(duplicate_rows(df).selectExpr("'duplicate_rows' as fact", "duplicate_rows as value"))
    if missing:
        facts.append(fully_empty_rows(df).selectExpr("'rows_with_missing' as fact", "rows_with_missing as value"))
    return union_all(facts)


def ask_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, max, min, mean, n) of the numeric columns asked for that have values."""
    infos = [c for c in (column_info(df, n) for n in columns) if c.kind == NUMERIC]
    measured = per_column(
        df,
        infos,
        lambda c: {
            "max": f"cast(max({c.value}) as double)",
            "min": f"cast(min({c.value}) as double)",
            "mean": f"avg({c.number})",
            "n": f"count({c.value})",
        },
    )
    return measured.where("n > 0").drop("position")


def ask_unique(df: DataFrame, column: str) -> DataFrame:
    """(rank, value, cnt, n_unique): the most frequent values and how many there are."""
    counts = distinct_counts(df, [column]).select("position", "n_unique")
    return counts.join(top_values(df, [column], MAX_VALUES), "position").select("rank", "value", "cnt", "n_unique")


def ask_correlation(df: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """(measure, value, n): Pearson of two numbers, else the listed association of the pair."""
    if all(column_info(df, c).kind == NUMERIC for c in (column_a, column_b)):
        return pearson_pairs(df, [column_a, column_b]).selectExpr(
            "'pearson_r' as measure", f"{rounded('stat', 3)} as value", "n"
        )
    listed = [
        (top_pearson(df), "pearson_r"),
        (top_spearman(df), "spearman_r"),
        (top_cramers_v(df), "cramers_v"),
    ]
    found = union_all(
        pairs.selectExpr("col_a", "col_b", f"{i} as at", f"'{name}' as measure", f"{name} as value")
        for i, (pairs, name) in enumerate(listed)
    )
    a, b = sorted([column_a, column_b])
    same = found.where((found.col_a == a) & (found.col_b == b) | (found.col_a == b) & (found.col_b == a))
    return same.orderBy("at").limit(1).selectExpr("measure", "value", "cast(null as bigint) as n")


def ask_dtype(df: DataFrame, column: str) -> DataFrame:
    """(column, dtype, kind, n_valid)."""
    return column_types(df.select(f"`{column}`")).drop("position")


def ask_duplicates(df: DataFrame) -> DataFrame:
    return duplicate_rows(df)


def schema_catalog(df: DataFrame, limit: int | None = None) -> DataFrame:
    """(position, column, kind, sample): range or first distinct values of each column, or of the first ``limit``."""
    infos = column_infos(df)[:limit]

    def sample(c) -> dict[str, str]:
        low, high = f"min({c.value})", f"max({c.value})"
        if c.kind == NUMERIC:
            shown = f"concat('min ', {as_text(low, c.data_type)}, ', max ', {as_text(high, c.data_type)})"
        elif c.kind == DATETIME:
            shown = f"concat({datetime_text(low)}, ' .. ', {datetime_text(high)})"
        else:
            shown = "max('True/False')" if c.kind == BOOLEAN else "max(cast(null as string))"
        return {"kind": f"max('{'text' if c.kind in (CATEGORICAL, NESTED) else c.kind}')", "sample": shown}

    ranges = per_column(df, infos, sample)
    texts = [c.name for c in infos if c.kind == CATEGORICAL]
    source, names = (df, texts) if texts else (no_columns(df, T.StringType()), ["none"])
    first = first_texts(source, names, CATALOG_VALUES)
    listed = grouped(  # five values per column
        first,
        ["position"],
        listed="concat_ws(', ', transform(sort_array(collect_list(struct(rank, value))), x -> concat('\\'', x.value, '\\'')))",
    )
    return (
        ranges.join(listed, "position", "left")
        .selectExpr("position", "column", "kind", "coalesce(sample, listed, 'empty') as sample")
        .orderBy("position")
    )
