"""Data-quality and personal-data checks on whole columns.

Every check is a conditional count in one pass over the table; only mixed case
needs the distinct values, and those are shuffled by a bounded key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasonde.functions.fixed_values import (
    CHECK_ADVICE,
    NUMERIC_SENTINELS,
    PII_KINDS,
    PII_MIN_RATIO,
    PII_MIN_VALUES,
    TEXT_PARSE_RATIO,
)
from datasonde.functions.kinds import CATEGORICAL, NUMERIC, column_infos, names_of, quoted, text_literal
from datasonde.functions.values import (
    grouped,
    is_sentinel,
    looks_like_date,
    looks_numeric,
    percent,
    strip,
    text_key,
    union_all,
)
from datasonde.operators.columns import per_column
from datasonde.operators.frequency import no_columns

CHECK_ORDER = f"array_position(array({', '.join(text_literal(c) for c, _ in CHECK_ADVICE)}), check)"
ISSUE_COLUMNS = ["position", "check", "column", "hits", "total", "example"]


def _texts(df: DataFrame) -> DataFrame:
    """(position, column, raw, s): every text value with its stripped form, one row per cell.

    Long form keeps the generated code the same size for any number of columns;
    the cells are counted per column before anything is shuffled.
    """
    if not names_of(df, CATEGORICAL):
        df = no_columns(df, T.StringType())
    infos = column_infos(df, CATEGORICAL)
    numbered = df.selectExpr(*[f"cast({quoted(c.name)} as string) as `{c.position}`" for c in infos])
    long = numbered.unpivot([], [f"`{c.position}`" for c in infos], "position", "raw").where("raw is not null")
    listed = f"array({', '.join(text_literal(n) for n in df.columns)})"
    return long.selectExpr(
        "cast(position as int) as position",
        f"element_at({listed}, cast(position as int) + 1) as column",
        "raw",
        f"{strip('raw')} as s",
    )


def text_counts(df: DataFrame) -> DataFrame:
    """Counts behind the text checks, one row per text column that has values."""
    judged = _texts(df).selectExpr(
        "position",
        "column",
        "s",
        "s != '' as nonblank",
        "raw != s or s = '' as padded",
        f"{looks_numeric('s')} as number",
        f"{looks_like_date('s')} as date",
        f"{is_sentinel('s')} as sentinel",
    )
    return grouped(
        judged,
        ["position", "column"],
        n="count(*)",
        n_nonblank="count_if(nonblank)",
        n_padded="count_if(padded)",
        n_numbers="count_if(number)",
        n_dates="count_if(date)",
        n_sentinels="count_if(sentinel)",
        example="min(if(sentinel and nonblank, s, null))",
    )


# check, when it applies, hits, total: the checks answered by text_counts
TEXT_CHECKS = (
    ("whitespace", "n_padded > 0", "n_padded", "n", "null"),
    (
        "numeric_as_text",
        f"n_nonblank >= 2 and n_numbers >= 2 and try_divide(n_numbers, n_nonblank) >= {TEXT_PARSE_RATIO}",
        "n_numbers",
        "n_nonblank",
        "null",
    ),
    (
        "dates_as_text",
        f"n_nonblank >= 3 and try_divide(n_dates, n_nonblank) >= {TEXT_PARSE_RATIO}",
        "n_dates",
        "n_nonblank",
        "null",
    ),
    ("sentinels", "n_sentinels > 0", "n_sentinels", "n", "example"),
)


def text_issues(df: DataFrame, *checks: str) -> DataFrame:
    """Issues of the text checks named, or of all four."""
    cells = ", ".join(
        f"struct('{check}' as check, {applies} as flagged, {hits} as hits, {total} as total, "
        f"cast({example} as string) as example)"
        for check, applies, hits, total, example in TEXT_CHECKS
        if not checks or check in checks
    )
    return text_counts(df).selectExpr("position", "column", f"inline(array({cells}))").where("flagged").select(*ISSUE_COLUMNS)


def mixed_case(df: DataFrame) -> DataFrame:
    """Columns where distinct values fall together once lowercased."""
    keyed = _texts(df).selectExpr(
        "position", "column", f"{text_key('s')} as value", f"{text_key('lower(s)')} as lowered"
    )
    folded = grouped(keyed.distinct(), ["position", "column", "lowered"], variants="count(*)")
    counted = grouped(folded, ["position", "column"], n_raw="sum(variants)", n_lower="count(*)")
    return counted.where("n_lower < n_raw").selectExpr(
        "position", "'mixed_case' as check", "column", "n_raw as hits", "n_lower as total", "cast(null as string) as example"
    )


def numeric_sentinel(df: DataFrame) -> DataFrame:
    listed = ", ".join(str(s) for s in NUMERIC_SENTINELS)
    counted = per_column(
        df,
        column_infos(df, NUMERIC),
        lambda c: {"hits": f"count_if({c.value} in ({listed}))", "total": f"count({c.value})"},
    )
    return counted.where("hits > 0").selectExpr(
        "position", "'numeric_sentinel' as check", "column", "hits", "total", "cast(null as string) as example"
    )


def quality_issues(df: DataFrame) -> DataFrame:
    """(position, check, column, hits, total, example, check_order) of every issue found."""
    found = union_all([text_issues(df), mixed_case(df), numeric_sentinel(df)])
    return found.selectExpr("*", f"cast({CHECK_ORDER} as int) as check_order")


# -- personal data -------------------------------------------------------------


def pii_counts(df: DataFrame) -> DataFrame:
    """Values of each text column that match each kind of personal data."""
    judged = _texts(df).where("s != ''").selectExpr(
        "position", "column", *[f"s rlike r'(?U){pattern}' as {kind}" for kind, _, pattern in PII_KINDS]
    )
    return grouped(
        judged, ["position", "column"], n="count(*)", **{kind: f"count_if({kind})" for kind, _, _ in PII_KINDS}
    )


def pii_kind(df: DataFrame, kind: str) -> DataFrame:
    """(column, kind, n, cnt, pct) of the text columns with a match of one kind."""
    return pii_counts(df).where(f"{kind} > 0").selectExpr(
        "column", f"'{kind}' as kind", "n", f"{kind} as cnt", f"{percent(kind, 'n', 1)} as pct"
    )


def pii_scan(df: DataFrame, min_ratio: float = PII_MIN_RATIO) -> DataFrame:
    """(column, kind, label, cnt, pct): the first kind most values match, per column."""
    verdicts = ", ".join(
        f"if({kind} / n >= {min_ratio!r}D, struct('{kind}' as kind, '{label}' as label, {kind} as cnt), null)"
        for kind, label, _ in PII_KINDS
    )
    judged = pii_counts(df).where(f"n >= {PII_MIN_VALUES}").selectExpr("position", "column", "n", f"coalesce({verdicts}) as hit")
    found = judged.where("hit is not null").selectExpr(
        "position", "column", "hit.kind", "hit.label", "hit.cnt", f"{percent('hit.cnt', 'n', 1)} as pct"
    )
    return found.orderBy(F.desc("cnt"), "position").drop("position")
