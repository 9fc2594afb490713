"""Composites that choose drill-through operators from the profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datasonde.functions.kinds import BOOLEAN, CATEGORICAL, NUMERIC, names_of, text_literal
from datasonde.functions.values import union_all
from datasonde.operators.columns import outlier_columns
from datasonde.operators.drill import correlation_check, group_compare, outlier_inspect
from datasonde.operators.relations import (
    category_effects,
    low_cardinality_counts,
    top_pearson,
    top_spearman,
)

MAX_DRILLED_COLUMNS = 2
MAX_DRILLED_CATEGORIES = 2

FINDING_SCHEMA = "step int, tool string, column_a string, column_b string, summary string"


def widest_categories(df: DataFrame) -> list[str]:
    """Category and boolean columns with 2..20 groups, most groups first."""
    near = low_cardinality_counts(df, (BOOLEAN, CATEGORICAL))
    return [name for name, n in sorted(near, key=lambda c: (-c[1], c[0]))]


def auto_investigate(df: DataFrame) -> DataFrame:
    """(step, tool, column_a, column_b, summary): up to three findings without being asked.

    The column with most outliers, the strongest numeric pair and the widest group
    effect; the choices come from three small profile tables.
    """
    parts = []
    worst = outlier_columns(df).limit(1).collect()
    if worst:
        parts.append(_outlier_finding(df, worst[0]["column"]))
    pair = top_pearson(df).limit(1).collect() or top_spearman(df).limit(1).collect()
    if pair:
        parts.append(_correlation_finding(df, pair[0]["col_a"], pair[0]["col_b"]))
    effect = category_effects(df, 1, 1).collect()
    numeric, categories = names_of(df, NUMERIC), [] if effect else widest_categories(df)
    if effect:
        parts.append(_group_finding(df, effect[0]["numeric"], effect[0]["category"]))
    elif numeric and categories:
        parts.append(_group_finding(df, numeric[0], categories[0]))
    return union_all(parts) if parts else df.sparkSession.createDataFrame([], FINDING_SCHEMA)


def _outlier_finding(df: DataFrame, column: str) -> DataFrame:
    bounds = outlier_inspect(df, column).where("part = 'bounds'")
    return bounds.selectExpr(
        "1 as step",
        "'outlier_inspect' as tool",
        "column as column_a",
        "cast(null as string) as column_b",
        "concat(n_outliers, ' IQR outlier(s) in ', column, ' (', pct_outliers, '% of ', n_valid, "
        "' non-null values), bounds [', lower, ', ', upper, ']') as summary",
    )


def _correlation_finding(df: DataFrame, a: str, b: str) -> DataFrame:
    return correlation_check(df, a, b).selectExpr(
        "2 as step",
        "'correlation_check' as tool",
        "column_a",
        "column_b",
        "concat('Pearson r=', pearson_r, ' and Spearman r=', spearman_r, ' over ', n, ' complete rows', "
        "if(low_n, ' (low n, treat with caution)', '')) as summary",
    )


def _group_finding(df: DataFrame, numeric: str, category: str) -> DataFrame:
    gap = group_compare(df, numeric, category).where("part = 'gap'")
    return gap.selectExpr(
        "3 as step",
        "'group_compare' as tool",
        f"{text_literal(numeric)} as column_a",
        f"{text_literal(category)} as column_b",
        "concat('mean differs by ', mean, ' between ', category, ' and ', low_category) as summary",
    )


def anomaly_drilldown(df: DataFrame) -> DataFrame:
    """The two columns with most outliers, each compared across the two widest categories.

    (column, n_outliers, pct_outliers, category_column, high_group, high_mean,
    low_group, low_mean, gap); one row without a category when there is none.
    """
    worst = [r.asDict() for r in outlier_columns(df).limit(MAX_DRILLED_COLUMNS).collect()]
    categories = widest_categories(df)[:MAX_DRILLED_CATEGORIES]
    schema = (
        "column string, n_outliers bigint, pct_outliers double, category_column string, "
        "high_group string, high_mean double, low_group string, low_mean double, gap double"
    )
    parts = [df.sparkSession.createDataFrame([], schema)]
    for w in worst:
        known = [f"{text_literal(w['column'])} as column", f"{w['n_outliers']}L as n_outliers", f"{w['pct_outliers']!r}D as pct_outliers"]
        for category in categories:
            compared = group_compare(df, w["column"], category)
            ends = compared.selectExpr(
                "max(if(part = 'group', struct(mean, -rank, category), null)) as high",
                "min(if(part = 'group', struct(mean, rank, category), null)) as low",
                "max(if(part = 'gap', mean, null)) as gap",
            )
            parts.append(
                ends.selectExpr(
                    *known,
                    f"{text_literal(category)} as category_column",
                    "high.category as high_group",
                    "high.mean as high_mean",
                    "low.category as low_group",
                    "low.mean as low_mean",
                    "gap",
                )
            )
        if not categories:
            row = (w["column"], w["n_outliers"], w["pct_outliers"], None, None, None, None, None, None)
            parts.append(df.sparkSession.createDataFrame([row], schema))
    return union_all(parts)
