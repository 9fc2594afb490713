"""Rules that turn profile tables into findings and recommendations.

Every rule returns rows (rule, rank, column_a, column_b, metric, value). Rules
look at the sections of a :class:`Profile`, which builds each section once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from datasonde.functions.fixed_values import CHECK_ADVICE
from datasonde.functions.kinds import BOOLEAN, CATEGORICAL, NUMERIC, text_literal
from datasonde.functions.shared import kept
from datasonde.functions.values import grouped, percent, union_all
from datasonde.operators.columns import (
    category_tops,
    datetime_spans,
    missing_counts,
    numeric_moments,
    numeric_buckets,
    outlier_stats,
    profiled,
)
from datasonde.operators.frequency import distinct_counts, first_k
from datasonde.operators.quality import pii_scan, quality_issues
from datasonde.operators.relations import category_effects, top_cramers_v, top_pearson, top_spearman
from datasonde.operators.table import duplicate_rows, fully_empty_rows, id_like, table_shape

HIGH_CARDINALITY = 50


class Profile:
    """The sections of a table's profile, each planned on first use.

    With ``keep`` a section, a few rows per column, is computed once and
    checkpointed; rules that share it then do not read the table again.
    """

    def __init__(self, df: DataFrame, keep: bool = False):
        self.df = df
        self._section = kept if keep else lambda section: section

    @cached_property
    def shape(self) -> DataFrame:
        return self._section(table_shape(self.df))

    @cached_property
    def duplicates(self) -> DataFrame:
        return self._section(duplicate_rows(self.df))

    @cached_property
    def missing(self) -> DataFrame:
        return self._section(missing_counts(self.df))

    @cached_property
    def distinct(self) -> DataFrame:
        """(position, column, n_unique, n_rows)."""
        return self._section(distinct_counts(self.df).select("position", "column", "n_unique", "n_rows"))

    @cached_property
    def moments(self) -> DataFrame:
        return self._section(numeric_moments(self.df))

    @cached_property
    def outliers(self) -> DataFrame:
        """(position, column, n_outliers, pct_outliers, n_rows) of columns that have any."""
        infos = profiled(self.df, NUMERIC)
        names = [c.name for c in infos]
        stats = outlier_stats(self.df, names, numeric_buckets(self.df, names)).where("n_outliers > 0")
        rows = missing_counts(self.df, infos).select("position", "n_rows")
        return self._section(stats.join(rows, "position").select("position", "column", "n_outliers", "pct_outliers", "n_rows"))

    @cached_property
    def tops(self) -> DataFrame:
        return self._section(category_tops(self.df))

    @cached_property
    def spans(self) -> DataFrame:
        return self._section(datetime_spans(self.df))

    @cached_property
    def empty(self) -> DataFrame:
        return self._section(fully_empty_rows(self.df))

    @cached_property
    def identifiers(self) -> DataFrame:
        return self._section(id_like(self.df))

    @cached_property
    def issues(self) -> DataFrame:
        return self._section(quality_issues(self.df))

    @cached_property
    def pii(self) -> DataFrame:
        return self._section(pii_scan(self.df))

    @cached_property
    def pearson(self) -> DataFrame:
        return self._section(top_pearson(self.df))

    @cached_property
    def spearman(self) -> DataFrame:
        return self._section(top_spearman(self.df))

    @cached_property
    def associations(self) -> DataFrame:
        return self._section(top_cramers_v(self.df))

    @cached_property
    def effects(self) -> DataFrame:
        return self._section(category_effects(self.df))

    def names(self, *kinds: str) -> str:
        """The profiled columns of the kinds, as a SQL list."""
        return ", ".join(text_literal(c.name) for c in profiled(self.df, *kinds)) or "null"


Rule = Callable[[Profile], DataFrame]


def _ranked(found: DataFrame, rule: str, order: str, metric: str, value: str, limit: int | None = None, a: str = "column", b: str = "null") -> DataFrame:
    """Shape the rows of a rule; ``found`` holds at most a few rows per column."""
    ranked = found.selectExpr(
        f"'{rule}' as rule",
        f"cast(row_number() over (partition by 0 order by {order}) as bigint) as rank",
        f"cast({a} as string) as column_a",
        f"cast({b} as string) as column_b",
        f"{metric} as metric",
        f"cast({value} as double) as value",
    )
    return ranked if limit is None else ranked.where(f"rank <= {limit}")


def _pairs(found: DataFrame, rule: str, stat: str, at_least: float, limit: int) -> DataFrame:
    kept = found.where(f"abs({stat}) >= {at_least!r}D")
    return _ranked(kept, rule, f"abs({stat}) desc, col_a, col_b", f"'{stat}'", stat, limit, "col_a", "col_b")


# -- insights ------------------------------------------------------------------


def insight_shape(p: Profile) -> DataFrame:
    facts = union_all(
        [
            p.shape.selectExpr(
                "inline(array(struct(1 as at, 'n_rows' as fact, n_rows as v), struct(2 as at, 'n_columns' as fact, n_columns as v), "
                "struct(3 as at, 'n_numeric_columns' as fact, n_numeric_columns as v), "
                "struct(4 as at, 'n_categorical_columns' as fact, n_categorical_columns as v)))"
            ),
            p.duplicates.selectExpr("5 as at", "'duplicate_rows' as fact", "duplicate_rows as v"),
        ]
    )
    return _ranked(facts, "shape", "at", "fact", "v", a="null")


def insight_missing(p: Profile) -> DataFrame:
    """The five worst columns, or one row without a column when nothing is missing."""
    worst = _ranked(p.missing.where("n_missing > 0"), "missing", "pct_missing desc, position", "'pct_missing'", "pct_missing", 5)
    total = p.missing.selectExpr("count_if(n_missing > 0) as v").where("v = 0")
    return worst.unionByName(_ranked(total, "missing", "v", "'columns_with_missing'", "v", a="null"))


def insight_constant(p: Profile) -> DataFrame:
    return _ranked(p.distinct.where("n_unique <= 1"), "constant", "position", "'n_unique'", "n_unique")


def insight_skew(p: Profile) -> DataFrame:
    return _ranked(p.moments.where("abs(skew) >= 1"), "skew", "abs(skew) desc, position", "'skew'", "skew", 5)


def insight_outliers(p: Profile) -> DataFrame:
    """Share of all rows, not of the non-null values."""
    return _ranked(
        p.outliers, "outliers", "n_outliers desc, position", "'pct_rows'", percent("n_outliers", "n_rows"), 5
    )


def insight_corr(p: Profile) -> DataFrame:
    return _pairs(p.pearson, "corr", "pearson_r", 0.5, 5)


def _high_cardinality(p: Profile) -> DataFrame:
    return p.distinct.where(f"n_unique > {HIGH_CARDINALITY} and column in ({p.names(CATEGORICAL)})")


def insight_high_card(p: Profile) -> DataFrame:
    return _ranked(_high_cardinality(p), "high_card", "position", "'n_unique'", "n_unique", 5)


def insight_imbalance(p: Profile) -> DataFrame:
    varied = p.distinct.where(f"n_unique > 1 and column in ({p.names(CATEGORICAL, BOOLEAN)})")
    first = p.tops.where("rank = 1").select("position", "value", "cnt")
    heavy = varied.join(first, "position").where("cnt / n_rows > 0.8")
    return _ranked(heavy, "imbalance", "position", "value", "cnt / n_rows", 5)


def insight_id_like(p: Profile) -> DataFrame:
    return _ranked(p.identifiers, "id_like", "position", "reason", "null", 5)


def insight_quality(p: Profile) -> DataFrame:
    return _ranked(p.issues, "quality", "position, check_order", "check", "hits", 5)


def insight_pii(p: Profile) -> DataFrame:
    return _ranked(p.pii, "pii", "cnt desc, column", "label", "cnt", 5)


def insight_empty_rows(p: Profile) -> DataFrame:
    found = p.empty.where("fully_empty_rows > 0")
    return _ranked(found, "empty_rows", "fully_empty_rows", "'fully_empty_rows'", "fully_empty_rows", a="null")


def insight_time_span(p: Profile) -> DataFrame:
    spans = p.spans.where("span_days > 0")
    return _ranked(spans, "time_span", "position", "concat(min, ' → ', max)", "span_days", 3)


def insight_nonlinear(p: Profile) -> DataFrame:
    """Strong by rank, weak (under 0.3, or not listed) by value."""
    pair = "least(col_a, col_b) as lo", "greatest(col_a, col_b) as hi"
    ranks = p.spearman.where("abs(spearman_r) >= 0.5").selectExpr("*", *pair)
    values = p.pearson.selectExpr(*pair, "abs(pearson_r) as r")
    found = ranks.join(values, ["lo", "hi"], "left").where("coalesce(r, 0D) < 0.3")
    return _ranked(found, "nonlinear", "abs(spearman_r) desc, col_a, col_b", "'spearman_r'", "spearman_r", 5, "col_a", "col_b")


def insight_assoc(p: Profile) -> DataFrame:
    return _pairs(p.associations, "assoc", "cramers_v", 0.5, 5)


def insight_group_effect(p: Profile) -> DataFrame:
    """Two rows per pair, the smallest and the largest listed mean of the three widest."""
    listed = p.effects.where("spread >= 0.5D and rank <= 3")
    ends = grouped(listed, ["rank", "category", "numeric"], low="min(mean)", high="max(mean)").selectExpr(
        "rank as at",
        "category",
        "numeric",
        "inline(array(struct('min_mean' as fact, low as v), struct('max_mean' as fact, high as v)))",
    )
    return _ranked(ends, "group_effect", "at, fact desc", "fact", "v", a="numeric", b="category")


# -- recommendations -----------------------------------------------------------


def rec_dedup(p: Profile) -> DataFrame:
    found = p.duplicates.where("duplicate_rows > 0")
    return _ranked(found, "dedup", "duplicate_rows", "'duplicate_rows'", "duplicate_rows", a="null")


def rec_pii(p: Profile) -> DataFrame:
    return _ranked(p.pii, "pii", "cnt desc, column", "label", "cnt", 5)


def rec_drop_missing(p: Profile) -> DataFrame:
    worst = _ranked(p.missing.where("n_missing > 0"), "drop_missing", "pct_missing desc, position", "'pct_missing'", "pct_missing", 10)
    return worst.where("value > 30")


def rec_transform(p: Profile) -> DataFrame:
    return _ranked(p.moments.where("abs(skew) >= 1"), "transform", "position", "'skew'", "skew", 6)


def rec_collinear(p: Profile) -> DataFrame:
    return _pairs(p.pearson, "collinear", "pearson_r", 0.8, 4)


def rec_constant(p: Profile) -> DataFrame:
    return _ranked(p.distinct.where("n_unique <= 1"), "constant", "position", "'n_unique'", "n_unique")


def rec_empty_rows(p: Profile) -> DataFrame:
    found = p.empty.where("fully_empty_rows > 0")
    return _ranked(found, "empty_rows", "fully_empty_rows", "'fully_empty_rows'", "fully_empty_rows", a="null")


def rec_quality(p: Profile) -> DataFrame:
    """The first column of each check, with the advice for the check."""
    first = first_k(p.issues, "check", "position", 1).drop("rank")
    advice = " ".join(f"when '{check}' then '{text}'" for check, text in CHECK_ADVICE)
    return _ranked(first, "quality", "position, check_order", f"concat(check, ': ', case check {advice} end)", "hits")


def rec_id_like(p: Profile) -> DataFrame:
    return _ranked(p.identifiers, "id_like", "position", "reason", "null", 4)


def rec_high_card(p: Profile) -> DataFrame:
    return _ranked(_high_cardinality(p), "high_card", "position", "'n_unique'", "n_unique", 4)


def rec_redundant(p: Profile) -> DataFrame:
    return _pairs(p.associations, "redundant", "cramers_v", 0.8, 4)


def rec_group_level(p: Profile) -> DataFrame:
    wide = p.effects.where("spread >= 1.5D and group_rank = 1").withColumnRenamed("rank", "at")
    return _ranked(wide, "group_level", "at", "'spread'", "spread", 3, "numeric", "category")


INSIGHTS: tuple[Rule, ...] = (
    insight_shape,
    insight_missing,
    insight_constant,
    insight_skew,
    insight_outliers,
    insight_corr,
    insight_high_card,
    insight_imbalance,
    insight_id_like,
    insight_quality,
    insight_pii,
    insight_empty_rows,
    insight_time_span,
    insight_nonlinear,
    insight_assoc,
    insight_group_effect,
)
RECOMMENDATIONS: tuple[Rule, ...] = (
    rec_dedup,
    rec_pii,
    rec_drop_missing,
    rec_transform,
    rec_collinear,
    rec_constant,
    rec_empty_rows,
    rec_quality,
    rec_id_like,
    rec_high_card,
    rec_redundant,
    rec_group_level,
)


def rec_clean(p: Profile) -> DataFrame:
    """One row when no recommendation applies."""
    return _recommended(p).where("rule = 'clean'")


def _recommended(p: Profile) -> DataFrame:
    """Every recommendation that applies, else the 'clean' row."""
    clean = _ranked(p.shape, "clean", "n_rows", "'recommendations'", "0", a="null")
    rows = union_all([*[rule(p) for rule in RECOMMENDATIONS], clean])  # a few rows per rule
    fired = rows.selectExpr("*", "count_if(rule != 'clean') over (partition by 0) as fired")
    return fired.where("rule != 'clean' or fired = 0").drop("fired")


def insights(table: DataFrame | Profile) -> DataFrame:
    p = table if isinstance(table, Profile) else Profile(table, keep=True)
    return union_all(rule(p) for rule in INSIGHTS)


def recommendations(table: DataFrame | Profile) -> DataFrame:
    """All that apply, or the single 'clean' row."""
    return _recommended(table if isinstance(table, Profile) else Profile(table, keep=True))
