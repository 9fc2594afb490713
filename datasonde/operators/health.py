"""Health score: four weighted components of 0..100, a grade and a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.functions.fixed_values import (
    CONSISTENCY_CHECKS,
    HEALTH_DEDUCTION,
    HEALTH_GRADES,
    HEALTH_WEIGHTS,
    VALIDITY_CHECKS,
)
from datasonde.functions.values import grouped, union_all
from datasonde.operators.columns import missing_counts
from datasonde.operators.quality import quality_issues
from datasonde.operators.table import constant_columns, duplicate_rows


def _component(name: str, lost: str) -> list[str]:
    return [f"'{name}' as component", f"least(100D, greatest(0D, 100D - ({lost}))) as score"]


def completeness(missing: DataFrame) -> DataFrame:
    """100 minus the mean of average and worst column missingness (pct_missing, 2 decimals)."""
    pct = "coalesce(pct_missing, 0D)"
    return missing.selectExpr(*_component("completeness", f"(avg({pct}) + max({pct})) / 2"))


def uniqueness(duplicates: DataFrame) -> DataFrame:
    """100 minus the share of duplicate rows."""
    return duplicates.selectExpr(*_component("uniqueness", "coalesce(try_divide(duplicate_rows * 100D, n_rows), 0D)"))


def _flagged(issues: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    listed = ", ".join(f"'{c}'" for c in checks)
    return issues.where(f"check in ({listed})").select("column").distinct()


def consistency(issues: DataFrame, constants: DataFrame) -> DataFrame:
    """15 points off per column with whitespace or mixed case, and per constant column."""
    penalties = _flagged(issues, CONSISTENCY_CHECKS).unionByName(constants.select("column"))
    return penalties.selectExpr(*_component("consistency", f"count(*) * {HEALTH_DEDUCTION}D"))


def validity(issues: DataFrame) -> DataFrame:
    """15 points off per column holding numbers or dates as text, or placeholders."""
    return _flagged(issues, VALIDITY_CHECKS).selectExpr(*_component("validity", f"count(*) * {HEALTH_DEDUCTION}D"))


def health_score(df: DataFrame) -> DataFrame:
    """One row: score, grade, the rounded components and a verdict sentence."""
    return health_of(missing_counts(df), duplicate_rows(df), quality_issues(df), constant_columns(df), len(df.columns))


def health_of(
    missing: DataFrame, duplicates: DataFrame, issues: DataFrame, constants: DataFrame, n_columns: int
) -> DataFrame:
    """The health row from the profile tables it is made of.

    Every table is folded to one row of scores and cited counts in a single use, so none is
    computed twice; the rows are stacked and read off in one aggregate.
    """
    nothing = "cast(null as string)"

    def score(name: str, lost: str, label: str = nothing) -> str:
        return f"struct('{name}' as component, least(100D, greatest(0D, 100D - ({lost}))) as score, {label} as label)"

    def fact(name: str, value: str, label: str = nothing) -> str:
        return f"struct('{name}' as component, {value} as score, {label} as label)"

    worst = "min(if(pct_missing > 0, struct(-pct_missing as p, position, column), null)) as worst"
    gaps = missing.selectExpr("(avg(coalesce(pct_missing, 0D)) + max(coalesce(pct_missing, 0D))) / 2 as lost", worst)
    repeats = duplicates.selectExpr("coalesce(try_divide(duplicate_rows * 100D, n_rows), 0D) as lost", "double(duplicate_rows) as cnt")
    listed = {name: ", ".join(f"'{c}'" for c in checks) for name, checks in (("c", CONSISTENCY_CHECKS), ("v", VALIDITY_CHECKS))}
    marks = issues.selectExpr("column", f"check in ({listed['c']}) as c", f"check in ({listed['v']}) as v", "true as issue")
    marks = marks.unionByName(constants.selectExpr("column", "false as c", "false as v", "false as issue").withColumn("constant", F.lit(True)), True)
    by_column = grouped(marks, ["column"], c="int(max(c))", v="int(max(v))", issue="int(max(issue))", constant="int(max(coalesce(constant, false)))")
    flags = by_column.selectExpr(*[f"coalesce(sum({c}), 0) as {c}" for c in ("c", "v", "issue", "constant")])
    stacked = [
        gaps.selectExpr(f"inline(array({score('completeness', 'lost')}, {fact('worst', '-worst.p', 'worst.column')}))"),
        repeats.selectExpr(f"inline(array({score('uniqueness', 'lost')}, {fact('duplicates', 'cnt')}))"),
        flags.selectExpr(
            f"inline(array({score('consistency', f'(c + constant) * {HEALTH_DEDUCTION}D')}, "
            f"{score('validity', f'v * {HEALTH_DEDUCTION}D')}, {fact('issues', 'double(issue)')}))"
        ),
    ]
    weight = " ".join(f"when '{c}' then {w}" for c, w in HEALTH_WEIGHTS)
    total = f"sum(score * case component {weight} end) / {sum(w for _, w in HEALTH_WEIGHTS)}D"
    one = "max(if(component = '{}', {}, null))".format
    grade = " ".join(f"when score >= {least} then '{letter}'" for least, letter in HEALTH_GRADES)
    components = [c for c, _ in HEALTH_WEIGHTS]
    return (
        union_all(stacked)
        .selectExpr(
            f"cast(bround({total}, 0) as bigint) as score",
            *[f"cast(bround({one(c, 'score')}, 0) as bigint) as {c}" for c in components],
            f"cast({one('duplicates', 'score')} as bigint) as dups",
            f"cast({one('issues', 'score')} as bigint) as issue_columns",
            f"{one('worst', 'score')} as worst_pct",
            f"{one('worst', 'label')} as worst_column",
        )
        .selectExpr("*", f"case {grade} else 'F' end as grade")
        .selectExpr("score", "grade", *components, f"{_verdict(n_columns)} as verdict")
    )


def _verdict(n_columns: int) -> str:
    """A sentence that cites only the counts that are not zero."""
    pct = r"regexp_replace(format_string('%.2f', worst_pct), r'\.?0+$', '')"
    clauses = (
        "concat_ws(', ', "
        "if(dups > 0, concat(format_number(dups, 0), ' duplicate row', if(dups = 1, '', 's')), null), "
        f"if(issue_columns > 0, concat(issue_columns, ' of {n_columns} columns with quality issues'), null), "
        f"if(worst_column is not null, concat('worst missingness `', worst_column, '` at ', {pct}, '%'), null))"
    )
    said = f"coalesce(nullif({clauses}, ''), 'no duplicates, missing values, or quality issues detected')"
    return f"concat('Grade ', grade, ' (', score, '/100): ', {said}, '.')"
