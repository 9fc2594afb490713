"""Writing a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datasonde.functions.kinds import NUMERIC
from datasonde.functions.shared import kept
from datasonde.operators.columns import column_quantiles, column_summaries, column_types, outlier_columns, profiled
from datasonde.operators.findings import Profile, insights, recommendations
from datasonde.operators.frequency import modes
from datasonde.operators.health import health_of
from datasonde.operators.table import co_missing_pairs, sample_rows


def profile_tables(df: DataFrame, order_by: list[str] | None = None) -> dict[str, DataFrame]:
    """The profile of ``df`` as small tables by section, each computed once.

    ``order_by`` names a key in whose order the sample rows are the first; without one
    there is no sample, since the rows of a table have no order.
    """
    p = Profile(df, keep=True)
    constants = p.distinct.where("n_unique <= 1").select("column")
    numbers = [c.name for c in profiled(df, NUMERIC)]
    sample = {"sample": kept(sample_rows(df, order_by))} if order_by else {}
    return {
        "column_types": kept(column_types(df)),
        "summaries": kept(column_summaries(df)),
        "quantiles": kept(column_quantiles(df, numbers)),
        "modes": kept(modes(df, numbers)),
        "outlier_examples": kept(outlier_columns(df)),
        "empty_rows": p.empty,
        "co_missing": kept(co_missing_pairs(df)),
        **sample,
        "shape": p.shape,
        "duplicates": p.duplicates,
        "missing": p.missing,
        "distinct": p.distinct,
        "moments": p.moments,
        "outliers": p.outliers,
        "top_values": p.tops,
        "datetime_spans": p.spans,
        "pearson": p.pearson,
        "spearman": p.spearman,
        "cramers_v": p.associations,
        "category_effects": p.effects,
        "id_like": p.identifiers,
        "quality": p.issues,
        "pii": p.pii,
        "health": health_of(p.missing, p.duplicates, p.issues, constants, len(df.columns)),
        "insights": insights(p),
        "recommendations": recommendations(p),
    }


def write_profile(tables: dict[str, DataFrame], path: str, run_id: str, fmt: str = "json") -> list[str]:
    """Write each table under ``path/section/run_id=…``; a run never overwrites another.

    The sections are a few rows each, so every one is written as a single file.
    """
    written = []
    for section, table in tables.items():
        target = f"{path.rstrip('/')}/{section}/run_id={run_id}"
        table.coalesce(1).write.mode("errorifexists").format(fmt).save(target)
        written.append(target)
    return written
