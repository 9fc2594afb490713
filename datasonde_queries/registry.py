"""The registered queries and, next to each, the same result as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL it is checked against."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def register(name: str, run: Query, sql: str | None = None) -> None:
    query(name, sql)(run)


def tidy(df: DataFrame, **digits: int) -> DataFrame:
    """Round result columns half-even, as ``round_even`` does in the SQL."""
    return df.withColumns({c: F.expr(f"bround(cast({c} as double), {d})") for c, d in digits.items()})


def each(template: str, **values) -> str:
    """``template`` once per value, as one UNION ALL."""
    (name, items), = values.items()
    return "\nunion all ".join(template.replace("{" + name + "}", str(v)) for v in items)
