"""Date windows as filters on the first datetime column of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datasonde.functions.kinds import DATETIME, names_of

PERIODS = ("day", "week", "month", "quarter", "year")


def date_window(
    df: DataFrame,
    kind: str,
    *,
    unit: str | None = None,
    days: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> list[dict]:
    """Filter leaves for one window; empty when the table has no datetime column.

    ``last_days`` (days), ``last_period`` (half open), ``this_period``,
    ``since_last``, ``since_this`` (unit; no upper bound), ``since``, ``after``,
    ``before`` (start), ``between`` (start and end, both included).
    """
    columns = names_of(df, DATETIME)
    if not columns:
        return []

    def leaf(op: str, value: str) -> dict:
        return {"op": op, "column": columns[0], "value": value}

    if unit is not None and unit not in PERIODS:
        raise ValueError(f"unknown period '{unit}'")
    if kind == "last_days":
        return [leaf(">=", f"@last_{int(days)}_days_start")]
    if kind == "last_period":
        return [leaf(">=", f"@last_{unit}_start"), leaf("<", f"@{unit}_start")]
    if kind in ("this_period", "since_this"):
        return [leaf(">=", f"@{unit}_start")]
    if kind == "since_last":
        return [leaf(">=", f"@last_{unit}_start")]
    if kind in ("since", "after", "before"):
        return [leaf({"since": ">=", "after": ">", "before": "<"}[kind], start)]
    if kind == "between":
        return [{"op": "between", "column": columns[0], "low": start, "high": end}]
    raise ValueError(f"unknown date window '{kind}'")


def conjunction(leaves: list[dict]) -> dict | None:
    """Leaves as the ``filters`` of a plan."""
    if len(leaves) > 1:
        return {"op": "and", "children": leaves}
    return leaves[0] if leaves else None
