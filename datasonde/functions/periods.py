"""Calendar periods and their labels, as SQL."""

from __future__ import annotations

UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def period_start(sql: str, freq: str) -> str:
    """First instant of the calendar period; weeks start on Monday."""
    return f"cast(date_trunc('{UNITS[freq]}', cast({sql} as timestamp_ntz)) as timestamp_ntz)"


def period_label(start: str, freq: str) -> str:
    if freq == "W":
        sunday = f"date_format({start} + interval 6 days, 'yyyy-MM-dd')"
        return f"concat(date_format({start}, 'yyyy-MM-dd'), '/', {sunday})"
    if freq == "Q":
        return f"concat(date_format({start}, 'yyyy'), 'Q', quarter({start}))"
    return f"date_format({start}, '{ {'D': 'yyyy-MM-dd', 'M': 'yyyy-MM', 'Y': 'yyyy'}[freq] }')"
