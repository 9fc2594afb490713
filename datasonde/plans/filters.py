"""Filter trees as Spark predicates.

Every leaf is two-valued: a missing value fails ``= < <= > >= in between`` and
passes ``!=`` and ``not in``. In a conjunction at the top of a WHERE, "unknown"
and "false" reject a row alike, so those leaves stay bare comparisons there and
reach the Parquet reader; below OR and NOT they are made two-valued explicitly.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

from datasonde.functions.kinds import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    is_floating,
    is_integral,
    kind_of,
    quoted,
    text_literal,
)
from datasonde.functions.values import number_literal
from datasonde.plans.dates import instant, wall_clock

TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")


def predicate(node: dict, schema: T.StructType, tz: str = "UTC", now: datetime | None = None) -> str:
    """The tree as SQL for a WHERE clause."""
    return _where(node, _Leaves(schema, tz, now))


def _where(node: dict, leaves: _Leaves) -> str:
    if node["op"] == "and":
        return " and ".join(f"({_where(kid, leaves)})" for kid in node["children"])
    return _exact(node, leaves) if node["op"] in ("or", "not") else leaves.sql(node)


def _exact(node: dict, leaves: _Leaves) -> str:
    op = node["op"]
    if op in ("and", "or"):
        return f" {op} ".join(f"({_exact(kid, leaves)})" for kid in node["children"])
    if op == "not":
        return f"not ({_exact(node['child'], leaves)})"
    sql = leaves.sql(node)
    return sql if op in ("is null", "not null", "!=", "not in") else f"coalesce({sql}, false)"


class _Leaves:
    """Turns leaves into SQL; the result may be null only for a missing value."""

    def __init__(self, schema: T.StructType, tz: str, now: datetime | None):
        self.schema, self.tz, self.now = schema, tz, now

    def sql(self, node: dict) -> str:
        op, column = node["op"], node["column"]
        data_type = self.schema[column].dataType
        c, nan = quoted(column), is_floating(data_type)
        if op == "is null":
            return f"({c} is null or isnan({c}))" if nan else f"{c} is null"
        if op == "not null":
            return f"({c} is not null and not isnan({c}))" if nan else f"{c} is not null"
        if op in ("in", "not in"):
            listed = ", ".join(self.literal(v, data_type) for v in node["values"])
            return f"{c} in ({listed})" if op == "in" else f"({c} is null or {c} not in ({listed}))"
        if op == "between":
            low, high = self.literal(node["low"], data_type), self.literal(node["high"], data_type)
            return f"({c} >= {low} and {c} <= {high})"
        value = self.literal(node["value"], data_type)
        if op == "!=":
            return f"({c} is null or {c} != {value})"
        # Spark sorts NaN above every number; here it is a missing value
        guard = f" and not isnan({c})" if nan and op in (">", ">=") else ""
        return f"({c} {op} {value}{guard})"

    def literal(self, value: object, data_type: T.DataType) -> str:
        kind = kind_of(data_type)
        if kind == DATETIME:
            if isinstance(data_type, T.TimestampType):
                at = instant(value, self.tz, self.now)
                return f"timestamp_ltz'{at:%Y-%m-%d %H:%M:%S.%f}+00:00'"
            at = wall_clock(value, self.tz, self.now)
            if isinstance(data_type, T.DateType) and at == at.replace(hour=0, minute=0, second=0, microsecond=0):
                return f"date'{at:%Y-%m-%d}'"
            return f"timestamp_ntz'{at:%Y-%m-%d %H:%M:%S.%f}'"
        if kind == BOOLEAN:
            return str(boolean_literal(value)).lower()
        if kind == NUMERIC:
            if isinstance(value, int):
                return str(value)
            whole = is_integral(data_type) and value == value and abs(value) < 2**53 and value == int(value)
            return str(int(value)) if whole else number_literal(value)
        return text_literal(value if isinstance(value, str) else str(value))


def boolean_literal(value: object) -> bool:
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    if word in TRUE_WORDS or word in FALSE_WORDS:
        return word in TRUE_WORDS
    raise ValueError(f"{value!r} is not boolean")
