"""SQL expressions shared by the operators: text, rounding, parsing.

Expressions are built as SQL text: a profile of a wide table needs hundreds of
them, and one parsed string costs far less than a chain of Column calls.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasonde.functions.fixed_values import (
    DATE_FORMATS,
    ISO_OFFSET_PATTERN,
    ISO_PATTERN,
    NUMBER_PATTERN,
    SENTINEL_STRINGS,
    WHITESPACE,
)
from datasonde.functions.kinds import BOOLEAN, DATETIME, is_floating, kind_of, text_literal

# Texts of more bytes than this are compared through a SHA-256 digest (see text_key).
KEY_BYTES = 128


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def grouped(df: DataFrame, keys: list[str], **measures: str) -> DataFrame:
    """``df`` grouped by ``keys`` with aggregates given as SQL."""
    return df.groupBy(*keys).agg(*[F.expr(f"{sql} as {name}") for name, sql in measures.items()])


def number_literal(x: float) -> str:
    if x != x or abs(x) == float("inf"):
        return f"double('{x}')"
    return f"{float(x)!r}D"


def finite(sql: str) -> str:
    """Null instead of an infinite value or NaN."""
    return f"if(abs({sql}) < double('Infinity'), {sql}, null)"


def rounded(sql: str, digits: int) -> str:
    """Half-even rounding of a double."""
    return f"bround(cast({sql} as double), {digits})"


def percent(part: str, whole: str, digits: int = 2) -> str:
    return rounded(f"try_divide(({part}) * 100.0D, {whole})", digits)


def strip(sql: str) -> str:
    """Remove Unicode whitespace at both ends (plain ``trim`` only removes spaces).

    Only the ends of a text are looked at, however long it is.
    """
    listed = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
    return f"trim(both '{listed}' from {sql})"


def as_text(sql: str, data_type: T.DataType) -> str:
    """A value as the text shown in results."""
    kind = kind_of(data_type)
    if kind == BOOLEAN:
        return f"case when {sql} then 'True' when not {sql} then 'False' end"
    if kind == DATETIME:
        return datetime_text(sql)
    if is_floating(data_type):
        d = f"cast({sql} as double)"
        whole = f"concat(cast(cast({d} as bigint) as string), '.0')"
        return f"if(abs({d}) < 1e15D and {d} = floor({d}), {whole}, cast({d} as string))"
    return f"cast({sql} as string)"


def datetime_text(sql: str) -> str:
    """``yyyy-MM-dd HH:mm:ss`` with six fractional digits when there are any."""
    ts = f"cast({sql} as timestamp_ntz)"
    return (
        f"regexp_replace(date_format({ts}, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), r'\\.000000$', '')"
    )


def text_key(sql: str) -> str:
    """An equality-preserving, bounded stand-in for a text of any length.

    Short texts stand for themselves. A longer one becomes its first characters
    followed by the SHA-256 of the whole text, so a shuffle by value moves a
    bounded number of bytes per text however long the documents are.
    """
    digest = f"concat(left({sql}, {KEY_BYTES}), sha2({sql}, 256))"
    return f"if({is_long(sql)}, {digest}, {sql})"


def is_long(sql: str) -> str:
    """Whether a text, or equally its key, is longer than the texts standing for themselves."""
    return f"octet_length({sql}) > {KEY_BYTES}"


def looks_numeric(stripped: str) -> str:
    # the first character settles it for most texts, without reading the rest
    return f"({stripped} rlike r'^[+\\-.,\\diI]' and replace({stripped}, ',', '') rlike r'{NUMBER_PATTERN}')"


def is_sentinel(stripped: str) -> str:
    # lowercasing shrinks a character to no less than a third of its bytes
    most = 3 * max(len(s) for s in SENTINEL_STRINGS)
    listed = ", ".join(text_literal(s) for s in SENTINEL_STRINGS)
    return f"(octet_length({stripped}) <= {most} and lower({stripped}) in ({listed}))"


def iso_timestamp(text: str) -> str:
    """ISO 8601 text as a wall-clock timestamp, null where it does not parse."""
    dashed = rf"regexp_replace({text}, r'^(\d{{4}})(\d{{2}})(\d{{2}})', '$1-$2-$3')"
    seconds = rf"regexp_replace({dashed}, r'T(\d{{2}})(\d{{2}})(\d{{2}})', 'T$1:$2:$3')"
    minutes = rf"regexp_replace({seconds}, r'T(\d{{2}})(\d{{2}})(?=$|Z|[+-])', 'T$1:$2')"
    return f"if({text} rlike r'{ISO_PATTERN}', try_cast({minutes} as timestamp_ntz), null)"


def iso_instant(text: str) -> str:
    """ISO 8601 text that carries a UTC offset as an instant."""
    return (
        f"if({text} rlike r'{ISO_PATTERN}' and {text} rlike r'{ISO_OFFSET_PATTERN}', "
        f"try_cast({text} as timestamp), null)"
    )


def iso_offset(text: str) -> str:
    """The UTC offset written in ISO text, '' when there is none."""
    return f"regexp_extract({text}, r'{ISO_OFFSET_PATTERN}', 1)"


def looks_like_date(stripped: str) -> str:
    """True when the text is a date in ISO 8601 or one of the fixed layouts."""
    tests = [f"{iso_timestamp(stripped)} is not null"] + [
        f"({stripped} rlike r'{shape}' and try_to_timestamp({stripped}, '{layout}') is not null)"
        for layout, shape in DATE_FORMATS
    ]
    return f"(octet_length({stripped}) between 4 and 40 and ({' or '.join(tests)}))"
