"""Column kinds: how a Spark type is treated by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = "numeric"
BOOLEAN = "boolean"
DATETIME = "datetime"
CATEGORICAL = "categorical"
NESTED = "nested"
SCALAR_KINDS = (NUMERIC, BOOLEAN, DATETIME, CATEGORICAL)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    return NESTED


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.IntegralType)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def quoted(name: str) -> str:
    """A column name as it is written in SQL, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    position: int
    data_type: T.DataType

    @property
    def kind(self) -> str:
        return kind_of(self.data_type)

    @property
    def dtype(self) -> str:
        return self.data_type.simpleString()

    @property
    def value(self) -> str:
        """SQL of the column with NaN folded into null, the single notion of "missing"."""
        c = quoted(self.name)
        return f"if(isnan({c}), null, {c})" if is_floating(self.data_type) else c

    @property
    def number(self) -> str:
        """SQL of the value as a double."""
        return f"cast({self.value} as double)"


def column_infos(df: DataFrame, *kinds: str, names: list[str] | None = None) -> list[ColumnInfo]:
    """Columns of ``df`` in table order: all, or those of the kinds or names asked for."""
    infos = [ColumnInfo(f.name, i, f.dataType) for i, f in enumerate(df.schema.fields)]
    return [c for c in infos if (not kinds or c.kind in kinds) and (names is None or c.name in names)]


def column_info(df: DataFrame, name: str) -> ColumnInfo:
    return next(c for c in column_infos(df) if c.name == name)


def names_of(df: DataFrame, *kinds: str) -> list[str]:
    return [c.name for c in column_infos(df, *kinds)]
