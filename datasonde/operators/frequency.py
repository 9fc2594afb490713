"""Value-frequency tables: each distinct value of each column with its count.

Columns of one type are unpivoted and aggregated together, so a profile needs one
shuffle per type rather than one per column, and a value held by a large share of
the rows is folded into one row before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasonde.functions.kinds import SCALAR_KINDS, column_infos, is_floating, is_integral, names_of, text_literal
from datasonde.functions.shared import stored
from datasonde.functions.values import KEY_BYTES, as_text, grouped, is_long, text_key, union_all


# The number of an unpivoted column. Never null, so that Spark adds no null filter to
# one use of a frequency table and computes it twice.
POSITION = "coalesce(cast(position as int), -1)"


def value_type(data_type: T.DataType) -> T.DataType:
    """The type under which values of ``data_type`` are counted, without loss."""
    if is_integral(data_type):
        return T.LongType()
    if is_floating(data_type):
        return T.DoubleType()
    if isinstance(data_type, (T.CharType, T.VarcharType)):
        return T.StringType()
    return data_type


def no_columns(df: DataFrame, data_type: T.DataType) -> DataFrame:
    """A stand-in with one empty column, for tables lacking a kind of column."""
    return df.selectExpr(f"cast(null as {data_type.simpleString()}) as none").limit(0)


def families(df: DataFrame, names: Iterable[str]) -> dict[T.DataType, list[str]]:
    """Columns grouped by the type under which their values are counted."""
    groups: dict[T.DataType, list[str]] = {}
    for c in column_infos(df, names=list(names)):
        groups.setdefault(value_type(c.data_type), []).append(c.name)
    return groups


def unpivot_values(df: DataFrame, names: list[str], data_type: T.DataType) -> DataFrame:
    """Rows (position, value) of equally typed columns; NaN is null.

    The column travels as its number: eight bytes in every shuffled row, not its name.
    """
    target = data_type.simpleString()
    infos = column_infos(df, names=names)
    narrowed = df.selectExpr(*[f"cast({c.value} as {target}) as `{c.position}`" for c in infos])
    cells = narrowed.unpivot([], [f"`{c.position}`" for c in infos], "position", "value")
    return cells.selectExpr(f"{POSITION} as position", "value")


def named(df: DataFrame, by_position: DataFrame) -> DataFrame:
    """Put the column's name next to its position."""
    listed = f"array({', '.join(text_literal(n) for n in df.columns)})"
    return by_position.selectExpr("position", f"element_at({listed}, position + 1) as column", "* except (position)")


def frequencies(df: DataFrame, names: list[str], data_type: T.DataType) -> DataFrame:
    """(position, value, cnt), nulls included as one row per column that has any.

    Long texts are represented by their key.
    """
    cells = unpivot_values(df, names, data_type)
    if isinstance(data_type, T.StringType):
        cells = cells.selectExpr("position", f"{text_key('value')} as value")
    return grouped(cells, ["position", "value"], cnt="count(*)")


def distinct_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(position, column, n_unique, n_missing, n_rows) of every scalar column."""
    names = names if names is not None else names_of(df, *SCALAR_KINDS)
    if not names:
        df, names = no_columns(df, T.StringType()), ["none"]
    counted = union_all(
        grouped(
            frequencies(df, cols, dt),
            ["position"],
            n_unique="count(value)",
            n_missing="sum(if(value is null, cnt, 0))",
            n_rows="sum(cnt)",
        )
        for dt, cols in families(df, names).items()
    )
    return named(df, counted)


def numeric_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """(position, value double, cnt) of numeric columns, nulls left out."""
    if not names:
        df, names = no_columns(df, T.DoubleType()), ["none"]
    return union_all(
        frequencies(df, cols, dt).where("value is not null").selectExpr("position", "cast(value as double) as value", "cnt")
        for dt, cols in families(df, names).items()
    )


def modes(df: DataFrame, names: list[str]) -> DataFrame:
    """(position, column, mode): the smallest of the most frequent values."""
    return named(df, grouped(numeric_frequencies(df, names), ["position"], mode="min(struct(-cnt, value)).value"))


def first_k(df: DataFrame, keys: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows per key; a bare row-number filter, so Spark trims every
    task's rows to ``k`` per key before the shuffle."""
    ranked = df.withColumn("rank", F.expr(f"row_number() over (partition by {keys} order by {order})"))
    return ranked.where(f"rank <= {k}")


def top_values(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """(position, column, rank, value, cnt): most frequent values as text, ties by text."""
    if not names:
        df, names = no_columns(df, T.BooleanType()), ["none"]
    parts = []
    for data_type, cols in families(df, names).items():
        counted = frequencies(df, cols, data_type).where("value is not null")
        shown = counted.selectExpr("position", f"{as_text('value', data_type)} as value", "cnt")
        if isinstance(data_type, T.StringType):
            best = top_texts(df, cols, shown, k) if holds_long_texts(df, cols) else first_k(shown, "position", "cnt desc, value", k)
        else:
            best = first_k(shown, "position", "cnt desc, value", k)
        parts.append(best.selectExpr("position", "cast(rank as bigint) as rank", "value", "cnt"))
    return named(df, union_all(parts))


# Characters by which prefixes of tied texts grow, and how far they are followed before whole texts decide.
PREFIX_STEPS = (KEY_BYTES, 1024, 8192, 65_536)


def holds_long_texts(df: DataFrame, cols: list[str]) -> bool:
    """Whether any text is longer than its key; one scan of the columns."""
    longest = df.selectExpr(*[f"max({is_long(c.value)}) as m{c.position}" for c in column_infos(df, names=cols)])
    return any(longest.first())


def top_texts(df: DataFrame, cols: list[str], counted: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows (position, rank, value, cnt) per column, by count and whole text.

    ``counted`` holds keys, which order by their first characters. Rows that are surely among the
    first, or surely not, are settled by a prefix; only those that share the prefix of the k-th
    go on, with a longer prefix of the text, and only if there are more of them than places.
    A step looks at prefixes folded with their numbers, so a column of texts with one long head
    brings a row a prefix, not a row a text, to any task.
    """
    head = f"left(value, {PREFIX_STEPS[0]})"
    open_ = stored(counted).selectExpr("position", "value", "cnt", f"{head} as prefix", f"cast({k} as bigint) as places")
    settled = []
    for step, size in enumerate(PREFIX_STEPS):
        if step:
            open_ = stored(open_.drop("prefix").join(_heads(df, cols, open_, size), ["position", "value"]))
        # counts of equal (cnt, prefix), of which only those that may hold one of the first places leave a task
        folded = grouped(open_, ["position", "places", "cnt", "prefix"], n="count(*)")
        near = first_k(folded, "position", "cnt desc, prefix", k).drop("rank")
        before = near.selectExpr("*", "coalesce(sum(n) over (partition by position order by cnt desc, prefix rows between unbounded preceding and 1 preceding), 0L) as before")
        judged = before.where("before < places").selectExpr("position", "cnt", "prefix", "places - before as room", "n")
        rows = open_.drop("places").join(F.broadcast(judged), ["position", "cnt", "prefix"])  # k rows a column
        rows = stored(rows)
        settled.append(rows.where("n <= room").select("position", "value", "cnt"))
        open_ = rows.where("n > room").selectExpr("position", "value", "cnt", "prefix", "room as places")
        if open_.isEmpty():
            break
    else:
        settled.append(open_.select("position", "value", "cnt"))  # alike for so long that whole texts have to decide
    best = whole_texts(df, cols, union_all(settled))
    return first_k(best, "position", "cnt desc, value", k)


def _heads(df: DataFrame, cols: list[str], keys: DataFrame, size: int) -> DataFrame:
    """(position, value, prefix): the first ``size`` characters of the texts that the keys stand for."""
    wanted = keys.selectExpr("position", "value")
    cells = unpivot_values(df, cols, T.StringType()).selectExpr("position", f"left(value, {size}) as prefix", f"{text_key('value')} as value")
    return grouped(cells.join(wanted, ["position", "value"], "left_semi"), ["position", "value"], prefix="any_value(prefix)")


def whole_texts(df: DataFrame, cols: list[str], best: DataFrame) -> DataFrame:
    """Replace the keys of long texts by the texts. As many as tie are joined, by key."""
    wanted = best.where(is_long("value")).selectExpr("position", "value as key")
    cells = unpivot_values(df, cols, T.StringType()).where(is_long("value"))
    keyed = cells.selectExpr("position", "value as whole", f"{text_key('value')} as key")
    texts = grouped(keyed.join(wanted, ["position", "key"]), ["position", "key"], whole="any_value(whole)")
    texts = texts.withColumnRenamed("key", "value")
    return best.join(texts, ["position", "value"], "left").withColumn("value", F.expr("coalesce(whole, value)")).drop("whole")


def first_texts(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(position, rank, value): the first ``k`` distinct texts of each column, in the order of whole texts.

    Texts are folded in the tasks, so repeats never travel, and every task passes on only its
    first ``k`` of a column.
    """
    cells = unpivot_values(df, cols, T.StringType()).where("value is not null")
    return first_k(cells.distinct(), "position", "value", k)
