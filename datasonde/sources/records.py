"""Records of CSV text whose quoted cells hold line breaks, read from all splits at once.

Whether a line starts inside a quoted cell depends on all lines before it, but each line only
leaves that state as it is, turns it, or ends it. Such steps compose, so every split of a file
is folded by itself, for either state it may start in; one row per split then gives each split
its true state by a running total. Lines are sorted within their split, which is never longer than
a task's share of the file; only those of records of several lines meet again by their record.
Lines end in ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A quote opens a cell only at its start; elsewhere, outside of quotes, it is a character.
OPENER = '(^|,)"'
FULL = r"[^\\x00-\\x20]"
IN_SPLIT = "partition by file, block order by at"
SO_FAR = f"{IN_SPLIT} rows between unbounded preceding and current row"
SPLITS_SO_FAR = "partition by file order by block rows between unbounded preceding and current row"
SPLITS_BEFORE = "partition by file order by block rows between unbounded preceding and 1 preceding"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the state after each, for a split that starts outside (0) or inside (1) of quotes.

    An odd number of quotes turns the state, or, without an opener among them, ends a cell.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.selectExpr("_metadata.file_path as file", "_metadata.file_block_start as block", "monotonically_increasing_id() as at", "value")
    odd = "(length(value) - length(replace(value, '\"', ''))) % 2 = 1"
    opener = f"value rlike '{OPENER}'"
    rows = rows.selectExpr("*", f"if({odd} and {opener}, 1, 0) as turn", f"{odd} and not ({opener}) as ends")
    rows = rows.selectExpr("*", f"sum(turn) over ({SO_FAR}) as turns", f"sum(if(value rlike '{FULL}', 1, 0)) over ({SO_FAR}) as seen")
    # turns never fall, so their maximum over the lines that end a cell is the one at the last of them
    rows = rows.selectExpr("*", f"max(if(ends, turns, null)) over ({SO_FAR}) as base")
    rows = rows.selectExpr("*", "(turns - coalesce(base, 0)) % 2 as after0", "(turns - coalesce(base, -1)) % 2 as after1")
    rows = rows.selectExpr("*", *[f"lag(after{s}, 1, {s}L) over ({IN_SPLIT}) as before{s}" for s in (0, 1)])
    return rows.selectExpr("*", *[f"sum(if(before{s} = 0 and after{s} = 1, 1, 0)) over ({SO_FAR}) as opened{s}" for s in (0, 1)])


def _splits(lines: DataFrame) -> DataFrame:
    """A row per split: the state it starts and ends in, and the cells opened in its file before it."""
    rows = lines.groupBy("file", "block").agg(*[F.max(c).alias(c) for c in ("turns", "base", "opened0", "opened1")])
    rows = rows.selectExpr("*", f"sum(turns) over ({SPLITS_SO_FAR}) as total")
    rows = rows.selectExpr("*", f"max(total - turns + base) over ({SPLITS_SO_FAR}) as last_end")
    rows = rows.selectExpr("*", "(total - coalesce(last_end, 0)) % 2 as closes_in")
    rows = rows.selectExpr("*", "lag(closes_in, 1, 0L) over (partition by file order by block) as starts_in")
    opened = f"coalesce(sum(if(starts_in = 0, opened0, opened1)) over ({SPLITS_BEFORE}), 0) as opened_before"
    return rows.selectExpr("file", "block", "starts_in", "closes_in", opened)


def unclosed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of files that end inside a quoted cell."""
    last = _splits(_lines(spark, path)).groupBy("file").agg(F.max_by("closes_in", "block").alias("closes_in"))
    return last.where("closes_in = 1").select("file")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of the data below each file's header, line breaks inside quotes kept as they are.

    Blank lines between records are left out. A quote in an unquoted cell is a character unless its
    line has both an odd number of quotes and a quoted cell.
    """
    lines = _lines(spark, path)
    splits = _splits(lines)
    rows = lines.join(splits, ["file", "block"])
    states = [f"if(starts_in = 0, {c}0, {c}1) as {c}" for c in ("before", "after", "opened")]
    header = f"block = 0 and seen = 1 and value rlike '{FULL}' as header"
    rows = rows.selectExpr("file", "block", "at", "value", "opened_before", header, *states)
    single = rows.where(f"before = 0 and after = 0 and not header and value rlike '{FULL}'").selectExpr("value as record")
    parts = rows.where("before = 1 or after = 1").selectExpr("file", "opened_before + opened as cell", "header", "struct(block, at, value) as part")
    joined = parts.groupBy("file", "cell").agg(F.max("header").alias("header"), F.collect_list("part").alias("parts"))
    joined = joined.where("not header").selectExpr("array_join(transform(array_sort(parts), p -> p.value), '\\n') as record")
    return single.unionByName(joined).selectExpr("trim(trailing '\\r' from record) as record")
