"""Reading tables: files, missing tokens, inferred types, guards, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasonde.functions.fixed_values import CSV_MISSING_TOKENS
from datasonde.functions.kinds import CATEGORICAL, column_infos, quoted, text_literal
from datasonde.functions.values import iso_instant, iso_offset, iso_timestamp
from datasonde.operators.columns import per_column
from datasonde.sources.records import csv_records, unclosed_files


class LoadError(Exception):
    """The input cannot become a table."""


# Where the cells beyond the header's are put, and what no cell is: empty cells stay empty texts.
SURPLUS = "__surplus"
NOT_A_CELL = "\u0001"
WHOLE = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file or directory with a header row.

    Every cell is read as text, the missing tokens become null, and each column then takes
    the narrowest type that holds all of its values without loss: 64-bit integers, integers
    of up to 38 digits, doubles, booleans or text. One pass over the data decides for all.

    Quoted cells may hold line breaks: splits are read in parallel all the same, see
    :mod:`datasonde.sources.records`. ``multi_line`` reads each file in one task instead, which also
    takes stray quotes beside quoted cells. Rows with a value beyond the cells of the header are an
    error, and so is a file that ends inside a quoted cell. Rows with fewer cells end in missing values.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "nullValue": NOT_A_CELL}
    try:
        # Only the first record is read for the names, whatever the size of the file.
        names = spark.read.csv(path, inferSchema=False, **{**options, "multiLine": True}).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])
        read = spark.read.schema(schema).csv(path, enforceSchema=True, **options) if names else None
    except Exception as problem:
        raise LoadError(f"could not load '{path}': {problem}") from problem
    if read is None:
        return spark.read.csv(path, inferSchema=False, **options)
    if not multi_line:
        quotes = "length(value) - length(replace(value, '\"', ''))"
        torn = spark.read.text(path).where(f"value rlike '(^|,)\\\\s*\"' and ({quotes}) % 2 = 1")
        if not torn.isEmpty():
            if not unclosed_files(spark, path).isEmpty():
                raise LoadError(f"'{path}' ends inside a quoted cell")
            ddl = ", ".join(f"{quoted(n)} string" for n in schema.names)
            cells = F.from_csv("record", ddl, {"escape": '"', "nullValue": NOT_A_CELL})
            read = csv_records(spark, path).select(cells.alias("cells")).select("cells.*")
    tokens = ", ".join(text_literal(t) for t in CSV_MISSING_TOKENS)
    blanked = read.selectExpr(*[f"if({quoted(c)} in ({tokens}), null, {quoted(c)}) as {quoted(c)}" for c in names], SURPLUS)

    def parses(c) -> dict[str, str]:
        v = quoted(c.name)
        whole = f"{v} rlike r'{WHOLE}'"
        return {
            "n": f"count({v})",
            "long": f"count(if({whole}, try_cast(trim({v}) as bigint), null))",
            "wide": f"count(if({whole}, try_cast(trim({v}) as decimal(38,0)), null))",
            "number": f"count(if({v} rlike r'{NUMBER}', 1, null))",
            "truth": f"count_if({v} in ('True', 'False', 'true', 'false', 'TRUE', 'FALSE'))",
        }

    counts = {r["column"]: r for r in per_column(blanked, column_infos(blanked), parses).collect()}  # one row per column
    surplus = counts[SURPLUS]["n"]
    if surplus:
        raise LoadError(f"'{path}' has {surplus} row(s) with more cells than the {len(names)} of the header")

    def typed(name: str) -> str:
        found, v = counts[name], quoted(name)
        if found["n"] == 0 or found["n"] == found["number"]:
            target = next((t for t, k in (("bigint", "long"), ("decimal(38,0)", "wide")) if found["n"] and found[k] == found["n"]), "double")
            return f"cast(trim({v}) as {target}) as {v}"
        return f"cast({v} as boolean) as {v}" if found["n"] == found["truth"] else v

    return blanked.selectExpr(*[typed(c) for c in names])


def read_table(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """CSV or Parquet by its suffix, Parquet for a folder without one; ``max_rows`` bounds it as in :func:`row_budget`."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix == "csv":
        df = read_csv(spark, path)
    elif suffix in ("parquet", ""):
        try:
            df = spark.read.parquet(path)
        except Exception as problem:
            raise LoadError(f"could not load '{path}': {problem}") from problem
    else:
        raise LoadError(f"cannot read '{path}': '.{suffix}' is neither .csv nor .parquet")
    return df if max_rows is None else row_budget(df, max_rows)


def row_budget(df: DataFrame, max_rows: int) -> DataFrame:
    """At most one row more than the budget, so that running over it shows."""
    return df.limit(max_rows + 1)


def exceeds_budget(df: DataFrame, max_rows: int) -> bool:
    return row_budget(df, max_rows).count() > max_rows


def check_input(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> str | None:
    """Why the table cannot be analysed, or None; the limits are off unless given."""
    if not df.columns:
        return "input contains no columns"
    if df.isEmpty():
        return "input contains no data rows"
    if max_rows is not None and exceeds_budget(df, max_rows):
        return f"input has more than {max_rows:,} rows"
    if max_bytes is not None:
        size = input_bytes(df)
        if size > max_bytes:
            return f"input is {size / 1e6:.1f} MB; the limit is {max_bytes / 1e6:.0f} MB"
    return None


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files behind ``df``, from their listing; no content is read."""
    files = df.inputFiles()
    if not files:
        return 0
    listed = df.sparkSession.read.format("binaryFile").load(files).select("length")
    return listed.selectExpr("coalesce(sum(length), 0L) as size").first()["size"]


def infer_datetimes(df: DataFrame) -> DataFrame:
    """Turn text columns into timestamps where every value is ISO 8601.

    Nothing is lost: one value that does not parse keeps the column as text. Values
    that all carry the same UTC offset become instants, values without one stay
    wall-clock times, a mixture stays text.
    """
    infos = column_infos(df, CATEGORICAL)
    if not infos:
        return df

    def parses(c) -> dict[str, str]:
        v = quoted(c.name)
        return {
            "n": f"count({v})",
            "naive": f"count(if({iso_offset(v)} = '', {iso_timestamp(v)}, null))",
            "aware": f"count({iso_instant(v)})",
            "offsets": f"if(min({iso_offset(v)}) = max({iso_offset(v)}), 1, 2)",
        }

    counts = {r["column"]: r for r in per_column(df, infos, parses).collect()}  # one row per text column

    def typed(name: str) -> str:
        found, v = counts.get(name), quoted(name)
        if found and found["n"] and found["n"] == found["naive"]:
            return f"{iso_timestamp(v)} as {v}"
        if found and found["n"] and found["n"] == found["aware"] and found["offsets"] == 1:
            return f"{iso_instant(v)} as {v}"
        return v

    return df.selectExpr(*[typed(c) for c in df.columns])


def preview(df: DataFrame, order_by: list[str], n: int = 100) -> DataFrame:
    """The first rows in the order of a key; Spark tables have no order of their own."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n)
