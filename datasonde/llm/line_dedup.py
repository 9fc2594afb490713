"""Remove passages of three lines that were seen before, with DataFrame functions only.

Every document gives overlapping windows of three consecutive lines; blank lines are passed
over, and a document of one or two lines is one window. A line of more than 16 words is first
cut into shorter ones, of 9 to 16 words, where the text itself says so: after a mark or a final
letter that every fourth word or so has. So a passage inside one long line is cut alike wherever
it stands, but for its first and last piece, and one of over 50 words has windows of its own.

Windows are hashed to 96 bits and counted over the whole corpus. The first occurrence, by
(id, position), stays; every later one covers its lines, covered positions are merged, and
those lines are removed. Pieces of a line that stay are one line as before.

The first occurrence of a line's text is never removed, since a window that holds it can
only be a first one. So no content is lost, whatever the overlaps.

Only (hash, id, position) rows are shuffled to find repeats: counts are combined before the
shuffle, and a window that a third of the documents share is joined to one row, so adaptive
execution may split it. Text is shuffled once, to meet the positions to remove.

Missing texts stay missing, empty ones empty. Lines are compared without ASCII white space at
their ends. A text without a removal is returned unchanged. Rows of one id and one text count
as one occurrence; a missing id sorts first. An empty table stays empty. Writing without spaces
is one word, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasonde.llm.columns import ASCII_SPACE, packed, unpacked

WINDOW_LINES = 3
# A line in pieces, which hold all of it: whole if it has at most 16 words, else up to the first of the words 9 to 16
# that ends in a mark or one of ten letters, which end a quarter of the words of most languages, else 16 words.
# \s and \S are ASCII white space and anything else. No match is given back, so a word is read once, the first 16 of a long line twice.
_WORD_ENDED = r"(?>\S+(?:\s+|\z))"
_GOES_ON = r"(?>(?>\S+)(?<![.!?,;:egklpu\x{0430}\x{043A}\x{043B}\x{043F}])\s+)"
PIECE = rf"\A\s*+{_WORD_ENDED}{{0,16}}+\z|\s*+{_WORD_ENDED}{{1,8}}+{_GOES_ON}{{0,7}}+{_WORD_ENDED}?+"


def _line_pieces(line: Column) -> Column:
    """A line, in pieces if it is long."""
    return F.regexp_extract_all(line, F.lit(PIECE), F.lit(0))


def _pieces(text: Column) -> Column:
    """(line, piece) of a text: its lines, long ones in pieces."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda line, i: F.transform(_line_pieces(line), lambda p: F.struct(i.alias("line"), p.alias("piece")))))


def _line_count(text: Column) -> Column:
    """Lines that aren't blank; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S[^\n]*")), F.lit(0))


def repeated_windows(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """(id, digest, ranges) for documents of (id, text): ranges of pieces whose windows occurred before."""
    bodies = F.transform(F.flatten(F.transform(F.split("text", "\n"), _line_pieces)), lambda p: F.btrim(p, F.lit(ASCII_SPACE)))

    def hashed(body: Column, i: Column) -> Column:
        return F.when(body != "", F.struct(i.alias("at"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")))

    units = F.filter(F.transform(bodies, hashed), lambda x: x.isNotNull())
    rows = docs.filter(F.col("text").isNotNull()).select("id", F.xxhash64("text").alias("digest"), units.alias("units"))
    # Not a filter on the units: Spark would move it below them and cut each text twice.
    starts = F.when(F.size("units") > 0, F.sequence(F.lit(0), F.greatest(F.size("units") - width, F.lit(0))))

    def window(p: Column) -> Column:
        units = [F.get(F.col("units"), p + k) for k in range(width)]
        return F.struct(
            F.xxhash64(*(u.h1 for u in units)).alias("h1"),
            F.hash(*(u.h2 for u in units)).alias("h2"),
            units[0].at.alias("a"),
            F.coalesce(*(u.at for u in reversed(units))).alias("b"),
        )

    windows = rows.select("id", "digest", F.inline(F.transform(starts, window)))
    firsts = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "digest", "a")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .drop("n")
    )
    later = windows.join(firsts, ["h1", "h2"]).filter(F.struct("id", "digest", "a") > F.col("first"))
    return later.groupBy("id", "digest").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WINDOW_LINES) -> DataFrame:
    """``docs`` as a struct ``row`` with the new text, whether it changed, the number of lines (blank ones not counted) and of those gone."""
    body = F.col(f"`{text}`")
    found = repeated_windows(docs.select(F.col(f"`{key}`").alias("id"), body.alias("text")), width)
    found = found.select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), "ranges")
    rows = packed(docs, id=F.col(f"`{key}`"), digest=F.xxhash64(body))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    joined = joined.withColumn("text", F.col("row").getField(text))  # shuffled once, within its row
    changed = F.col("ranges").isNotNull()
    joined = joined.withColumn("pieces", F.when(changed, _pieces(F.col("text"))))
    covered = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r.a, r.b))))
    left = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), covered)
    joined = joined.withColumn("left", F.when(changed, F.transform(left, lambda i: F.get(F.col("pieces"), i))))
    # A piece starts a line if the piece before it is of another one.
    before = F.concat(F.array(F.lit(None).cast("int")), F.col("left.line"))
    parts = F.zip_with("left", before, lambda p, line: F.concat(F.when(line != p.line, "\n").otherwise(""), p.piece))
    joined = joined.withColumn("new_text", F.when(changed, F.array_join(parts, "")).otherwise(F.col("text")))
    joined = joined.withColumn("n_lines", _line_count(F.col("text")))
    gone = F.when(changed, F.col("n_lines") - _line_count(F.col("new_text"))).otherwise(0)
    return joined.select("row", "new_text", changed.alias("changed"), "n_lines", gone.alias("n_removed"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = "n_chars", width: int = WINDOW_LINES) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and the length column, if there is one, set to match."""
    rows = without_repeats(docs, text, key, width)
    changed = {text: F.col("new_text")}
    if length in docs.columns:
        old = F.col("row").getField(length)
        changed[length] = F.when(F.col("changed"), F.length("new_text")).otherwise(old).cast(docs.schema[length].dataType)
    return unpacked(rows, docs.columns, **changed)
