"""Interaction audit of filters: what each removes, alone and after others, under every order.

Documents are reduced to a mask of the filters that they fail, and masks to cells (part, mask)
with the numbers of documents, good ones and toxic ones: at most 2^filters cells a part. Each
cell folds, with higher-order functions, across the array of all orders, which is a literal of
the plan and so reaches every task: ``aggregate`` walks an order's filters and remembers whether
the cell is gone, ``transform`` does so for all orders. Five filters give 120 orders of five
steps, 600 structs weighted by the cell. The cells of a part are merged by elementwise sums.

The only filter that looks beyond its document, "identical to a smaller id's text", is settled
by digests: rows are counted by digest and id, then by digest, each time in the tasks first, and
what is left of a digest, one row for each part and label, meets its smallest id in a window. So
a text that a third of the documents share is a few rows there.

A missing text is an empty one, a missing part the empty string, a missing mark of a label no
mark. A missing id has no label, is never smaller than another and has none smaller, so it isn't removed as a
copy; rows of one id and one text aren't copies of each other. A document labelled twice is good
or toxic if one of its labels says so. Extra columns are ignored; an empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasonde.functions.kinds import text_literal
from datasonde.functions.values import grouped
from datasonde.llm.columns import WORD

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
COPY = "E"
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 3


def text_failures(text: Column) -> dict[str, Column]:
    """The filters A to D that look at one text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    return {
        "A": n_words < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame) -> DataFrame:
    """(id, part, digest, mask) of (id, part, text) rows: a bit for each failed filter but the last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_failures(text).values())]
    mask = sum(bits[1:], bits[0])
    part = F.coalesce(F.col("part").cast("string"), F.lit(""))
    return docs.select("id", part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` (0 or 1) from labels of (id, quality, toxic)."""
    known = grouped(labels, ["id"], good="max(if(quality = 1, 1, 0))", toxic="max(if(toxic = 1, 1, 0))")
    found = rows.join(known, "id", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def cells(rows: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic) of (id, part, digest, mask, good, toxic) rows, copies marked by ``copy_bit``."""
    alike = ["digest", "part", "mask", "good", "toxic"]
    by_id = grouped(rows, [*alike, "id"], n="count(*)")
    folded = grouped(
        by_id,
        alike,
        n="sum(n)",
        unnamed="sum(if(id is null, n, 0))",
        first="min(if(id is null, null, struct(id, n)))",
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))  # a row for each part and label
    single = F.col("unnamed") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    both = folded.withColumn("single", single).selectExpr(
        "part", "good", "toxic", f"inline(array(struct(mask, single as n), struct(mask + {copy_bit} as mask, n - single as n)))"
    )
    return grouped(both.where("n > 0"), ["part", "mask"], n="sum(n)", good="sum(n * good)", toxic="sum(n * toxic)")


def folded_orders(letters: str) -> str:
    """SQL: the structs of all orders and steps of a cell (mask, n, good, toxic)."""
    orders = ", ".join(text_literal("".join(p)) for p in permutations(letters))
    kind = "array<struct<filter_order: string, step: int, " + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"
    bit = f"shiftleft(1, instr('{letters}', substr(o, s, 1)) - 1)"
    fails = f"(mask & {bit}) != 0"
    values = {
        "kept": f"if(acc.gone or {fails}, 0L, n)",
        "removed": f"if({fails} and not acc.gone, n, 0L)",
        "redundant": f"if({fails} and acc.gone, n, 0L)",
        "unique_fails": f"if(mask = {bit}, n, 0L)",
        "good_lost": f"if({fails} and not acc.gone, good, 0L)",
        "toxic_lost": f"if({fails} and not acc.gone, toxic, 0L)",
    }
    step = "named_struct('filter_order', o, 'step', s, " + ", ".join(f"'{c}', {sql}" for c, sql in values.items()) + ")"
    walk = (
        f"aggregate(sequence(1, {len(letters)}), named_struct('gone', false, 'steps', cast(array() as {kind})), "
        f"(acc, s) -> named_struct('gone', acc.gone or {fails}, 'steps', concat(acc.steps, array({step}))), acc -> acc.steps)"
    )
    return f"flatten(transform(array({orders}), o -> {walk}))"


def audit(cells_: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, counts…, shapley) of (part, mask, n, good, toxic) cells, zeros included."""
    one = cells_.selectExpr("part", f"{folded_orders(letters)} as steps")
    summed = ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS)
    merge = f"zip_with(a, b, (x, y) -> named_struct('filter_order', x.filter_order, 'step', x.step, {summed}))"
    lists = one.groupBy("part").agg(F.collect_list("steps").alias("each"))  # 2^filters lists at most
    merged = lists.selectExpr("part", f"aggregate(slice(each, 2, size(each)), each[0], (a, b) -> {merge}) as steps")
    each = ", ".join(f"'{c}'" for c in letters)
    total = "aggregate(filter(steps, x -> substr(x.filter_order, x.step, 1) = f), 0L, (t, x) -> t + x.removed)"
    known = merged.selectExpr("part", "steps", f"transform(array({each}), f -> {total}) as totals")
    rows = known.selectExpr("part", "totals", "inline(steps)")
    return rows.selectExpr(
        "part", "filter_order", "step", *COUNTS, f"element_at(totals, instr('{letters}', substr(filter_order, step, 1))) as shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over documents (id, part, text) and labels (id, quality, toxic)."""
    letters = "".join(text_failures(F.lit(""))) + COPY
    rows = with_labels(masked(docs), labels)
    return audit(cells(rows, 1 << letters.index(COPY)), letters)
