"""Sums over all pairs of columns in one scan: products, presence and ranks.

For a few columns, generated SQL aggregates are fastest; for hundreds of pairs they outgrow what
one plan can hold. Here every task reads its rows as Arrow batches, turns a batch into a matrix
and adds the batch's products to fixed matrices (columns x columns), which is all that leaves
it. So the scans don't grow with the columns, a row makes no rows, and memory is a few matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.functions.kinds import ColumnInfo, is_floating, is_integral
from datasonde.functions.shared import stored
from datasonde.functions.values import grouped, union_all
from datasonde.operators.order_stats import plan_keyed_buckets

SUMS = ("n", "sx", "sy", "qx", "qy", "p")
SUM_SCHEMA = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS) + ", odd boolean"
# Rows of a batch that are ranked at once: bounds their ranks, columns x (1 + columns with gaps) a row.
CELLS_AT_ONCE = 4_000_000
# A value held by more than one row in this many is looked up by broadcast.
HOT_SHARE = 200
SPREAD = 64
BITS = 62


def _upper(sums: list[np.ndarray], odd: np.ndarray) -> pa.RecordBatch:
    """The pairs i < j of matrices as rows."""
    i, j = np.triu_indices(len(odd), 1)
    arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(m[i, j].astype(np.float64)) for m in sums), pa.array(odd[i, j])]
    return pa.RecordBatch.from_arrays(arrays, ["i", "j", *SUMS, "odd"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The columns of doubles side by side, missing values as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)


def _folded(parts: DataFrame) -> DataFrame:
    """(i, j, sums…, odd), a row a pair, from those of all tasks."""
    return grouped(parts, ["i", "j"], **{s: f"sum({s})" for s in SUMS}, odd="max(odd)")


def pair_sums(values: DataFrame) -> DataFrame:
    """(i, j, n, sx, sy, qx, qy, p, odd) of each pair of columns of doubles, over the rows where both are present.

    ``odd`` marks pairs whose rows hold an infinite value.
    """
    width = len(values.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p, odd = (np.zeros((width, width)) for _ in range(5))
        for batch in batches:
            v = _matrix(batch)
            there, infinite = ~np.isnan(v), np.isinf(v)
            v = np.where(there & ~infinite, v, 0.0)
            mask = there.astype(np.float64)
            n += mask.T @ mask
            s += v.T @ mask  # of the row's column, where the other is present
            q += (v * v).T @ mask
            p += v.T @ v
            if infinite.any():
                odd += infinite.astype(np.float64).T @ mask
        if n.any():
            yield _upper([n, s, s.T, q, q.T, p], (odd > 0) | (odd.T > 0))

    return _folded(values.mapInArrow(run, SUM_SCHEMA))


def together_missing(missing: DataFrame) -> DataFrame:
    """(i, j, cnt) of each pair of columns of booleans: the rows where both are true."""
    width = len(missing.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), np.int64)
        for batch in batches:
            marks = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            marks = marks[marks.sum(axis=1) > 1]
            total += (marks.T @ marks).astype(np.int64)  # counts of a batch are exact in doubles
        i, j = np.triu_indices(width, 1)
        some = np.flatnonzero(total[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(i[some], pa.int32()), pa.array(j[some], pa.int32()), pa.array(total[i, j][some])], ["i", "j", "cnt"])

    return grouped(missing.mapInArrow(run, "i int, j int, cnt long"), ["i", "j"], cnt="sum(cnt)")


def pair_tables(labels: DataFrame) -> DataFrame:
    """(i, j, a, b, cnt): the contingency table of each pair of text columns of few values, missing ones left out.

    Every task gives the values of a column numbers of its own, and adds the pairs of numbers of a
    batch to one table per pair; what leaves it are the cells of those tables.
    """
    width = len(labels.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[dict[str, int]] = [{} for _ in range(width)]
        tables: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            codes = []
            for column, known in zip(batch.columns, numbers):
                encoded = column.dictionary_encode()
                own = [known.setdefault(v, len(known) + 1) for v in encoded.dictionary.to_pylist()]
                at = encoded.indices.fill_null(len(own)).to_numpy()
                codes.append(np.array([*own, 0])[at])  # 0: missing
            for i in range(width - 1):
                for j in range(i + 1, width):
                    shape = len(numbers[i]) + 1, len(numbers[j]) + 1
                    new = np.bincount(codes[i] * shape[1] + codes[j], minlength=shape[0] * shape[1]).reshape(shape)
                    if (i, j) in tables:
                        old = tables[i, j]
                        new[: old.shape[0], : old.shape[1]] += old
                    tables[i, j] = new
        names = [[None, *known] for known in numbers]
        for (i, j), table in tables.items():
            a, b = np.nonzero(table[1:, 1:])
            n = len(a)
            columns = [pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32())]
            columns += [pa.array([of[k + 1] for k in at], pa.string()) for of, at in ((names[i], a), (names[j], b))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[1:, 1:][a, b], pa.int64())], ["i", "j", "a", "b", "cnt"])

    return grouped(labels.mapInArrow(run, "i int, j int, a string, b string, cnt long"), ["i", "j", "a", "b"], cnt="sum(cnt)")


# -- ranks within each other column's rows ----------------------------------------


def _kind(c: ColumnInfo) -> str:
    return "bigint" if is_integral(c.data_type) else "double" if is_floating(c.data_type) else c.data_type.simpleString()


def _subset_ranks(cells: DataFrame, subsets: int, n_rows: int) -> DataFrame:
    """(position, value, ranks) of (position, value, bits…) cells.

    ``ranks`` has the average rank of the value among all rows of its column and among those
    where each of the ``subsets`` columns is present, less the mean rank, so about 0. Values are
    counted once, with a count for each subset beside the whole one, and the running totals of
    all are taken in the same windows.
    """
    counts = {"c0": "count(*)"}
    counts |= {f"c{g + 1}": f"sum(shiftright(b{g // BITS}, {g % BITS}) & 1)" for g in range(subsets)}
    freq = grouped(cells, ["position", "value"], **counts)
    buckets = plan_keyed_buckets(cells.selectExpr("position", "cast(value as double) as value"), "position", n_rows)
    placed = buckets.place(freq)
    so_far = "rows between unbounded preceding and current row"
    inside = placed.selectExpr(
        "*", *(f"sum({c}) over (partition by position, bucket order by value {so_far}) - {c} as i_{c}" for c in counts)
    )
    sizes = grouped(placed, ["position", "bucket"], **{f"z_{c}": f"sum({c})" for c in counts})  # a row a bucket
    base = sizes.selectExpr(
        "position",
        "bucket",
        *(f"sum(z_{c}) over (partition by position order by bucket {so_far}) - z_{c} as b_{c}" for c in counts),
        *(f"sum(z_{c}) over (partition by position) as t_{c}" for c in counts),
    )
    ranked = inside.join(base, ["position", "bucket"])
    ranks = ", ".join(f"b_{c} + i_{c} + ({c} - t_{c}) / 2D" for c in counts)
    return ranked.selectExpr("position", "value", "c0 as cnt", f"array({ranks}) as ranks")


def _with_ranks(cells: DataFrame, ranks: DataFrame, n_rows: int) -> DataFrame:
    """(id, position, ranks) of (id, position, value) cells.

    Values of more than one row in ``HOT_SHARE`` are looked up by broadcast, the others by a
    join on the value, in which the cells already served are spread over keys of their own.
    """
    hot = f"cnt * {HOT_SHARE} > {n_rows}"
    common = ranks.where(hot).selectExpr("position", "value", "ranks as hot")  # HOT_SHARE a column at most
    others = ranks.where(f"not ({hot})").selectExpr("position", "value", "0 as salt", "ranks as cold")
    served = cells.join(F.broadcast(common), ["position", "value"], "left")
    keyed = served.withColumn("salt", F.expr(f"if(hot is null, 0, 1 + cast(pmod(id, {SPREAD}) as int))"))
    return keyed.join(others, ["position", "value", "salt"], "left").selectExpr("id", "position", "coalesce(hot, cold) as ranks")


def rank_sums(df: DataFrame, infos: list[ColumnInfo], gaps: list[int], n_rows: int) -> DataFrame:
    """(i, j, n, sx, sy, qx, qy, p, odd) of the average ranks of each pair of columns, ranked on the pair's complete rows.

    ``gaps`` are the places, among ``infos``, of the columns with missing values. Rows are
    numbered and unpivoted once; the ranks of a value within each gap column's rows come of one
    frequency table and travel together. So neither the scans nor the shuffles grow with the
    columns or their gaps: for each type of values one for the table, two for its totals and one
    for the join, and one that brings the cells of a row together again.
    """
    width, subsets = len(infos), len(gaps)
    rows = stored(df.selectExpr("monotonically_increasing_id() as id", *[f"{c.value} as v{i}" for i, c in enumerate(infos)]))
    words = range(-(-subsets // BITS))
    masks = []
    for w in words:
        terms = [f"if(v{i} is null, 0L, {1 << (g % BITS)}L)" for g, i in enumerate(gaps) if g // BITS == w]
        masks.append(f"{' + '.join(terms)} as b{w}")
    marked = rows.selectExpr("*", *masks)
    families: dict[str, list[int]] = {}
    for i, c in enumerate(infos):
        families.setdefault(_kind(c), []).append(i)
    parts = []
    for kind, members in families.items():
        listed = ", ".join(f"struct({i} as position, cast(v{i} as {kind}) as value)" for i in members)
        bits = [f"b{w}" for w in words]
        # adding 0.0 makes -0.0 the 0.0 that it equals
        value = "value + 0D as value" if kind == "double" else "value"
        cells = marked.selectExpr("id", *bits, f"inline(array({listed}))").where("value is not null").selectExpr("id", *bits, "position", value)
        parts.append(_with_ranks(cells.select("id", "position", "value"), _subset_ranks(cells, subsets, n_rows), n_rows))
    whole = union_all(parts).groupBy("id").agg(F.expr("collect_list(struct(position, ranks)) as cells")).select("cells")  # a cell a column
    subset_of = np.zeros(width, np.int64)
    subset_of[gaps] = np.arange(1, subsets + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((width, width)) for _ in SUMS]
        at_once = max(1, CELLS_AT_ONCE // (width * (subsets + 1)))
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                _add(sums, batch.column(0).slice(start, at_once))
        if sums[0].any():
            yield _upper(sums, np.zeros((width, width), bool))

    def _add(sums: list[np.ndarray], lists: pa.ListArray) -> None:
        cells = lists.flatten()
        position = cells.field(0).to_numpy()
        ranks = cells.field(1).flatten().to_numpy().reshape(-1, subsets + 1)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        table = np.full((len(lists), width, subsets + 1), np.nan)
        table[row, position] = ranks
        for i in range(width - 1):
            x = table[:, i][:, subset_of[i + 1 :]]  # i's ranks where the other is present
            y = table[:, i + 1 :, subset_of[i]]
            both = ~np.isnan(x) & ~np.isnan(y)
            x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
            for total, part in zip(sums, (both, x, y, x * x, y * y, x * y)):
                total[i, i + 1 :] += part.sum(axis=0)

    return _folded(whole.mapInArrow(run, SUM_SCHEMA))
