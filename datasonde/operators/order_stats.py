"""Exact quantiles and average ranks without collecting a column in one task.

Both start from a frequency table. Values are placed in order-preserving range
buckets; one window sorts inside each bucket, and a second, over the few bucket
totals, adds what lies below. No task ever sorts more than one bucket, and
because a repeated value is one row, a value held by a third of all rows weighs
as little as any other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.functions.values import grouped, number_literal

# Distinct values one window partition may hold before ranges are split.
ROWS_PER_BUCKET = 2_000_000
# Ranges of about equal counts on each of two levels, the second within each range of the first;
# beyond that, even parts of the second's ranges.
EDGES = 64

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


@dataclass(frozen=True)
class RangeBuckets:
    """A monotone map from values to bucket numbers, from edges shared by all keys or one set per key.

    Where rows ask for more buckets than there are edges, ``fine`` has edges of its own for the
    values of each range, so clustered and heavy-tailed values are spread like any others. Edges
    only balance the work; results are exact for any edges.
    """

    edges: tuple[float, ...] = ()
    splits: int = 1
    key: str | None = None
    edges_by_key: tuple[tuple[int, tuple[float, ...]], ...] = ()
    fine: tuple[tuple, ...] = ()  # (key, if any, range, edges)

    @property
    def single(self) -> bool:
        return not self.edges and not self.edges_by_key

    def place(self, freq: DataFrame) -> DataFrame:
        """``freq`` with a column ``bucket``."""
        if self.single:
            return freq.selectExpr("*", "0 as bucket")
        if not self.edges_by_key:
            ranged = freq.selectExpr("*", f"{_search([number_literal(e) for e in self.edges])} as bucket")
        else:
            ranged = self._looked_up(freq, "e", [self.key], self.edges_by_key, 1)
        if not self.fine:
            return ranged
        keys = [self.key, "bucket"] if self.key else ["bucket"]
        return self._looked_up(ranged, "g", keys, self.fine, self.splits)

    def _looked_up(self, rows: DataFrame, prefix: str, keys: list[str], edges: tuple, splits: int) -> DataFrame:
        """``rows`` with the place among the edges of their keys, after the range they are in, if any."""
        names = [f"{prefix}{i}" for i in range(EDGES + 1)]
        schema = ", ".join([*(f"{k} int" for k in keys), *(f"{n} double" for n in names)])
        known = rows.sparkSession.createDataFrame([(*row[:-1], *row[-1]) for row in edges], schema)
        # one row per column, or per column and range; without finite values there are no edges and one bucket
        placed = rows.join(F.broadcast(known), keys, "left")
        start = f"cast(bucket as bigint) * {(EDGES + 2) * splits} + " if "bucket" in keys else ""
        kept = [c for c in rows.columns if c != "bucket"]
        return placed.selectExpr(*kept, f"{start}{_search(names, splits)} as bucket")


def _search(edges: list[str], splits: int = 1) -> str:
    """Binary search as nested conditions; leaf ``i`` holds edges[i-1] <= value < edges[i]."""
    v = "cast(value as double)"

    def between(lo: int, hi: int) -> str:
        if lo < hi:
            mid = (lo + hi) // 2
            return f"if({v} < {edges[mid]}, {between(lo, mid)}, {between(mid + 1, hi)})"
        start = lo * splits
        if splits == 1 or lo in (0, len(edges)):
            return f"{start}"
        share = f"try_divide({v} - {edges[lo - 1]}, {edges[lo]} - {edges[lo - 1]})"
        return f"{start} + coalesce(cast(least(floor({share} * {splits}), {splits - 1}) as int), 0)"

    return between(0, len(edges))


def _sketch() -> str:
    steps = ", ".join(f"{i / EDGES!r}D" for i in range(EDGES + 1))
    return f"percentile_approx(cast(value as double), array({steps}), {10 * EDGES}) as edges"


def _filled(edges: tuple[float, ...]) -> tuple[float, ...]:
    return edges + edges[-1:] * (EDGES + 1 - len(edges))


def _refined(buckets: RangeBuckets, values: DataFrame, n: int) -> RangeBuckets:
    """``buckets`` with edges inside their ranges, if ``n`` rows fill more than the ranges."""
    if n <= EDGES * ROWS_PER_BUCKET or buckets.single:
        return buckets
    keys = [buckets.key, "bucket"] if buckets.key else ["bucket"]
    found = buckets.place(values.where("value is not null")).groupBy(*keys).agg(F.expr(_sketch())).collect()  # a row per column and range
    full = ((*(r[k] for k in keys), _finite(r["edges"])) for r in found)
    fine = tuple((*row[:-1], _filled(row[-1])) for row in full if row[-1])
    return replace(buckets, fine=fine, splits=max(1, -(-n // (EDGES * EDGES * ROWS_PER_BUCKET))))


def _finite(edges: list[float] | None) -> tuple[float, ...]:
    return tuple(sorted(float(e) for e in edges or [] if abs(e) != float("inf") and e == e))


def plan_buckets(values: DataFrame, n: int) -> RangeBuckets:
    """Buckets for the column ``value`` of at most ``n`` rows, whatever their keys.

    Small inputs get a single bucket. Otherwise one aggregate brings back a fixed
    number of approximate quantiles, and for many rows a second one those of each range.
    """
    if n <= ROWS_PER_BUCKET:
        return RangeBuckets()
    found = values.selectExpr(_sketch()).first()["edges"]
    return _refined(RangeBuckets(tuple(sorted(set(_finite(found))))), values, n)


def plan_keyed_buckets(values: DataFrame, key: str, n: int) -> RangeBuckets:
    """Buckets of their own for each key of (key, value), a key holding at most ``n`` rows.

    For columns profiled together, whose values may lie on different scales; one row of
    edges per column comes back, and for many rows one per column and range.
    """
    if n <= ROWS_PER_BUCKET:
        return RangeBuckets()
    found = values.where("value is not null").groupBy(key).agg(F.expr(_sketch())).collect()
    full = ((r[key], _finite(r["edges"])) for r in found)
    rows = tuple((k, _filled(edges)) for k, edges in full if edges)
    return _refined(RangeBuckets((), 1, key, rows), values, n)


def running_counts(freq: DataFrame, keys: list[str], buckets: RangeBuckets, totals: bool = True) -> DataFrame:
    """Add ``before`` (rows below the value, per key) and, if asked, ``total`` to (keys…, value, cnt)."""
    total = ["total"] if totals else []
    by = ", ".join(keys)
    so_far = "rows between unbounded preceding and current row"
    if buckets.single:
        return freq.selectExpr(
            *keys,
            "value",
            "cnt",
            f"sum(cnt) over (partition by {by} order by value {so_far}) - cnt as before",
            *[f"sum(cnt) over (partition by {by}) as {t}" for t in total],
        )
    placed = buckets.place(freq.select(*keys, "value", "cnt"))
    inside = placed.selectExpr(
        "*", f"sum(cnt) over (partition by {by}, bucket order by value {so_far}) - cnt as inside"
    )
    sizes = grouped(placed, [*keys, "bucket"], size="sum(cnt)")
    base = sizes.selectExpr(
        *keys,
        "bucket",
        f"sum(size) over (partition by {by} order by bucket {so_far}) - size as base",
        f"sum(size) over (partition by {by}) as total",
    )
    return inside.join(base, [*keys, "bucket"]).selectExpr(*keys, "value", "cnt", "base + inside as before", *total)


def quantiles(freq: DataFrame, keys: list[str], probs: dict[str, float], buckets: RangeBuckets) -> DataFrame:
    """(keys…, n, one column per entry of ``probs``) with linear interpolation."""
    ends = {"n": "max(total)"}
    shown = []
    for name, p in probs.items():
        at = f"floor((total - 1) * {p!r}D)"
        for side, spot in (("lo", at), ("hi", f"least({at} + 1, total - 1)")):
            ends[f"{name}_{side}"] = f"max(if(before <= {spot} and {spot} < before + cnt, value, null))"
        spot = f"(n - 1) * {p!r}D"
        between = f"{name}_lo + ({name}_hi - {name}_lo) * ({spot} - floor({spot}))"
        shown.append(f"if({name}_lo = {name}_hi, {name}_lo, {between}) as {name}")  # equal infinities have no difference
    return grouped(running_counts(freq, keys, buckets), keys, **ends).selectExpr(*keys, "n", *shown)


def average_ranks(freq: DataFrame, keys: list[str], buckets: RangeBuckets) -> DataFrame:
    """(keys…, value, cnt, rank): tied values share their mean rank."""
    counted = running_counts(freq, keys, buckets, totals=False)
    return counted.selectExpr(*keys, "value", "cnt", "before + (cnt + 1) / 2D as rank")


def with_fences(quartiles: DataFrame) -> DataFrame:
    """Add IQR outlier fences to (…, p25, p75); null when the IQR is zero."""
    return quartiles.selectExpr(
        "*",
        "if(p75 != p25, p25 - 1.5D * (p75 - p25), null) as lower",
        "if(p75 != p25, p75 + 1.5D * (p75 - p25), null) as upper",
    )


# Strictly outside the fences; false where there are none.
IS_OUTLIER = "coalesce(value < lower or value > upper, false)"
