"""Relationships between columns: correlations, associations, group effects."""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.functions.fixed_values import LOW_CARDINALITY
from datasonde.functions.kinds import (
    BOOLEAN,
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    column_infos,
    names_of,
    text_literal,
)
from datasonde.functions.moments import sample_deviation
from datasonde.functions.values import as_text, finite, grouped, number_literal, rounded, union_all
from datasonde.operators.columns import approximate_distinct, missing_counts, per_column
from datasonde.operators.frequency import distinct_counts
from datasonde.operators.gram import pair_sums, pair_tables, rank_sums
from datasonde.operators.order_stats import RangeBuckets, average_ranks, plan_buckets

# Column pairs that generated aggregates take in one scan; more are added up as matrices, in one scan too.
PAIRS_IN_SQL = 600
# Columns with no more values than this, by a sketch within a few percent, are looked up by broadcast.
FEW_VALUES = 10_000
# A value held by more than one row in this many is attached by broadcast.
HOT_SHARE = 200
SPREAD = 64
# Joint groups of the category columns up to which rows are folded into them first.
MAX_JOINT_GROUPS = 1_000_000
# Remaining share of a sum of squares that counts as rounding noise, not variance.
NO_VARIANCE = "1e-14D"

Pair = tuple[int, int, str, str]
PAIR_SCHEMA = "i int, j int, col_a string, col_b string, stat double, n bigint"
EFFECT_SCHEMA = (
    "rank bigint, category string, numeric string, spread double, "
    "group_rank bigint, group string, mean double, cnt bigint"
)


# -- which columns take part ---------------------------------------------------


def low_cardinality_counts(
    df: DataFrame, kinds: tuple[str, ...], at_least: int = 2, at_most: int = LOW_CARDINALITY
) -> list[tuple[str, int]]:
    """(column, distinct values) of the columns with ``at_least``..``at_most`` values.

    A sketch rules out the columns that are far above the limit, so that exact
    counting only touches columns with few values.
    """
    infos = column_infos(df, *kinds)
    if not infos:
        return []
    sketch = approximate_distinct(df, [c.name for c in infos]).orderBy("position").collect()  # one row per column
    near = [r["column"] for r in sketch if r["n_unique"] <= 4 * at_most + 20]
    if not near:
        return []
    exact = {r["column"]: r["n_unique"] for r in distinct_counts(df, near).collect()}  # one row per column
    return [(n, exact[n]) for n in near if at_least <= exact.get(n, 0) <= at_most]


def low_cardinality_columns(df: DataFrame, cap: int | None = None) -> list[tuple[str, int]]:
    """The non-numeric columns with 2..20 distinct values, or the first ``cap``, and how many they have."""
    return low_cardinality_counts(df, (BOOLEAN, CATEGORICAL, DATETIME))[:cap]


def numeric_pairs(names: list[str]) -> list[Pair]:
    return [(i, j, names[i], names[j]) for i, j in combinations(range(len(names)), 2)]


# -- Pearson -------------------------------------------------------------------


def pearson_pairs(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(i, j, col_a, col_b, stat, n) for every numeric pair, complete rows of each pair.

    A first pass finds each column's mean and whether it has gaps; the second sums
    products of the centred values. One row leaves each task.
    """
    names = names if names is not None else names_of(df, NUMERIC)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    infos = {c.name: c for c in column_infos(df, names=names)}
    facts = per_column(
        df,
        list(infos.values()),
        lambda c: {"n_rows": "count(*)", "n": f"count({c.value})", "mean": f"avg({c.number})"},
    )
    known = {r["column"]: r for r in facts.collect()}  # one row per column
    gaps = {n for n, r in known.items() if r["n"] < r["n_rows"]}
    centred = df.selectExpr(
        *[f"{infos[n].number} - {number_literal(_centre(known[n]['mean']))} as v{i}" for i, n in enumerate(names)]
    )
    pairs = numeric_pairs(names)
    if len(pairs) > PAIRS_IN_SQL:
        return correlated(pair_sums(centred), names)
    return _correlate(centred, pairs, gaps)


def _centre(mean: float | None) -> float:
    """What is taken from a column before its products are summed; any number gives the same result."""
    return mean if mean is not None and abs(mean) < float("inf") else 0.0


def correlated(sums: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, col_a, col_b, stat, n) of every pair of columns from the sums over its rows."""
    listed = f"array({', '.join(text_literal(n) for n in names)})"
    pairs = sums.sparkSession.createDataFrame([(i, j) for i, j, _, _ in numeric_pairs(names)], "i int, j int")
    found = pairs.join(sums, ["i", "j"], "left")  # no row of an empty table
    vx, vy = "(qx - try_divide(sx * sx, n))", "(qy - try_divide(sy * sy, n))"
    r = f"try_divide(p - try_divide(sx * sy, n), sqrt({vx}) * sqrt({vy}))"
    varies = f"not odd and {vx} > qx * {NO_VARIANCE} and {vy} > qy * {NO_VARIANCE}"
    return found.selectExpr(
        "i", "j", f"element_at({listed}, i + 1) as col_a", f"element_at({listed}, j + 1) as col_b",
        f"if({varies}, greatest(-1D, least(1D, {r})), null) as stat", "cast(coalesce(n, 0D) as bigint) as n",
    )


def _correlate(centred: DataFrame, pairs: list[Pair], gaps: set[str]) -> DataFrame:
    """Pearson's r of column pairs from sums over the roughly centred columns v0, v1, ….

    Columns without gaps share their own sums; a pair touching a column with gaps
    sums over the rows where both are present.
    """
    sums: dict[str, str] = {"n": "cast(count(*) as double)"}
    rows = []
    for i, j, a, b in pairs:
        x, y = f"v{i}", f"v{j}"
        if {a, b} & gaps:
            both, own = f"v{i} is not null and v{j} is not null", f"_{i}_{j}"
            x, y = f"if({both}, {x}, null)", f"if({both}, {y}, null)"
            sums["n" + own] = f"cast(count_if({both}) as double)"
            at_x, at_y, n = f"x{own}", f"y{own}", f"n{own}"
        else:
            at_x, at_y, n = f"c{i}", f"c{j}", "n"
        for key, v in ((at_x, x), (at_y, y)):
            sums[f"s_{key}"], sums[f"q_{key}"] = f"sum({v})", f"sum({v} * {v})"
        sums[f"p{i}_{j}"] = f"sum({x} * {y})"
        cov = f"(p{i}_{j} - try_divide(s_{at_x} * s_{at_y}, {n}))"
        vx, vy = (f"(q_{k} - try_divide(s_{k} * s_{k}, {n}))" for k in (at_x, at_y))
        varies = f"{vx} > q_{at_x} * {NO_VARIANCE} and {vy} > q_{at_y} * {NO_VARIANCE}"
        r = f"if({varies}, greatest(-1D, least(1D, try_divide({cov}, sqrt({vx}) * sqrt({vy})))), null)"
        rows.append(
            f"struct({i} as i, {j} as j, {text_literal(a)} as col_a, {text_literal(b)} as col_b, "
            f"{r} as stat, cast({n} as bigint) as n)"
        )
    wide = centred.selectExpr(*[f"{sql} as {k}" for k, sql in sums.items()])
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def strongest(pairs: DataFrame, threshold: float, limit: int, name: str) -> DataFrame:
    """(col_a, col_b, name): the pairs at or above the threshold, strongest first."""
    kept = pairs.where(f"abs(stat) >= {threshold!r}D").selectExpr("i", "j", "col_a", "col_b", f"{rounded('stat', 3)} as {name}")
    ordered = kept.orderBy(F.expr(f"abs({name})").desc(), "i", "j").limit(limit)
    return ordered.select("col_a", "col_b", name)


def pearson_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The full symmetric matrix in long form: (col_a, col_b, r)."""
    names = names if names is not None else names_of(df, NUMERIC)
    both = "inline(array(struct(col_a, col_b, stat as r), struct(col_b as col_a, col_a as col_b, stat as r)))"
    own = per_column(df, column_infos(df, names=names), lambda c: {"low": f"min({c.number})", "high": f"max({c.number})"})
    diagonal = own.selectExpr("column as col_a", "column as col_b", "if(low < high, 1D, null) as r")
    return union_all([pearson_pairs(df, names).selectExpr(both), diagonal])


def top_pearson(df: DataFrame, threshold: float = 0.3, limit: int = 10) -> DataFrame:
    return strongest(pearson_pairs(df), threshold, limit, "pearson_r")


# -- Spearman ------------------------------------------------------------------


def attach_ranks(rows: DataFrame, base: DataFrame, v: str, n_rows: int, few: bool) -> DataFrame:
    """Replace column ``v`` of ``rows`` by its average rank within ``base``.

    A column of few values is looked up by broadcast. Otherwise the values held by
    more than one row in ``HOT_SHARE``, at most ``HOT_SHARE`` of them, are looked up
    by broadcast and the others join on the value, with the rows already served
    spread over salted keys, so no task gets more than a small share of the rows
    whatever the distribution.
    """
    values = base.selectExpr(f"{v} as value").where("value is not null")
    freq = grouped(values, ["value"], cnt="count(*)").selectExpr("0 as side", "value", "cnt")
    ranks = average_ranks(freq, ["side"], RangeBuckets() if few else plan_buckets(values, n_rows))
    kept = [c for c in rows.columns if c != v]
    if few:
        found = rows.join(F.broadcast(ranks.selectExpr("value", f"rank as r{v}")), F.expr(f"{v} = value"), "left")
        return found.select(*kept, f"r{v}")
    hot = f"cnt * {HOT_SHARE} > {n_rows}"
    common = ranks.where(hot).selectExpr("value as k1", "rank as r1")
    others = ranks.where(f"not ({hot})").selectExpr("value as k2", "0 as s2", "rank as r2")
    served = rows.join(F.broadcast(common), F.expr(f"{v} = k1"), "left")
    spread = f"1 + cast(pmod(xxhash64({', '.join(rows.columns)}), {SPREAD}) as int)"
    keyed = served.selectExpr("*", f"if(r1 is null and {v} is not null, 0, {spread}) as s")
    joined = keyed.join(others, F.expr(f"{v} = k2 and s = s2"), "left")
    return joined.selectExpr(*kept, f"coalesce(r1, r2) as r{v}")


def spearman_pairs(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(i, j, col_a, col_b, stat, n): Pearson on average ranks of each pair's complete rows.

    Columns without missing values share one ranking. If any column has gaps, cells are
    ranked in long form, on the rows of each column with gaps at once.
    """
    names = names if names is not None else names_of(df, NUMERIC)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    infos = {c.name: c for c in column_infos(df, names=names)}
    counted = missing_counts(df, list(infos.values())).collect()  # one row per numeric column
    gaps = {r["column"] for r in counted if r["n_missing"] > 0}
    n_rows = max([r["n_rows"] for r in counted])
    sketch = approximate_distinct(df, names).collect()  # one row per numeric column
    few = {r["column"] for r in sketch if r["n_unique"] <= FEW_VALUES}
    if gaps:
        return correlated(rank_sums(df, list(infos.values()), [i for i, n in enumerate(names) if n in gaps], n_rows), names)
    base = df.selectExpr(*[f"{infos[n].value} as v{k}" for k, n in enumerate(names)])
    rows = base
    for k, n in enumerate(names):
        rows = attach_ranks(rows, base, f"v{k}", n_rows, n in few)
    ranks = rows.selectExpr(*[f"rv{k} - {number_literal(n_rows / 2)} as v{k}" for k in range(len(names))])
    if len(numeric_pairs(names)) > PAIRS_IN_SQL:
        return correlated(pair_sums(ranks), names)
    return _correlate(ranks, numeric_pairs(names), set())


def top_spearman(df: DataFrame, threshold: float = 0.5, limit: int = 10) -> DataFrame:
    return strongest(spearman_pairs(df), threshold, limit, "spearman_r")


# -- categories ----------------------------------------------------------------


def pair_counts(df: DataFrame, counts: list[tuple[str, int]]) -> DataFrame:
    """(i, j, a, b, cnt): contingency tables of every pair of columns in one aggregation.

    ``counts`` names the columns and their distinct values. Where these bound the
    joint groups, rows are folded into joint groups first and only those are
    spread over the pairs. Else the tables are filled in the tasks, and rows aren't
    spread at all.
    """
    names = [n for n, _ in counts]
    infos = {c.name: c for c in column_infos(df, names=names)}
    labels = df.selectExpr(*[f"{as_text(infos[n].value, infos[n].data_type)} as c{i}" for i, n in enumerate(names)])
    if joint_groups(counts) > MAX_JOINT_GROUPS:
        return pair_tables(labels)
    rows = grouped(labels, [f"c{i}" for i in range(len(names))], cnt="count(*)")
    cells = ", ".join(
        f"struct({i} as i, {j} as j, c{i} as a, c{j} as b)" for i, j in combinations(range(len(names)), 2)
    )
    long = rows.selectExpr("cnt", f"inline(array({cells}))").where("a is not null and b is not null")
    return grouped(long, ["i", "j", "a", "b"], cnt="sum(cnt)")


def joint_groups(counts: list[tuple[str, int]]) -> int:
    """The most groups the columns can form together, a missing value being one more."""
    return prod(n + 1 for _, n in counts)


def chi_square(counts: DataFrame) -> DataFrame:
    """(i, j, n, n_a, n_b, chi2) from contingency tables in long form."""
    totals = counts.selectExpr(
        "*",
        "sum(cnt) over (partition by i, j) as n",
        "sum(cnt) over (partition by i, j, a) as na",
        "sum(cnt) over (partition by i, j, b) as nb",
    )
    summed = grouped(
        totals,
        ["i", "j", "n"],
        n_a="count(distinct a)",
        n_b="count(distinct b)",
        share="sum(cnt * cnt / (cast(na as double) * nb))",
    )
    return summed.selectExpr("i", "j", "n", "n_a", "n_b", "n * (share - 1) as chi2")


def cramers_v(tested: DataFrame) -> DataFrame:
    """Add the bias-corrected Cramér's V, 0 for degenerate tables, as ``stat``."""
    phi2 = "greatest(0D, try_divide(chi2, n) - try_divide((n_b - 1) * (n_a - 1), n - 1)) as phi2"
    room = (
        "least(n_a - try_divide((n_a - 1) * (n_a - 1), n - 1), n_b - try_divide((n_b - 1) * (n_b - 1), n - 1)) - 1 as room"
    )
    defined = "n >= 2 and n_a >= 2 and n_b >= 2 and room > 0"
    return tested.selectExpr("*", phi2, room).selectExpr(
        "*", f"if({defined}, sqrt(try_divide(phi2, room)), 0D) as stat"
    )


def cramers_v_pairs(df: DataFrame, counts: list[tuple[str, int]]) -> DataFrame:
    """(i, j, col_a, col_b, chi2, stat, n) for every pair of the columns counted."""
    names = [n for n, _ in counts]
    if len(names) < 2:
        return df.sparkSession.createDataFrame(
            [], "i int, j int, col_a string, col_b string, chi2 double, stat double, n bigint"
        )
    listed = f"array({', '.join(text_literal(n) for n in names)})"
    tested = cramers_v(chi_square(pair_counts(df, counts)))
    return tested.selectExpr(
        "i", "j", f"element_at({listed}, i + 1) as col_a", f"element_at({listed}, j + 1) as col_b", "chi2", "stat", "n"
    )


def top_cramers_v(df: DataFrame, threshold: float = 0.3, limit: int = 10) -> DataFrame:
    """(col_a, col_b, cramers_v) among the columns with few values."""
    pairs = cramers_v_pairs(df, low_cardinality_columns(df)).where("n >= 2")
    return strongest(pairs, threshold, limit, "cramers_v")


# -- category effects ----------------------------------------------------------


def category_effects(df: DataFrame, limit: int = 8, groups: int = 8) -> DataFrame:
    """Group means of each numeric column by each category, widest spread first.

    (rank, category, numeric, spread, group_rank, group, mean, cnt). The spread is
    the distance between the extreme group means in standard deviations of the
    column; pairs with a single group or a group under three rows are left out.
    """
    cats, nums = low_cardinality_columns(df), names_of(df, NUMERIC)
    if not cats or not nums:
        return df.sparkSession.createDataFrame([], EFFECT_SCHEMA)
    deviations = per_column(
        df, column_infos(df, names=nums), lambda c: {"std": finite(sample_deviation(c.number))}
    ).selectExpr("column as numeric", "std")
    pair = "over (partition by category, numeric)"
    judged = (
        group_means(df, cats, nums)
        .join(F.broadcast(deviations), "numeric")  # one row per numeric column
        .selectExpr(
            "*",
            f"try_divide(max(mean) {pair} - min(mean) {pair}, std) as raw_spread",
            f"count(*) {pair} as n_groups",
            f"min(cnt) {pair} as smallest",
        )
        .where("n_groups >= 2 and smallest >= 3 and raw_spread > 0")
        .withColumn("spread", F.expr(rounded("raw_spread", 3)))
    )
    # at most categories x numeric columns x 20 groups from here on
    ranked = judged.selectExpr(
        "*",
        "cast(row_number() over (partition by category, numeric order by abs(mean) desc, group) as bigint) as group_rank",
        "cast(dense_rank() over (partition by 0 order by spread desc, ci, ni) as bigint) as rank",
    )
    return ranked.where(f"rank <= {limit} and group_rank <= {groups}").selectExpr(
        "rank", "category", "numeric", "spread", "group_rank", "group", f"{rounded('mean', 4)} as mean", "cnt"
    )


def group_means(df: DataFrame, counts: list[tuple[str, int]], nums: list[str]) -> DataFrame:
    """(ci, ni, category, numeric, group, mean, cnt): one aggregation over all categories.

    Every numeric column rides along as a sum and a count, so a task emits at most
    20 rows per category. Where the distinct values bound the joint groups of the
    categories, rows are folded into those first and only the groups are unpivoted.
    """
    cats = [c for c, _ in counts]
    infos = {c.name: c for c in column_infos(df, names=[*cats, *nums])}
    rows = df.selectExpr(
        *[f"{as_text(infos[c].value, infos[c].data_type)} as c{i}" for i, c in enumerate(cats)],
        *[f"{infos[n].number} as s{i}" for i, n in enumerate(nums)],
        *[f"if({infos[n].number} is null, 0L, 1L) as n{i}" for i, n in enumerate(nums)],
    )
    sums = {f"{m}{i}": f"sum({m}{i})" for i in range(len(nums)) for m in ("s", "n")}
    if joint_groups(counts) <= MAX_JOINT_GROUPS:
        rows = grouped(rows, [f"c{i}" for i in range(len(cats))], **sums)
    cells = ", ".join(f"struct({i} as ci, c{i} as group)" for i in range(len(cats)))
    long = rows.selectExpr(*sums, f"inline(array({cells}))").where("group is not null")
    found = ", ".join(
        f"struct({i} as ni, {text_literal(n)} as numeric, try_divide(s{i}, n{i}) as mean, n{i} as cnt)"
        for i, n in enumerate(nums)
    )
    listed = f"array({', '.join(text_literal(c) for c in cats)})"
    wide = grouped(long, ["ci", "group"], **sums)
    means = wide.selectExpr("ci", f"element_at({listed}, ci + 1) as category", "group", f"inline(array({found}))")
    return means.where("cnt > 0")
