"""Run guarded plans: filter, group, aggregate, as one DataFrame.

A plan is a dict ``{"aggregate", "column", "filters", "group_by"}``. Only the
checked plan reaches Spark, and a bad plan yields an error, not an exception.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from datasonde.functions.fixed_values import MAX_RESULT_GROUPS
from datasonde.functions.kinds import column_info, column_infos, is_integral, quoted
from datasonde.functions.values import as_text, grouped
from datasonde.plans.dates import is_token, resolve_token, zone
from datasonde.plans.filters import predicate
from datasonde.plans.validate import children_of, operands, plan_errors

RESULT_NAMES = ("value", "n", "n_rows", "truncated")
SQL_AGGREGATES = {"count_nonnull": "count", "sum": "sum", "mean": "avg", "min": "min", "max": "max"}


@dataclass(frozen=True)
class PlanResult:
    """The outcome of a plan; ``table`` and ``matched`` are lazy."""

    ok: bool
    error: str | None = None
    interpretation: str | None = None
    tz: str = "UTC"
    table: DataFrame | None = None
    matched: DataFrame | None = None

    def n_matched(self) -> int:
        """Rows that pass the filter, before rows with a null key are left out."""
        return self.matched.count()


def run_plan(
    df: DataFrame, plan: object, tz: str = "UTC", now: datetime | None = None, max_groups: int | None = MAX_RESULT_GROUPS
) -> PlanResult:
    """Check the plan against ``df`` and build its result.

    Ungrouped: one row (value, n_matched, n_used). Grouped: (keys…, value, n, n_rows, truncated),
    keys as text, the first ``max_groups`` groups in key order, or all for None. A key called like
    a result gets underscores after its name. Integers are summed without overflow.

    What can't be planned is an error value. The table is lazy: a value that Spark rejects only
    when it reads the rows raises there.
    """
    try:
        errors = plan_errors(plan, df.schema)
        if errors:
            return PlanResult(False, "; ".join(errors))
        zone(tz)
        rows = df.where(predicate(plan["filters"], df.schema, tz, now)) if plan.get("filters") else df
        table = _grouped(rows, plan, max_groups) if plan.get("group_by") else _scalar(rows, plan)
        return PlanResult(True, None, describe(plan, tz, now), tz, table, rows)
    except Exception as problem:  # a plan never raises; what Spark rejects is an error value too
        return PlanResult(False, f"{type(problem).__name__}: {problem}")


def _measures(rows: DataFrame, plan: dict) -> tuple[str, str]:
    """SQL of the value and of the number of values used."""
    if plan["aggregate"] == "count":
        return "count(*)", "count(*)"
    info = column_info(rows, plan["column"])
    value = info.value
    if plan["aggregate"] == "sum" and is_integral(info.data_type):
        value = f"cast({value} as decimal(38,0))"
    measure = f"{SQL_AGGREGATES[plan['aggregate']]}({value})"
    if plan["aggregate"] == "sum":
        measure = f"coalesce({measure}, 0)"
    return measure, f"count({value})"


def _scalar(rows: DataFrame, plan: dict) -> DataFrame:
    value, used = _measures(rows, plan)
    return rows.selectExpr(f"{value} as value", "count(*) as n_matched", f"{used} as n_used")


def _key_name(key: str) -> str:
    while key.lower() in RESULT_NAMES:
        key += "_"
    return key


def _grouped(rows: DataFrame, plan: dict, max_groups: int | None) -> DataFrame:
    """Keys are grouped under internal names, so that they may be called like results."""
    keys = plan["group_by"]
    value, used = _measures(rows, plan)
    infos = {c.name: c for c in column_infos(rows, names=keys)}
    inner = [f"__key_{i}" for i in range(len(keys))]
    present = rows.where(" and ".join(f"({infos[k].value}) is not null" for k in keys))
    named = present.selectExpr("*", *[f"{quoted(k)} as {n}" for k, n in zip(keys, inner)])
    counted = grouped(named, inner, value=value, n=used, n_rows="count(*)")
    shown = counted.selectExpr(*[f"{as_text(n, infos[k].data_type)} as {n}" for k, n in zip(keys, inner)], "value", "n", "n_rows")
    final = [f"{n} as {quoted(_key_name(k))}" for k, n in zip(keys, inner)]
    if max_groups is None:
        return shown.orderBy(*inner).selectExpr(*final, "value", "n", "n_rows", "false as truncated")
    # one group more than shown tells whether any were left out; max_groups + 1 rows at most from here on
    first = shown.orderBy(*inner).limit(max_groups + 1).selectExpr("*", f"count(*) over (partition by 0) > {max_groups} as truncated")
    return first.orderBy(*inner).limit(max_groups).selectExpr(*final, "value", "n", "n_rows", "truncated")


# -- explanation ---------------------------------------------------------------


def describe(plan: dict, tz: str = "UTC", now: datetime | None = None) -> str:
    """What the plan computes, with its relative dates resolved."""
    column = plan.get("column")
    said = ["count of matching rows" if plan["aggregate"] == "count" else f"{plan['aggregate']} of `{column}`"]
    bounds = {t: resolve_token(t, tz, now) for t in sorted(_tokens(plan.get("filters")))}
    if plan.get("filters"):
        said.append("where " + _describe(plan["filters"], bounds))
    if plan.get("group_by"):
        said.append("grouped by " + ", ".join(f"`{k}`" for k in plan["group_by"]))
    if bounds:
        said.append(f"[{tz}; " + ", ".join(f"{t}={at.isoformat()}" for t, at in bounds.items()) + "]")
    return " | ".join(said)


def _tokens(node: dict | None) -> set[str]:
    if node is None:
        return set()
    kids = children_of(node)
    if kids:
        return set().union(*[_tokens(kid) for kid in kids])
    return {v for v in operands(node) if is_token(v)}


def _describe(node: dict, bounds: dict[str, datetime]) -> str:
    op = node["op"]
    if op in ("and", "or"):
        return "(" + f" {op} ".join(_describe(kid, bounds) for kid in node["children"]) + ")"
    if op == "not":
        return f"not ({_describe(node['child'], bounds)})"
    shown = [str(bounds[v]) if is_token(v) else repr(v) for v in operands(node)]
    tail = {"between": " and ".join(shown), "in": f"({', '.join(shown)})", "not in": f"({', '.join(shown)})"}
    return f"`{node['column']}` {op} {tail.get(op, ''.join(shown))}".rstrip()
