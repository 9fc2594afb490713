"""Check a plan against a schema before anything runs; problems are values."""

from __future__ import annotations

from pyspark.sql import types as T

from datasonde.functions.fixed_values import MAX_FILTER_NODES, MAX_GROUP_COLUMNS, MAX_IN_VALUES
from datasonde.functions.kinds import DATETIME, NUMERIC, kind_of
from datasonde.plans.dates import is_iso, is_token

AGGREGATES = ("count", "count_nonnull", "sum", "mean", "min", "max")
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
ORDERED = ("<", "<=", ">", ">=", "between")
BRANCHES = ("and", "or")
MEMBERSHIP = ("in", "not in")
PRESENCE = ("is null", "not null")


def plan_errors(plan: object, schema: T.StructType) -> list[str]:
    """Everything wrong with the plan; an empty list means it can run."""
    if not isinstance(plan, dict):
        return ["a plan must be an object"]
    aggregate, column = plan.get("aggregate"), plan.get("column")
    if aggregate not in AGGREGATES:
        return [f"aggregate must be one of {', '.join(AGGREGATES)}"]
    errors = []
    if aggregate == "count":
        if column is not None:
            errors.append("'count' counts matching rows and takes no column")
    elif column not in schema.names:
        return [f"metric column {column!r} not found"]
    elif aggregate in ("sum", "mean") and kind_of(schema[column].dataType) != NUMERIC:
        errors.append(f"aggregate '{aggregate}' needs a numeric column")
    if plan.get("filters") is not None:
        errors += filter_errors(plan["filters"], schema)
        if count_nodes(plan["filters"]) > MAX_FILTER_NODES:
            errors.append(f"the filter tree exceeds {MAX_FILTER_NODES} nodes")
    return errors + _group_errors(plan.get("group_by"), schema)


def _group_errors(keys: object, schema: T.StructType) -> list[str]:
    if keys is None:
        return []
    if not isinstance(keys, list) or not keys:
        return ["'group_by' must be a list of columns or null"]
    errors = []
    if len(keys) > MAX_GROUP_COLUMNS:
        errors.append(f"'group_by' takes at most {MAX_GROUP_COLUMNS} columns")
    return errors + [f"group-by column {k!r} not found" for k in keys if k not in schema.names]


def children_of(node: object) -> list:
    if not isinstance(node, dict):
        return []
    if node.get("op") == "not":
        return [node.get("child")]
    kids = node.get("children")
    return kids if isinstance(kids, list) else []


def count_nodes(node: object) -> int:
    total, todo = 0, [node]
    while todo:
        current = todo.pop()
        total += 1
        todo += children_of(current)
    return total


def operands(node: dict) -> list:
    """The literal operands of a leaf."""
    if node["op"] in MEMBERSHIP:
        return node["values"]
    if node["op"] == "between":
        return [node["low"], node["high"]]
    return [node["value"]] if node["op"] in COMPARISONS else []


def filter_errors(node: object, schema: T.StructType) -> list[str]:
    if not isinstance(node, dict) or "op" not in node:
        return ["a filter node must be an object with an 'op'"]
    op = node["op"]
    if op in BRANCHES:
        kids = children_of(node)
        if len(kids) < 2:
            return [f"'{op}' needs at least two children"]
        return [e for kid in kids for e in filter_errors(kid, schema)]
    if op == "not":
        return filter_errors(node["child"], schema) if "child" in node else ["'not' needs a 'child'"]
    if op not in (*COMPARISONS, *MEMBERSHIP, *PRESENCE, "between"):
        return [f"unknown filter op {op!r}"]
    if node.get("column") not in schema.names:
        return [f"filter column {node.get('column')!r} not found"]
    missing = _missing_operand(node)
    if missing:
        return [missing]
    data_type = schema[node["column"]].dataType
    found = [_operand_error(node, v, data_type) for v in operands(node)]
    return [e for e in found if e]


def _missing_operand(node: dict) -> str | None:
    op = node["op"]
    if op in MEMBERSHIP:
        values = node.get("values")
        if not isinstance(values, list) or not values:
            return f"'{op}' needs a non-empty list of 'values'"
        if len(values) > MAX_IN_VALUES:
            return f"'{op}' takes at most {MAX_IN_VALUES} values"
    elif op == "between" and not {"low", "high"} <= node.keys():
        return "'between' needs 'low' and 'high'"
    elif op in COMPARISONS and "value" not in node:
        return f"'{op}' needs a 'value'"
    return None


def _operand_error(node: dict, value: object, data_type: T.DataType) -> str | None:
    kind, column = kind_of(data_type), node["column"]
    if kind == DATETIME:
        if not is_token(value) and not is_iso(value):
            return f"column '{column}' is datetime; {value!r} must be an @-token or ISO 8601 text"
    elif kind == NUMERIC:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return f"column '{column}' is numeric; {value!r} must be a number"
    elif node["op"] in ORDERED:
        return f"'{node['op']}' needs a numeric or datetime column, '{column}' is neither"
    return None
