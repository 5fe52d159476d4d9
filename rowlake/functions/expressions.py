"""Computed fields: the one-call expressions fn(a, b) and the JSON expression tree, compiled to Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlake.functions.values import NUMERIC, col, kind_of, miss, num, truthy, vts

EPSILON = 2.220446049250313e-16
_DOUBLE, _STRING, _BOOL = T.DoubleType(), T.StringType(), T.BooleanType()


def _literal(value) -> tuple[Column, T.DataType]:
    if value is None:
        return F.lit(None).cast("string"), _STRING
    if isinstance(value, bool):
        return F.lit(value), _BOOL
    if isinstance(value, int):
        return F.lit(value).cast("long"), T.LongType()
    return F.lit(value), _DOUBLE if isinstance(value, float) else _STRING


def _argument(df: DataFrame, text: str) -> tuple[Column, T.DataType]:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return _literal(text[1:-1])
    if re.fullmatch(r"[+-]?\d+", text):
        return _literal(int(text))
    if re.fullmatch(r"[+-]?\d*\.\d+|[+-]?\d+\.\d*", text):
        return _literal(float(text))
    name = text.removeprefix("$")
    return (col(name), kind_of(df, name)) if name in df.columns else _literal(None)


def mini_expression(df: DataFrame, text: str) -> Column:
    """add sub mul div concat coalesce lower upper trim over fields, literals and numbers; anything else is null."""
    m = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", text, re.S)
    if not m:
        return _argument(df, text)[0]
    args = [_argument(df, x) for x in m[2].split(",")] if m[2].strip() else []
    numbers = [F.coalesce(num(*x), F.lit(0.0)) for x in args] + [F.lit(0.0)] * 2
    first = vts(args[0][0]) if args else F.lit("")
    match m[1].lower():
        case "add":
            return numbers[0] + numbers[1]
        case "sub":
            return numbers[0] - numbers[1]
        case "mul":
            return numbers[0] * numbers[1]
        case "div":
            return F.when(numbers[1] != 0, F.try_divide(numbers[0], numbers[1]))
        case "concat":
            return F.concat(*(vts(c) for c, _ in args)) if args else F.lit("")
        case "coalesce":
            same = len({k.simpleString() for _, k in args}) == 1
            return F.coalesce(*(F.when(~miss(c), c if same else c.cast("string")) for c, _ in args)) if args else F.lit(None).cast("string")
        case "lower":
            return F.lower(first)
        case "upper":
            return F.upper(first)
        case "trim":
            return F.trim(first)
    return F.lit(None).cast("string")


def tree_expression(df: DataFrame, node) -> tuple[Column, T.DataType]:
    """The Column of a JSON tree ({const}, {field}, {op, args}, {if, then, else}, {expr} or a scalar), and its type."""
    if not isinstance(node, dict):
        if isinstance(node, list):
            raise ValueError("an expression must be an object or a scalar")
        return _literal(node)
    if "const" in node:
        return _literal(node["const"])
    if "field" in node:
        name = node["field"]
        return (col(name), kind_of(df, name)) if name in df.columns else _literal(None)
    if "op" in node:
        return _operation(df, str(node["op"]).lower(), [tree_expression(df, x) for x in node.get("args", [])])
    if "if" in node:
        test, kind = tree_expression(df, node["if"])
        flag = F.coalesce(test, F.lit(False)) if isinstance(kind, T.BooleanType) else F.coalesce(num(test, kind) != 0, F.lit(False))
        (a, ka), (b, kb) = tree_expression(df, node.get("then")), tree_expression(df, node.get("else"))
        if ka != kb:
            both = all(isinstance(k, NUMERIC) for k in (ka, kb))
            a, b, ka = (a.cast("double"), b.cast("double"), _DOUBLE) if both else (a.cast("string"), b.cast("string"), _STRING)
        return F.when(flag, a).otherwise(b), ka
    if "expr" in node:
        return tree_expression(df, node["expr"])
    raise ValueError(f"not an expression: {node}")


def _operation(df: DataFrame, op: str, args: list) -> tuple[Column, T.DataType]:
    def number(i: int, default: float = 0.0) -> Column:
        return F.coalesce(num(*args[i]), F.lit(default)) if i < len(args) else F.lit(default)

    def text(i: int) -> Column:
        return vts(args[i][0]) if i < len(args) else F.lit("")

    if op in ("add", "mul"):
        out = F.lit(0.0 if op == "add" else 1.0)
        for i in range(len(args)):
            out = out + number(i) if op == "add" else out * number(i, 1.0)
        return out, _DOUBLE
    if op == "sub":
        return number(0) - number(1), _DOUBLE
    if op == "div":
        return F.when(F.abs(number(1)) >= EPSILON, F.try_divide(number(0), number(1))), _DOUBLE
    if op in ("eq", "ne"):
        return (text(0) == text(1)) if op == "eq" else (text(0) != text(1)), _BOOL
    if op in ("gt", "gte", "lt", "lte"):
        a, b = number(0), number(1)
        return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op], _BOOL
    if op in ("and", "or"):
        out = F.lit(op == "and")
        for c, k in args:
            out = out & truthy(c, k) if op == "and" else out | truthy(c, k)
        return out, _BOOL
    if op == "not":
        return ~truthy(*args[0]) if args else F.lit(True), _BOOL
    if op == "concat":
        return F.concat(F.lit(""), *(vts(c) for c, _ in args)), _STRING
    if op in ("lower", "upper", "trim"):
        return {"lower": F.lower, "upper": F.upper, "trim": F.trim}[op](text(0)), _STRING
    raise ValueError(f"no operation {op!r}")


def fields_of(node) -> set[str]:
    """The fields that a tree, or the $fields that a one-call expression, reads; branches of {if} aren't followed."""
    if isinstance(node, str):
        return set(re.findall(r"\$([\w.]+)", node))
    if isinstance(node, list):
        return set().union(*map(fields_of, node)) if node else set()
    if not isinstance(node, dict):
        return set()
    out = {node["field"]} if "field" in node else set()
    for key in ("args", "expr"):
        if key in node:
            out |= fields_of(node[key]) if not isinstance(node[key], str) else set()
    return out
