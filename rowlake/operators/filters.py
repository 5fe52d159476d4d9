"""Row filters: a specification compiled to a Column that is true for the rows that stay."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlake.functions.values import NUMERIC, col, kind_of, miss, num, plain_number, vts

#: Words of subtotal and note rows, and names that a repeated header row holds.
SUBTOTAL = ["subtotal", "sub total", "total", "grand total", "合计", "小计", "本页合计", "累计", "汇总"]
NOTES = ["note", "notes", "备注", "说明", "注", "附注"]
HEADERS = ["id", "amount", "currency", "biz_date", "account_no", "txn_date", "debit_amount", "credit_amount", "balance", "counterparty_name", "remark", "ref_no", "txn_type", "customer_name", "phone", "city"]


def _json_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _same(c: Column, kind: T.DataType, values: list) -> Column:
    """Whether the text of a cell is one of the values' texts; plain comparisons of strings and integers, which reach the scan."""
    wanted = [_json_text(v) for v in values]
    if isinstance(kind, _WHOLE):
        numbers = [int(v) for v in wanted if re.fullmatch(r"0|-?[1-9]\d{0,17}", v)]
        out = (c == numbers[0]) if len(numbers) == 1 else c.isin(numbers) if numbers else F.lit(False)
        return out | c.isNull() if "" in wanted else out
    if isinstance(kind, T.StringType):
        out = (c == wanted[0]) if len(wanted) == 1 else c.isin(wanted) if wanted else F.lit(False)
        return out | c.isNull() if "" in wanted else out
    return vts(c).isin(wanted) if wanted else F.lit(False)


def predicate(df: DataFrame, spec: dict) -> Column:
    """The Column of one filter; null counts as false. Unknown operations pass all rows; invalid values pass none."""
    op = str(spec.get("op", "eq")).lower()
    if op in ("blank_row", "subtotal_row", "note_row", "header_repeat_row"):
        return _row_predicate(df, op, spec)
    name, value = spec.get("field", ""), spec.get("value")
    c, kind = (col(name), kind_of(df, name)) if name in df.columns else (F.lit(None).cast("string"), T.StringType())
    text = vts(c)
    match op:
        case "exists":
            return ~miss(c)
        case "not_exists":
            return miss(c)
        case "eq":
            return _same(c, kind, [value])
        case "ne":
            return ~F.coalesce(_same(c, kind, [value]), F.lit(False))
        case "contains":
            return (c if isinstance(kind, T.StringType) and value else text).contains(F.lit(_json_text(value)))
        case "in" | "not_in":
            if not isinstance(value, list):
                return F.lit(False)
            inside = _same(c, kind, value)
            return inside if op == "in" else ~F.coalesce(inside, F.lit(False))
        case "regex" | "not_regex":
            pattern = _json_text(value)
            if not pattern.strip() or len(pattern) > 1024 or not _compiles(pattern):
                return F.lit(False)
            return text.rlike(pattern) if op == "regex" else ~text.rlike(pattern)
        case "gt" | "gte" | "lt" | "lte":
            bound = value if isinstance(value, (int, float)) and not isinstance(value, bool) else None
            target = F.lit(float(bound)) if bound is not None else num(F.lit(_json_text(value)))
            x = num(c, kind)
            return {"gt": x > target, "gte": x >= target, "lt": x < target, "lte": x <= target}[op]
    return F.lit(True)


def typed_predicate(df: DataFrame, spec: dict) -> Column:
    """The filters of text pre-processing: a value equals only one of its own kind (numbers among each other, 10 = 10.0), null equals null, texts read None where a cell is null.

    The four that look at whole rows are unknown here; a registered filter of that name is used, else unknown ones raise.
    """
    from rowlake.plans.registry import ROW_FILTERS

    op, name, value = str(spec.get("op", "eq")).lower(), str(spec.get("field") or "").strip(), spec.get("value")
    if op in ROW_FILTERS:
        return F.coalesce(ROW_FILTERS.get(op)(df, spec), F.lit(False))
    if op not in ("exists", "not_exists", "eq", "ne", "in", "not_in", "contains", "regex", "not_regex", "gt", "gte", "lt", "lte"):
        raise ValueError(f"unknown filter {op!r}")
    if not name and op not in ("exists", "not_exists"):
        return F.lit(True)
    c, kind = (col(name), kind_of(df, name)) if name in df.columns else (F.lit(None).cast("string"), T.StringType())
    text = F.coalesce(c.cast("string"), F.lit("None"))

    def same(v) -> Column:
        if v is None:
            return c.isNull()
        if isinstance(v, bool):
            fits = isinstance(kind, T.BooleanType)
        elif isinstance(v, (int, float)):
            fits = isinstance(kind, NUMERIC)
        else:
            fits = isinstance(kind, T.StringType) and isinstance(v, str)
        return F.coalesce(c == F.lit(v), F.lit(False)) if fits else F.lit(False)

    match op:
        case "exists" | "not_exists":
            return ~miss(c) if op == "exists" else miss(c)
        case "eq" | "ne":
            return same(value) if op == "eq" else ~same(value)
        case "in" | "not_in":
            inside = reduce(lambda a, b: a | b, map(same, value if isinstance(value, list) else []), F.lit(False))
            return inside if op == "in" else ~inside
        case "contains":
            return text.contains(F.lit(str(value)))
        case "regex" | "not_regex":
            if not _compiles(str(value)):
                return F.lit(False)
            return text.rlike(str(value)) if op == "regex" else ~text.rlike(str(value))
    x, bound = (c.cast("double") if isinstance(kind, NUMERIC) else plain_number(c)), plain_number(F.lit(str(value)))
    return F.coalesce({"gt": x > bound, "gte": x >= bound, "lt": x < bound, "lte": x <= bound}[op], F.lit(False))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _row_predicate(df: DataFrame, op: str, spec: dict) -> Column:
    names = sorted(df.columns)
    cells = [vts(col(x)) for x in names]
    any_of = lambda flags: reduce(lambda a, b: a | b, flags, F.lit(False))
    if op == "blank_row":
        return F.concat_ws(" ", *cells).rlike(r"[\p{L}\p{N}]")
    if op == "subtotal_row":
        words = [w.lower() for w in spec.get("keywords", SUBTOTAL)]
        return ~any_of(F.lower(c).contains(w) for c in cells for w in words)
    if op == "note_row":
        first = F.coalesce(*(F.when(~miss(col(x)), F.lower(vts(col(x)))) for x in names), F.lit(""))
        return ~any_of(first.contains(w.lower()) for w in spec.get("keywords", NOTES))
    known = [h.lower() for h in spec.get("headers", HEADERS)]
    hits = reduce(lambda a, b: a + b, (F.when(F.lower(F.trim(c)).isin(known), 1).otherwise(0) for c in cells), F.lit(0))
    return hits < int(spec.get("min_matches", 2))


def apply_filters(df: DataFrame, specs: list[dict], typed: bool = False) -> DataFrame:
    make = typed_predicate if typed else predicate
    return df.filter(reduce(lambda a, b: a & b, (make(df, s) for s in specs))) if specs else df


def columnar_eval(df: DataFrame, where: dict | None = None, select: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose texts equal the given ones (unknown columns are ignored), as text columns, `limit` at most if there is one."""
    for name, value in (where or {}).items():
        if name in df.columns:
            df = df.filter(vts(col(name)) == _json_text(value))
    out = df.select(*(col(c).cast("string").alias(c) for c in (select or df.columns) if c in df.columns))
    return out if limit is None else out.limit(limit)


def query_lang(df: DataFrame, text: str) -> DataFrame:
    """One clause: where f OP v, select a,b, or limit n."""
    word, _, rest = text.strip().partition(" ")
    if word == "select":
        return df.select(*(col(c.strip()) for c in rest.split(",") if c.strip() in df.columns))
    if word == "limit":
        return df.limit(int(rest) if rest.strip().isdigit() else 100)
    if word != "where":
        raise ValueError(f"unknown clause {word!r}")
    for op in ("==", "!=", ">=", "<=", ">", "<"):
        if op in rest:
            name, value = (x.strip() for x in rest.split(op, 1))
            value = value.strip("'\"")
            c = col(name) if name in df.columns else F.lit(None).cast("string")
            if op in ("==", "!="):
                return df.filter(vts(c) == value if op == "==" else vts(c) != value)
            a, b = plain_number(c), plain_number(F.lit(value))
            out = {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[op]
            return df.filter(F.coalesce(out, F.lit(False)))
    return df
