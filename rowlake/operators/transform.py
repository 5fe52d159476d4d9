"""The row transform: rename, defaults, casts, required fields, filters, projections, computed fields, field operations,
deduplication or survivorship, sort, aggregate, quality gates and audit counts, in that order, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlake.functions.expressions import mini_expression, tree_expression
from rowlake.functions.fields import date_op, field_op, string_op
from rowlake.functions.values import NUMERIC, cast_to, col, kind_of, miss, num, number, truthy, vts, ymd
from rowlake.operators.aggregates import aggregate_stats
from rowlake.operators.filters import predicate

STATUS = "__status"
GATES = ("max_invalid_rows", "min_output_rows", "max_invalid_ratio", "max_required_missing_ratio", "max_filtered_rows", "max_duplicate_rows_removed", "allow_empty_output", "numeric_parse_rate_min", "date_parse_rate_min", "duplicate_key_ratio_max", "blank_row_ratio_max")


class QualityGateError(ValueError):
    pass


@dataclass
class Rules:
    rename_map: dict[str, str] = field(default_factory=dict)
    casts: dict[str, str] = field(default_factory=dict)
    filters: list[dict] = field(default_factory=list)
    required_fields: list[str] = field(default_factory=list)
    default_values: dict = field(default_factory=dict)
    null_values: list[str] = field(default_factory=list)
    trim_strings: bool = True
    include_fields: list[str] = field(default_factory=list)
    exclude_fields: list[str] = field(default_factory=list)
    computed_fields: dict[str, str] = field(default_factory=dict)
    string_ops: list[dict] = field(default_factory=list)
    date_ops: list[dict] = field(default_factory=list)
    field_ops: list[dict] = field(default_factory=list)
    deduplicate_by: list[str] = field(default_factory=list)
    deduplicate_keep: str = "last"
    survivorship: dict = field(default_factory=dict)
    sort_by: list = field(default_factory=list)
    aggregate: dict = field(default_factory=dict)
    strict_numbers: bool = False  # plain numbers with commas only, no currency grammar
    max_rows: int | None = None  # more input rows than that are an error

    @classmethod
    def of(cls, rules: dict) -> Rules:
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in rules.items() if k in known})


def _is(kind, to: str) -> bool:
    """Whether a cast to the named type leaves a column as it is."""
    return {"string": ("string", "str"), "long": ("int", "integer"), "double": ("float", "double", "number"), "boolean": ("bool", "boolean")}.get(kind.typeName(), ()).__contains__(to.lower())


def prepare(df: DataFrame, rules: Rules, keep_rejected: bool = True, counters: bool = False) -> DataFrame:
    """All rows, cleaned up to the filters, with __status: ok, cast_failed, required_missing or filter_rejected.

    keep_rejected=False gives the ok rows only, without __status, by plain filters that can reach the scan. counters
    adds __cells and __parsed, a row's cells under number casts that aren't missing and those of them that are numbers,
    and __hits, the names of the rules that rejected the row.
    """
    tokens = [str(x).lower() for x in rules.null_values]
    out: list[Column] = []
    renamed = {old: new for old, new in rules.rename_map.items() if old in df.columns}
    lost = set(renamed.values()) - set(renamed)
    for c in df.columns:
        if c in lost:
            continue  # a renamed column takes its name
        x = col(c)
        if kind_of(df, c).typeName() == "string":
            x = F.trim(x) if rules.trim_strings else x
            x = F.when(~F.lower(F.trim(x)).isin(tokens), x) if tokens else x
        out.append(x.alias(renamed.get(c, c)))
    df = df.select(*out)
    for c, value in rules.default_values.items():
        given = F.lit(value)
        df = df.withColumn(c, F.when(miss(col(c)), given.cast(kind_of(df, c))).otherwise(col(c)) if c in df.columns else given)
    known = {c: to for c, to in rules.casts.items() if c in df.columns}
    casts = {c: cast_to(col(c), kind_of(df, c), to, rules.strict_numbers) for c, to in known.items() if not _is(kind_of(df, c), to)}
    if rules.strict_numbers:  # absent columns under a cast are there, as null
        df = df.withColumns({c: F.lit(None).cast("string") for c in rules.casts if c not in df.columns})
    broken = [new.isNull() & (~miss(col(c)) if rules.strict_numbers else col(c).isNotNull()) for c, new in casts.items()]
    missing = [c for c in rules.required_fields if c not in df.columns]
    if not keep_rejected:
        for bad in broken:
            df = df.filter(~bad)
        df = df.withColumns(casts)
        for c in rules.required_fields:
            df = df.filter(F.lit(False) if c in missing else col(c).isNotNull() & ~miss(col(c)) if kind_of(df, c).typeName() == "string" else col(c).isNotNull())
        for spec in rules.filters:
            df = df.filter(predicate(df, spec))
        return df
    made = {"__failed": reduce(lambda a, b: a | b, broken, F.lit(False))}
    if counters:
        numeric = [c for c, to in known.items() if to.lower() in ("int", "integer", "float", "double", "number", "decimal")]
        one = lambda flags: sum((F.when(x, 1).otherwise(0) for x in flags), F.lit(0))
        made["__cells"], made["__parsed"] = one(~miss(col(c)) for c in numeric), one(~miss(col(c)) & casts.get(c, col(c)).isNotNull() for c in numeric)
        made["__hits"] = F.array(*(F.when(bad, F.lit(f"cast_fail_{c}")) for c, bad in zip(casts, broken))) if casts else F.array().cast("array<string>")
    df = df.withColumns(made).withColumns(casts)
    body = df.drop(*made)
    lacking = [miss(col(c)) if c in df.columns else F.lit(True) for c in rules.required_fields]
    passing = [F.coalesce(predicate(body, s), F.lit(False)) for s in rules.filters]
    absent = reduce(lambda a, b: a | b, lacking, F.lit(False))
    kept = reduce(lambda a, b: a & b, passing, F.lit(True))
    if counters:  # of each row the first rule that rejects it
        ways = [*(F.when(x, F.lit(f"required_missing_{c}")) for c, x in zip(rules.required_fields, lacking)), *(F.when(~x, F.lit(f"filter_{s.get('field') or s.get('op', '')}")) for s, x in zip(rules.filters, passing))]
        df = df.withColumn("__hits", F.slice(F.array_compact(F.concat("__hits", F.array(*ways))), 1, 1) if ways else F.slice(F.array_compact("__hits"), 1, 1))
    status = F.when(F.col("__failed"), "cast_failed").when(absent, "required_missing").when(~kept, "filter_rejected").otherwise("ok")
    return df.withColumn(STATUS, status).drop("__failed")


def deduplicate(df: DataFrame, by: list[str], order_by: list[str], keep: str = "last") -> DataFrame:
    """One row for each key text: the last or first in order_by."""
    order = [(col(c).desc_nulls_last() if keep == "last" else col(c).asc_nulls_first()) for c in order_by]
    w = Window.partitionBy(*(vts(col(c)) if c in df.columns else F.lit("") for c in by)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def survivorship(df: DataFrame, rule: dict, order_by: list[str]) -> DataFrame:
    """One row for each key: by score fields (dates over numbers over texts over missing, then larger), non-null, latest, then order."""
    made: dict[str, Column] = {}
    order: list[Column] = []
    for i, c in enumerate(rule.get("score_fields", [])):
        x, n = col(c), num(col(c), kind_of(df, c))
        dates = F.when(n.isNull() | x.cast("string").rlike("[-/年.].*[-/月.]"), ymd(x))
        made[f"__d{i}"] = F.lit(None).cast("struct<y:int,m:int,d:int>") if isinstance(kind_of(df, c), NUMERIC) else dates  # a number is no date
        made[f"__n{i}"] = n
        rank = F.when(miss(x), 0).when(F.col(f"__d{i}").isNotNull(), 3).when(F.col(f"__n{i}").isNotNull(), 2).otherwise(1)
        order += [rank.desc(), F.col(f"__d{i}").desc(), F.when(F.col(f"__d{i}").isNull(), F.col(f"__n{i}")).desc(), F.when(rank == 1, vts(x)).desc()]
    order += [miss(col(c)).asc() for c in rule.get("prefer_non_null_fields", [])]
    for i, c in enumerate(rule.get("prefer_latest_fields", [])):
        made[f"__l{i}"] = ymd(F.substring(col(c).cast("string"), 1, 10))
        order += [F.col(f"__l{i}").desc_nulls_last(), vts(col(c)).desc()]
    last = rule.get("tie_breaker", "last") == "last"
    order += [col(c).desc() if last else col(c).asc() for c in order_by]
    w = Window.partitionBy(*(vts(col(c)) for c in rule["keys"])).orderBy(*order)
    return df.withColumns(made).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", *made)


def sort_rows(df: DataFrame, by: list, numeric: bool = False) -> DataFrame:
    """By the text of each key; numeric sorts by number with nulls last in both directions."""
    order: list[Column] = []
    for key in by:
        name, way = (key, "asc") if isinstance(key, str) else (key["field"], str(key.get("order", "asc")).lower())
        if numeric:
            x = number(df, name)
            order.append(x.desc_nulls_last() if way == "desc" else x.asc_nulls_last())
        else:
            x = vts(col(name)) if name in df.columns else F.lit("")
            order.append(x.desc() if way == "desc" else x.asc())
    return df.orderBy(*order)


@dataclass
class Result:
    df: DataFrame
    audit: DataFrame
    aggregate: DataFrame | None


def transform(df: DataFrame, rules: Rules | dict, order_by: list[str] | None = None, numeric_sort: bool = False, filter_expr=None, computed: list[dict] | None = None) -> Result:
    """The cleaned rows, the counts by status, and the aggregate. order_by says what comes first and last among the rows of a key.

    filter_expr and computed are expression trees and apply last; neither the aggregate nor the counts reflect them.
    """
    rules = rules if isinstance(rules, Rules) else Rules.of(rules)
    if rules.max_rows is not None and df.limit(rules.max_rows + 1).count() > rules.max_rows:
        raise ValueError(f"more than {rules.max_rows} rows")
    audit = prepare(df, rules).groupBy(STATUS).agg(F.count("*").alias("rows")).withColumnRenamed(STATUS, "status")
    out = prepare(df, rules, keep_rejected=False)
    if rules.include_fields:
        out = out.select(*(col(c) for c in rules.include_fields if c in out.columns))
    out = out.drop(*rules.exclude_fields)
    for c in sorted(rules.computed_fields):
        out = out.withColumn(c, mini_expression(out, rules.computed_fields[c]))
    for step, specs in ((string_op, rules.string_ops), (date_op, rules.date_ops), (field_op, rules.field_ops)):
        for spec in specs:
            out = step(out, spec)
    order_by = order_by or [c for c in out.columns]
    if rules.survivorship:
        out = survivorship(out, {"keys": rules.deduplicate_by, **rules.survivorship}, order_by)
    elif rules.deduplicate_by:
        out = deduplicate(out, rules.deduplicate_by, order_by, rules.deduplicate_keep)
    if rules.sort_by:
        out = sort_rows(out, rules.sort_by, numeric_sort)
    total = None
    if rules.aggregate:
        total = aggregate_stats(out, rules.aggregate.get("group_by", []), rules.aggregate.get("metrics") or [{"op": "sum", "field": "amount", "as": "sum_amount"}])
    if filter_expr is not None:
        c, kind = tree_expression(out, filter_expr)
        out = out.filter(truthy(c, kind))
    for spec in computed or []:
        out = out.withColumn(spec.get("as") or spec["field"], tree_expression(out, spec["expr"])[0])
    return Result(out, audit, total)


def quality_metrics(df: DataFrame, rules: Rules | dict, order_by: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """One row of counts and rates of a transform: its input by status, the cells that casts and date operations read, and its output.

    required: the fields whose missing cells are counted in the output, by default the required ones.
    """
    rules = rules if isinstance(rules, Rules) else Rules.of(rules)
    staged, ok = prepare(df, rules, counters=True), F.col(STATUS) == "ok"
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    ratio = lambda a, b, none: F.when(b > 0, a / b).otherwise(none)
    dates = [s["field"] for s in [*rules.date_ops, *(s for s in rules.field_ops if s.get("op") == "parse_date")] if s["field"] in staged.columns]
    there, read = ([ok & ~miss(col(c)) for c in dates], [ok & ~miss(col(c)) & ymd(col(c)).isNotNull() for c in dates])
    one = staged.agg(
        F.count("*").alias("input_rows"), n(F.col(STATUS) == "cast_failed").alias("invalid_rows"), n(F.col(STATUS) == "required_missing").alias("required_missing_rows"), n(F.col(STATUS).isin("filter_rejected", "required_missing")).alias("filtered_rows"), n(ok).alias("passed_rows"),
        total("__cells").alias("numeric_cells_total"), total("__parsed").alias("numeric_cells_parsed"), sum((n(x) for x in there), F.lit(0).cast("long")).alias("date_cells_total"), sum((n(x) for x in read), F.lit(0).cast("long")).alias("date_cells_parsed"),
    )
    out = transform(df, Rules(**{**rules.__dict__, "sort_by": [], "aggregate": {}}), order_by).df
    fields = rules.required_fields if required is None else required
    blank = reduce(lambda x, y: x & y, (miss(col(c)) for c in out.columns), F.lit(True))
    lacking = [n(miss(col(c)) if c in out.columns else F.lit(True)) for c in fields]
    two = out.agg(F.count("*").alias("output_rows"), n(blank).alias("blank_rows"), sum(lacking, F.lit(0).cast("long")).alias("required_missing_cells"))
    both = one.crossJoin(two).withColumn("duplicate_rows_removed", F.col("passed_rows") - F.col("output_rows"))  # one row each
    c = F.col
    return both.withColumns({
        "invalid_ratio": ratio(c("invalid_rows"), c("input_rows"), 0.0), "required_missing_ratio": ratio(c("required_missing_cells"), c("output_rows") * max(1, len(fields)), 0.0), "duplicate_key_ratio": ratio(c("duplicate_rows_removed"), c("passed_rows"), 0.0),
        "blank_row_ratio": ratio(c("blank_rows"), c("output_rows"), 0.0), "numeric_parse_rate": ratio(c("numeric_cells_parsed"), c("numeric_cells_total"), 1.0), "date_parse_rate": ratio(c("date_cells_parsed"), c("date_cells_total"), 1.0),
    })


#: A gate's metric, and 1 where it may be the bound at most, -1 where at least.
_LIMITS = {
    "max_invalid_rows": ("invalid_rows", 1), "max_filtered_rows": ("filtered_rows", 1), "max_duplicate_rows_removed": ("duplicate_rows_removed", 1), "max_invalid_ratio": ("invalid_ratio", 1), "max_required_missing_ratio": ("required_missing_ratio", 1),
    "duplicate_key_ratio_max": ("duplicate_key_ratio", 1), "blank_row_ratio_max": ("blank_row_ratio", 1), "min_output_rows": ("output_rows", -1), "numeric_parse_rate_min": ("numeric_parse_rate", -1), "date_parse_rate_min": ("date_parse_rate", -1),
}


def gate_report(metrics: DataFrame, gates: dict) -> DataFrame:
    """A row for each gate: gate, value, bound and passed, from one row of metrics. Unknown gates and gates without their metric raise."""
    rows = []
    for gate, bound in gates.items():
        if gate == "allow_empty_output":
            value, limit, passed = F.col("output_rows").cast("double"), 0.0 if bound else 1.0, F.lit(bool(bound)) | (F.col("output_rows") > 0)
        elif gate not in _LIMITS:
            raise ValueError(f"unknown gate {gate!r}")
        elif bound is None:
            continue
        else:
            name, sign = _LIMITS[gate]
            if name not in metrics.columns:
                raise ValueError(f"{gate} needs the metric {name}")
            value, limit = F.col(name).cast("double"), float(bound)
            passed = value * sign <= limit * sign
        rows.append(F.struct(F.lit(gate).alias("gate"), value.alias("value"), F.lit(limit).alias("bound"), passed.alias("passed")))
    if not rows:
        raise ValueError("no gates")
    return metrics.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def check_gates(metrics: dict, gates: dict) -> None:
    """Raises QualityGateError for the first gate that the metrics miss, ValueError for an unknown gate or one without its metric."""
    for gate, bound in gates.items():
        if gate == "allow_empty_output":
            if not bound and not metrics["output_rows"]:
                raise QualityGateError("the output is empty")
        elif gate not in _LIMITS:
            raise ValueError(f"unknown gate {gate!r}")
        elif bound is not None:
            name, sign = _LIMITS[gate]
            if metrics.get(name) is None:
                raise ValueError(f"{gate} needs the metric {name}")
            if sign * (metrics[name] - bound) > 0:
                raise QualityGateError(f"{name} is {metrics[name]}; {gate} is {bound}")


def rule_hits(df: DataFrame, rules: Rules | dict, order_by: list[str] | None = None) -> DataFrame:
    """reason and rows: how often each cast, required field and filter was the first to reject a row, and duplicate_removed."""
    rules = rules if isinstance(rules, Rules) else Rules.of(rules)
    hits = prepare(df, rules, counters=True).select(F.explode("__hits").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))
    if not (rules.deduplicate_by or rules.survivorship):
        return hits
    gone = quality_metrics(df, rules, order_by).filter("duplicate_rows_removed > 0").select(F.lit("duplicate_removed").alias("reason"), F.col("duplicate_rows_removed").alias("rows"))
    return hits.unionByName(gone)


def run_transform(df: DataFrame, rules: Rules | dict, gates: dict | None = None, **options) -> Result:
    """transform, after its quality gates."""
    if gates:
        gates = dict(gates)
        required = gates.pop("required_fields", None)
        check_gates(quality_metrics(df, rules, options.get("order_by"), required).first().asDict(), gates)
    return transform(df, rules, **options)


def reason_samples(df: DataFrame, rules: Rules | dict, order_by: list[str], limit: int = 5) -> DataFrame:
    """The first rows of each reason (cast_failed, required_missing, filter_rejected, and duplicate_removed by deduplicate_by), as JSON."""
    rules = rules if isinstance(rules, Rules) else Rules.of(rules)
    staged = prepare(df, rules)
    if rules.deduplicate_by:
        keep = [(col(c).desc_nulls_last() if rules.deduplicate_keep == "last" else col(c).asc_nulls_first()) for c in order_by]
        keys = [vts(col(c)) if c in staged.columns else F.lit("") for c in rules.deduplicate_by]
        later = F.row_number().over(Window.partitionBy(F.col(STATUS), *keys).orderBy(*keep)) > 1
        staged = staged.withColumn("__later", later).withColumn(STATUS, F.when((F.col(STATUS) == "ok") & F.col("__later"), "duplicate_removed").otherwise(F.col(STATUS))).drop("__later")
    staged = staged.filter(F.col(STATUS) != "ok")
    w = Window.partitionBy(STATUS).orderBy(*(col(c) for c in order_by))
    rows = staged.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= min(100, limit))
    return rows.select(F.col(STATUS).alias("status"), F.to_json(F.struct(*(col(c) for c in staged.columns if c != STATUS))).alias("row"))


def clean_finance(df: DataFrame, digits: int = 2, drop_negative: bool = False, low: float | None = None, high: float | None = None, order_by: list[str] | None = None) -> DataFrame:
    """id and amount parsed, bounded and rounded half up; the last row of each id, in order of id."""
    id_, amount = cast_to(col("id"), kind_of(df, "id"), "int"), number(df, "amount")
    out = df.select(id_.alias("id"), amount.alias("amount"), *(col(c).alias(f"__o{i}") for i, c in enumerate(order_by or []))).filter("id is not null and amount is not null")
    out = out.filter("amount >= 0") if drop_negative else out
    out = out.filter(F.col("amount") >= low) if low is not None else out
    out = out.filter(F.col("amount") <= high) if high is not None else out
    out = out.withColumn("amount", F.round(F.col("amount"), min(6, max(0, digits))))
    return deduplicate(out, ["id"], [f"__o{i}" for i in range(len(order_by or []))] or ["amount"]).select("id", "amount").orderBy("id")


def clean_finance_report(df: DataFrame, drop_negative: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """A row for each reason why clean_finance leaves rows out (invalid_id, invalid_amount, negative, below_min, above_max, duplicate), and for input and output: reason and rows."""
    id_, amount = cast_to(col("id"), kind_of(df, "id"), "int"), number(df, "amount")
    reason = F.when(id_.isNull(), "invalid_id").when(amount.isNull(), "invalid_amount")
    reason = reason.when(amount < 0, "negative") if drop_negative else reason
    reason = reason.when(amount < low, "below_min") if low is not None else reason
    reason = reason.when(amount > high, "above_max") if high is not None else reason
    counts = df.select(id_.alias("id"), F.coalesce(reason, F.lit("ok")).alias("reason")).groupBy("reason", F.when(F.col("reason") == "ok", F.col("id")).alias("id")).agg(F.count("*").alias("n"))
    told = counts.groupBy("reason").agg(F.sum("n").alias("n"), F.count("*").alias("ids"))
    parts = F.when(F.col("reason") == "ok", F.array(F.struct(F.lit("output").alias("reason"), F.col("ids").alias("rows")), F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - F.col("ids")).alias("rows")))).otherwise(F.array(F.struct(F.col("reason").alias("reason"), F.col("n").alias("rows"))))
    every = told.select(F.explode(F.concat(parts, F.array(F.struct(F.lit("input").alias("reason"), F.col("n").alias("rows"))))).alias("x"))
    return every.groupBy(F.col("x.reason").alias("reason")).agg(F.sum("x.rows").alias("rows")).filter("rows > 0")


def normalize_schema(df: DataFrame, fields: list[str], defaults: dict | None = None) -> DataFrame:
    """Adds the absent fields, from defaults or null; what is there stays."""
    return df.withColumns({c: F.lit((defaults or {}).get(c)) if (defaults or {}).get(c) is not None else F.lit(None).cast("string") for c in fields if c not in df.columns})


def clean_generic(df: DataFrame, rules: Rules | dict, order_by: list[str]) -> DataFrame:
    """The other order of stages: projection before defaults, computed fields and text operations before casts, and required fields and filters last before deduplication.

    Null tokens are null, none, na and n/a unless given; a failed cast drops the row; the sort is typed, nulls last ascending and first descending.
    """
    r = rules if isinstance(rules, Rules) else Rules.of(rules)
    out = prepare(df, Rules(rename_map=r.rename_map, null_values=r.null_values or ["null", "none", "na", "n/a"], trim_strings=r.trim_strings), keep_rejected=False)
    out = out.select(*(col(c) for c in r.include_fields if c in out.columns)) if r.include_fields else out
    out = prepare(out.drop(*r.exclude_fields), Rules(default_values=r.default_values, trim_strings=False), keep_rejected=False)
    for c in sorted(r.computed_fields):
        out = out.withColumn(c, mini_expression(out, r.computed_fields[c]))
    for spec in r.string_ops:
        out = string_op(out, spec)
    out = prepare(out, Rules(casts=r.casts, trim_strings=False), keep_rejected=False)
    for step, specs in ((date_op, r.date_ops), (field_op, r.field_ops)):
        for spec in specs:
            out = step(out, spec)
    out = prepare(out, Rules(required_fields=r.required_fields, filters=r.filters, trim_strings=False), keep_rejected=False)
    out = deduplicate(out, r.deduplicate_by, order_by, r.deduplicate_keep) if r.deduplicate_by else out
    keys = [(k, "asc") if isinstance(k, str) else (k["field"], str(k.get("order", "asc")).lower()) for k in r.sort_by]
    return out.orderBy(*(col(k).desc_nulls_first() if way == "desc" else col(k).asc_nulls_last() for k, way in keys)) if keys else out


def transform_chunks(df: DataFrame, rules: Rules | dict, order_by: str, size: int = 2000, after=None, done: int = -1, most: int | None = None) -> tuple[DataFrame, dict]:
    """The transform of chunks of consecutive rows, resumed behind chunk `done`: each row keeps its chunk_id, deduplication is within chunks. Also {last_chunk, has_more}."""
    from rowlake.streaming.windows import chunk_ids

    numbered = chunk_ids(df, order_by, size, after)
    last = numbered.agg(F.max("chunk_id")).first()[0]
    last = -1 if last is None else last
    end = last if most is None else min(last, done + most)
    r = rules if isinstance(rules, Rules) else Rules.of(rules)
    within = Rules(**{**r.__dict__, "deduplicate_by": [*r.deduplicate_by, "chunk_id"] if r.deduplicate_by else []})
    return transform(numbered.filter((F.col("chunk_id") > done) & (F.col("chunk_id") <= end)), within, [order_by]).df, {"last_chunk": end, "has_more": end < last}
