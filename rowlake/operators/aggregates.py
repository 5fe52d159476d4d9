"""Grouped aggregates: plain, statistical, sketched and verified, and pivots for charts.

Group keys go by their text, so null and blank are one group. Percentiles are nearest-rank: the value at index
round((n - 1) p) of the sorted numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlake.functions.values import col, kind_of, number, vts
from rowlake.operators.ranges import percentiles

BASIC = ("count", "sum", "avg", "min", "max")
SKETCHED = re.compile(r"approx_count_distinct(?:_hll)?|hll_count|topk(?:_\d+)?|tdigest_p\d+|approx_percentile_p?\d+|approx_p\d+")


def parse_specs(aggregates: list[dict]) -> list[dict]:
    """{op, field?, as?}: the default alias is field_op, or _op without a field."""
    if not aggregates:
        raise ValueError("aggregates are required")
    out = []
    for spec in aggregates:
        op, name = str(spec.get("op", "")).strip().lower(), spec.get("field", "")
        known = op in (*BASIC, "count_distinct", "stddev", "median", "p50") or re.fullmatch(r"percentile_p?\d+", op) or SKETCHED.fullmatch(op)
        if not known:
            raise ValueError(f"unknown aggregate {op!r}")
        if not name and op != "count":
            raise ValueError(f"{op} needs a field")
        out.append({"op": op, "field": name, "as": spec.get("as") or f"{name}_{op}"})
    return out


def share_of(op: str) -> float | None:
    if op in ("median", "p50"):
        return 0.5
    m = re.fullmatch(r"(?:percentile_|tdigest_|approx_percentile_|approx_)p?(\d+)", op)
    return min(1.0, max(0.0, int(m[1]) / 100)) if m else None


def _groups(df: DataFrame, group_by: list[str]) -> list[Column]:
    return [vts(col(c)).alias(c) if kind_of(df, c).typeName() == "string" else col(c) for c in group_by]


def _basic(df: DataFrame, spec: dict, avg_of_rows: bool) -> Column:
    x = number(df, spec["field"]) if spec["field"] else F.lit(None).cast("double")
    return {
        "count": F.count("*"), "sum": F.coalesce(F.sum(x), F.lit(0.0)), "avg": (F.coalesce(F.sum(x), F.lit(0.0)) / F.count("*")) if avg_of_rows else F.avg(x), "min": F.min(x), "max": F.max(x),
    }[spec["op"]]


def aggregate_basic(df: DataFrame, group_by: list[str], aggregates: list[dict]) -> DataFrame:
    """count, sum, avg, min, max; avg divides by all rows of the group. Other operations give no column."""
    specs = [s for s in parse_specs(aggregates) if s["op"] in BASIC]
    return df.groupBy(*_groups(df, group_by)).agg(*(_basic(df, s, True).alias(s["as"]) for s in specs))


def aggregate_stats(df: DataFrame, group_by: list[str], aggregates: list[dict], skip_unknown: bool = False) -> DataFrame:
    """Also count_distinct (missing counts as one value), stddev (population; null below two numbers) and percentiles."""
    plain: list[Column] = []
    ranked: list[dict] = []
    for s in parse_specs(aggregates):
        x = number(df, s["field"]) if s["field"] else None
        if s["op"] in BASIC:
            plain.append(_basic(df, s, False).alias(s["as"]))
        elif s["op"] == "count_distinct" or re.fullmatch("approx_count_distinct(?:_hll)?|hll_count", s["op"]):
            plain.append(F.count_distinct(vts(col(s["field"]))).alias(s["as"]))
        elif s["op"] == "stddev":
            plain.append(F.when(F.count(x) >= 2, F.stddev_pop(x)).alias(s["as"]))
        elif share_of(s["op"]) is not None:
            ranked.append(s)
        elif not s["op"].startswith("topk") and not skip_unknown:
            raise ValueError(s["op"])
    keys = _groups(df, group_by)
    names = list(group_by)
    out = df.groupBy(*keys).agg(F.count("*").alias("__n"), *plain)
    for field in dict.fromkeys(s["field"] for s in ranked):
        mine = {s["as"]: share_of(s["op"]) for s in ranked if s["field"] == field}
        out = _null_safe(out, percentiles(df.select(*keys, number(df, field).alias("__v")), names, "__v", mine), names)
    for s in parse_specs(aggregates):
        if s["op"].startswith("topk"):
            out = _null_safe(out, top_values(df, group_by, s["field"], int((s["op"].split("_") + ["5"])[1]), s["as"]), names)
    return out.select(*(col(c) for c in names), *(col(s["as"]) for s in parse_specs(aggregates) if s["as"] in out.columns))


def _null_safe(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        return a.crossJoin(b)  # one row each: both are aggregates without keys
    b = b.withColumnsRenamed({c: f"__r_{c}" for c in names})
    condition = [a[f"`{c}`"].eqNullSafe(b[f"`__r_{c}`"]) for c in names]
    return a.join(b, condition, "left").drop(*(f"__r_{c}" for c in names))


def sampled_percentiles(df: DataFrame, group_by: list[str], field: str, shares: dict[str, float], order_by: list[str], sample_size: int = 1024) -> DataFrame:
    """Nearest ranks of every k-th number of a group in order_by, k so that at most sample_size (64 to a million) are taken. The group's rows are numbered in one window."""
    size = min(1_000_000, max(64, sample_size))
    keys, names = _groups(df, group_by), [col(c) for c in group_by]
    rows = df.select(*keys, number(df, field).alias("__v"), *(col(c).alias(f"__o{i}") for i, c in enumerate(order_by))).filter("__v is not null")
    one = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    place = F.row_number().over(one.orderBy(*(F.col(f"__o{i}") for i in range(len(order_by))))) - 1
    taken = rows.withColumns({"__i": place, "__k": F.ceil(F.count("*").over(one) / size)}).filter("__i % __k = 0")
    return percentiles(taken.select(*names, "__v"), group_by, "__v", shares)


def top_values(df: DataFrame, group_by: list[str], field: str, n: int = 5, alias: str = "top") -> DataFrame:
    """The n most frequent texts of each group as [{value, count}]; of equally frequent ones the smaller text first."""
    n = min(100, max(1, n))
    counts = df.groupBy(*_groups(df, group_by), vts(col(field)).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*(col(c) for c in group_by)).orderBy(F.desc("__c"), "__v")
    kept = counts.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n)
    listed = F.array_sort(F.collect_list(F.struct("__i", "__v", "__c")))
    return kept.groupBy(*(col(c) for c in group_by)).agg(F.transform(listed, lambda x: F.struct(x["__v"].alias("value"), x["__c"].alias("count"))).alias(alias))


def aggregate_sketched(df: DataFrame, group_by: list[str], aggregates: list[dict], exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Distinct counts, top values and percentiles: exact by default, else from mergeable sketches of a bounded size."""
    if exact:
        return aggregate_stats(df, group_by, aggregates, skip_unknown=True)
    out = []
    for s in parse_specs(aggregates):
        x = number(df, s["field"]) if s["field"] else None
        p = share_of(s["op"])
        if s["op"] in BASIC:
            out.append(_basic(df, s, False).alias(s["as"]))
        elif "distinct" in s["op"] or s["op"] == "hll_count":
            out.append(F.hll_sketch_estimate(F.hll_sketch_agg(vts(col(s["field"])))).alias(s["as"]))
        elif p is not None:
            out.append(F.percentile_approx(x, p, accuracy).alias(s["as"]))
    return df.groupBy(*_groups(df, group_by)).agg(*out)


def verify_exact(df: DataFrame, group_by: list[str], aggregates: list[dict]) -> DataFrame:
    """One row: how many groups the plain plan gives more than the sketched one."""
    specs = [s for s in aggregates if str(s["op"]).lower() in BASIC] or [{"op": "count"}]
    a, b = aggregate_sketched(df, group_by, specs, exact=False).agg(F.count("*").alias("groups")), aggregate_stats(df, group_by, specs).agg(F.count("*").alias("exact_groups"))
    return a.crossJoin(b).withColumn("row_count_delta", F.col("exact_groups") - F.col("groups"))


def chart_first_seen(df: DataFrame, order_by: str, category: str = "category", series: str = "series", value: str = "value") -> DataFrame:
    """category, series, value and the places of both in order of their first rows."""
    sums = df.groupBy(vts(col(category)).alias("category"), vts(col(series)).alias("series")).agg(F.coalesce(F.sum(number(df, value)), F.lit(0.0)).alias("value"), F.min(col(order_by)).alias("__first"))
    place = lambda c: sums.groupBy(c).agg(F.min("__first").alias("__f")).select(c, F.row_number().over(Window.orderBy("__f", c)).alias(f"{c}_order"))  # noqa: E731  a row for each value that the chart shows
    return sums.drop("__first").join(place("category"), "category").join(place("series"), "series")


def chart_data(df: DataFrame, category: str, series: str, value: str, top_n: int = 100) -> DataFrame:
    """category, series, value: sums over every pair of one of the first top_n categories and a series that one of them has, 0 where there are none."""
    sums = df.groupBy(vts(col(category)).alias("category"), vts(col(series)).alias("series")).agg(F.coalesce(F.sum(number(df, value)), F.lit(0.0)).alias("value"))
    categories = sums.select("category").distinct().orderBy("category").limit(top_n)
    sums = sums.join(categories, "category", "left_semi")
    grid = sums.select("series").distinct().crossJoin(F.broadcast(categories)).select("category", "series")  # the result itself: at most top_n rows a series
    return grid.join(sums, ["category", "series"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each field: rows, missing, numbers, sum, min, max and avg to two places. One pass over the table."""
    one = F.array(*(F.struct(F.lit(f).alias("field"), F.when(vts(col(f)) == "", 1).otherwise(0).alias("m"), number(df, f).alias("x")) for f in fields))
    rows = df.select(F.explode(one).alias("v")).select("v.*")
    r = lambda c: F.round(c, 2)
    return rows.groupBy("field").agg(F.count("*").alias("rows"), F.sum("m").alias("missing"), F.count("x").alias("numbers"), r(F.sum("x")).alias("sum"), r(F.min("x")).alias("min"), r(F.max("x")).alias("max"), r(F.avg("x")).alias("avg"))


def text_metrics(df: DataFrame, text: str) -> DataFrame:
    """Sections, bullets, characters, lines, scripts, references and notes of each text, with its hash."""
    t = vts(col(text))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    return df.withColumns({
        "sections": count(r"(?m)^#{1,6} "), "bullets": count(r"(?m)^\s*[-*] "), "chars": F.length(t).cast("long"), "lines": F.when(t == "", 0).otherwise(F.size(F.split(t, "\n"))).cast("long"), "cjk": count(r"[一-鿿]"), "latin": count("[A-Za-z]"), "digits": count("[0-9]"),
        "reference_hits": count(r"(?i)\breferences\b|参考文献"), "note_hits": count(r"(?i)footnote|注释|脚注"), "sha256": F.sha2(t.cast("binary"), 256),
    })
