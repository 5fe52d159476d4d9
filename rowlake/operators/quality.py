"""Data-quality checks, constraints, drift and rule simulation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlake.functions.values import col, kind_of, miss, num, number, vts, ymd
from rowlake.operators.ranges import percentiles

DEFAULTS = {"max_null_ratio": 1.0, "max_z": 4.0, "max_psi": 0.25, "iqr_ratio": 0.10}
#: The score falls by so much for each violation, by version.
PENALTY = {2: 10, 3: 8, 4: 8}


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def quality_check(df: DataFrame, rules: dict, version: int = 1) -> DataFrame:
    """A row for each check: check, field, value, limit, passed. version 1: unique, required, z-score; 2: ranges, dependencies, drift of the mean and rates; 3 and 4: PSI and IQR, 4 with dsl text.

    All single-pass checks share one aggregation; only distinct keys, quartiles and histograms read the table again.
    """
    rules = {**rules, **(parse_dsl(rules["rules_dsl"]) if version >= 4 and rules.get("rules_dsl") else {})}
    wanted: list[tuple[str, str, Column, float]] = []
    limit = float(rules.get("max_null_ratio", DEFAULTS["max_null_ratio"]))
    rows = F.greatest(F.count("*"), F.lit(1))
    absent = lambda c: miss(col(c)) if c in df.columns else F.lit(True)
    for c in rules.get("required_fields", []):
        wanted.append(("null_ratio", c, _n(absent(c)) / rows, limit))
    if version >= 2:
        for r in rules.get("range_checks", []):
            x = number(df, r["field"])
            bad = F.coalesce((x < float(r["min"])) if r.get("min") is not None else F.lit(False), F.lit(False)) | F.coalesce((x > float(r["max"])) if r.get("max") is not None else F.lit(False), F.lit(False))
            wanted.append(("range", r["field"], _n(bad).cast("double"), 0.0))
        for r in rules.get("dependency_checks", []):
            wanted.append(("dependency", r["then"], _n(~absent(r["if"]) & absent(r["then"])).cast("double"), 0.0))
        if d := rules.get("drift_check"):
            wanted.append(("drift", d["field"], F.abs(F.coalesce(F.avg(number(df, d["field"])), F.lit(0.0)) - float(d["baseline_mean"])), float(d.get("max_delta", 0.0))))
        if "numeric_parse_rate_min" in rules:
            for c in rules.get("numeric_fields", []):
                rate = F.when(_n(~absent(c)) > 0, _n(number(df, c).isNotNull()) / _n(~absent(c))).otherwise(1.0)
                wanted.append(("numeric_parse_rate", c, -rate, -float(rules["numeric_parse_rate_min"])))
        if "date_parse_rate_min" in rules:
            for c in rules.get("date_fields", []):
                rate = F.when(_n(~absent(c)) > 0, _n(ymd(col(c)).isNotNull()) / _n(~absent(c))).otherwise(1.0)
                wanted.append(("date_parse_rate", c, -rate, -float(rules["date_parse_rate_min"])))
        if "blank_row_ratio_max" in rules:
            wanted.append(("blank_row_ratio", "", _n(F.trim(F.concat_ws("", *(vts(col(c)) for c in df.columns))) == "") / rows, float(rules["blank_row_ratio_max"])))
    parts = []
    if wanted:
        one = df.agg(*(c.cast("double").alias(f"v{i}") for i, (_, _, c, _) in enumerate(wanted)))
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(f).alias("field"), F.abs(F.col(f"v{i}")).alias("value"), F.lit(abs(m)).alias("limit"), (F.col(f"v{i}") <= m).alias("passed")) for i, (k, f, _, m) in enumerate(wanted)))).alias("x")).select("x.*"))
    result = lambda out, k, f, value, m: out.select(F.lit(k).alias("check"), F.lit(f).alias("field"), value.cast("double").alias("value"), F.lit(float(m)).alias("limit"), (value <= m).alias("passed"))
    if unique := rules.get("unique_fields"):
        counted = df.groupBy(*(vts(col(c)).alias(c) for c in unique)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        share = version >= 2 and rules.get("duplicate_key_ratio_max") is not None
        value = (F.col("d") / F.greatest(F.col("n"), F.lit(1))) if share else F.col("d")
        parts.append(result(counted, "unique", ",".join(unique), value, rules["duplicate_key_ratio_max"] if share else 0))
    if z := rules.get("outlier_zscore"):
        parts.append(result(outliers_z(df, z["field"], float(z.get("max_z", DEFAULTS["max_z"]))).agg(F.count("*").alias("n")), "outlier_zscore", z["field"], F.col("n"), 0))
    if version >= 3:
        for spec in _listed(rules.get("anomaly_iqr")):
            ratio = version >= 4
            bound = float(spec.get("max_ratio", DEFAULTS["iqr_ratio"])) if ratio else 0
            counts = iqr_outliers(df, spec["field"])
            parts.append(result(counts, "anomaly_iqr", spec["field"], (F.col("outliers") / F.greatest(F.col("n"), F.lit(1))) if ratio else F.col("outliers"), bound))
        for spec in _listed(rules.get("drift_psi")):
            parts.append(result(psi(df, spec["baseline"], spec["field"]), "drift_psi", spec["field"], F.col("psi"), float(spec.get("max_psi", DEFAULTS["max_psi"]))))
    if not parts:
        raise ValueError("no checks")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _listed(x) -> list[dict]:
    return [] if not x else [x] if isinstance(x, dict) else [{"field": y} if isinstance(y, str) else y for y in x]


def score(checks: DataFrame, version: int = 2) -> DataFrame:
    """One row: violations, passed, and a score of 100 less a penalty for each violation."""
    bad = _n(~F.col("passed"))
    return checks.agg(bad.alias("violations"), (bad == 0).alias("passed"), F.greatest(F.lit(0), F.lit(100) - bad * PENALTY[version]).alias("score"))


def parse_dsl(text: str) -> dict:
    """required: a,b / unique: a,b / range:f x >= lo <= hi / anomaly_iqr: field=f,max_ratio=r; other lines are ignored."""
    out: dict = {}
    for line in text.lower().splitlines():
        word, _, rest = line.strip().partition(":")
        names = [x.strip() for x in rest.split(",") if x.strip()]
        if word == "required":
            out.setdefault("required_fields", []).extend(names)
        elif word == "unique":
            out.setdefault("unique_fields", []).extend(names)
        elif word == "range":
            spec: dict = {"field": rest.split()[0]} if rest.split() else {}
            for op, value in re.findall(r"(>=|<=)\s*(-?[\d.]+)", rest):
                spec["min" if op == ">=" else "max"] = float(value)
            out.setdefault("range_checks", []).append(spec)
        elif word == "anomaly_iqr":
            pairs = dict(x.split("=", 1) for x in names if "=" in x)
            out["anomaly_iqr"] = {"field": pairs.get("field", ""), **({"max_ratio": float(pairs["max_ratio"])} if "max_ratio" in pairs else {})}
    return out


def outliers_z(df: DataFrame, field: str, max_z: float = 4.0) -> DataFrame:
    """The rows more than max_z population deviations from the mean; none below three numbers."""
    x = number(df, field)
    stats = df.agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"), F.count(x).alias("__n"))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.filter((F.col("__n") >= 3) & (F.col("__s") > 0) & (F.abs(x - F.col("__m")) / F.col("__s") > max_z)).drop("__m", "__s", "__n")


def quartiles(df: DataFrame, field: str, interpolated: bool = False) -> DataFrame:
    """One row: n, q1 and q3 by nearest rank, or between the two nearest numbers (interpolated, from counts of distinct values in one task's memory)."""
    rows = df.select(number(df, field).alias("x"))
    n = rows.agg(F.count("x").alias("n"))
    if interpolated:
        return rows.agg(F.count("x").alias("n"), F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"))
    return n.crossJoin(F.broadcast(percentiles(rows, [], "x", {"q1": 0.25, "q3": 0.75})))  # one row each


def iqr_outliers(df: DataFrame, field: str, factor: float = 1.5, interpolated: bool = False) -> DataFrame:
    """One row: n and outliers, the numbers beyond factor quartile ranges; none below four numbers."""
    x, q = number(df, field), quartiles(df, field, interpolated)
    wide = factor * (F.col("q3") - F.col("q1"))
    out = df.select(x.alias("x")).crossJoin(F.broadcast(q))  # one row
    beyond = (F.col("n") >= 4) & ((F.col("x") < F.col("q1") - wide) | (F.col("x") > F.col("q3") + wide))
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), _n(F.coalesce(beyond, F.lit(False))).alias("outliers"))


def psi(df: DataFrame, baseline: DataFrame, field: str, bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """One row: the population stability index over equal bins of the joint range."""
    a, b = df.select(number(df, field).alias("x"), F.lit(1).alias("new")), baseline.select(number(baseline, field).alias("x"), F.lit(0).alias("new"))
    both = a.unionByName(b).filter("x is not null")
    span = both.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)), F.lit(bins - 1))
    counts = both.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.sum("new").alias("a"), F.sum(1 - F.col("new")).alias("b"))  # one row
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p = F.greatest(F.col("a") / F.greatest(F.col("ta"), F.lit(1)), F.lit(epsilon))
    q = F.greatest(F.col("b") / F.greatest(F.col("tb"), F.lit(1)), F.lit(epsilon))
    return counts.crossJoin(totals).agg(F.coalesce(F.sum((p - q) * F.log(p / q)), F.lit(0.0)).alias("psi"))


def constraint_violations(df: DataFrame, constraints: list[dict]) -> DataFrame:
    """A row for each broken constraint: the row's columns, constraint (its index) and kind; sum_equals and non_negative, missing is 0."""
    zero = lambda c: F.coalesce(number(df, c), F.lit(0.0))
    flags = []
    for i, c in enumerate(constraints):
        if c["kind"] == "sum_equals":
            total = sum((zero(x) for x in c["left"]), F.lit(0.0))
            bad = F.abs(total - zero(c["right"])) > float(c.get("tolerance", 1e-6))
        else:
            bad = zero(c["field"]) < 0
        flags.append(F.when(bad, F.struct(F.lit(i).alias("constraint"), F.lit(c["kind"]).alias("kind"))))
    return df.withColumn("__v", F.explode(F.array_compact(F.array(*flags)))).select(*(col(c) for c in df.columns), "__v.constraint", "__v.kind")


def simulate_rules(df: DataFrame, before, after, key: list[str], order_by: list[str] | None = None) -> DataFrame:
    """changed_fields: how many rows of the two transforms' outputs, matched by key, differ in each shared field."""
    from rowlake.operators.transform import transform

    a, b = transform(df, before, order_by).df, transform(df, after, order_by).df
    shared = [c for c in a.columns if c in b.columns and c not in key]
    b = b.select(*(col(c).alias(f"__k{i}") for i, c in enumerate(key)), *(col(c).alias(f"__b{i}") for i, c in enumerate(shared)))
    joined = a.join(b, [a[f"`{c}`"].eqNullSafe(b[f"__k{i}"]) for i, c in enumerate(key)])
    differs = F.array_compact(F.array(*(F.when(~vts(col(c)).eqNullSafe(vts(F.col(f"__b{i}"))), F.lit(c)) for i, c in enumerate(shared))))
    return joined.select(F.explode(differs).alias("field")).groupBy("field").agg(F.count("*").alias("changed"))


def image_report(blocks: DataFrame, kind: str = "block_type", confidence: str = "confidence", text: str = "text", low: float = 0.6) -> DataFrame:
    """One row of the quality of recognised blocks: counts, mean and low confidence, repeated and empty texts, signs among the characters."""
    said = F.lower(F.trim(F.regexp_replace(vts(col(text)), r"\s+", " ")))
    texts = F.when(F.coalesce(col(kind) != "figure", F.lit(True)), True).otherwise(False) if kind in blocks.columns else F.lit(True)
    sure, there = F.when(texts, number(blocks, confidence)), texts & (said != "")
    signs = F.when(there, F.regexp_count(said, F.lit(r"[^0-9a-z一-鿿\s]")) / F.greatest(F.length(said), F.lit(1)))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return blocks.agg(
        F.count("*").alias("block_count"), _n(texts).alias("text_block_count"), F.round(F.coalesce(F.avg(sure), F.lit(0.0)), 6).alias("ocr_confidence_avg"), part(_n(F.coalesce(sure < low, F.lit(False))), F.count(sure)).alias("low_confidence_block_ratio"),
        part(_n(there) - F.count_distinct(F.when(there, said)), _n(there)).alias("duplicate_line_ratio"), part(_n(texts & (said == "")), _n(texts)).alias("empty_text_block_ratio"), F.round(F.coalesce(F.avg(signs), F.lit(0.0)), 6).alias("non_text_symbol_ratio"),
    )


def modality_report(df: DataFrame, header_confidence: float = 1.0, numeric: list[str] = (), dates: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """One row of a sheet's quality: header confidence, parse rates, blank and duplicate ratios, coverage of cells."""
    cells = [miss(col(c)) for c in df.columns]
    rows = F.greatest(F.count("*"), F.lit(1))
    rate = lambda good, there: F.when(there > 0, good / there).otherwise(1.0)
    total = lambda xs: sum(xs, F.lit(0)) if xs else F.lit(0)
    numbers = rate(total([_n(num(col(c), kind_of(df, c)).isNotNull()) for c in numeric]), total([_n(~miss(col(c))) for c in numeric]))
    days = rate(total([_n(ymd(col(c)).isNotNull()) for c in dates]), total([_n(~miss(col(c))) for c in dates]))
    blank = F.lit(True)
    for x in cells:
        blank = blank & x
    filled = total([_n(~x) for x in cells]) / (rows * max(1, len(cells)))
    out = df.agg(F.count("*").alias("rows"), F.lit(header_confidence).alias("header_confidence"), numbers.cast("double").alias("numeric_parse_rate"), days.cast("double").alias("date_parse_rate"), (_n(blank) / rows).alias("blank_row_ratio"), filled.alias("coverage"))
    if not keys:
        return out.withColumn("duplicate_key_ratio", F.lit(0.0))
    distinct = df.select(*(vts(col(c)) for c in keys)).distinct().agg(F.count("*").alias("__d"))
    return out.crossJoin(distinct).withColumn("duplicate_key_ratio", F.when(F.col("rows") > 0, 1 - F.col("__d") / F.col("rows")).otherwise(0.0)).drop("__d")
