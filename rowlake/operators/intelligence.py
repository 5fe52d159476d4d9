"""Ratios, rankings, cross-checks, text search, statistics and provenance."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlake.functions.values import NUMERIC, col, kind_of, number, once, vts
from rowlake.operators.ranges import percentiles
from rowlake.operators.text import tokens

EPSILON = 2.220446049250313e-16


def finance_ratios(df: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(number(df, c), F.lit(0.0))
    ratio = lambda a, b: F.when(F.abs(zero(b)) >= EPSILON, zero(a) / zero(b))
    return df.withColumns({"ratio_current": ratio("current_assets", "current_liabilities"), "ratio_debt_to_equity": ratio("total_debt", "total_equity"), "ratio_net_margin": ratio("net_income", "revenue"), "ratio_ocf_margin": ratio("operating_cash_flow", "revenue")})


def explain_anomalies(df: DataFrame, score: str, threshold: float = 0.8, top: int = 3) -> DataFrame:
    """The rows of a score of the threshold or more, with top_factors: the other numbers of the largest size."""
    names = sorted(c for c in df.columns if c != score and isinstance(kind_of(df, c), NUMERIC))
    found = F.array_compact(F.array(*(F.when(col(c).isNotNull(), F.struct((-F.abs(col(c).cast("double"))).alias("order"), F.lit(c).alias("field"), col(c).cast("double").alias("value"))) for c in names)))
    factors = F.transform(F.slice(F.array_sort(found), 1, top), lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value")))
    return df.filter(F.coalesce(number(df, score), F.lit(0.0)) >= threshold).withColumn("top_factors", factors)


def rank_evidence(df: DataFrame, now, time: str = "published_at") -> DataFrame:
    """rank_score of relevance, source, consistency and recency at the time `now`."""
    zero = lambda c: F.coalesce(number(df, c), F.lit(0.0))
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(col(time).cast("timestamp"))) / 86400.0
    recent = F.when(col(time).isNull(), 0.5).otherwise(1 / (1 + F.greatest(age, F.lit(0.0)) / 30)) if time in df.columns else F.lit(0.5)
    return df.withColumn("rank_score", 0.45 * zero("relevance") + 0.25 * zero("source_score") + 0.20 * zero("consistency") + 0.10 * recent)


def crosscheck_facts(df: DataFrame, claim: str, source: str) -> DataFrame:
    """canonical claim, its distinct sources, and supported: two or more of them."""
    key = F.array_join(tokens(col(claim)), " ")
    return df.groupBy(key.alias("claim")).agg(F.count_distinct(vts(col(source))).alias("sources"), F.count("*").alias("rows")).withColumn("supported", F.col("sources") >= 2)


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, term, tf (count over words) and norm of each text; blank ids and texts have none."""
    rows = df.filter(vts(col(key)) != "").select(vts(col(key)).alias("id"), tokens(col(text)).alias("w")).filter(F.size("w") > 0)
    # counted inside the row, as runs of the sorted words: no shuffle for what lies in one text, and no word is held against all others
    begins = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, s: F.transform(s, lambda i, j: F.struct(F.get(w, i).alias("term"), ((F.coalesce(F.get(s, j + 1), F.size(w)) - i) / F.size(w)).alias("tf")))
    rows = rows.withColumn("t", once(F.array_sort("w"), lambda w: once(begins(w), lambda s: runs(w, s))))
    return rows.select("id", F.explode("t").alias("x"), F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, x: a + x["tf"] * x["tf"])).alias("norm")).select("id", "x.term", "x.tf", "norm")


def vector_search(index: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """query, id, score and rank by cosine of term frequencies; both sides as term_frequencies gives them."""
    q = queries.select(F.col("id").alias("query"), "term", F.col("tf").alias("qtf"), F.col("norm").alias("qnorm"))
    dots = index.join(q, "term").groupBy("query", "id").agg((F.sum(F.col("tf") * F.col("qtf")) / F.first("norm") / F.first("qnorm")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return dots.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= min(100, max(1, top_k)))


def character_search(df: DataFrame, key: str, text: str, query: str, where: dict | None = None, top_k: int = 5, rerank: str | None = None, weight: float = 0.0) -> DataFrame:
    """id and score: how many of the query's characters a text holds, over the query's bytes, plus a weighted column."""
    for c, v in (where or {}).items():
        df = df.filter(vts(col(c)) == str(v))
    low = F.lower(vts(col(text)))
    hits = sum((F.when(low.contains(c), 1).otherwise(0) for c in query.lower()), F.lit(0))
    score = hits / float(max(1, len(query.encode())))
    if rerank:
        score = score + F.coalesce(number(df, rerank), F.lit(0.0)) * weight
    return df.select(vts(col(key)).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(min(100, max(1, top_k)))


def search_quality(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """recall_at_k and mrr of ranked results (query, id, rank) against expected (query, id)."""
    hits = expected.join(results.filter(F.col("rank") <= k), ["query", "id"], "left")
    each = hits.groupBy("query").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return each.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall_at_k"), F.avg("rr").alias("mrr"))


def bind_template(text: str, values: dict) -> tuple[str, int]:
    """{{ a.b }} by nested values; an unknown path is left. Also how many were bound."""
    count = 0

    def one(m: re.Match) -> str:
        nonlocal count
        x = values
        for part in m[1].split("."):
            if not isinstance(x, dict) or part not in x:
                return m[0]
            x = x[part]
        count += 1
        return "" if x is None else str(x)

    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", one, text), count


def sign_provenance(previous: str, timestamp: str, payload: str) -> str:
    return hashlib.sha256(f"{previous}|{timestamp}|{payload}".encode()).hexdigest()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """The two-sided p-value of Student's t."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if 0 < x < 1 else 0.0
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def regression(df: DataFrame, x: str, y: str) -> dict:
    """Ordinary least squares of y on x from one aggregation: slope, intercept, its error, t, p and 95 % interval."""
    both = df.select(number(df, x).alias("x"), number(df, y).alias("y")).filter("x is not null and y is not null")
    r = both.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy")).first()
    if r.n < 2:
        raise ValueError("at least two pairs are needed")
    out = {"count": r.n, "correlation": r.r, "slope": r.slope, "intercept": r.intercept, "mean_x": r.mx, "mean_y": r.my}
    if r.n > 2 and r.slope is not None and r.sxx:
        error = math.sqrt(max(0.0, (r.syy - r.slope * r.slope * r.sxx)) / (r.n - 2) / r.sxx)
        t = r.slope / error if error else math.inf
        wide = t_quantile(0.975, r.n - 2) * error
        out |= {"slope_stderr": error, "t": t, "p_value": t_two_sided(t, r.n - 2), "ci95_low": r.slope - wide, "ci95_high": r.slope + wide}
    return out


def regression_columns(df: DataFrame, group_by: list[str], x: str, y: str) -> DataFrame:
    """count, correlation, slope and intercept of each group."""
    a, b = number(df, x), number(df, y)
    return df.groupBy(*(col(c) for c in group_by)).agg(F.regr_count(b, a).alias("n"), F.corr(a, b).alias("correlation"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def stats_columns(df: DataFrame, group_by: list[str], x: str, y: str, inference: bool = True) -> DataFrame:
    """For each group count, correlation, slope, intercept, means, slope_stderr, slope_t and the exact median_y; with inference slope_p_value and the 95 % interval too.

    Of one table without groups give []. Numbers that don't vary have correlation and slope 0. Groups below two pairs are left out.
    """
    both = df.select(*(col(c) for c in group_by), number(df, x).alias("__x"), number(df, y).alias("__y")).filter("__x is not null and __y is not null")
    one = both.groupBy(*(col(c) for c in group_by)).agg(F.count("*").alias("count"), F.avg("__x").alias("mean_x"), F.avg("__y").alias("mean_y"), F.regr_sxx("__y", "__x").alias("__sxx"), F.regr_syy("__y", "__x").alias("__syy"), F.regr_sxy("__y", "__x").alias("__sxy")).filter("count >= 2")
    flat = F.col("__sxx") <= 0
    out = one.withColumns({"correlation": F.when(flat | (F.col("__syy") <= 0), 0.0).otherwise(F.try_divide(F.col("__sxy"), F.sqrt(F.col("__sxx")) * F.sqrt(F.col("__syy")))), "slope": F.when(flat, 0.0).otherwise(F.try_divide("__sxy", "__sxx"))})
    rest = F.greatest(F.col("__syy") - F.col("slope") * F.col("__sxy"), F.lit(0.0))
    out = out.withColumns({"intercept": F.col("mean_y") - F.col("slope") * F.col("mean_x"), "slope_stderr": F.when(~flat, F.sqrt(F.try_divide(rest / F.greatest(F.col("count") - 2, F.lit(1)), F.col("__sxx"))))})
    out = out.withColumn("slope_t", F.when(F.col("slope_stderr") > 0, F.try_divide("slope", "slope_stderr")).otherwise(0.0))
    middle = percentiles(both, group_by, "__y", {"median_y": 0.5})
    names = ["count", "correlation", "slope", "intercept", "mean_x", "mean_y", "slope_stderr", "slope_t", "median_y"]
    if group_by:
        middle = middle.withColumnsRenamed({c: f"__m_{c}" for c in group_by})
        same = [out[f"`{c}`"].eqNullSafe(middle[f"`__m_{c}`"]) for c in group_by]
        out = out.join(middle, same)
    else:
        out = out.crossJoin(middle)  # one row each
    out = out.select(*(col(c) for c in group_by), *names)
    if not inference:
        return out

    def infer(batches):  # a row for each group
        import pyarrow as pa

        for batch in batches:
            slope, error, t, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("slope", "slope_stderr", "slope_t", "count"))
            p = [t_two_sided(abs(a), max(1, k - 2)) for a, k in zip(t, n)]
            wide = [None if e is None else t_quantile(0.975, max(1, k - 2)) * e for e, k in zip(error, n)]
            low, high = ([None if w is None else s + sign * w for s, w in zip(slope, wide)] for sign in (-1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=[*batch.schema.names, "slope_p_value", "ci95_low", "ci95_high"])

    schema = T.StructType([*out.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("slope_p_value", "ci95_low", "ci95_high"))])
    return out.mapInArrow(infer, schema)


def build_index(df: DataFrame, path: str, key: str, text: str, metadata: list[str] = (), shards: int = 8, mode: str = "replace") -> None:
    """A sharded table of id, text, metadata and shard; replace or append."""
    rows = df.filter((vts(col(key)) != "") & (vts(col(text)) != "")).select(vts(col(key)).alias("id"), vts(col(text)).alias("text"), *(col(c) for c in metadata))
    rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).write.mode("overwrite" if mode == "replace" else "append").partitionBy("shard").parquet(path)


def search_index(spark, path: str, queries: DataFrame, where: dict | None = None, top_k: int = 5, shards: list[int] | None = None) -> DataFrame:
    """Cosine search of an index; `where` filters metadata, `shards` prunes folders."""
    index = spark.read.parquet(path)
    index = index.filter(col("shard").isin(shards)) if shards else index
    for c, v in (where or {}).items():
        index = index.filter(vts(col(c)) == str(v))
    return vector_search(term_frequencies(index, "id", "text"), term_frequencies(queries, "id", "text"), top_k)
