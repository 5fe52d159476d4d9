"""Registered queries over the sample tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlake.functions.values import money
from rowlake.operators import aggregates as agg
from rowlake.operators import enrichment, filters, intelligence, joins, quality, sketches, text, transform, windows
from rowlake.plans import rules as plan_rules
from rowlake.plans import workflow
from rowlake.sources import load, tables
from rowlake.streaming import windows as streams

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Registers f(table, ...) -> DataFrame over the named tables, and its SQL."""

    def put(f: Callable[..., DataFrame]):
        _Q[name] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()))
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rowlake import more_queries  # noqa: F401  registers its own

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from rowlake import more_queries  # noqa: F401

    return dict(_SQL)


def _r(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


# Aggregates

@query("agg_v1_flags", "lineitem", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice) / count(*), 2) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n
FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2""")
def _(li):
    rows = filters.apply_filters(li, [{"field": "l_quantity", "op": "gte", "value": 10}])
    out = agg.aggregate_basic(rows, ["l_returnflag", "l_linestatus"], [{"op": "sum", "field": "l_quantity", "as": "sum_qty"}, {"op": "avg", "field": "l_extendedprice", "as": "avg_price"}, {"op": "min", "field": "l_discount", "as": "min_disc"}, {"op": "max", "field": "l_tax", "as": "max_tax"}, {"op": "count", "as": "n"}])
    return _r(out, "sum_qty", "avg_price", digits=2)


@query("agg_v2_stats", "lineitem", """
SELECT l_shipmode_flag, count(DISTINCT l_suppkey) AS suppliers, round(CASE WHEN count(l_quantity) >= 2 THEN stddev_pop(l_quantity) END, 4) AS sd,
       list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS mid
FROM (SELECT *, l_returnflag AS l_shipmode_flag FROM lineitem) GROUP BY 1""")
def _(li):
    out = agg.aggregate_stats(li.withColumnRenamed("l_returnflag", "l_shipmode_flag"), ["l_shipmode_flag"], [{"op": "count_distinct", "field": "l_suppkey", "as": "suppliers"}, {"op": "stddev", "field": "l_quantity", "as": "sd"}, {"op": "percentile_p95", "field": "l_extendedprice", "as": "p95"}, {"op": "median", "field": "l_extendedprice", "as": "mid"}])
    return _r(out, "sd")


@query("agg_v3_topk", "orders", """
SELECT o_orderstatus, o_orderpriority AS value, n AS count, rk AS rank FROM (
  SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS INTEGER) AS rk FROM orders GROUP BY 1, 2) WHERE rk <= 3""")
def _(o):
    out = agg.top_values(o, ["o_orderstatus"], "o_orderpriority", 3).select("o_orderstatus", F.posexplode("top").alias("i", "x"))
    return out.select("o_orderstatus", "x.value", "x.count", (F.col("i") + 1).alias("rank"))


@query("agg_v3_exact_sketches", "events", """
SELECT event_type, count(DISTINCT user_id) AS users, list_sort(list(value))[CAST(floor((count(value) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS p90 FROM events GROUP BY 1""")
def _(e):
    return agg.aggregate_sketched(e, ["event_type"], [{"op": "approx_count_distinct_hll", "field": "user_id", "as": "users"}, {"op": "tdigest_p90", "field": "value", "as": "p90"}])


@query("agg_v4_verify", "lineitem", "SELECT CAST(count(DISTINCT l_returnflag) AS BIGINT) AS groups, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS exact_groups, CAST(0 AS BIGINT) AS row_count_delta FROM lineitem")
def _(li):
    return agg.verify_exact(li, ["l_returnflag"], [{"op": "sum", "field": "l_quantity", "as": "q"}])


@query("agg_sketch_merge", "events")
def _(e):
    parts = sketches.distinct_sketch(e, ["event_type", "user_id"], "user_id")
    return sketches.estimate_distinct(sketches.merge_distinct(parts, ["event_type"])).select("event_type", "estimate")


@query("sketch_quantiles", "events")
def _(e):
    merged = sketches.merge_quantiles(sketches.quantile_sketch(e.withColumn("part", F.col("user_id") % 4), ["event_type", "part"], "value"), ["event_type"])
    return sketches.estimate_quantile(merged, 0.5).select("event_type", "estimate")


@query("sketch_frequencies", "events", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def _(e):
    odd, even = (sketches.frequency_sketch(e.filter(F.col("event_id") % 2 == i), [], "event_type") for i in (1, 0))
    return sketches.merge_frequencies(odd, even, [])


@query("chart_pivot", "supplier nation", """
WITH s AS (SELECT n_name AS category, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS series, sum(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT c.category, t.series, round(coalesce(s.v, 0.0), 2) AS value FROM (SELECT DISTINCT category FROM s) c CROSS JOIN (SELECT DISTINCT series FROM s) t LEFT JOIN s ON s.category = c.category AND s.series = t.series""")
def _(s, n):
    rows = s.join(n, s.s_nationkey == n.n_nationkey).withColumn("series", F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit"))
    return _r(agg.chart_data(rows, "n_name", "series", "s_acctbal"), "value", digits=2)


@query("profile_customer", "customer", """
SELECT 'c_acctbal' AS field, count(*) AS rows, CAST(0 AS BIGINT) AS missing, count(c_acctbal) AS numbers, round(sum(c_acctbal), 2) AS sum, round(min(c_acctbal), 2) AS min, round(max(c_acctbal), 2) AS max, round(avg(c_acctbal), 2) AS avg FROM customer
UNION ALL SELECT 'c_nationkey', count(*), 0, count(c_nationkey), round(CAST(sum(c_nationkey) AS DOUBLE), 2), min(c_nationkey), max(c_nationkey), round(avg(c_nationkey), 2) FROM customer""")
def _(c):
    return agg.profile(c, ["c_acctbal", "c_nationkey"])


@query("text_metrics", "documents", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS latin, CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS digits, sha256(text) AS sha256 FROM documents""")
def _(d):
    return agg.text_metrics(d, "text").select("doc_id", "chars", "lines", "latin", "digits", "sha256")


# Joins

_PICK = ["o_orderkey", "o_custkey", "c_custkey", "c_name"]


def _pairs(o, c):
    """Both whole tables; the customers' keys are moved by seven, so that both sides have rows without a match."""
    return o.select("o_orderkey", "o_custkey"), c.select((F.col("c_custkey") + 7).alias("c_custkey"), "c_name")


_L, _R = "(SELECT o_orderkey, o_custkey FROM orders)", "(SELECT c_custkey + 7 AS c_custkey, c_name FROM customer)"
for _how, _join in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}.items():

    @query(f"join_{_how}", "orders customer", f"SELECT {', '.join(_PICK)} FROM {_L} o {_join} {_R} c ON o_custkey = c_custkey")
    def _(o, c, how=_how):
        return joins.join_rows(*_pairs(o, c), "o_custkey", "c_custkey", how).select(*_PICK)


for _how, _not in {"semi": "", "anti": "NOT "}.items():

    @query(f"join_{_how}", "orders customer", f"SELECT o_orderkey, o_custkey FROM {_L} o WHERE {_not}EXISTS (SELECT 1 FROM {_R} c WHERE o_custkey = c_custkey)")
    def _(o, c, how=_how):
        return joins.join_rows(*_pairs(o, c), "o_custkey", "c_custkey", how)


@query("join_v1_single_key", "nation region", "SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(n, r):
    return joins.join_rows(n, r, "n_regionkey", "r_regionkey", "weird", strict=False)


@query("join_collision", "nation", "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS right_n_nationkey, b.n_name AS right_n_name, b.n_regionkey AS right_n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey = b.n_nationkey")
def _(n):
    return joins.join_rows(n, n, ["n_regionkey", "n_nationkey"], ["n_regionkey", "n_nationkey"])


@query("join_null_keys", "nation", """
WITH l AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN '' ELSE n_name END AS k FROM nation)
SELECT l.n_nationkey, l.k, r.n_nationkey AS right_n_nationkey, r.k AS right_k FROM l JOIN l r ON coalesce(l.k, '') = coalesce(r.k, '')""")
def _(n):
    k = n.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, None).when(F.col("n_nationkey") % 5 == 1, "").otherwise(F.col("n_name")).alias("k"))
    return joins.join_rows(k, k, "k", "k")


@query("join_bloom_left", "customer orders", "SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer JOIN orders ON c_custkey = o_custkey")
def _(c, o):
    return joins.join_rows_prefiltered(c.select("c_custkey", "c_name"), o.select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey", "left")


@query("join_strategy_merge", "customer orders", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(c, o):
    return joins.join_rows_strategy(c.select("c_custkey"), o.select("o_custkey"), "c_custkey", "o_custkey", strategy="sort_merge").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("join_stats", "orders customer", f"SELECT count(c_custkey) FILTER (o_orderkey IS NOT NULL) AS matched_pairs, count(*) AS output_rows FROM {_L} o FULL JOIN {_R} c ON o_custkey = c_custkey")
def _(o, c):
    return joins.join_stats(*_pairs(o, c), "o_custkey", "c_custkey", "full")


@query("diff_audit", "part", """
WITH b AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN -1 - p_partkey ELSE p_partkey END AS p_partkey, p_name, p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS p_size FROM part), a AS (SELECT p_partkey, p_name, p_size FROM part)
SELECT CAST(coalesce(a.p_partkey, b.p_partkey) AS VARCHAR) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size <> b.p_size""")
def _(p):
    a = p.select("p_partkey", "p_name", "p_size")
    b = a.withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 10 == 0, 1).otherwise(0))
    b = b.withColumn("p_partkey", F.when(F.col("p_partkey") % 7 == 0, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")))  # some keys are moved: removed here, added there
    return joins.diff_audit(a, b, ["p_partkey"])


# Filters and transforms

_FILTERS = {
    "filter_eq": ({"field": "p_brand", "op": "eq", "value": "Brand#13"}, "p_brand = 'Brand#13'"), "filter_ne": ({"field": "p_brand", "op": "ne", "value": "Brand#13"}, "p_brand <> 'Brand#13'"), "filter_contains": ({"field": "p_name", "op": "contains", "value": "re"}, "contains(p_name, 're')"),
    "filter_in": ({"field": "p_size", "op": "in", "value": [1, 5, 9]}, "p_size IN (1, 5, 9)"), "filter_not_in": ({"field": "p_size", "op": "not_in", "value": [1, 5, 9]}, "p_size NOT IN (1, 5, 9)"), "filter_regex": ({"field": "p_type", "op": "regex", "value": "^[A-M].*U"}, "regexp_matches(p_type, '^[A-M].*U')"),
    "filter_not_regex": ({"field": "p_type", "op": "not_regex", "value": "^[A-E]"}, "NOT regexp_matches(p_type, '^[A-E]')"), "filter_gt": ({"field": "p_retailprice", "op": "gt", "value": 905.5}, "p_retailprice > 905.5"), "filter_lte": ({"field": "p_size", "op": "lte", "value": "10"}, "p_size <= 10"),
    "filter_exists": ({"field": "p_name", "op": "exists"}, "trim(p_name) <> ''"), "filter_not_exists": ({"field": "p_name", "op": "not_exists"}, "trim(coalesce(p_name, '')) = ''"), "filter_invalid": ({"field": "p_size", "op": "in", "value": "1"}, "false"), "filter_unknown": ({"field": "p_size", "op": "whatever"}, "true"),
}
for _name, (_spec, _where) in _FILTERS.items():

    @query(_name, "part", f"SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM (SELECT * REPLACE (CASE WHEN p_partkey % 4 = 0 THEN '  ' WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS p_name) FROM part) WHERE {_where}")
    def _(p, spec=_spec):
        some = F.when(F.col("p_partkey") % 4 == 0, "  ").when(F.col("p_partkey") % 9 == 0, None).otherwise(F.col("p_name"))
        return filters.apply_filters(p.select("p_partkey", some.alias("p_name"), "p_brand", "p_type", "p_size", "p_retailprice"), [spec])


@query("columnar_eval", "part", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part WHERE p_size = 5")
def _(p):
    return filters.columnar_eval(p, {"p_size": 5, "nothing": 1}, ["p_partkey", "p_brand"])


@query("query_lang", "part", "SELECT p_partkey, p_size FROM part WHERE p_size >= 40")
def _(p):
    return filters.query_lang(filters.query_lang(p, "where p_size >= 40"), "select p_partkey, p_size")


_RULES = {"rename_map": {"o_totalprice": "amount"}, "casts": {"amount": "float", "o_custkey": "int"}, "filters": [{"field": "amount", "op": "gte", "value": 1000}, {"field": "o_orderstatus", "op": "in", "value": ["F", "O"]}], "required_fields": ["o_orderpriority"], "deduplicate_by": ["o_custkey"], "deduplicate_keep": "last"}
_CLEAN = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS amount, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus IN ('F', 'O') AND trim(o_orderpriority) <> ''"


@query("transform_clean", "orders", f"SELECT o_orderkey, o_custkey, o_orderstatus, amount, o_orderpriority FROM ({_CLEAN}) WHERE rn = 1")
def _(o):
    return transform.transform(o.drop("o_orderdate"), _RULES, ["o_orderkey"]).df


@query("transform_audit", "orders", "SELECT CASE WHEN o_totalprice >= 1000 AND o_orderstatus IN ('F', 'O') THEN 'ok' ELSE 'filter_rejected' END AS status, count(*) AS rows FROM orders GROUP BY 1")
def _(o):
    return transform.transform(o, _RULES, ["o_orderkey"]).audit


@query("transform_aggregate", "orders", f"SELECT o_orderstatus, round(sum(amount), 2) AS sum_amount, count(*) AS n FROM ({_CLEAN}) WHERE rn = 1 GROUP BY 1")
def _(o):
    rules = _RULES | {"aggregate": {"group_by": ["o_orderstatus"], "metrics": [{"op": "sum", "field": "amount", "as": "sum_amount"}, {"op": "count", "as": "n"}]}}
    return _r(transform.transform(o, rules, ["o_orderkey"]).aggregate, "sum_amount", digits=2)


@query("transform_metrics", "orders", f"SELECT (SELECT count(*) FROM orders) AS input_rows, (SELECT count(*) FROM ({_CLEAN})) AS passed_rows, count(*) AS output_rows FROM ({_CLEAN}) WHERE rn = 1")
def _(o):
    return transform.quality_metrics(o, _RULES).select("input_rows", "passed_rows", "output_rows")


@query("transform_expr_v3", "lineitem", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1.0 - l_discount), 4) AS net, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size, upper(l_returnflag || '-' || l_linestatus) AS tag FROM lineitem WHERE l_tax > 0.02 AND l_returnflag <> 'N'""")
def _(li):
    f = lambda x: {"field": x}
    where = {"op": "and", "args": [{"op": "gt", "args": [f("l_tax"), 0.02]}, {"op": "ne", "args": [f("l_returnflag"), "N"]}]}
    made = [{"as": "net", "expr": {"op": "mul", "args": [f("l_extendedprice"), {"op": "sub", "args": [1.0, f("l_discount")]}]}}, {"as": "size", "expr": {"if": {"op": "gt", "args": [f("l_quantity"), 25]}, "then": "big", "else": "small"}}, {"as": "tag", "expr": {"op": "upper", "args": [{"op": "concat", "args": [f("l_returnflag"), "-", f("l_linestatus")]}]}}]
    out = transform.transform(li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"), {}, filter_expr=where, computed=made).df
    return _r(out.select("l_orderkey", "l_linenumber", "net", "size", "tag"), "net")


@query("transform_computed", "part", "SELECT p_partkey, p_retailprice + p_size AS total, CASE WHEN p_size <> 0 THEN p_retailprice / p_size END AS each, lower(p_brand) AS low, p_brand || ':' || p_type AS both, coalesce(nullif(trim(p_name), ''), p_type) AS first FROM part")
def _(p):
    made = {"total": "add($p_retailprice, $p_size)", "each": "div(p_retailprice, p_size)", "low": "lower(p_brand)", "both": "concat(p_brand, ':', p_type)", "first": "coalesce(p_name, p_type)"}
    return transform.transform(p, {"computed_fields": made}).df.select("p_partkey", *made)


@query("transform_field_ops", "events", """
SELECT event_id, upper(event_type) AS kind, CASE WHEN value IS NOT NULL THEN sign(value) * floor(abs(value) * 10.0 + 0.5) / 10.0 END AS rounded, value * 100.0 AS scaled, regexp_extract(props, '[0-9]+') AS digits FROM events WHERE regexp_matches(props, '[0-9]')""")
def _(e):
    rules = {"filters": [{"field": "props", "op": "regex", "value": "[0-9]"}], "field_ops": [{"field": "event_type", "op": "upper", "as": "kind"}, {"field": "value", "op": "round_number", "digits": 1, "as": "rounded"}, {"field": "value", "op": "scale_number", "multiplier": 100, "as": "scaled"}, {"field": "props", "op": "extract_regex", "pattern": "[0-9]+", "as": "digits"}]}
    return transform.transform(e.drop("ts"), rules).df.select("event_id", "kind", "rounded", "scaled", "digits")


@query("transform_dates", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders")
def _(o):
    rows = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy/M/d").alias("raw"))
    out = transform.transform(rows, {"date_ops": [{"field": "raw", "op": "parse_ymd", "as": "day"}, {"field": "raw", "op": "year", "as": "y"}, {"field": "raw", "op": "month", "as": "m"}]}).df
    return out.select("o_orderkey", "day", "y", "m")


@query("survivorship", "orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(o):
    rule = {"survivorship": {"keys": ["o_custkey"], "score_fields": ["o_totalprice"], "prefer_latest_fields": ["o_orderdate"]}}
    return transform.transform(o, rule, ["o_orderkey"]).df.select("o_custkey", "o_orderkey", "o_totalprice")


@query("reason_samples", "part", "SELECT 'filter_rejected' AS status, p_partkey FROM part WHERE p_size < 10 ORDER BY p_partkey LIMIT 5")
def _(p):
    out = transform.reason_samples(p, {"filters": [{"field": "p_size", "op": "gte", "value": 10}]}, ["p_partkey"])
    return out.select("status", F.get_json_object("row", "$.p_partkey").cast("long").alias("p_partkey"))


@query("clean_finance", "orders", "SELECT id, amount FROM (SELECT o_custkey AS id, round(o_totalprice, 1) AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000) WHERE rn = 1")
def _(o):
    return transform.clean_finance(o.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"), "o_orderkey"), 1, True, 1000, 200000, ["o_orderkey"])


# Windows and time series

@query("window_rows", "orders", """
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER d AS INTEGER) AS rk, CAST(dense_rank() OVER d AS INTEGER) AS dr, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after, round(avg(o_totalprice) OVER (w ROWS 2 PRECEDING), 4) AS mov
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), d AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")
def _(o):
    made = [{"op": "row_number", "as": "rn"}, {"op": "rank", "as": "rk"}, {"op": "dense_rank", "as": "dr"}, {"op": "lag", "field": "o_totalprice", "as": "before"}, {"op": "lead", "field": "o_totalprice", "offset": 2, "as": "after"}, {"op": "moving_avg", "field": "o_totalprice", "as": "mov"}]
    return _r(windows.window_rows(o, ["o_custkey"], "o_orderdate", made, ["o_orderkey"]).select("o_orderkey", "rn", "rk", "dr", "before", "after", "mov"), "mov")


_MONTHS = "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1"


def _months(o):
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query("time_series", "orders", f"SELECT month, round(avg(v) OVER (ORDER BY month ROWS 2 PRECEDING), 2) AS ts_moving_avg, round(v - lag(v) OVER (ORDER BY month), 2) AS ts_mom, round((v - lag(v, 12) OVER (ORDER BY month)) / lag(v, 12) OVER (ORDER BY month), 4) AS ts_yoy FROM ({_MONTHS})")
def _(o):
    out = windows.time_series(_months(o), "month", "v")
    return _r(_r(out, "ts_moving_avg", "ts_mom", digits=2), "ts_yoy").select("month", "ts_moving_avg", "ts_mom", "ts_yoy")


@query("forecast", "orders", f"WITH m AS ({_MONTHS}), e AS (SELECT max_by(v, month) AS l, min_by(v, month) AS f, count(*) AS n FROM m) SELECT CAST(s AS INTEGER) AS step, round(l + s * (l - f) / (n - 1), 2) AS forecast FROM e, range(1, 4) t(s)")
def _(o):
    return _r(windows.forecast(_months(o), "month", "v"), "forecast", digits=2)


@query("balance_gaps", "orders", """
SELECT o_orderkey, p AS previous_balance, coalesce(abs(b - (p + a)) > 0.05, false) AS balance_gap FROM (SELECT o_orderkey, o_totalprice AS b, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 1.5 END AS a, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)""")
def _(o):
    rows = o.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("balance"), F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(1.5).alias("amount"))
    return windows.balance_gaps(rows, "o_custkey", ["o_orderkey"]).select("o_orderkey", "previous_balance", "balance_gap")


# Event-time windows

_SUMS = "count(*) AS count, round(coalesce(sum(value), 0.0), 4) AS sum, round(avg(value), 8) AS avg"


@query("stream_tumbling", "events", f"SELECT (epoch_us(ts) // 1000) // 3600000 * 3600000 AS window_start_ms, (epoch_us(ts) // 1000) // 3600000 * 3600000 + 3600000 AS window_end_ms, event_type, {_SUMS} FROM events GROUP BY 1, 2, 3")
def _(e):
    return _r(_r(streams.stream_window(e, "ts", 3_600_000, "value", ["event_type"]), "sum"), "avg", digits=8)


@query("stream_sliding", "events", f"SELECT s AS window_start_ms, s + 7200000 AS window_end_ms, {_SUMS} FROM (SELECT value, unnest(list_filter([(epoch_us(ts) // 1000) // 1800000 * 1800000 - j * 1800000 FOR j IN range(0, 5)], lambda x: x <= (epoch_us(ts) // 1000) AND (epoch_us(ts) // 1000) < x + 7200000)) AS s FROM events) GROUP BY 1, 2")
def _(e):
    return _r(_r(streams.stream_window(e, "ts", 7_200_000, "value", window_type="sliding", slide_ms=1_800_000), "sum"), "avg", digits=8)


@query("stream_session", "events", f"""
WITH g AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, value, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000 THEN 1 ELSE 0 END AS gap FROM events), s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS sid FROM g)
SELECT min(t) AS window_start_ms, max(t) + 1 AS window_end_ms, CAST(user_id AS VARCHAR) AS user_id, {_SUMS} FROM s GROUP BY user_id, sid""")
def _(e):
    return _r(_r(streams.stream_window(e, "ts", 3_600_000, "value", ["user_id"], "session", gap_ms=3_600_000), "sum"), "avg", digits=8)


_NOW = 1706600000000


@query("stream_late", "events", f"SELECT event_id FROM events WHERE {_NOW} - (epoch_us(ts) // 1000) > 864000000")
def _(e):
    return streams.split_late(e, "ts", _NOW, 864_000_000)[1].select("event_id")


@query("stream_chunks", "events", "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 100 AS BIGINT) AS chunk_id FROM events WHERE event_id > 50")
def _(e):
    return streams.chunk_ids(e, "event_id", 100, 50).select("event_id", "chunk_id")


# Quality

@query("quality_v2", "lineitem", """
SELECT 'null_ratio' AS "check", 'l_orderkey' AS field, CAST(0.0 AS DOUBLE) AS value, CAST(0.1 AS DOUBLE) AS "limit", true AS passed UNION ALL SELECT 'range', 'l_discount', CAST(count(*) FILTER (l_discount > 0.05) AS DOUBLE), 0.0, count(*) FILTER (l_discount > 0.05) = 0 FROM lineitem
UNION ALL SELECT 'drift', 'l_quantity', round(abs(avg(l_quantity) - 20.0), 4), 1.0, abs(avg(l_quantity) - 20.0) <= 1.0 FROM lineitem
UNION ALL SELECT 'unique', 'l_orderkey,l_linenumber', CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS DOUBLE), 0.0, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def _(li):
    return _r(quality.quality_check(li, {"required_fields": ["l_orderkey"], "max_null_ratio": 0.1, "range_checks": [{"field": "l_discount", "max": 0.05}], "drift_check": {"field": "l_quantity", "baseline_mean": 20.0, "max_delta": 1.0}, "unique_fields": ["l_orderkey", "l_linenumber"]}, 2), "value")


_IQR = "SELECT list_sort(list(s_acctbal))[CAST(floor((count(*) - 1) * 0.25 + 0.5) AS BIGINT) + 1] AS q1, list_sort(list(s_acctbal))[CAST(floor((count(*) - 1) * 0.75 + 0.5) AS BIGINT) + 1] AS q3 FROM supplier"


@query("quality_iqr", "supplier", f"SELECT count(*) AS n, count(*) FILTER (s_acctbal < q1 - 0.3 * (q3 - q1) OR s_acctbal > q3 + 0.3 * (q3 - q1)) AS outliers FROM supplier, ({_IQR})")
def _(s):
    return quality.iqr_outliers(s, "s_acctbal", 0.3)


@query("quality_zscore", "events", "SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE s > 0 AND abs(value - m) / s > 1.5")
def _(e):
    return quality.outliers_z(e, "value", 1.5).select("event_id")


@query("quality_psi", "lineitem", """
WITH s AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem), b AS (SELECT least(CAST(floor((l_quantity - lo) / w) AS INTEGER), 9) AS bin, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS c FROM lineitem, s GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(c) AS tc FROM b)
SELECT round(sum((greatest(a / ta, 1e-6) - greatest(c / tc, 1e-6)) * ln(greatest(a / ta, 1e-6) / greatest(c / tc, 1e-6))), 6) AS psi FROM b, t""")
def _(li):
    return _r(quality.psi(li.filter("l_returnflag = 'R'"), li.filter("l_returnflag <> 'R'"), "l_quantity"), "psi", digits=6)


@query("quality_v4_dsl", "supplier")
def _(s):
    return quality.quality_check(s, {"rules_dsl": "required: s_name\nunique: s_suppkey\nrange: s_acctbal x >= -1000 <= 10000\nanomaly_iqr: field=s_acctbal,max_ratio=0.2"}, 4)


@query("constraints", "lineitem", """
SELECT l_orderkey, l_linenumber, CAST(0 AS INTEGER) AS "constraint", 'sum_equals' AS kind FROM lineitem WHERE abs(l_discount + l_tax - 0.1) > 0.05 UNION ALL SELECT l_orderkey, l_linenumber, 1, 'non_negative' FROM lineitem WHERE l_quantity < 0""")
def _(li):
    return quality.constraint_violations(li.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity", F.lit(0.1).alias("ten")), [{"kind": "sum_equals", "left": ["l_discount", "l_tax"], "right": "ten", "tolerance": 0.05}, {"kind": "non_negative", "field": "l_quantity"}]).select("l_orderkey", "l_linenumber", "constraint", "kind")


@query("rule_simulator", "part", "SELECT 'p_brand' AS field, count(*) AS changed FROM part WHERE lower(p_brand) <> p_brand")
def _(p):
    return quality.simulate_rules(p, {}, {"string_ops": [{"field": "p_brand", "op": "lower"}]}, ["p_partkey"])


# Texts

@query("entity_extract", "documents", """
SELECT doc_id, 'email' AS kind, CAST(i - 1 AS INTEGER) AS position, x[i] AS value FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS x FROM documents), unnest(range(1, len(x) + 1)) t(i)""")
def _(d):
    return text.extract_entities(d, "doc_id", "text").filter("kind = 'email'")


@query("entity_link", "customer", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS canonical, substr(sha256(trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g'))), 1, 12) AS entity_id FROM customer")
def _(c):
    return text.link_entities(c, "c_name").select("c_custkey", "canonical", "entity_id")


@query("text_chunks", "conversations", "SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS chunk_seq, trim(substr(text, CAST((i - 1) * 100 + 1 AS BIGINT), 100)) AS chunk_text FROM conversations, unnest(range(1, CAST(ceil(length(text) / 100.0) AS BIGINT) + 1)) t(i) WHERE length(text) > 0")
def _(c):
    return text.chunk(c, "text", "fixed", 100).select("conv_id", "turn", "chunk_seq", "chunk_text")


@query("text_preprocess", "documents")
def _(d):
    return text.preprocess(d, "text").select("doc_id", "text_sha256")


@query("clean_lines", "documents")
def _(d):
    return text.clean_lines(d, "text").select("doc_id", "n_lines", F.md5("clean_text").alias("md5"))


@query("corruption_score", "documents")
def _(d):
    return d.select("doc_id", F.round(text.corruption(F.col("text")), 6).alias("corruption"))


@query("evidence_rows", "conversations", "SELECT substr(sha1('|||' || turn || '|' || trim(text)), 1, 16) AS evidence_id, trim(text) AS claim_text FROM conversations WHERE trim(text) <> ''")
def _(c):
    out = text.standardize_evidence(c.select("text", F.col("turn").cast("string").alias("row")))
    return out.filter("claim_text <> ''").select("evidence_id", "claim_text")


@query("fact_crosscheck", "documents", """
WITH k AS (SELECT array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> ''), ' ') AS claim, source FROM documents) SELECT md5(claim) AS claim, count(DISTINCT source) AS sources, count(*) AS rows, count(DISTINCT source) >= 2 AS supported FROM k GROUP BY claim""")
def _(d):
    return intelligence.crosscheck_facts(d, "text", "source").withColumn("claim", F.md5("claim"))


@query("conflicts", "conversations")
def _(c):
    return text.detect_conflicts(c, "text", "role").select("conv_id", "turn", "topic", "polarity", "conflict")


@query("near_identical_lines", "benchmark", "SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY regexp_replace(lower(text), '[^a-z0-9]', '', 'g') ORDER BY item_id) AS rn FROM benchmark WHERE length(text) >= 18 AND length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) > 16) WHERE rn = 1 UNION ALL SELECT item_id FROM benchmark WHERE NOT (length(text) >= 18 AND length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) > 16)")
def _(b):
    return text.drop_near_identical(b, "text", ["item_id"]).select("item_id")


# Search and analysis

@query("vector_tf_search", "benchmark", """
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS term, len(w) AS n FROM w), t AS (SELECT item_id, term, count(*) / any_value(n) AS tf FROM u GROUP BY 1, 2), v AS (SELECT item_id, sqrt(sum(tf * tf)) AS norm FROM t GROUP BY 1),
d AS (SELECT CAST(q.item_id AS VARCHAR) AS query, CAST(i.item_id AS VARCHAR) AS id, sum(q.tf * i.tf) / any_value(a.norm) / any_value(b.norm) AS score FROM t q JOIN t i USING (term) JOIN v a ON a.item_id = q.item_id JOIN v b ON b.item_id = i.item_id WHERE q.item_id % 20 = 0 GROUP BY 1, 2)
SELECT query, id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rk FROM d) WHERE rk <= 5""")
def _(b):
    index = intelligence.term_frequencies(b, "item_id", "text")
    asked = intelligence.term_frequencies(b.filter("item_id % 20 = 0"), "item_id", "text")
    return _r(intelligence.vector_search(index, asked), "score", digits=6)


@query("vector_quality", "benchmark", "SELECT count(*) AS queries, CAST(1.0 AS DOUBLE) AS recall_at_k, CAST(1.0 AS DOUBLE) AS mrr FROM benchmark WHERE item_id % 20 = 0")
def _(b):
    index = intelligence.term_frequencies(b, "item_id", "text")
    asked = b.filter("item_id % 20 = 0")
    found = intelligence.vector_search(index, intelligence.term_frequencies(asked, "item_id", "text"))
    return intelligence.search_quality(found, asked.select(F.col("item_id").cast("string").alias("query"), F.col("item_id").cast("string").alias("id")))


@query("character_search", "part", "SELECT CAST(p_partkey AS VARCHAR) AS id, (CAST(contains(lower(p_name), 'r') AS INTEGER) + CAST(contains(lower(p_name), 'e') AS INTEGER) + CAST(contains(lower(p_name), 'd') AS INTEGER)) / 3.0 AS score FROM part ORDER BY score DESC, id LIMIT 10")
def _(p):
    return intelligence.character_search(p, "p_partkey", "p_name", "red", top_k=10)


@query("regression", "lineitem", "SELECT l_returnflag, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def _(li):
    out = intelligence.regression_columns(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return _r(_r(_r(out, "correlation", digits=6), "slope"), "intercept", digits=2).withColumn("n", F.col("n").cast("long"))


@query("finance_ratio", "supplier", "SELECT s_suppkey, CASE WHEN s_nationkey <> 0 THEN round(s_acctbal / s_nationkey, 8) END AS ratio_current, CAST(NULL AS DOUBLE) AS ratio_net_margin FROM supplier")
def _(s):
    out = intelligence.finance_ratios(s.withColumns({"current_assets": F.col("s_acctbal"), "current_liabilities": F.col("s_nationkey"), "net_income": F.lit(1.0)}))
    return _r(out, "ratio_current", digits=8).select("s_suppkey", "ratio_current", "ratio_net_margin")


@query("anomaly_explain", "lineitem", "SELECT l_orderkey, l_linenumber, 'l_extendedprice' AS top FROM lineitem WHERE l_quantity >= 49")
def _(li):
    out = intelligence.explain_anomalies(li.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice") + 1e9, "l_tax").toDF("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"), "l_quantity", 49)
    return out.select("l_orderkey", "l_linenumber", F.col("top_factors")[0]["field"].alias("top"))


@query("evidence_rank", "events", "SELECT event_id, round(0.45 * value + 0.10 / (1 + greatest((epoch(TIMESTAMP '2024-02-01') - (epoch_us(ts) // 1000) // 1000) / 86400.0, 0) / 30), 6) AS rank_score FROM events WHERE value IS NOT NULL")
def _(e):
    out = intelligence.rank_evidence(e.filter("value is not null").select("event_id", F.col("value").alias("relevance"), F.col("ts").alias("published_at")), "2024-02-01 00:00:00")
    return _r(out, "rank_score", digits=6).select("event_id", "rank_score")


# Sources, plans and streams

def _folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a local one only in a session of one process that has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rowlake-")
    return f"{base.rstrip('/')}/rowlake-tables/{uuid.uuid4().hex[:12]}"


@query("parquet_roundtrip", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def _(n):
    path = _folder(n.sparkSession)
    tables.write_parquet(n, path, ["n_regionkey"], "zstd")
    return tables.read_parquet(n.sparkSession, path, ["n_nationkey", "n_name", "n_regionkey"], {"n_regionkey": 2})


@query("jsonl_roundtrip", "region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def _(r):
    path = _folder(r.sparkSession) + ".jsonl"
    load.save(r, path)
    return load.load(r.sparkSession, path).select("r_regionkey", "r_name")


@query("merge_small", "region", "SELECT r_regionkey, r_name FROM region")
def _(r):
    path = _folder(r.sparkSession)
    r.repartition(4).write.parquet(path)
    tables.merge_small(r.sparkSession, path, path + "-merged")
    return r.sparkSession.read.parquet(path + "-merged")


@query("aggregate_pushdown", "orders", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(o):
    o.createOrReplaceTempView("rowlake_orders")
    return load.aggregate_pushdown(o.sparkSession, "rowlake_orders", ["o_orderstatus"], [{"op": "count", "as": "n"}, {"op": "max", "field": "o_totalprice", "as": "top"}], "o_totalprice > 1000")


@query("feature_upsert", "customer", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(c):
    old = c.select("c_custkey", "c_acctbal", F.lit(0).alias("version"))
    new = old.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return tables.upsert_features(old, new, "c_custkey", "version").select("c_custkey", "c_acctbal")


@query("schema_migration", "part", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(NULL AS BIGINT) AS p_brand, CAST(NULL AS VARCHAR) AS extra FROM part")
def _(p):
    steps = tables.suggest_migration({"p_partkey": "int_like", "p_size": "int", "p_brand": "string", "extra": "string"}, {"p_partkey": "string", "p_size": "float", "p_brand": "int"})
    return tables.migrate(p.select("p_partkey", "p_size", "p_brand"), steps)


@query("normalize_schema", "region", "SELECT r_regionkey, r_name, 'x' AS tag, CAST(NULL AS VARCHAR) AS note FROM region")
def _(r):
    return transform.normalize_schema(r, ["r_name", "tag", "note"], {"tag": "x"})


@query("rules_dsl", "part", "SELECT p_partkey, p_brand AS brand, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE p_size >= 10 AND trim(p_name) <> ''")
def _(p):
    rules = plan_rules.compile_rules("rename p_brand -> brand\ncast p_size: float\nrequired p_name\nfilter p_size >= 10\nfilter p_type != 'nothing'  # a comment")
    return transform.transform(p, rules).df.select("p_partkey", "brand", "p_size")


@query("workflow_dag", "orders", "SELECT o_orderstatus, o_orderkey, t FROM (SELECT o_orderstatus, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 2) AS t FROM orders WHERE o_totalprice > 100000)")
def _(o):
    nodes = [{"id": "keep", "type": "transform_rows", "config": {"rules": {"filters": [{"field": "o_totalprice", "op": "gt", "value": 100000}]}}}, {"id": "sums", "type": "aggregate_rows", "config": {"group_by": ["o_orderstatus"], "aggregates": [{"op": "sum", "field": "o_totalprice", "as": "t"}]}}, {"id": "both", "type": "join_rows", "config": {"input_map": {"left": "$keep", "right": "$sums"}, "left_on": "o_orderstatus", "right_on": "o_orderstatus"}}]
    out = workflow.run({"nodes": nodes, "edges": [{"from": "keep", "to": "sums"}, {"from": "keep", "to": "both"}, {"from": "sums", "to": "both"}]}, {"rows": o})
    return _r(out["outputs"]["both"], "t", digits=2).select("o_orderstatus", "o_orderkey", "t")


@query("chart_first_seen", "orders", """
WITH s AS (SELECT o_orderpriority AS category, o_orderstatus AS series, round(sum(o_totalprice), 2) AS value, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), c AS (SELECT category, CAST(row_number() OVER (ORDER BY min(f), category) AS INTEGER) AS category_order FROM s GROUP BY 1), t AS (SELECT series, CAST(row_number() OVER (ORDER BY min(f), series) AS INTEGER) AS series_order FROM s GROUP BY 1)
SELECT category, series, value, category_order, series_order FROM s JOIN c USING (category) JOIN t USING (series)""")
def _(o):
    return _r(agg.chart_first_seen(o, "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"), "value", digits=2)


@query("transform_chunks", "orders", "SELECT o_orderkey, chunk_id FROM (SELECT o_orderkey, o_custkey, chunk_id, row_number() OVER (PARTITION BY chunk_id, o_custkey ORDER BY o_orderkey DESC) AS rn FROM (SELECT *, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS BIGINT) AS chunk_id FROM orders)) WHERE rn = 1 AND chunk_id IN (1, 2)")
def _(o):
    return transform.transform_chunks(o, {"deduplicate_by": ["o_custkey"]}, "o_orderkey", 500, done=0, most=2)[0].select("o_orderkey", "chunk_id")


@query("clean_generic", "orders", "SELECT o_orderkey, round(o_totalprice, 0) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus <> 'P' AND round(o_totalprice, 0) > 50000")
def _(o):
    rows = o.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 0).cast("long").cast("string").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("day"))
    rules = {"casts": {"o_totalprice": "float"}, "date_ops": [{"field": "day", "op": "parse_ymd"}], "filters": [{"field": "o_orderstatus", "op": "ne", "value": "P"}, {"field": "o_totalprice", "op": "gt", "value": 50000}], "sort_by": ["o_orderkey"]}
    return transform.clean_generic(rows, rules, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "day")


@query("money_grammar", "customer", "SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer WHERE abs(c_acctbal) >= 1")
def _(c):
    n = F.format_number(F.abs("c_acctbal"), 2)
    shown = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), n, F.lit(")"))).otherwise(F.concat(F.lit("$ "), n))
    return c.filter("abs(c_acctbal) >= 1").select("c_custkey", F.round(money(shown), 2).alias("amount"))


@query("modality_report", "supplier", "SELECT count(*) AS rows, CAST(0.9 AS DOUBLE) AS header_confidence, CAST(1.0 AS DOUBLE) AS numeric_parse_rate, CAST(1.0 AS DOUBLE) AS date_parse_rate, CAST(0.0 AS DOUBLE) AS blank_row_ratio, CAST(1.0 AS DOUBLE) AS coverage, CAST(0.0 AS DOUBLE) AS duplicate_key_ratio FROM supplier")
def _(s):
    return quality.modality_report(s, 0.9, ["s_acctbal"], [], ["s_suppkey"])


@query("session_ids", "events", "SELECT event_id, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) > 7200000 THEN 1 ELSE 0 END AS gap FROM events)")
def _(e):
    return streams.session_ids(e, ["user_id"], "ts", 7_200_000).select("event_id", "session_id")


@query("text_signals", "documents", "SELECT doc_id, nullif(regexp_extract(text, 'https?://[^\\s]+|www\\.[^\\s]+'), '') AS source_url, nullif(regexp_extract(text, '\\[(\\d{1,3})\\]', 1), '') AS citation FROM documents")
def _(d):
    return enrichment.text_signals(d, "text").select("doc_id", "source_url", "citation")


@query("paragraphs", "documents")
def _(d):
    return enrichment.rebuild_paragraphs(d, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query("speaker_turns", "conversations")
def _(c):
    return text.speaker_turns(c.select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line")), "line").select("conv_id", "turn", "turn_seq", "speaker")


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums by a stream over the events file, into the shared folder and back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = _folder(spark)
    streams.run_available(streams.windowed_stream(stream, "ts", "1 day", "1 hour", "value", ["event_type"]), f"{folder}/out", f"{folder}/checkpoint")
    return _r(_r(spark.read.parquet(f"{folder}/out"), "sum"), "avg", digits=8)


_Q["structured_stream"] = _structured
_SQL["structured_stream"] = f"WITH e AS (SELECT *, epoch_us(ts) // 86400000000 * 86400000 AS s FROM events) SELECT s AS window_start_ms, s + 86400000 AS window_end_ms, event_type, {_SUMS} FROM e WHERE s + 86400000 <= (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events) GROUP BY 1, 2, 3"
