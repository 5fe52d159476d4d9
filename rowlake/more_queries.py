"""More registered queries, one for each component that queries.py doesn't reach, each with the SQL that gives the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlake.functions import fields
from rowlake.operators import aggregates as agg
from rowlake.operators import claims, enrichment, filters, intelligence, papers, quality, ranges, text, transform, windows
from rowlake.plans import contracts, governance, rules as plan_rules, tasks, workflow
from rowlake.queries import _CLEAN, _RULES, _Q, _SQL, _folder, _r, query
from rowlake.sources import load, office, tables
from rowlake.streaming import state, windows as streams


def told(name: str, schema: str, rows: list[tuple]):
    """Registers a small table that f() makes, row tuples, and the rows that it must have as SQL."""
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    names = [x.split() for x in schema.split(", ")]
    one = lambda v, k: f"CAST({'NULL' if v is None else repr(v).lower() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)} AS {kinds[k]})"

    def put(f):
        _Q[name] = lambda spark, sf_dir: spark.createDataFrame(f(spark), schema)
        _SQL[name] = " UNION ALL ".join("SELECT " + ", ".join(f'{one(v, k)} AS "{n}"' for v, (n, k) in zip(r, names)) for r in rows)
        return f

    return put


# Sources and sinks

@query("txt_lines", "nation", "SELECT row_number() OVER (ORDER BY n_nationkey) AS line_no, n_name AS text FROM nation")
def _(n):
    path = _folder(n.sparkSession)
    n.orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return load.load(n.sparkSession, path, "txt").select("line_no", "text")


@query("txt_paragraphs", "documents", r"SELECT count(*) AS n FROM (SELECT unnest(regexp_split_to_array(string_agg(text, chr(10) || chr(10)), '\n\s*\n')) AS p FROM (SELECT text FROM documents WHERE length(trim(text)) > 0)) WHERE trim(p, ' ') <> ''")
def _(d):
    path = _folder(d.sparkSession)
    d.filter("length(trim(text)) > 0").select("text").coalesce(1).write.option("lineSep", "\n\n").text(path)
    return load.load(d.sparkSession, path, "txt", paragraphs=True).agg(F.count("*").alias("n"))


@query("metadata_rows", "region", "SELECT 'pdf' AS source_type, 'metadata_only' AS extract_status, count(*) > 0 AS sized FROM region")
def _(r):
    path = _folder(r.sparkSession)
    r.coalesce(1).write.json(path)
    rows = load.load(r.sparkSession, f"{path}/*.json", "pdf")
    return rows.select("source_type", "extract_status", (F.col("size_bytes") > 0).alias("sized"))


@query("load_retries", "nation", "SELECT n_name, 2 AS attempt FROM nation")
def _(n):
    path, calls = _folder(n.sparkSession) + ".jsonl", []
    load.save(n, path)

    def flaky(df):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("lost")
        return df.count()

    df, stats = load.load_stats(n.sparkSession, path, wait_s=0.01, action=flaky)
    return df.select("n_name", F.lit(stats["attempt"]).alias("attempt"))


@query("csv_roundtrip", "part", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, replace(p_brand || ',' || p_type, ',', ' ') AS both, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(p):
    path = _folder(p.sparkSession) + ".csv"
    load.save(p.select("p_size", F.concat_ws(",", "p_brand", "p_type").alias("both"), "p_partkey"), path)
    return load.load(p.sparkSession, path)


@query("csv_naive", "nation", """SELECT n_name AS name, '"' || n_regionkey || ' "' AS quoted, '' AS rest FROM nation""")
def _(n):
    path = _folder(n.sparkSession)
    n.select(F.concat(F.col("n_name"), F.lit(' , "'), F.col("n_regionkey"), F.lit(' "')).alias("value")).unionByName(n.limit(0).select(F.lit("x").alias("value"))).coalesce(1).write.text(path)
    spark = n.sparkSession
    spark.range(1).select(F.lit("name,quoted,rest").alias("value")).write.mode("append").text(path)
    rows = spark.read.text(path)  # the header may lie in any file: put first
    head = _folder(spark)
    rows.orderBy(F.col("value") != "name,quoted,rest").coalesce(1).write.text(head)
    return load.load(spark, head, "csv", naive=True)


@query("sqlite_roundtrip", "nation", "SELECT n_nationkey, n_name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation) WHERE n_nationkey > 5")
def _(n):
    path = _folder(n.sparkSession).removeprefix("file://") + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    load.save(n, f"sqlite://{path}", "sqlite")
    sql = "select json_extract(payload, '$.n_nationkey') as n_nationkey, json_extract(payload, '$.n_name') as n_name from rows where json_extract(payload, '$.n_nationkey') > 5"
    return load.load(n.sparkSession, f"sqlite://{path}", query=sql)


@query("typed_parquet", "part", "SELECT p_partkey, CASE WHEN p_size > 9 THEN p_retailprice END AS price, p_size > 25 AS large, p_name FROM part")
def _(p):
    path = _folder(p.sparkSession)
    texts = p.select(F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 9, F.col("p_retailprice").cast("string")).otherwise("").alias("price"), F.upper((F.col("p_size") > 25).cast("string")).alias("large"), "p_name")
    load.save(texts, path, "parquet", infer=True)
    return p.sparkSession.read.parquet(path)


@query("payload_parquet", "supplier", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(s):
    path = _folder(s.sparkSession)
    load.save(s.select("s_suppkey", "s_name", "s_acctbal"), path, "parquet", payload=True)
    return load.load(s.sparkSession, path, "parquet", payload_schema="s_suppkey long, s_name string, s_acctbal double")


@query("parquet_inspect", "region", "SELECT 'r_regionkey' AS name, 'int' AS kind, 'int' AS sidecar UNION ALL SELECT 'r_name', 'string', 'string'")
def _(r):
    spark, path = r.sparkSession, _folder(r.sparkSession)
    tables.write_parquet(r, path)
    side = {f.name: f.dataType.simpleString() for f in tables.sidecar_schema(spark, path)}
    return spark.createDataFrame([(n, k, side[n]) for n, k in tables.inspect_parquet(spark, path)], "name string, kind string, sidecar string")


@query("load_many", "nation region", "SELECT n_name AS name, n_nationkey AS nation, CAST(NULL AS BIGINT) AS region FROM (SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation) UNION ALL SELECT r_name, NULL, CAST(r_regionkey AS BIGINT) FROM region")
def _(n, r):
    spark, a, b = n.sparkSession, _folder(n.sparkSession) + ".jsonl", _folder(n.sparkSession) + ".jsonl"
    load.save(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation")), a)
    load.save(r.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), b)
    return load.load_many(spark, [a, f"{a}-none.jsonl", b])[0].select("name", "nation", "region")


@query("json_rows", "nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(n):
    path = _folder(n.sparkSession)
    one = n.select("n_nationkey", "n_name").agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))).alias("value"))
    one.coalesce(1).write.text(path)
    return load.load(n.sparkSession, path, "json_rows")


@query("encoded_texts", "region", "SELECT r_name || ' 金额' AS text FROM region")
def _(r):
    path = _folder(r.sparkSession)
    r.select(F.concat(F.col("r_name"), F.lit(" 金额")).alias("value")).repartition(5, "r_name" if "r_name" in r.columns else "value").write.option("encoding", "UTF-8").text(path)
    rows = load.read_encoded(r.sparkSession, f"{path}/*.txt")
    return rows.select(F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("text"))


@told("sniffed_delimiters", "text string, delimiter string, decoded string", [("a;b;c", ";", "a;b;c"), ("a\tb", "\t", "a\tb"), ("a,b;c,d", ",", "a,b;c,d"), ("金额|日期", "|", "金额|日期")])
def _(spark):
    out = []
    for x in ("a;b;c", "a\tb", "a,b;c,d", "金额|日期"):
        path = _folder(spark)
        spark.createDataFrame([(x,)], "value string").write.text(path)
        out.append((x, load.sniff_delimiter(spark, path), load.decode(x.encode("gb18030"))))
    return out


@query("catalog_columns", "nation", "SELECT 'n_nationkey' AS name, 'int' AS kind, 'sampled' AS what, CAST(3 AS BIGINT) AS n UNION ALL SELECT 'n_name', 'string', 'sampled', 3 UNION ALL SELECT 'n_regionkey', 'int', 'sampled', 3")
def _(n):
    n.createOrReplaceTempView("rowlake_nation")
    spark = n.sparkSession
    some = load.browse(spark, "sample_rows", "rowlake_nation", 3).count()
    assert "rowlake_nation" in load.browse(spark, "list_tables") and "default" in load.browse(spark, "list_schemas") and load.browse(spark, "validate_connection") == [True]
    return spark.createDataFrame([(c, k, "sampled", some) for c, k, _ in load.browse(spark, "describe_table", "rowlake_nation")], "name string, kind string, what string, n long")


_GUARDED = [("query", "select a from t", True), ("query", "SELECT 1", True), ("query", "delete from t", False), ("query", "select 1; select 2", False), ("query", "select * from t where x = 'drop'", False), ("where", "a >= 3 and b like 'x%'", True), ("where", "a = 1 or 1=1 --", False), ("where", "a in (1)", False), ("identifier", "s.t_1", True), ("identifier", "a..b", False), ("identifier", "a;b", False)]


@told("sql_guards", "kind string, text string, allowed boolean", _GUARDED)
def _(spark):
    check, out = {"query": load.check_query, "where": load.check_where, "identifier": load.check_identifier}, []
    for kind, x, _ in _GUARDED:
        try:
            out.append((kind, x, bool(check[kind](x))))
        except ValueError:
            out.append((kind, x, False))
    return out


@told("schema_modes", "mode string, change string, fits boolean", [("additive", "more", True), ("strict", "more", False), ("additive", "wider", False), ("widen", "wider", True), ("widen", "text", True), ("widen", "gone", False), ("strict", "same", True)])
def _(spark):
    base = spark.createDataFrame([], "a int, b string").schema
    kinds = {"more": "a int, b string, c int", "wider": "a double, b string", "text": "a string, b string", "gone": "b string", "same": "a int, b string"}
    out = []
    for mode, change in (("additive", "more"), ("strict", "more"), ("additive", "wider"), ("widen", "wider"), ("widen", "text"), ("widen", "gone"), ("strict", "same")):
        try:
            tables.compatible(base, spark.createDataFrame([], kinds[change]).schema, mode)
            out.append((mode, change, True))
        except tables.SchemaError:
            out.append((mode, change, False))
    return out


# Transforms

@query("transform_projection", "part", "SELECT p_partkey, p_size FROM part WHERE p_size < 20")
def _(p):
    return transform.transform(p, {"filters": [{"field": "p_size", "op": "lt", "value": 20}], "include_fields": ["p_partkey", "nothing", "p_size", "p_type"], "exclude_fields": ["p_type", "none"]}).df


@query("strict_casts", "part", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size * 1000 AS BIGINT) WHEN p_size % 3 = 1 THEN NULL END AS n, CAST(NULL AS DOUBLE) AS more FROM part WHERE p_size % 3 < 2")
def _(p):
    n = F.when(F.col("p_size") % 3 == 0, F.format_number(F.col("p_size") * 1000, 0)).when(F.col("p_size") % 3 == 1, " ").otherwise(F.concat(F.lit("¥"), F.col("p_size")))
    out = transform.transform(p.select("p_partkey", n.alias("n")), {"casts": {"n": "int", "more": "float"}, "strict_numbers": True}).df
    return out.withColumn("more", F.col("more").cast("double"))


@query("transform_benchmark", "lineitem", """
WITH r AS (SELECT l_orderkey AS id, l_extendedprice AS amount, l_quantity AS qty, l_discount * 1000 AS score, l_returnflag <> 'N' AS active, l_linestatus AS grp, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_extendedprice >= 10 AND l_quantity >= 2 AND l_returnflag <> 'N'), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, p DESC, amount DESC) AS rn FROM r)
SELECT grp, round(sum(amount), 2) AS sum_amount, round(sum(qty), 2) AS sum_qty, round(avg(score), 4) AS avg_score FROM k WHERE rn = 1 GROUP BY 1""")
def _(li):
    """Texts as a CSV holds them: five casts, three filters, the last row of each id, a sort by two keys, three aggregates."""
    rows = li.select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_extendedprice").cast("decimal(20,2)").cast("string").alias("amount"), F.col("l_quantity").cast("string").alias("qty"), (F.col("l_discount") * 1000).cast("string").alias("score"), (F.col("l_returnflag") != "N").cast("string").alias("active"), F.col("l_linestatus").alias("grp"), "l_linenumber", "l_partkey")
    rules = {
        "casts": {"id": "int", "amount": "float", "qty": "float", "score": "float", "active": "bool"}, "filters": [{"field": "amount", "op": "gte", "value": 10}, {"field": "qty", "op": "gte", "value": 2}, {"field": "active", "op": "eq", "value": True}],
        "deduplicate_by": ["id"], "sort_by": [{"field": "id", "order": "asc"}, {"field": "score", "order": "desc"}], "aggregate": {"group_by": ["grp"], "metrics": [{"op": "sum", "field": "amount", "as": "sum_amount"}, {"op": "sum", "field": "qty", "as": "sum_qty"}, {"op": "avg", "field": "score", "as": "avg_score"}]},
    }
    return _r(_r(transform.transform(rows, rules, ["l_linenumber", "l_partkey", "amount"]).aggregate, "sum_amount", "sum_qty", digits=2), "avg_score")


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("place", F.row_number().over(__import__("pyspark").sql.Window.partitionBy(F.lit(1)).orderBy(F.monotonically_increasing_id())))


@query("sort_rows", "supplier", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CAST(s_nationkey AS VARCHAR) DESC, CAST(s_suppkey AS VARCHAR)) AS INTEGER) AS place FROM supplier")
def _(s):
    return _ranked(transform.transform(s, {"sort_by": [{"field": "s_nationkey", "order": "desc"}, "s_suppkey"]}, ["s_suppkey"]).df).select("s_suppkey", "place")


@query("sort_numbers", "supplier", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END DESC NULLS LAST, s_suppkey) AS INTEGER) AS place FROM supplier")
def _(s):
    rows = s.select("s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal").cast("decimal(20,2)").cast("string")).alias("b"))
    return _ranked(transform.transform(rows, {"sort_by": [{"field": "b", "order": "desc"}, "s_suppkey"]}, ["s_suppkey"], numeric_sort=True).df).select("s_suppkey", "place")


_MESSY = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'bad' WHEN o_orderkey % 10 = 1 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS price, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_custkey FROM orders"
_MESSY_RULES = {"casts": {"price": "float"}, "filters": [{"field": "price", "op": "gte", "value": 1000}], "date_ops": [{"field": "day", "op": "parse_ymd"}], "deduplicate_by": ["o_custkey"]}


def _messy(o):
    k = F.col("o_orderkey")
    return o.select("o_orderkey", F.when(k % 10 == 0, "bad").when(k % 10 == 1, None).otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), "o_custkey")


_METRICS = f"""WITH m AS ({_MESSY}), k AS (SELECT * FROM m WHERE o_orderkey % 10 > 1 AND CAST(price AS DOUBLE) >= 1000),
q AS (SELECT (SELECT count(*) FROM m) AS input_rows, (SELECT count(*) FROM m WHERE price = 'bad') AS invalid_rows, (SELECT count(*) FROM k) AS passed_rows, (SELECT count(DISTINCT o_custkey) FROM k) AS output_rows, (SELECT count(*) FILTER (price <> 'bad') / count(price) FROM m) AS numeric_parse_rate, (SELECT count(*) FILTER (day <> 'soon') / count(*) FROM k) AS date_parse_rate)"""


@query("transform_rates", "orders", f"{_METRICS} SELECT input_rows, invalid_rows, passed_rows, output_rows, passed_rows - output_rows AS duplicate_rows_removed, round(numeric_parse_rate, 6) AS numeric_parse_rate, round(date_parse_rate, 6) AS date_parse_rate, round((passed_rows - output_rows) / passed_rows, 6) AS duplicate_key_ratio FROM q")
def _(o):
    out = transform.quality_metrics(_messy(o), _MESSY_RULES, ["o_orderkey"])
    return _r(out, "numeric_parse_rate", "date_parse_rate", "duplicate_key_ratio", digits=6).select("input_rows", "invalid_rows", "passed_rows", "output_rows", "duplicate_rows_removed", "numeric_parse_rate", "date_parse_rate", "duplicate_key_ratio")


@query("transform_gates", "orders", f"{_METRICS} SELECT 'numeric_parse_rate_min' AS gate, round(numeric_parse_rate, 6) AS value, CAST(0.95 AS DOUBLE) AS bound, numeric_parse_rate >= 0.95 AS passed FROM q UNION ALL SELECT 'date_parse_rate_min', round(date_parse_rate, 6), 0.5, date_parse_rate >= 0.5 FROM q UNION ALL SELECT 'min_output_rows', CAST(output_rows AS DOUBLE), 10.0, output_rows >= 10 FROM q UNION ALL SELECT 'max_duplicate_rows_removed', CAST(passed_rows - output_rows AS DOUBLE), 5.0, passed_rows - output_rows <= 5 FROM q")
def _(o):
    report = transform.gate_report(transform.quality_metrics(_messy(o), _MESSY_RULES, ["o_orderkey"]), {"numeric_parse_rate_min": 0.95, "date_parse_rate_min": 0.5, "min_output_rows": 10, "max_duplicate_rows_removed": 5})
    return _r(report, "value", digits=6)


@query("rule_hits", "orders", f"WITH m AS ({_MESSY}), k AS (SELECT * FROM m WHERE o_orderkey % 10 > 1 AND CAST(price AS DOUBLE) >= 1000) SELECT 'cast_fail_price' AS reason, count(*) AS rows FROM m WHERE price = 'bad' UNION ALL SELECT 'filter_price', count(*) FROM m WHERE price IS NULL OR (price <> 'bad' AND CAST(price AS DOUBLE) < 1000) UNION ALL SELECT 'duplicate_removed', count(*) - count(DISTINCT o_custkey) FROM k")
def _(o):
    return transform.rule_hits(_messy(o), _MESSY_RULES, ["o_orderkey"])


@query("duplicate_samples", "orders", "SELECT 'duplicate_removed' AS status, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn > 1 ORDER BY o_orderkey LIMIT 7")
def _(o):
    out = transform.reason_samples(o.select("o_orderkey", "o_custkey"), {"deduplicate_by": ["o_custkey"]}, ["o_orderkey"], 7)
    return out.select("status", F.get_json_object("row", "$.o_orderkey").cast("long").alias("o_orderkey"))


@query("rules_package", "orders", f"SELECT o_orderkey, o_custkey, o_orderstatus, amount, o_orderpriority FROM ({_CLEAN}) WHERE rn = 1")
def _(o):
    packages = plan_rules.RulePackages(_folder(o.sparkSession))
    packages.publish("clean", "1.0", _RULES)
    return transform.transform(o.drop("o_orderdate"), packages.get("clean", "1.0")["rules"], ["o_orderkey"]).df


@query("task_run", "orders", "SELECT o_orderstatus, count(*) AS n, 'done' AS state, 2 AS attempts FROM orders GROUP BY 1")
def _(o):
    runner, calls = tasks.Tasks(o.sparkSession), []

    def work():
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("again")
        return [tuple(r) for r in o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()]

    name = runner.submit(work, "key")
    assert runner.submit(work, "key") == name
    done = runner.wait(name)
    return o.sparkSession.createDataFrame([(*r, done["state"], done["attempts"]) for r in done["result"]], "o_orderstatus string, n long, state string, attempts int")


@query("cached_result", "part", "SELECT p_brand, count(*) AS n, CAST(1 AS INTEGER) AS hits FROM part GROUP BY 1")
def _(p):
    cache = tasks.ResultCache()
    make = lambda df: df.groupBy("p_brand").agg(F.count("*").alias("n"))
    cache.get(p, {"by": "brand"}, make)
    out = cache.get(p, {"by": "brand"}, make)
    return out.withColumn("hits", F.lit(cache.hits))


@query("finance_report", "orders", "WITH r AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS a FROM orders), k AS (SELECT * FROM r WHERE a BETWEEN 1000 AND 200000) SELECT 'input' AS reason, count(*) AS rows FROM r UNION ALL SELECT 'invalid_amount', count(*) FROM r WHERE a IS NULL HAVING count(*) > 0 UNION ALL SELECT 'below_min', count(*) FROM r WHERE a < 1000 HAVING count(*) > 0 UNION ALL SELECT 'above_max', count(*) FROM r WHERE a > 200000 HAVING count(*) > 0 UNION ALL SELECT 'output', count(DISTINCT id) FROM k UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT id) FROM k")
def _(o):
    return transform.clean_finance_report(o.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice")).alias("amount")), True, 1000, 200000)


_ODD = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Sub Total' WHEN 1 THEN 'note: see below' WHEN 2 THEN 'id' WHEN 3 THEN ' ' ELSE p_name END AS a, CASE p_partkey % 6 WHEN 2 THEN 'Amount ' WHEN 3 THEN '--' ELSE p_brand END AS b FROM part"
for _op, _where in {"blank_row": "p_partkey % 6 <> 3", "subtotal_row": "p_partkey % 6 <> 0", "note_row": "p_partkey % 6 <> 1", "header_repeat_row": "p_partkey % 6 <> 2"}.items():

    @query(f"filter_{_op}", "part", f"SELECT p_partkey, a, b FROM ({_ODD}) WHERE {_where}")
    def _(p, op=_op):
        k = F.col("p_partkey") % 6
        rows = p.select("p_partkey", F.when(k == 0, "Sub Total").when(k == 1, "note: see below").when(k == 2, "id").when(k == 3, " ").otherwise(F.col("p_name")).alias("a"), F.when(k == 2, "Amount ").when(k == 3, "--").otherwise(F.col("p_brand")).alias("b"))
        return rows.join(filters.apply_filters(rows.drop("p_partkey").distinct(), [{"op": op}]), ["a", "b"], "left_semi").select("p_partkey", "a", "b")


@query("filter_typed", "part", "SELECT p_partkey FROM part WHERE p_size IN (5, 7) AND p_retailprice = 900.5 OR false UNION ALL SELECT p_partkey FROM part WHERE p_size > 48 AND contains(p_name, 'e')")
def _(p):
    one = filters.apply_filters(p, [{"field": "p_size", "op": "in", "value": [5, 7.0, "9"]}, {"field": "p_retailprice", "op": "eq", "value": 900.5}], typed=True)
    two = filters.apply_filters(p, [{"field": "p_size", "op": "gt", "value": "48"}, {"field": "p_name", "op": "contains", "value": "e"}, {"field": "p_size", "op": "ne", "value": "49"}], typed=True)
    return one.select("p_partkey").unionAll(two.select("p_partkey"))


# Field operations, over texts made of the sample columns

def _field(name: str, spec: dict, made, sql: str, cols: str = "x"):
    """The operation on a column x that `made` builds of part; sql is its result."""

    @query(f"field_{name}", "part", f"SELECT p_partkey, {sql} FROM part")
    def _(p):
        return transform.transform(p.select("p_partkey", made().alias("x")), {"trim_strings": False, "field_ops": [{"field": "x", **spec}]}).df.select("p_partkey", *cols.split())


_c, _l = F.col, F.lit
_field("collapse_whitespace", {"op": "collapse_whitespace"}, lambda: F.concat(_l("  "), _c("p_name"), _l(" \t\n "), _c("p_brand"), _l(" ")), "p_name || ' ' || p_brand AS x")
_field("remove_urls", {"op": "remove_urls"}, lambda: F.concat(_c("p_name"), _l(" http://a.b/c?d="), _c("p_partkey"), _l(" www.x.y")), "p_name AS x")
_field("remove_emails", {"op": "remove_emails"}, lambda: F.concat(_l("mail a.b"), _c("p_partkey"), _l("@c.org now "), _c("p_name")), "'mail  now ' || p_name AS x")
_field("regex_replace", {"op": "regex_replace", "pattern": "Brand#([0-9]+)", "replace": "$1-B"}, lambda: F.concat(_c("p_brand"), _l(" "), _c("p_name")), "replace(p_brand, 'Brand#', '') || '-B ' || p_name AS x")
_field("extract_group", {"op": "extract_regex", "pattern": "#([0-9])", "group": 1, "as": "y"}, lambda: _c("p_brand"), "substr(p_brand, 7, 1) AS y", "y")
_field("parse_number", {"op": "parse_number"}, lambda: F.when(_c("p_size") % 2 == 0, F.concat(_l("¥"), F.format_number("p_size", 2), _l("万"))).otherwise(F.concat(_l("("), _c("p_size"), _l(")"))), "CASE WHEN p_size % 2 = 0 THEN p_size * 10000.0 ELSE -CAST(p_size AS DOUBLE) END AS x, CASE WHEN p_size % 2 = 0 THEN '¥' || p_size || '.00万' ELSE '(' || p_size || ')' END AS x__raw", "x x__raw")
_field("strip_currency_symbol", {"op": "strip_currency_symbol"}, lambda: F.concat(_l("€ "), _c("p_size"), _l(" USD")), "CAST(p_size AS VARCHAR) AS x")
_field("strip_thousands_sep", {"op": "strip_thousands_sep"}, lambda: F.concat(F.format_number(_c("p_partkey") * 1000003 + 1000, 0), _l(" a,b")), "CAST(p_partkey * 1000003 + 1000 AS VARCHAR) || ' a,b' AS x")
_field("map_value", {"op": "map_value", "mapping": {"SMALL": "S", "LARGE": "L"}}, lambda: F.concat(_l(" "), _c("p_type")), "CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'LARGE' THEN 'L' ELSE ' ' || p_type END AS x")
_field("fix_ocr_digits", {"op": "fix_ocr_digits"}, lambda: F.concat(_l("OoIl|SsB"), _c("p_size")), "'00111558' || p_size AS x")
_field("normalize_phone_cn", {"op": "normalize_phone_cn"}, lambda: F.when(_c("p_size") % 2 == 0, F.concat(_l("+86 138-"), F.lpad(_c("p_partkey").cast("string"), 8, "0"))).otherwise(_c("p_name")), "CASE WHEN p_size % 2 = 0 THEN '+86138' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') ELSE p_name END AS x")
_field("normalize_account_no", {"op": "normalize_account_no"}, lambda: F.concat(_l("ab-"), _c("p_partkey"), _l(" / x")), "'AB' || p_partkey || 'X' AS x")
_field("normalize_name", {"op": "normalize_name"}, lambda: F.concat(_l("　"), _c("p_name"), _l("　 "), _c("p_type")), "p_name || ' ' || p_type AS x")
_field("scale_by_header_unit", {"op": "scale_by_header_unit", "header_text": "金额(万元)"}, lambda: _c("p_size").cast("string"), "CAST(p_size * 10000 AS DOUBLE) AS x")
_field("parse_date", {"op": "parse_date"}, lambda: F.concat(_l("2024年"), 1 + _c("p_size") % 12, _l("月"), 1 + _c("p_size") % 28, _l("日")), "'2024-' || lpad(CAST(1 + p_size % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') AS x")


@query("field_sign_amount", "part", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN -CAST(p_size AS DOUBLE) WHEN 1 THEN p_retailprice - p_size ELSE CAST(p_size AS DOUBLE) END AS amount FROM part")
def _(p):
    k = F.col("p_size") % 3
    rows = p.select("p_partkey", F.col("p_size").cast("double").alias("amount"), F.when(k == 0, "付款").otherwise("in").alias("txn_type"), F.when(k == 1, F.col("p_retailprice")).alias("credit_amount"), F.when(k == 1, F.col("p_size").cast("double")).alias("debit_amount"))
    return transform.transform(rows, {"field_ops": [{"field": "amount", "op": "sign_amount_from_debit_credit"}]}).df.select("p_partkey", "amount")


@query("string_ops", "customer", "SELECT c_custkey, replace(c_name, 'Customer#', 'C-') AS short, upper(c_mktsegment) AS up, trim('  ' || c_mktsegment || ' ') AS bare FROM customer")
def _(c):
    ops = [{"field": "c_name", "op": "replace", "from": "Customer#", "to": "C-", "as": "short"}, {"field": "c_mktsegment", "op": "upper", "as": "up"}, {"field": "wide", "op": "trim", "as": "bare"}, {"field": "absent", "op": "lower", "as": "never"}]
    rows = c.withColumn("wide", F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")))
    return transform.transform(rows, {"trim_strings": False, "string_ops": ops}).df.select("c_custkey", "short", "up", "bare")


@query("text_transforms", "part", """
SELECT p_partkey, p_name || ' says so' AS citation, p_name || ' ok' AS noise, p_name || chr(10) || p_type AS lines, 'Ann ' || p_size AS speaker, CASE p_size % 4 WHEN 0 THEN 'pro' WHEN 1 THEN 'con' WHEN 2 THEN 'neutral' ELSE 'unknown' END AS stance, CASE WHEN p_size % 2 = 0 THEN 'quote' ELSE 'claim' END AS quoted, '2024-03-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') AS day FROM part""")
def _(p):
    c, t = F.col, fields.text_transform
    k = c("p_size")
    said = F.when(k % 4 == 0, "I support it").when(k % 4 == 1, "反对").when(k % 4 == 2, "undecided, I agree").otherwise("supporters agree or oppose")
    return p.select(
        "p_partkey", t("clean_citation", F.concat(c("p_name"), F.lit(" [Smith 2] says (Source: a book) so"))).alias("citation"), t("strip_ocr_noise", F.concat(c("p_name"), F.lit("\x07 okkkkkkk"))).alias("noise"), t("collapse_duplicate_lines", F.concat(c("p_name"), F.lit("\n "), F.upper("p_name"), F.lit("\n\n"), c("p_type"), F.lit("\n"), c("p_name"))).alias("lines"),
        t("extract_speaker_prefix", F.concat(F.lit("Speaker Ann "), k, F.lit(": words"))).alias("speaker"), t("normalize_stance", said).alias("stance"), t("detect_quote_only", F.concat(F.lit("“"), c("p_name"), F.when(k % 2 == 0, "” she said").otherwise("” is what one of them said there"))).alias("quoted"),
        t("parse_date", F.concat(1 + k % 28, F.lit("/03/2024")), formats=["yyyy-MM-dd", "d/MM/yyyy"]).alias("day"),
    )


@query("normalize_by_name", "part", "SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size * 10000.0 AS VARCHAR) AS amount, '2024-01-05' AS made_at, p_name || ' x' AS remark FROM part")
def _(p):
    rows = p.select(F.concat(F.col("p_partkey"), F.lit(".0")).alias("part_id"), F.concat(F.lit("¥ "), F.col("p_size")).alias("amount"), F.lit("2024年1月5日 10:30").alias("made_at"), F.concat(F.col("p_name"), F.lit("　ｘ")).alias("remark"))
    out = fields.normalize_by_name(rows, {"amount": "金额(万元)"})
    return out.withColumn("amount", F.col("amount").cast("double").cast("decimal(20,1)").cast("string"))


# Aggregates, statistics and windows

@query("agg_stride_percentile", "lineitem", """
WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY l_returnflag) / 100.0) AS BIGINT) AS k FROM lineitem)
SELECT l_returnflag, list_sort(list(x))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS p90 FROM r WHERE i % k = 0 GROUP BY 1""")
def _(li):
    return agg.sampled_percentiles(li, ["l_returnflag"], "l_extendedprice", {"p90": 0.9}, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 100)


@told("agg_specs", "spec string, alias string, valid boolean", [("sum x", "x_sum", True), ("count ", "_count", True), ("percentile_p95 x", "x_percentile_p95", True), ("sum ", None, False), ("mode x", None, False), ("topk_3 x", "x_topk_3", True)])
def _(spark):
    out = []
    for x in ("sum x", "count ", "percentile_p95 x", "sum ", "mode x", "topk_3 x"):
        op, _, field = x.partition(" ")
        try:
            out.append((x, agg.parse_specs([{"op": op, "field": field}])[0]["as"], True))
        except ValueError:
            out.append((x, None, False))
    return out


@query("percentile_whole", "lineitem", "SELECT list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.05 + 0.5) AS BIGINT) + 1] AS low, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS mid, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.99 + 0.5) AS BIGINT) + 1] AS high FROM lineitem")
def _(li):
    return ranges.percentiles(li, [], "l_extendedprice", {"low": 0.05, "mid": 0.5, "high": 0.99})


@query("chart_many_series", "lineitem", """
WITH s AS (SELECT l_returnflag AS category, CAST(l_suppkey AS VARCHAR) AS series, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), c AS (SELECT DISTINCT category FROM s ORDER BY 1 LIMIT 2), k AS (SELECT s.* FROM s JOIN c USING (category))
SELECT c.category, t.series, coalesce(k.v, 0.0) AS value FROM c CROSS JOIN (SELECT DISTINCT series FROM k) t LEFT JOIN k ON k.category = c.category AND k.series = t.series""")
def _(li):
    return agg.chart_data(li, "l_returnflag", "l_suppkey", "l_quantity", top_n=2)


@query("stats_ols", "lineitem", """
WITH m AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, corr(l_quantity, l_extendedprice) AS r, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, list_sort(list(l_extendedprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_y FROM lineitem GROUP BY 1)
SELECT l_returnflag, n AS "count", round(r, 6) AS correlation, round(s, 4) AS slope, round(i, 2) AS intercept, round(mx, 6) AS mean_x, round(my, 2) AS mean_y, round(sqrt((syy - s * s * sxx) / (n - 2) / sxx), 6) AS slope_stderr, round(s / sqrt((syy - s * s * sxx) / (n - 2) / sxx), 4) AS slope_t, median_y FROM m""")
def _(li):
    out = intelligence.stats_columns(li, ["l_returnflag"], "l_quantity", "l_extendedprice", inference=False)
    return _r(_r(_r(out, "correlation", "mean_x", "slope_stderr", digits=6), "slope", "slope_t"), "intercept", "mean_y", digits=2)


@query("window_whole", "customer", """
SELECT c_custkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER d AS INTEGER) AS rk, CAST(dense_rank() OVER d AS INTEGER) AS dr, lag(c_acctbal, 3) OVER w AS before, lead(c_name) OVER w AS after, round(avg(c_acctbal) OVER (w ROWS 4 PRECEDING), 4) AS mov
FROM customer WINDOW w AS (ORDER BY c_nationkey, c_custkey), d AS (ORDER BY c_nationkey)""")
def _(c):
    made = [{"op": "row_number", "as": "rn"}, {"op": "rank", "as": "rk"}, {"op": "dense_rank", "as": "dr"}, {"op": "lag", "field": "c_acctbal", "offset": 3, "as": "before"}, {"op": "lead", "field": "c_name", "as": "after"}, {"op": "moving_avg", "field": "c_acctbal", "window": 5, "as": "mov"}]
    # the tie comes behind the order's text
    return _r(windows.window_rows(c, [], "c_nationkey", made, ["c_custkey"]).select("c_custkey", "rn", "rk", "dr", "before", "after", "mov"), "mov")


@query("window_unknown", "nation", "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS odd FROM nation")
def _(n):
    return windows.window_rows(n.select("n_nationkey"), [], "n_nationkey", [{"op": "ntile", "as": "odd"}, {"op": "row_number", "as": " "}])


@query("signed_amounts", "part", "SELECT p_partkey, p_size % 4 = 0 AS signed_amount_conflict FROM part")
def _(p):
    rows = p.select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.col("p_size") + 5.0).otherwise(-F.col("p_size").cast("double")).alias("amount"), F.col("p_size").cast("double").alias("debit_amount"), F.lit(None).cast("double").alias("credit_amount"))
    return windows.signed_amount_conflicts(rows).select("p_partkey", "signed_amount_conflict")


@query("limit_rows", "orders", "SELECT CAST(100 AS BIGINT) AS n, CAST(7 AS BIGINT) AS m")
def _(o):
    return filters.query_lang(o, "limit what").agg(F.count("*").alias("n")).crossJoin(filters.query_lang(o, "limit 7").agg(F.count("*").alias("m")))  # one row each


# Streams, state and sketches

@query("stream_unknown_type", "events", "SELECT (epoch_us(ts) // 1000) // 3600000 * 3600000 AS window_start_ms, count(*) AS count FROM events GROUP BY 1")
def _(e):
    return streams.stream_window(e, "ts", 3_600_000, window_type="hopping").select("window_start_ms", "count")


@query("stream_text_times", "orders", "SELECT epoch_ms(o_orderdate) // 86400000 * 86400000 AS window_start_ms, count(*) AS count, round(sum(o_totalprice), 2) AS sum FROM orders GROUP BY 1")
def _(o):
    return _r(streams.stream_window(o.withColumn("t", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")), "t", 86_400_000, "o_totalprice").select("window_start_ms", "count", "sum"), "sum", digits=2)


def _transform_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = _folder(spark)
    streams.transform_stream(stream, {"filters": [{"field": "event_type", "op": "eq", "value": "click"}], "include_fields": ["event_id", "user_id"]}, f"{folder}/out", f"{folder}/checkpoint", ["event_id"])
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id")


_Q["stream_transform"], _SQL["stream_transform"] = _transform_stream, "SELECT event_id, user_id FROM events WHERE event_type = 'click'"


@query("stream_state", "nation", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS n, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM nation WHERE n_nationkey % 5 <> 0")
def _(n):
    store = state.StreamState(_folder(n.sparkSession))
    rows = n.collect()
    for r in rows:
        store.save(r.n_name, {"n": -1 if r.n_nationkey % 2 == 0 else r.n_nationkey}, now_ms=0)
    for r in rows:
        if r.n_nationkey % 2 == 0:
            store.save(r.n_name, {"n": r.n_nationkey}, expected_version=1, now_ms=1)
        if r.n_nationkey % 5 == 0:
            store.delete(r.n_name)
    return n.sparkSession.createDataFrame([(k, store.load(k)["state"]["n"], store.load(k)["version"]) for k in store.list()], "name string, n long, version long")


@query("delivery_table", "events", "SELECT event_id, CASE WHEN event_id < 500 THEN 'first' ELSE 'second' END AS batch FROM events")
def _(e):
    t = state.DeliveryTable(e.sparkSession, _folder(e.sparkSession), 8)
    one = t.take(e.filter("event_id < 500").unionAll(e.filter("event_id < 100")), "event_id", "first").select("event_id", F.lit("first").alias("batch"))
    folder = _folder(e.sparkSession)
    one.write.parquet(f"{folder}/b=1")
    t.take(e, "event_id", "second").select("event_id", F.lit("second").alias("batch")).write.parquet(f"{folder}/b=2")
    return e.sparkSession.read.parquet(folder).select("event_id", "batch")


@told("reliability", "what string, n long", [("seen", 4), ("failed", 2), ("repeats", 3), ("checkpoint", 9), ("replayed", 2), ("flushed", 2), ("left", 0)])
def _(spark):
    r = state.Reliability(_folder(spark))
    for i in range(7):
        r.record("s", f"m{i % 4}", {"i": i}, "bad" if i % 4 > 1 else None)
    r.checkpoint("s", 9)
    s = r.stats("s")
    return [*((k, int(s[k])) for k in ("seen", "failed", "repeats", "checkpoint")), ("replayed", len(r.replay("s"))), ("flushed", r.flush("s")), ("left", r.stats("s")["failed"])]


@query("sketch_distinct_close", "events", "SELECT event_type, true AS close FROM events GROUP BY 1")
def _(e):
    from rowlake.operators import sketches

    parts = sketches.merge_distinct(sketches.distinct_sketch(e.withColumn("part", F.col("event_id") % 4), ["event_type", "part"], "event_id"), ["event_type"])
    exact = e.groupBy("event_type").agg(F.count_distinct("event_id").alias("n"))
    return sketches.estimate_distinct(parts).join(exact, "event_type").select("event_type", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


@query("sketch_quantile_close", "events", "SELECT event_type, true AS close FROM events GROUP BY 1")
def _(e):
    from rowlake.operators import sketches

    merged = sketches.merge_quantiles(sketches.quantile_sketch(e.withColumn("part", F.col("event_id") % 4), ["event_type", "part"], "value"), ["event_type"])
    bounds = e.groupBy("event_type").agg(F.percentile_approx("value", 0.46, 100000).alias("low"), F.percentile_approx("value", 0.54, 100000).alias("high"))
    return sketches.estimate_quantile(merged, 0.5).join(bounds, "event_type").select("event_type", F.col("estimate").between(F.col("low"), F.col("high")).alias("close"))


@told("incremental_plans", "given string, strategy string", [("same", "cache_reuse"), ("other with checkpoint", "resume_from_checkpoint"), ("other", "full_recompute"), ("first", "full_recompute")])
def _(spark):
    old = governance.incremental_plan(None, {"rules": [1]})
    return [("same", governance.incremental_plan(old, {"rules": [1]})["strategy"]), ("other with checkpoint", governance.incremental_plan(old, {"rules": [2]}, "c7")["strategy"]), ("other", governance.incremental_plan(old, {"rules": [2]})["strategy"]), ("first", old["strategy"])]


# Functions and plugins

@query("cell_functions", "part", "SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS twice, -CAST(p_size AS DOUBLE) AS minus, upper(p_name) AS up FROM part")
def _(p):
    out = governance.apply_udf(p.select("p_partkey", "p_size", "p_name"), "p_size", "double", "twice")
    out = governance.apply_udf_signed(out, "p_size", "negate", "minus", ["negate"], governance.sign("negate", "k"), "k")
    return governance.apply_udf(out, "p_name", "upper", "up").select("p_partkey", "twice", "minus", "up")


@query("plugin_rows", "nation", "SELECT n_name AS name, CAST(n_nationkey * 2 AS BIGINT) AS twice FROM nation")
def _(n):
    import sys

    code = "import json, sys; print(json.dumps([{'name': r['n_name'], 'twice': r['n_nationkey'] * 2} for r in json.load(sys.stdin)]))"
    return governance.Plugins({"twice": [sys.executable, "-c", code]}, enabled=True).apply(n, "twice", "name string, twice long")


@query("registered_transform", "part", "SELECT p_partkey, p_name || '!' AS p_name FROM part WHERE p_size > 10")
def _(p):
    from rowlake.plans.registry import FIELD_TRANSFORMS, ROW_FILTERS

    FIELD_TRANSFORMS.register("shout", lambda c, s: F.concat(c, F.lit(s["mark"])), "replace")
    ROW_FILTERS.register("above", lambda df, s: F.col(s["field"]) > s["value"], "replace")
    spec = {"field_transforms": [{"field": "p_name", "op": "shout", "mark": "!"}], "row_filters": [{"op": "above", "field": "p_size", "value": 10}], "typed_filters": True}
    return enrichment.preprocess_rows(p, spec, ["p_partkey"]).select("p_partkey", "p_name")


# Quality

_SQL["quality_v4_dsl"] = """
WITH q AS (SELECT list_sort(list(s_acctbal))[CAST(floor((count(*) - 1) * 0.25 + 0.5) AS BIGINT) + 1] AS q1, list_sort(list(s_acctbal))[CAST(floor((count(*) - 1) * 0.75 + 0.5) AS BIGINT) + 1] AS q3 FROM supplier), o AS (SELECT count(*) FILTER (s_acctbal < q1 - 1.5 * (q3 - q1) OR s_acctbal > q3 + 1.5 * (q3 - q1)) / count(*) AS r FROM supplier, q)
SELECT 'null_ratio' AS "check", 's_name' AS field, count(*) FILTER (coalesce(trim(s_name), '') = '') / count(*) AS value, CAST(1.0 AS DOUBLE) AS "limit", true AS passed FROM supplier
UNION ALL SELECT 'range', 's_acctbal', CAST(count(*) FILTER (s_acctbal < -1000 OR s_acctbal > 10000) AS DOUBLE), 0.0, count(*) FILTER (s_acctbal < -1000 OR s_acctbal > 10000) = 0 FROM supplier
UNION ALL SELECT 'unique', 's_suppkey', CAST(count(*) - count(DISTINCT s_suppkey) AS DOUBLE), 0.0, count(*) = count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT 'anomaly_iqr', 's_acctbal', r, 0.2, r <= 0.2 FROM o"""


@query("quality_v4", "lineitem", """
WITH b AS (SELECT count(*) FILTER (l_discount < 0.02 OR l_discount > 0.08) AS n FROM lineitem), q AS (SELECT list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.25 + 0.5) AS BIGINT) + 1] AS q1, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.75 + 0.5) AS BIGINT) + 1] AS q3 FROM lineitem), o AS (SELECT count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) / count(*) AS r FROM lineitem, q), u AS (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS d FROM lineitem)
SELECT CASE WHEN n > 0 THEN 1 ELSE 0 END + CASE WHEN d > 0 THEN 1 ELSE 0 END + CASE WHEN r > 0.01 THEN 1 ELSE 0 END AS violations, n = 0 AND d = 0 AND r <= 0.01 AS passed, greatest(0, 100 - 8 * (CASE WHEN n > 0 THEN 1 ELSE 0 END + CASE WHEN d > 0 THEN 1 ELSE 0 END + CASE WHEN r > 0.01 THEN 1 ELSE 0 END)) AS score FROM b, o, u""")
def _(li):
    checks = quality.quality_check(li, {"rules_dsl": "unique: l_orderkey,l_linenumber\nrange: l_discount x >= 0.02 <= 0.08\nanomaly_iqr: field=l_extendedprice,max_ratio=0.01\nwhat is this"}, 4)
    return quality.score(checks, 4).select(F.col("violations").cast("int").alias("violations"), "passed", F.col("score").cast("int").alias("score"))


@query("quality_iqr_interpolated", "supplier", "WITH q AS (SELECT quantile_cont(s_acctbal, 0.25) AS q1, quantile_cont(s_acctbal, 0.75) AS q3 FROM supplier) SELECT count(*) AS n, count(*) FILTER (s_acctbal < q1 - 0.3 * (q3 - q1) OR s_acctbal > q3 + 0.3 * (q3 - q1)) AS outliers FROM supplier, q")
def _(s):
    return quality.iqr_outliers(s, "s_acctbal", 0.3, interpolated=True)


@query("quality_rates", "orders", f"""
WITH m AS ({_MESSY}), r AS (SELECT count(*) FILTER (price <> 'bad') / count(price) AS n, count(*) FILTER (day <> 'soon') / count(*) AS d, 1.0 - count(DISTINCT o_custkey) / count(*) AS u, count(*) FILTER (price IS NULL) / count(*) AS z FROM m)
SELECT 'numeric_parse_rate' AS "check", 'price' AS field, round(n, 6) AS value, CAST(0.95 AS DOUBLE) AS "limit", n >= 0.95 AS passed FROM r UNION ALL SELECT 'date_parse_rate', 'day', round(d, 6), 0.5, d >= 0.5 FROM r UNION ALL SELECT 'unique', 'o_custkey', round(u, 6), 0.5, u <= 0.5 FROM r UNION ALL SELECT 'blank_row_ratio', '', 0.0, 0.1, true FROM r UNION ALL SELECT 'dependency', 'price', CAST(round(z * count(*), 0) AS DOUBLE), 0.0, z = 0 FROM r, m GROUP BY z""")
def _(o):
    rules = {"numeric_fields": ["price"], "numeric_parse_rate_min": 0.95, "date_fields": ["day"], "date_parse_rate_min": 0.5, "unique_fields": ["o_custkey"], "duplicate_key_ratio_max": 0.5, "blank_row_ratio_max": 0.1, "dependency_checks": [{"if": "day", "then": "price"}]}
    return _r(quality.quality_check(_messy(o), rules, 2), "value", digits=6)


@query("image_report", "events", "WITH t AS (SELECT event_type, value / 100 AS c, lower(trim(props)) AS t FROM events WHERE event_type <> 'error') SELECT (SELECT count(*) FROM events) AS block_count, count(*) AS text_block_count, round(avg(c), 6) AS ocr_confidence_avg, round(count(*) FILTER (c < 0.6) / count(c), 6) AS low_confidence_block_ratio, round(1.0 - count(DISTINCT t) / count(*), 6) AS duplicate_line_ratio, CAST(0.0 AS DOUBLE) AS empty_text_block_ratio, round(avg(length(regexp_replace(t, '[0-9a-z\\s]', '', 'g')) / length(t)), 6) AS non_text_symbol_ratio FROM t")
def _(e):
    return quality.image_report(e.select(F.when(F.col("event_type") == "error", "figure").otherwise(F.col("event_type")).alias("block_type"), (F.col("value") / 100).alias("confidence"), F.col("props").alias("text")))


@told("guardrails", "headers string, profile string, action string", [("x", "bank_statement", "block"), ("id,amount", "finance_statement", "allow"), ("id", "finance_statement", "warn"), ("客户,手机,金额,业务日期", "customer_contact", "warn")])
def _(spark):
    return [(h, p, plan_rules.guard(h.split(","), p)["action"]) for h, p in (("x", "bank_statement"), ("id,amount", "finance_statement"), ("id", "finance_statement"), ("客户,手机,金额,业务日期", "customer_contact"))]


_HEADERS = [("Total Amount", "strict", "amount", 1.0), ("金额（万元）", "strict", "amount", 1.0), ("客户姓名 (全)", "strict", "customer_name", 0.88), ("交易日期", "strict", "biz_date", 1.0), ("交易日期", "auto", None, 0.55), ("balence", "strict", None, 0.55), ("balence", "auto", "balance", 0.857143), ("zzz", "auto", None, 0.55)]


@told("header_mapping", "header string, mode string, field string, confidence double", _HEADERS)
def _(spark):
    return [(h, mode, *plan_rules.map_headers([h], mode, "bank_statement")[h]) for h, mode, *_ in _HEADERS]


@query("cleaning_spec", "orders", "SELECT id, amount, biz_date FROM (SELECT o_custkey AS id, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS biz_date, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(o):
    rows = o.select(F.col("o_custkey").alias("编号"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("发生额"), F.date_format("o_orderdate", "yyyy年M月d日").alias("业务日期"), "o_orderkey")
    spec = plan_rules.cleaning_spec("finance_statement", rows.columns[:3])
    return transform.transform(rows, spec, ["o_orderkey"]).df.select("id", "amount", "biz_date")


# Texts

_SPACED = r"list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))"
_SQL["text_preprocess"] = rf"""
WITH l AS (SELECT doc_id, {_SPACED} AS x FROM documents), s AS (SELECT doc_id, x, list_position(list_transform(x, lambda y: regexp_matches(y, '(?i)^\s*(?:#+\s*)?(?:references|bibliography|works cited|参考文献)\s*[:：]?\s*$')), true) AS stop FROM l)
SELECT doc_id, sha256(array_to_string(list_filter(CASE WHEN stop > 0 THEN x[1 : stop - 1] ELSE x END, lambda y: y <> '' AND NOT (regexp_matches(y, '^\[.*\]$') AND strlen(y) < 24) AND NOT regexp_matches(y, '(?i)^\s*(?:footnote|注释|脚注)')), chr(10))) AS text_sha256 FROM s"""


@query("chunk_paragraphs", "documents", r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_seq, md5(x[i]) AS md5 FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda y: trim(y, ' ')), lambda y: y <> '') AS x FROM documents), unnest(range(1, len(x) + 1)) t(i)")
def _(d):
    return text.chunk(d, "text", "paragraph").select("doc_id", "chunk_seq", F.md5("chunk_text").alias("md5"))


@query("chunk_sentences", "benchmark", r"SELECT item_id, CAST(i - 1 AS INTEGER) AS chunk_seq, md5(x[i]) AS md5 FROM (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\s*', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, ' ')), lambda y: y <> '') AS x FROM benchmark), unnest(range(1, len(x) + 1)) t(i)")
def _(b):
    return text.chunk(b, "text", "sentence").select("item_id", "chunk_seq", F.md5("chunk_text").alias("md5"))


@query("chunk_whole", "benchmark", "SELECT item_id, CAST(0 AS INTEGER) AS chunk_seq, md5(trim(text, ' ')) AS md5 FROM benchmark WHERE trim(text, ' ') <> ''")
def _(b):
    return text.chunk(b, "text", "none").select("item_id", "chunk_seq", F.md5("chunk_text").alias("md5"))


@query("entity_kinds", "documents", r"""
WITH e AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS value FROM documents UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, 'https?://[^\s]+|www\.[^\s]+')) FROM documents UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '[-+]?\d+(?:,\d{3})*(?:\.\d+)?')) FROM documents)
SELECT doc_id, kind, count(*) AS n, md5(string_agg(value, '|' ORDER BY value)) AS md5 FROM e GROUP BY 1, 2""")
def _(d):
    found = text.extract_entities(d, "doc_id", "text")
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("value")), "|")).alias("md5"))


@query("table_reconstruct", "nation", "SELECT n_nationkey, CAST(0 AS INTEGER) AS row, 'name|region|' AS cells FROM nation UNION ALL SELECT n_nationkey, 1, n_name || '|' || n_regionkey || '|x y' FROM nation")
def _(n):
    rows = n.select("n_nationkey", F.concat(F.lit("name  region\n\n "), F.col("n_name"), F.lit("\t"), F.col("n_regionkey"), F.lit("    x y\n")).alias("t"))
    return text.reconstruct_table(rows, "n_nationkey", "t").select("n_nationkey", "row", F.array_join("cells", "|").alias("cells"))


_STOPS = ", ".join(f"'{w}'" for w in [*text.STOP, *text.PRO, *text.CON])
_HAS = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_SIDE = f"CASE WHEN {_HAS(text.PRO)} AND NOT {_HAS(text.CON)} THEN 'pro' WHEN {_HAS(text.CON)} AND NOT {_HAS(text.PRO)} THEN 'con' ELSE 'unknown' END"
_SQL["conflicts"] = rf"""
WITH c AS (SELECT *, lower(coalesce(text, '')) AS low FROM conversations), m AS (SELECT conv_id, turn, lower(trim(role)) AS topic, {_SIDE} AS polarity FROM c)
SELECT conv_id, turn, topic, polarity, topic IN (SELECT topic FROM m WHERE polarity <> 'unknown' GROUP BY 1 HAVING count(DISTINCT polarity) > 1) AS conflict FROM m"""


@query("conflict_topics", "part", f"""
WITH c AS (SELECT p_partkey, lower(p_name) || ' ' || regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS topic, p_size FROM part), m AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'con' ELSE 'unknown' END AS polarity FROM c)
SELECT p_partkey, topic, polarity, topic IN (SELECT topic FROM m WHERE polarity <> 'unknown' GROUP BY 1 HAVING count(DISTINCT polarity) > 1) AS conflict FROM m""")
def _(p):
    k = F.col("p_size") % 3
    line = F.concat(F.lit("We "), F.when(k == 0, "approve").when(k == 1, "reject").otherwise("should agree or oppose"), F.lit(" the "), F.col("p_name"), F.lit(" of "), F.col("p_brand"))
    return text.detect_conflicts(p.select("p_partkey", line.alias("t")), "t").select("p_partkey", "topic", "polarity", "conflict")


@query("topics", "benchmark", rf"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-z0-9一-鿿\s]+', ' ', 'g')), '\s+'), lambda x: x <> '' AND x NOT IN ({_STOPS}))[1:8], ' ') AS topic FROM benchmark")
def _(b):
    return b.select("item_id", text.topic(b, "text", ignore=[*text.PRO, *text.CON]).alias("topic"))


@query("claim_conflicts", "part", """
WITH m AS (SELECT p_partkey, lower(p_type) AS t, CASE WHEN p_size % 5 = 0 THEN 'moderator' ELSE 'debater' END AS r, CASE p_size % 4 WHEN 0 THEN 'pro' WHEN 1 THEN 'con' WHEN 2 THEN 'neutral' ELSE 'unknown' END AS p, p_brand AS b FROM part), k AS (SELECT *, t || ' ' || lower(regexp_replace(b, '[^A-Za-z0-9]+', ' ')) AS topic FROM m)
SELECT p_partkey, topic AS conflict_topic, p AS conflict_polarity, r <> 'moderator' AND p IN ('pro', 'con') AND topic IN (SELECT topic FROM k WHERE r <> 'moderator' AND p IN ('pro', 'con') GROUP BY 1 HAVING count(DISTINCT p) = 2) AS conflict_flag FROM k""")
def _(p):
    k = F.col("p_size")
    said = F.when(k % 4 == 0, "We SUPPORT it").when(k % 4 == 1, "no, false").when(k % 4 == 2, "mixed views").otherwise("untrue supporters")
    rows = p.select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("debate_topic"), F.when(k % 5 == 0, "moderator").otherwise("debater").alias("speaker_role"), said.alias("claim_text"))
    return claims.mark_conflicts(rows).select("p_partkey", "conflict_topic", "conflict_polarity", "conflict_flag")


@query("topic_keys", "part", "SELECT p_partkey, lower(p_name) || ' works' AS topic FROM part")
def _(p):
    said = F.concat(F.lit("The question is whether "), F.col("p_name"), F.lit(" works [12] because https://a.b it sells"))
    return p.select("p_partkey", claims.topic_key(said).alias("topic"))


@query("text_signals_all", "part", """
SELECT p_partkey, 'Ann ' || p_size AS speaker, 'evidence' AS argument_role, 'http://a.b/' || p_partkey AS source_url, '7' AS citation, p_name AS quote, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS source_card, 'pro' AS stance, false AS ocr_noise FROM part""")
def _(p):
    line = F.concat(F.lit("Ann "), F.col("p_size"), F.lit(": evidence, I agree [7] “"), F.col("p_name"), F.lit("” http://a.b/"), F.col("p_partkey"))
    return enrichment.text_signals(p.select("p_partkey", line.alias("t")), "t").drop("t")


_EVIDENCE = "sha1(lower(p_name) || ' is ' || CASE WHEN p_size % 2 = 0 THEN 'good' ELSE 'bad' END || '|ann|a.org')"


@query("canonical_evidence", "part", f"""
SELECT substr({_EVIDENCE}, 1, 16) AS evidence_id, p_name || ' is ' || CASE WHEN p_size % 2 = 0 THEN 'good' ELSE 'bad' END AS claim_text, 'Ann' AS speaker, '' AS speaker_role, 'claim' AS argument_role, '' AS source_title, 'https://www.a.org/x' AS source_url, 'a.org' AS source_domain, '2024-01-01' AS published_at, CASE WHEN p_size % 2 = 0 THEN 'pro' ELSE 'con' END AS stance, '0.5' AS confidence, '[3]' AS citation_text, '' AS quote_text, lower(p_name) || ' ' || CASE WHEN p_size % 2 = 0 THEN 'good' ELSE 'bad' END AS debate_topic, 'en' AS language,
  CAST(NULL AS VARCHAR) AS source_file, 'p.txt' AS source_path, CAST(NULL AS VARCHAR) AS source_type, CAST(NULL AS VARCHAR) AS page, CAST(NULL AS VARCHAR) AS sheet_name, p_partkey AS row_index, CAST(NULL AS VARCHAR) AS chunk_index FROM part""")
def _(p):
    good = F.col("p_size") % 2 == 0
    line = F.concat(F.lit("Ann: "), F.col("p_name"), F.lit(" is "), F.when(good, "good").otherwise("bad"), F.lit(" [3] www.a.org/x/"))
    rows = p.select(line.alias("text"), F.lit("2024-01-01").alias("date"), F.when(good, "agree").otherwise("oppose").alias("position"), F.lit(0.5).alias("confidence"), F.lit("p.txt").alias("source_path"), F.col("p_partkey").alias("row_index"))
    return claims.canonical_evidence(rows)


@query("evidence_report", "part", """
SELECT count(*) AS row_count, count(*) FILTER (p_size % 2 = 0) / count(*) AS speaker_coverage, count(*) FILTER (p_size % 10 = 0) / count(*) AS stance_coverage, round(1.0 - count(DISTINCT lower(p_name)) / count(*), 6) AS duplicate_claim_ratio, min(length(p_name)) AS claim_min, max(length(p_name)) AS claim_max FROM part""")
def _(p):
    rows = p.select(F.col("p_name").alias("claim_text"), F.when(F.col("p_size") % 2 == 0, "Ann").alias("speaker"), F.when(F.col("p_size") % 10 == 0, "pro").otherwise("unknown").alias("stance"), F.lit("a").alias("source_path"))
    out = claims.evidence_report(rows)
    return out.select("row_count", "speaker_coverage", "stance_coverage", "duplicate_claim_ratio", F.col("claim_min").cast("long").alias("claim_min"), F.col("claim_max").cast("long").alias("claim_max"))


@query("preprocess_stages", "part", """
WITH m AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'We support ' ELSE 'We oppose ' END || p_type AS claim, p_brand AS path FROM part WHERE p_size > 5), k AS (SELECT *, row_number() OVER (PARTITION BY path, claim ORDER BY p_partkey) AS rn FROM m)
SELECT path AS source_path, claim AS claim_text, CAST(p_partkey AS VARCHAR) AS row_index FROM k WHERE rn = 1""")
def _(p):
    rows = p.select(F.concat(F.lit(" "), F.when(F.col("p_size") % 2 == 0, "We support ").otherwise("We oppose "), F.col("p_type"), F.lit("\x07")).alias("Body"), F.col("p_brand").alias("path"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("row"), "p_size")
    spec = {"header_map": {"Body": "text"}, "row_filters": [{"field": "p_size", "op": "gt", "value": 5}], "standardize_evidence": True, "deduplicate_by": ["source_path", "claim_text"]}
    out = enrichment.preprocess_rows(rows, spec, ["row"])
    return out.select("source_path", "claim_text", F.col("row_index").cast("long").cast("string").alias("row_index"))


_LINES = "SELECT p_partkey // 5 AS doc, p_partkey AS n, CASE p_partkey % 5 WHEN 0 THEN '# Part' WHEN 1 THEN 'A claim' WHEN 2 THEN 'Another claim' WHEN 3 THEN 'Source: Journal' ELSE 'A last claim' END AS t, CASE WHEN p_partkey % 5 = 3 THEN 'http://s/' || p_partkey END AS source_url FROM part"


def _lines(p):
    k = F.col("p_partkey") % 5
    return p.select(F.floor(F.col("p_partkey") / 5).alias("doc"), F.col("p_partkey").alias("n"), F.when(k == 0, "# Part").when(k == 1, "A claim").when(k == 2, "Another claim").when(k == 3, "Source: Journal").otherwise("A last claim").alias("t"), F.when(k == 3, F.concat(F.lit("http://s/"), F.col("p_partkey"))).alias("source_url"))


@query("propagate_sources", "part", f"SELECT n, t, CASE WHEN n % 5 IN (1, 2, 3) THEN 'http://s/' || (n // 5 * 5 + 3) END AS source_url FROM ({_LINES}) WHERE n // 5 * 5 + 3 <= (SELECT max(p_partkey) FROM part) OR n % 5 IN (0, 4) UNION ALL SELECT n, t, NULL FROM ({_LINES}) WHERE n // 5 * 5 + 3 > (SELECT max(p_partkey) FROM part) AND n % 5 NOT IN (0, 4)")
def _(p):
    return enrichment.propagate_sources(_lines(p), ["doc"], ["n"], "t").select("n", "t", "source_url")


@query("fill_sources", "part", f"SELECT n, coalesce(max(source_url) OVER (PARTITION BY doc), source_url) AS source_url FROM ({_LINES})")
def _(p):
    return enrichment.fill_sources(_lines(p), ["doc"], ["n"]).select("n", "source_url")


@query("propagate_values", "part", "SELECT p_partkey, last_value(CASE WHEN p_size % 7 = 0 THEN p_name END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS name FROM part")
def _(p):
    return text.propagate(p.withColumn("name", F.when(F.col("p_size") % 7 == 0, F.col("p_name")).when(F.col("p_size") % 7 == 1, " ")), ["p_brand"], ["p_partkey"], ["name"]).select("p_partkey", "name")


@query("merge_wrapped", "part", "SELECT p_partkey // 3 * 3 AS n, string_agg(CASE p_partkey % 3 WHEN 0 THEN 'The claim' WHEN 1 THEN 'goes on' ELSE 'to its end.' END, ' ' ORDER BY p_partkey) AS t FROM part GROUP BY 1")
def _(p):
    k = F.col("p_partkey") % 3
    rows = p.select(F.lit("d").alias("doc"), F.floor(F.col("p_partkey") / 300).alias("page"), F.col("p_partkey").alias("n"), F.when(k == 0, "The claim").when(k == 1, "goes on").otherwise("to its end.").alias("t"))
    return enrichment.merge_wrapped(rows, ["doc", "page"], ["n"], "t").select("n", "t")


@query("structural_repeats", "part", f"SELECT n, t FROM (SELECT *, row_number() OVER (PARTITION BY n // 50, lower(t) ORDER BY n) AS rn FROM ({_LINES})) WHERE rn = 1 OR n % 5 NOT IN (0, 3)")
def _(p):
    return enrichment.drop_structural_repeats(_lines(p).withColumn("doc", F.floor(F.col("n") / 50)), ["doc"], ["n"], "t").select("n", "t")


@query("resolve_citations", "part", "SELECT p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN NULL ELSE 'https://r/' || (p_partkey // 4) END AS source_url FROM part WHERE p_partkey // 4 * 4 + 3 <= (SELECT max(p_partkey) FROM part) UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey // 4 * 4 + 3 > (SELECT max(p_partkey) FROM part)")
def _(p):
    k, d = F.col("p_partkey") % 4, F.floor(F.col("p_partkey") / 4)
    rows = p.select(d.alias("doc"), F.col("p_partkey").alias("n"), F.when(k == 0, "no mark").when(k == 3, F.concat(F.lit("[2] Paper https://r/"), d)).otherwise("as said [2]").alias("t"), F.lit(None).cast("string").alias("source_url"))
    return enrichment.resolve_citations(rows, ["doc"], "t").select("n", "source_url")


@query("repair_encoding", "part", "SELECT p_partkey, '人口 ' || p_name AS t FROM part")
def _(p):
    return enrichment.repair_encoding(p.select("p_partkey", F.concat(F.lit("⼈⼝\x01"), F.col("p_name")).alias("t")))


@query("languages", "documents", "SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM documents")
def _(d):
    return d.select("doc_id", text.language(F.coalesce("text", F.lit(""))).alias("language"))


@query("preprocess_report", "part", "SELECT count(*) AS rows, count(*) FILTER (p_size % 2 = 0) / count(*) AS speaker_coverage, 1 - count(DISTINCT lower(p_name)) / count(*) AS duplicate_claim_ratio, avg(length(p_name)) AS mean_claim_chars FROM part")
def _(p):
    return text.preprocess_report(p.select(F.col("p_name").alias("claim_text"), F.when(F.col("p_size") % 2 == 0, "x").otherwise(" ").alias("speaker")))


_SQL["speaker_turns"] = r"""
WITH l AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(role || ': ' || text, '\r?\n'), lambda x: trim(x) <> '') AS x FROM conversations), u AS (SELECT conv_id, turn, i, x[i] AS line FROM l, unnest(range(1, len(x) + 1)) t(i)), s AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*(\pL[\pL\pN ._-]{0,40}?)\s*[:：]\s*(.*)$') THEN regexp_extract(line, '^\s*(\pL[\pL\pN ._-]{0,40}?)\s*[:：]\s*(.*)$', 1) END AS who FROM u)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS turn_seq, coalesce(last_value(who IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i), '') AS speaker FROM s"""

_NOISE = r"regexp_matches(y, '^(?:-?\s*\d{1,4}\s*-?|(?i:page)\s+\d+(?:\s+of\s+\d+)?|第\s*\d+\s*页)$') OR regexp_matches(y, '(?i)^(?:doi\s*:|https?://(?:dx\.)?doi\.org/)') OR (length(y) < 40 AND length(regexp_replace(y, '[^\pL\pN]', '', 'g')) * 2 < length(y))"
_ENTRY = r"regexp_matches(y, '^\s*(?:\[\d+\]|\d+\.)\s') AND regexp_matches(y, '(?:19|20)\d{2}') AND regexp_matches(y, '(?i)doi|https?://|journal|vol\.|pp\.|press|proceedings')"
_SQL["clean_lines"] = rf"""
WITH l AS (SELECT doc_id, {_SPACED} AS x FROM documents), u AS (SELECT doc_id, i, x[i] AS y FROM l, unnest(range(1, len(x) + 1)) t(i)), k AS (SELECT doc_id, y, min(i) AS i FROM u WHERE length(y) >= 18 AND NOT ({_NOISE}) AND NOT ({_ENTRY}) GROUP BY 1, 2), g AS (SELECT doc_id, count(*) AS n, string_agg(y, chr(10) ORDER BY i) AS t FROM k GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(g.n, 0) AS INTEGER) AS n_lines, md5(coalesce(g.t, '')) AS md5 FROM documents d LEFT JOIN g USING (doc_id)"""
_SQL["corruption_score"] = r"SELECT doc_id, CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(text, '�|[\x00-\x08\x0b\x0c\x0e-\x1f]|[ÃÂ][\x{80}-\x{bf}]|â€')) / length(text), 6) ELSE 0.0 END AS corruption FROM documents"


@query("noise_lines", "part", "SELECT p_partkey, p_size % 4 < 3 AS noise FROM part")
def _(p):
    k = F.col("p_size") % 4
    line = F.when(k == 0, F.concat(F.lit("Page "), F.col("p_size"), F.lit(" of 90"))).when(k == 1, "doi: 10.1/x and more words here").when(k == 2, "-- *** ##").otherwise(F.col("p_name"))
    return p.select("p_partkey", text.noise_line(line).alias("noise"))


@query("finance_spelled", "customer", "SELECT c_custkey, round(abs(c_acctbal) * CASE c_custkey % 3 WHEN 0 THEN 10000.0 WHEN 1 THEN 1.0 ELSE -1.0 END, 2) AS amount FROM customer WHERE abs(c_acctbal) >= 1")
def _(c):
    from rowlake.functions.values import money

    n = F.format_number(F.abs("c_acctbal"), 2)
    shown = F.when(F.col("c_custkey") % 3 == 0, F.concat(n, F.lit("万元"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("贷 "), n)).otherwise(F.concat(n, F.lit("－")))
    return c.filter("abs(c_acctbal) >= 1").select("c_custkey", F.round(money(shown), 2).alias("amount"))


# Search, registry and workflows

@query("index_search", "benchmark", _SQL["vector_tf_search"])
def _(b):
    path = _folder(b.sparkSession)
    intelligence.build_index(b.filter("item_id < 50"), path, "item_id", "text", shards=4)
    intelligence.build_index(b.filter("item_id >= 50"), path, "item_id", "text", shards=4, mode="append")
    return _r(intelligence.search_index(b.sparkSession, path, b.filter("item_id % 20 = 0").select(F.col("item_id").alias("id"), "text")), "score", digits=6)


@told("templates", "text string, bound long", [("Dear Ann, {{ x }} 3", 2), ("", 1), ("plain", 0)])
def _(spark):
    values = {"a": {"b": "Ann"}, "n": 3, "none": None}
    return [intelligence.bind_template(t, values) for t in ("Dear {{a.b}}, {{ x }} {{ n }}", "{{none}}", "plain")]


@query("provenance_chain", "nation", "SELECT n_name, sha256('|2024-01-01|' || n_name) AS signed FROM nation")
def _(n):
    rows = [(r.n_name, intelligence.sign_provenance("", "2024-01-01", r.n_name)) for r in n.collect()]
    return n.sparkSession.createDataFrame(rows, "n_name string, signed string")


@told("lineage_edges", "source string, target string, kind string", [("a", "t", "field"), ("b", "t", "field"), ("orders.csv", "rows", "source"), ("load", "clean", "step")])
def _(spark):
    return [(e["from"], e["to"], e["kind"]) for e in workflow.lineage({"t": "add($a, $b)"}, ["orders.csv"], {"edges": [{"from": "load", "to": "clean"}]})]


@query("schema_registry", "part", "SELECT * FROM (VALUES ('p_partkey', 'int', 'long'), ('code', 'int_like', 'string'), ('price', 'float_like', 'string'), ('yes', 'bool_like', 'string'), ('p_name', 'string', 'string')) t(field, kind, stored)")
def _(p):
    registry = tables.SchemaRegistry(_folder(p.sparkSession))
    rows = p.select("p_partkey", F.col("p_size").cast("string").alias("code"), F.concat(F.lit("$"), F.col("p_retailprice")).alias("price"), F.when(F.col("p_size") > 5, "Yes").otherwise("no").alias("yes"), "p_name")
    kinds = registry.infer(rows, "parts", "2")
    stored = {f.name: f.dataType.typeName() for f in registry.get("parts", "2")}
    return p.sparkSession.createDataFrame([(c, k, stored[c]) for c, k in kinds.items()], "field string, kind string, stored string")


@told("schema_compat", "mode string, change string, compatible boolean, breaking long, widening long", [("backward", "wider", True, 0, 1), ("backward", "removed", False, 1, 0), ("backward", "added", True, 0, 0), ("full", "added", False, 1, 0), ("forward", "retyped", False, 1, 0)])
def _(spark):
    new = {"wider": {"a": "float", "b": "string"}, "removed": {"a": "int"}, "added": {"a": "int", "b": "string", "c": "int"}, "retyped": {"a": "bool", "b": "string"}}
    cases = [("backward", "wider"), ("backward", "removed"), ("backward", "added"), ("full", "added"), ("forward", "retyped")]
    found = [(m, c, tables.check_compat({"a": "int", "b": "string"}, new[c], m)) for m, c in cases]
    return [(m, c, x["compatible"], len(x["breaking"]), len(x["widening"])) for m, c, x in found]


# Governance

@told("runtime_stats", "operator string, count long, p50 double, p95 double", [("join", 100, 50.0, 95.0), ("sort", 1, 7.0, 7.0)])
def _(spark):
    s = governance.RuntimeStats(_folder(spark))
    for i in range(100):
        s.record("join", float(i))
    s.record("sort", 7.0)
    return [(o, s.summary(o)["count"], s.summary(o)["p50"], s.summary(o)["p95"]) for o in ("join", "sort")]


@told("io_contracts", "operator string, missing string", [("join_rows", "right,left_on,right_on"), ("aggregate_rows", ""), ("unknown", "")])
def _(spark):
    return [("join_rows", ",".join(governance.check_contract("join_rows", {"left": 1}))), ("aggregate_rows", ",".join(governance.check_contract("aggregate_rows", {"rows": 1, "group_by": [], "aggregates": []}))), ("unknown", ",".join(governance.check_contract("unknown", {})))]


@told("failure_policies", "error string, class string, retryable boolean, action string", [("Read timed out", "timeout", True, "retry"), ("quota exceeded", "quota", True, "backoff"), ("connection refused", "network", True, "retry"), ("schema mismatch", "schema", False, "fix_input"), ("quality gate failed", "quality", False, "review"), ("permission denied", "policy", False, "escalate"), ("what", "unknown", False, "inspect")])
def _(spark):
    found = [(e, governance.classify_failure(e)) for e in ("Read timed out", "quota exceeded", "connection refused", "schema mismatch", "quality gate failed", "permission denied", "what")]
    return [(e, x["class"], x["retryable"], x["action"]) for e, x in found]


@told("plan_costs", "id string, cost double", [("a", 10.0), ("b", 8.0), ("c", 3.0), ("total", 21.0)])
def _(spark):
    out = governance.explain_plan([{"id": "a", "type": "join_rows"}, {"id": "b", "type": "aggregate_rows"}, {"id": "c", "type": "other"}], 50_000, {"other": 1.5})
    return [*((x["id"], x["cost"]) for x in out["steps"]), ("total", out["total"])]


@told("plan_advice", "rows long, engine string, joins string, aggregates string", [(100, "row", "hash", "exact"), (20_000, "columnar", "hash", "exact"), (150_000, "columnar", "sort_merge", "approx_hybrid")])
def _(spark):
    return [(n, x["engine"], x["join"], x["aggregate"]) for n in (100, 20_000, 150_000) for x in [governance.advise(n)]]


@told("tenant_policies", "tenant string, operator string, allowed boolean, max_steps long", [("a", "join_rows", False, 128), ("a", "sort", True, 128), ("b", "join_rows", True, 5), ("b", "sort", False, 5), ("c", "sort", True, 128)])
def _(spark):
    p = governance.Policies(_folder(spark))
    p.set("a", deny=["join_rows"])
    p.set("b", allow=["join_rows"], max_steps=5)
    p.set("c", deny=["sort"])
    p.reset("c")
    return [(t, o, p.permits(t, o), p.get(t)["max_steps"]) for t, o in (("a", "join_rows"), ("a", "sort"), ("b", "join_rows"), ("b", "sort"), ("c", "sort"))]


@told("workflow_contract", "path string, code string", [("workflow.version", "required"), ("workflow.nodes[0].config.rules", "required"), ("workflow.nodes[1].type", "unknown_operator"), ("workflow.nodes[2].config.window_type", "enum_not_allowed"), ("workflow.edges[0].to", "unknown_node")])
def _(spark):
    flow = {"workflow_id": "w", "nodes": [{"id": "a", "type": "transform_rows"}, {"id": "b", "type": "nope"}, {"id": "c", "type": "stream_window", "config": {"time": "t", "window_ms": 5, "window_type": "hop"}}], "edges": [{"from": "a", "to": "z"}]}
    return [(e["path"], e["code"]) for e in contracts.check_workflow(flow)["errors"]]


@query("workflow_reference_run", "orders", "SELECT '| ' || o_orderstatus || ' | ' || count(*) || ' |' AS markdown FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def _(o):
    nodes = [{"id": "keep", "type": "query_lang", "config": {"text": "where o_totalprice > 100000"}}, {"id": "sums", "type": "aggregate_rows", "config": {"group_by": ["o_orderstatus"], "aggregates": [{"op": "count", "as": "n"}]}}, {"id": "out", "type": "md_output"}]
    flow = {"workflow_id": "w", "nodes": nodes, "edges": [{"from": "keep", "to": "sums"}, {"from": "sums", "to": "out"}]}
    return workflow.reference_run(flow, {"rows": o}, migrate=True)["outputs"]["out"].select("markdown")


@query("workflow_branches", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(o):
    nodes = [{"id": "f", "type": "query_lang", "config": {"text": "where o_orderstatus == F"}}, {"id": "all", "type": "query_lang", "config": {"text": "select o_orderkey"}}, {"id": "none", "type": "query_lang", "config": {"text": "limit 1"}}]
    out = workflow.run({"nodes": nodes, "edges": [{"from": "f", "to": "all", "when": {"field": "go", "value": 1}}, {"from": "f", "to": "none", "when": {"field": "go", "value": 2}}]}, {"rows": o}, {"go": 1})
    assert "none" not in out["outputs"]
    return out["outputs"]["all"]


@told("stored_versions", "what string, name string, version long", [("rules", "a", 2), ("app", "f", 2), ("review", "r--n", 0), ("baseline", "rows", 0)])
def _(spark):
    folder = _folder(spark)
    sets, apps, reviews, base = governance.RuleSets(f"{folder}/s"), governance.Apps(f"{folder}/a"), governance.Reviews(f"{folder}/r"), governance.Baselines(f"{folder}/b")
    for i in range(2):
        sets.save("a", {"x": i})
        apps.publish("f", {"nodes": [{"id": str(i)}]})
    reviews.ask("r", "n")
    base.save("q", {"rows": 1.0})
    return [("rules", sets.list()[0]["name"], sets.list()[0]["version"]), ("app", *next(iter(apps.list().items()))), ("review", "r--n", len(reviews.list("approved"))), ("baseline", base.compare("q", {"rows": 2.0})[0]["metric"], len(base.compare("q", {"rows": 1.05})))]


# Papers

_P = r"trim(regexp_replace(coalesce({}, ''), '[\s\x{{a0}}\x{{3000}}\x{{feff}}]+', ' ', 'g'))"
_LETTERS, _SIGNS = r"len(regexp_extract_all({0}, '[A-Za-z一-鿿]'))", r"len(regexp_extract_all({0}, '[^A-Za-z0-9一-鿿\s]'))"
_NOISY = rf"(length({{0}}) <= 1 OR regexp_matches({{0}}, '^\d{{{{1,4}}}}$') OR regexp_matches({{0}}, '(?i)^(?:page|页)\s*\d+$|^--\s*\d+\s*of\s*\d+\s*--$|^doi[:\s]') OR starts_with({{0}}, 'doi:') OR starts_with({{0}}, '收稿日期') OR starts_with({{0}}, '基金项目') OR starts_with({{0}}, '通讯作者') OR ({_LETTERS} = 0 AND {_SIGNS} > 0) OR ({_SIGNS} > 2 * {_LETTERS} AND length({{0}}) < 24))"


@query("paper_noise", "documents", f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS y FROM documents), p AS (SELECT doc_id, {_P.format('y')} AS s FROM l) SELECT doc_id, count(*) AS lines, count(*) FILTER ({_NOISY.format('s')}) AS noise FROM p GROUP BY 1")
def _(d):
    lines = d.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("y"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(papers.noise(F.col("y")).cast("int")).alias("noise"))


@query("paper_paragraphs", "documents", rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda y: {_P.format('y')}), lambda y: y <> '' AND NOT {_NOISY.format('y')}) AS x FROM documents),
f AS (SELECT doc_id, list_reduce(list_prepend('', x), lambda a, y: CASE WHEN regexp_matches(a || '', '(^|\x01)$') THEN a || y ELSE a || CASE WHEN regexp_matches(a, '[一-鿿]$') OR regexp_matches(y, '^[一-鿿]') THEN '' ELSE ' ' END || y END || CASE WHEN regexp_matches(y, '[。！？!?；;.]$') OR length(CASE WHEN regexp_matches(a || '', '(^|\x01)$') THEN y ELSE regexp_extract(a, '[^\x01]*$') || CASE WHEN regexp_matches(a, '[一-鿿]$') OR regexp_matches(y, '^[一-鿿]') THEN '' ELSE ' ' END || y END) > 260 THEN chr(1) ELSE '' END) AS t FROM l),
u AS (SELECT doc_id, string_split(t, chr(1)) AS ps FROM f), e AS (SELECT doc_id, i, ps[i] AS p, regexp_replace(lower(ps[i]), '[^a-z0-9一-鿿]', '', 'g') AS k FROM u, unnest(range(1, len(ps) + 1)) t(i) WHERE length(ps[i]) >= 18),
k AS (SELECT doc_id, i, p, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM e WHERE length(k) >= 10)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS paragraph_seq, md5(p) AS md5 FROM k WHERE rn = 1""")
def _(d):
    return papers.paragraphs(d, "doc_id", "text").select("doc_id", "paragraph_seq", F.md5("paragraph").alias("md5"))


@query("paper_corruption", "documents", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, t, greatest(length(t), 1) AS total, len(regexp_extract_all(t, '[一-鿿]')) AS cjk, len(regexp_extract_all(t, '[A-Za-z]')) AS latin, len(regexp_extract_all(t, '[0-9]')) AS digits, len(regexp_extract_all(t, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]')) AS ctrl, len(regexp_extract_all(t, '�')) + len(regexp_extract_all(t, '[ÃÂ¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿]')) + len(regexp_extract_all(t, '[聙聛聜聝聞聟聠聡聢聣聤聥聦聧聨聩聪]')) AS odd, len(regexp_extract_all(t, '[^A-Za-z0-9一-鿿\s]')) AS symbol FROM t),
r AS (SELECT *, cjk + latin + CAST(floor(digits * 0.2) AS BIGINT) AS readable FROM c)
SELECT doc_id, readable, round(readable / total, 6) AS readable_ratio, round((odd + floor(symbol * 0.2)) / total, 6) AS noise_ratio, trim(t) = '' OR ctrl / total > 0.002 OR ((odd + floor(symbol * 0.2)) / total > 0.22 AND readable / total < 0.3) OR (readable / total < 0.14 AND symbol > readable * 1.2) AS corrupted FROM r""")
def _(d):
    return _r(papers.corruption_stats(d, "text").select("doc_id", "readable", "readable_ratio", "noise_ratio", "corrupted"), "readable_ratio", "noise_ratio", digits=6)


@query("paper_references", "part", "SELECT p_partkey, p_size % 7 > 0 AS entry, CASE p_size % 7 WHEN 0 THEN p_name || ' is shown by many' WHEN 1 THEN 'A. Writer, 2019' ELSE NULL END AS bare FROM part")
def _(p):
    k = F.col("p_size") % 7
    line = F.when(k == 0, F.concat(F.col("p_name"), F.lit(" is shown [1, 2] by many (Smith 2019; x)"))).when(k == 1, "[3] A. Writer, 2019").when(k == 2, "(12) On things 1999a").when(k == 3, "see https://a.b").when(k == 4, "Vol. 3, 2004").when(k == 5, "Smith et al., 2003").otherwise("参考文献 列表")
    bare = papers.strip_citations(line)
    return p.select("p_partkey", papers.reference_entry(line).alias("entry"), F.when(k <= 1, bare).alias("bare"))


@query("paper_lines", "part", "SELECT p_partkey, p_name || ' wellknown text' AS line FROM part")
def _(p):
    return p.select("p_partkey", papers.academic_line(F.concat(F.lit(" "), F.col("p_name"), F.lit("  well- known text All Rights Reserved (3) *"))).alias("line"))


@query("paper_chunks", "part", """
SELECT p_partkey, 'The ' || p_name || ' goes on and to its end! | Another line of words that stands alone!' AS chunks, CAST(7 AS INTEGER) AS raw_chunks, CAST(2 AS INTEGER) AS kept_chunks, CAST(1 AS INTEGER) AS removed_reference_lines, CAST(1 AS INTEGER) AS removed_noise_lines, CAST(1 AS INTEGER) AS removed_short_lines, true AS stop_section_hit, CAST(1 AS INTEGER) AS inline_citation_cleaned_lines FROM part""")
def _(p):
    page = F.concat(F.lit("The "), F.col("p_name"), F.lit(" goes on [2] and\nto its end!\n[7] A. Writer, 2019;\n-- 3 of 9 --;\nshort!\nAnother line of words that stands alone!\nReferences\nA line behind the end of the body"))
    out = papers.clean_chunks(p.select("p_partkey", page.alias("t")), "p_partkey", "t")
    return out.withColumn("chunks", F.array_join("chunks", " | "))


@query("clean_rows", "part", """
WITH r AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name || ' with a long line of text' END AS text, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n) AS rn FROM r WHERE text <> '')
SELECT n, text, CAST(size AS BIGINT) AS size FROM k WHERE rn = 1""")
def _(p):
    none = F.col("p_partkey") % 9 == 0
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    rows = p.select(F.col("p_partkey").alias("n"), F.when(none, " ").otherwise(F.concat(name, F.lit(" with a long, line of text"))).alias("body"), F.when(none, "").otherwise(F.concat(F.lit("¥ "), F.col("p_size"))).alias("size"))
    out = papers.clean_rows(rows, ["n"], {"body": "text"}, {"size": "int"}, ["text"])
    return out.select("n", F.lower(F.regexp_replace("text", ",", "")).alias("text"), "size")


@query("docx_paragraphs", "benchmark", r"SELECT md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS md5 FROM benchmark WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def _(b):
    path = _folder(b.sparkSession) + ".docx"
    office.save_docx(b, path)
    return load.load(b.sparkSession, path, "docx_text").select(F.md5("text").alias("md5"))


@query("xlsx_table", "part", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(p_size AS VARCHAR) AS amount FROM part")
def _(p):
    path = _folder(p.sparkSession) + ".xlsx"
    office.save_xlsx(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("amount")), path)
    return office.sheet_table(load.load(p.sparkSession, path, "xlsx_cells"), {"id", "name", "amount"}).select("id", "name", "amount")


# What is left of metadata, limits and recognised layouts

@told("fault_injection", "operator string, variable string, outcome string", [("join_rows", "join_rows:fail", "RuntimeError"), ("JOIN_ROWS", "join_rows:timeout", "TimeoutError"), ("sort", "join_rows:fail", "ok"), ("sort", "", "ok")])
def _(spark):
    out, faults = [], governance.Faults("ROWLAKE_FAULT_QUERY", 0)
    for operator, variable in (("join_rows", "join_rows:fail"), ("JOIN_ROWS", "join_rows:timeout"), ("sort", "join_rows:fail"), ("sort", "")):
        os.environ["ROWLAKE_FAULT_QUERY"] = variable
        try:
            faults.check(operator)
            out.append((operator, variable, "ok"))
        except (RuntimeError, TimeoutError) as e:
            out.append((operator, variable, type(e).__name__))
    del os.environ["ROWLAKE_FAULT_QUERY"]
    return out


@told("plugin_health", "plugin string, step string, outcome string", [("good", "run", "ok"), ("bad", "run", "failed"), ("bad", "again", "paused"), ("good", "health", "True"), ("bad", "health", "False"), ("none", "run", "refused"), ("good", "audited", "1"), ("bad", "audited", "1")])
def _(spark):
    import sys

    plugins = governance.Plugins({"good": [sys.executable, "-c", "print('[]')"], "bad": [sys.executable, "-c", "raise SystemExit(1)"]}, enabled=True, failures=1)
    out = []
    for name, step in (("good", "run"), ("bad", "run"), ("bad", "again"), ("none", "run")):
        try:
            plugins.run(name, [])
            out.append((name, step, "ok"))
        except PermissionError:
            out.append((name, step, "refused"))
        except RuntimeError:
            out.append((name, step, "paused"))
        except Exception:
            out.append((name, step, "failed"))
    return [*out, *((n, "health", str(h)) for n, h in plugins.health().items()), *((n, "audited", str(sum(a["plugin"] == n for a in plugins.audit))) for n in ("good", "bad"))]


@told("capabilities", "operator string, known boolean", [("transform_rows", True), ("join_rows", True), ("clean_chunks", True), ("manual_review", True), ("spatial_join", False)])
def _(spark):
    known = governance.capabilities()["operators"]
    return [(x, x in known) for x in ("transform_rows", "join_rows", "clean_chunks", "manual_review", "spatial_join")]


@told("perf_baselines", "operator string, limit double, regressed boolean", [("fast", 20.0, False), ("slow", 20.0, True), ("none", 20.0, False)])
def _(spark):
    s = governance.RuntimeStats(_folder(spark))
    for i in range(20):
        s.record("fast", 1.0 + i / 2)
        s.record("slow", 10.0 + i)
    return [(o, 20.0, s.regression(o, 20.0)) for o in ("fast", "slow", "none")]


@told("extension_modules", "module string, outcome string", [("rowlake.plans.registry", "loaded"), ("rowlake.no_such_module", "failed")])
def _(spark):
    from rowlake.plans.registry import Extensions

    status = Extensions().load(["rowlake.plans.registry", "rowlake.no_such_module"])
    return [*((m, "loaded") for m in status["loaded"]), *((m, "failed") for m in status["failed"])]


@query("row_limits", "part", "SELECT 'within' AS given, count(*) AS rows FROM part UNION ALL SELECT 'beyond', CAST(-1 AS BIGINT)")
def _(p):
    n, out = p.count(), []
    for given, most in (("within", n), ("beyond", n - 1)):
        try:
            out.append((given, transform.transform(p, {"max_rows": most}).df.count()))
        except ValueError:
            out.append((given, -1))
    return p.sparkSession.createDataFrame(out, "given string, rows long")


@told("stats_inference", "metric string, value double", [("slope", 1.99), ("slope_stderr", 0.059722), ("slope_t", 33.321291), ("slope_p_value", 0.000059), ("ci95_low", 1.799939), ("ci95_high", 2.180061), ("median_y", 6.2)])
def _(spark):
    rows = spark.createDataFrame([(1.0, 2.1), (2.0, 3.9), (3.0, 6.2), (4.0, 7.8), (5.0, 10.1)], "x double, y double")
    r = intelligence.stats_columns(rows, [], "x", "y").first()
    return [(k, round(r[k], 6)) for k in ("slope", "slope_stderr", "slope_t", "slope_p_value", "ci95_low", "ci95_high", "median_y")]


@query("clustered_lines", "part", "SELECT p_partkey, CAST(line AS BIGINT) AS line, cells FROM (SELECT p_partkey, 1 AS line, p_name || '|' || p_brand AS cells FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part)")
def _(p):
    boxes = p.select("p_partkey", F.explode(F.array(F.struct(F.lit(90.0).alias("x"), F.lit(12.0).alias("y"), F.col("p_brand").alias("text")), F.struct(F.lit(5.0).alias("x"), F.lit(20.0).alias("y"), F.col("p_name").alias("text")), F.struct(F.lit(5.0).alias("x"), F.lit(60.0).alias("y"), F.col("p_type").alias("text")))).alias("b")).select("p_partkey", "b.*", F.lit(14.0).alias("h"))
    return enrichment.cluster_lines(boxes, "p_partkey").select("p_partkey", F.col("line").cast("long").alias("line"), F.array_join("cells", "|").alias("cells"))


@query("sheet_headers", "region", "SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region")
def _(r):
    """The header is found below a title row."""
    spark, path = r.sparkSession, _folder(r.sparkSession) + ".xlsx"
    rows = [("id", "name"), *((x.r_regionkey, x.r_name) for x in r.orderBy("r_regionkey").collect())]
    office._put(spark, path, office.xlsx_bytes(["All regions", ""], rows))
    return office.sheet_table(load.load(spark, path, "xlsx_cells"), {"id", "name"}).select("id", "name")


@query("stream_drop_late", "events", "SELECT (epoch_us(ts) // 1000) // 86400000 * 86400000 AS window_start_ms, count(*) AS count FROM events WHERE 1706600000000 - (epoch_us(ts) // 1000) <= 864000000 GROUP BY 1")
def _(e):
    return streams.stream_window(e, "ts", 86_400_000, now_ms=1706600000000, lateness_ms=864_000_000).select("window_start_ms", "count")


@query("transform_chunks_middle", "orders", "SELECT o_orderkey, o_orderstatus, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, o_custkey ORDER BY o_orderkey DESC) AS rn FROM (SELECT *, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS chunk_id FROM orders)) WHERE rn = 1 AND chunk_id BETWEEN 7 AND 11")
def _(o):
    """A run resumed in the middle of the table, over wide rows."""
    return transform.transform_chunks(o, {"deduplicate_by": ["o_custkey"]}, "o_orderkey", 100, done=6, most=5)[0].select("o_orderkey", "o_orderstatus", "chunk_id")


@query("chunks_of_equal_keys", "lineitem", "SELECT chunk_id, count(*) AS n FROM (SELECT CAST((row_number() OVER (ORDER BY l_returnflag) - 1) // 1000 AS BIGINT) AS chunk_id FROM lineitem) GROUP BY 1")
def _(li):
    """Three keys for all rows: chunks are full all the same."""
    return streams.chunk_ids(li, "l_returnflag", 1000).groupBy("chunk_id").agg(F.count("*").alias("n"))
