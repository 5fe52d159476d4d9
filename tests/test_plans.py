import gzip
import random
import re
import sqlite3
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rowlake.plans import governance, rules, workflow
from rowlake.sources import load, office, tables


def test_rule_language(tmp_path):
    got = rules.compile_rules("rename a -> b # c\ncast b: float\n\nrequired b\nfilter b >= 10\nfilter n != 'x'")
    assert got == {"rename_map": {"a": "b"}, "casts": {"b": "float"}, "required_fields": ["b"], "filters": [{"field": "b", "op": "gte", "value": 10}, {"field": "n", "op": "ne", "value": "x"}]}
    with pytest.raises(ValueError, match="line 2"):
        rules.compile_rules("required a\nwhat")
    packages = rules.RulePackages(str(tmp_path))
    mark = packages.publish("p", "1", got)
    assert packages.get("p", "1")["fingerprint"] == mark == rules.fingerprint(got)
    with pytest.raises(KeyError):
        packages.get("p", "2")


def test_profiles():
    assert rules.recommend_profile(["客户", "手机", "金额", "日期"])[0]["profile"] == "customer_ledger"
    spec = rules.cleaning_spec("finance_statement", ["编号", "金额(元)"])
    assert spec["rename_map"] == {"编号": "id", "金额(元)": "amount"} and spec["deduplicate_by"] == ["id"]
    assert rules.guard(["x"], "bank_statement")["action"] == "block" and rules.guard(["id", "amount"], "finance_statement")["action"] == "allow"


def test_workflow(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 7)], "g string, v int")
    nodes = [{"id": "f", "type": "transform_rows", "config": {"rules": {"filters": [{"field": "v", "op": "gt", "value": 2}]}}}, {"id": "s", "type": "aggregate_rows", "config": {"group_by": ["g"], "aggregates": [{"op": "sum", "field": "v", "as": "t"}]}}, {"id": "j", "type": "join_rows", "config": {"input_map": {"left": "$f", "right": "$s"}, "left_on": "g", "right_on": "g"}}, {"id": "z", "type": "query_lang", "config": {"text": "limit 1"}}]
    edges = [{"from": "f", "to": "s"}, {"from": "s", "to": "j"}, {"from": "f", "to": "j"}, {"from": "j", "to": "z", "when": {"field": "go", "value": 1}}]
    out = workflow.run({"nodes": nodes, "edges": edges}, {"rows": df}, {"go": 0})
    assert out["ok"] and [t["status"] for t in out["trace"]] == ["done"] * 3 + ["skipped"] and sorted(map(tuple, out["outputs"]["j"].select("g", "v", "t").collect())) == [("a", 5, 5.0), ("b", 7, 7.0)]
    failed = workflow.run({"nodes": [{"id": "q", "type": "query_lang", "config": {"text": "drop"}}]}, {"rows": df})
    assert not failed["ok"] and failed["trace"][0]["status"] == "failed"
    for bad in ({"nodes": nodes, "edges": [*edges, {"from": "z", "to": "f"}]}, {"nodes": [*nodes, nodes[0]]}, {"nodes": nodes, "edges": [{"from": "f", "to": "x"}]}, {"nodes": [{"id": "a", "type": "?"}]}):
        with pytest.raises(workflow.WorkflowError):
            workflow.order(bad)
    assert workflow.lineage({"t": "add($a, $b)"}, ["src"]) == [{"from": "a", "to": "t", "kind": "field"}, {"from": "b", "to": "t", "kind": "field"}, {"from": "src", "to": "rows", "kind": "source"}]


def test_governance(spark, tmp_path):
    s = governance.RuntimeStats(f"{tmp_path}/s")
    for x in range(100):
        s.record("op", x)
    assert s.summary("op") == {"count": 100, "p50": 50, "p95": 95} and s.regression("op", 90) and governance.classify_failure("Read timed out")["retryable"]
    p = governance.Policies(f"{tmp_path}/p")
    p.set("t", deny=["join_rows"])
    assert not p.permits("t", "join_rows") and p.permits("t", "x") and governance.check_contract("join_rows", {"left": 1}) == ["right", "left_on", "right_on"]
    assert governance.incremental_plan({"fingerprint": rules.fingerprint({"a": 1})}, {"a": 1})["strategy"] == "cache_reuse" and governance.explain_plan([{"id": 1, "type": "join_rows"}], 50_000)["total"] == 10.0
    df = spark.createDataFrame([("2",)], "x string")
    assert governance.apply_udf(df, "x", "double").first()[0] == 4.0
    with pytest.raises(ValueError):
        governance.apply_udf(df, "x", "evil")
    plugins = governance.Plugins({"echo": [sys.executable, "-c", "import sys; print(sys.stdin.read())"], "bad": [sys.executable, "-c", "raise SystemExit(1)"]}, enabled=True, failures=1)
    assert plugins.run("echo", {"a": 1}) == {"a": 1}
    for error in (Exception, RuntimeError):
        with pytest.raises(error):
            plugins.run("bad", 1)
    with pytest.raises(PermissionError):
        governance.Plugins({}).run("echo", 1)
    assert "Scan" in governance.explain_text(df) and "aggregate_rows" in governance.capabilities()["operators"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, y"\n2,\n')
    assert [tuple(r) for r in load.load(spark, f"{tmp_path}/a.csv").collect()] == [("1", "x, y"), ("2", None)]
    assert [tuple(r) for r in load.load(spark, f"{tmp_path}/a.csv", naive=True).collect()][1] == ("2", "")
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert load.load(spark, f"{tmp_path}/b.jsonl", limit=1, retries=1).count() == 1
    (tmp_path / "c.txt").write_text("one\ntwo\n\nthree\n")
    assert [(r.line_no, r.text) for r in load.load(spark, f"{tmp_path}/c.txt").collect()] == [(1, "one"), (2, "two"), (3, ""), (4, "three")]
    assert [r.text for r in load.load(spark, f"{tmp_path}/c.txt", paragraphs=True).collect()] == ["one\ntwo", "three\n"]
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    assert load.load(spark, f"{tmp_path}/d.pdf").first().size_bytes == 4
    with sqlite3.connect(tmp_path / "e.db") as db:
        db.execute("create table t (x int)")
        db.executemany("insert into t values (?)", [(i,) for i in range(5)])
    assert load.load(spark, f"sqlite://{tmp_path}/e.db", query="select x from t where x > 1").count() == 3
    df, failed = load.load_many(spark, [f"{tmp_path}/b.jsonl", f"{tmp_path}/none.jsonl"])
    assert df.count() == 2 and len(failed) == 1
    for kind in ("jsonl", "csv", "parquet"):
        load.save(spark.createDataFrame([("1", "p,q"), ("2", "")], "b string, a string"), f"{tmp_path}/out.{kind}")
    assert spark.read.parquet(f"{tmp_path}/out.parquet").filter("a is null").count() == 1 and load.load(spark, f"{tmp_path}/out.csv").columns == ["a", "b"]
    for bad in ("drop table t", "select 1; select 2", "select * from t where delete"):
        with pytest.raises(ValueError):
            load.check_query(bad)
    spark.range(10).withColumn("g", F.col("id") % 2).createOrReplaceTempView("numbers")
    assert sorted(map(tuple, load.aggregate_pushdown(spark, "numbers", ["g"], [{"op": "sum", "field": "id", "as": "s"}], "id > 3 and id < 9").collect())) == [(0, 18), (1, 12)]
    with pytest.raises(ValueError):
        load.aggregate_pushdown(spark, "numbers", ["g"], [{"op": "sum", "field": "id"}], "1=1 or exists(select 1)")
    assert load.browse(spark, "sample_rows", "numbers", 3).count() == 3


def test_paragraphs_of_split_files(spark, tmp_path):
    """A file's paragraphs are those of the whole text, wherever its splits end, and come from several tasks."""
    rng = random.Random(7)
    texts = ["", " ", "\n", " \n", "\n ", "\t", "a\n\n\t", "a\n\t", "a\r\n\r\nb\r\n", "\ufeffa\n\nb", "\ufeff\n\nb\n", "\n\na\n\n b \n\n", "a\r\r\n\n", "x" * 50 + "\n\n" + "y" * 50]
    texts += ["".join(rng.choice(["a", "é", "\n", "\n\n", " ", "\t", "\r\n", "\r", "word\n", "\n \n"]) for _ in range(rng.randint(1, 25))) for _ in range(30)]
    (tmp_path / "t").mkdir()
    want = []
    for i, t in enumerate(texts):
        (tmp_path / "t" / f"{i:03}.txt").write_bytes(t.encode())
        want += [(f"{i:03}.txt", k, x) for k, x in enumerate(x for x in (x.strip(" ") for x in re.split(r"\r?\n[ \t\n\x0b\f\r]*\r?\n", t)) if x)]
    with gzip.open(tmp_path / "t" / "z.txt.gz", "wt") as f:
        f.write("one\n\ntwo\n")
    want += [("txt.gz", 0, "one"), ("txt.gz", 1, "two\n")]
    (tmp_path / "long.txt").write_text("\n\n".join(f"paragraph {i}\nof two lines" for i in range(300)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (12, 1000):
            for k, v in zip(before, (size, 0)):
                spark.conf.set(k, v)
            got = load.load(spark, f"{tmp_path}/t", "txt", paragraphs=True)
            assert got.dtypes == [("source_path", "string"), ("chunk_index", "int"), ("text", "string")]
            assert sorted((r.source_path.rsplit("/")[-1].removeprefix("z."), r.chunk_index, r.text) for r in got.collect()) == sorted(want)
        long = load.load(spark, f"{tmp_path}/long.txt", paragraphs=True)
        assert [(r.chunk_index, r.text) for r in long.orderBy("chunk_index").collect()] == [(i, f"paragraph {i}\nof two lines") for i in range(300)]
        assert long.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
    tables.write_parquet(df, f"{tmp_path}/t", ["p"])
    plan = tables.read_parquet(spark, f"{tmp_path}/t", ["x"], {"p": "a"})
    assert plan.collect()[0].x == 1 and "PartitionFilters: [isnotnull(p" in governance.explain_text(plan)
    with pytest.raises(tables.SchemaError):
        tables.write_parquet(df.withColumn("x", F.col("x").cast("string")), f"{tmp_path}/t", ["p"])
    tables.compatible(df.schema, df.withColumn("x", F.col("x").cast("double")).schema, "widen")
    tables.merge_small(spark, f"{tmp_path}/t", f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2
    r = tables.SchemaRegistry(f"{tmp_path}/r")
    seen = r.infer(spark.createDataFrame([("1", "1.5", "yes", "x", 2), (None, "2", "no", "", 3)], "a string, b string, c string, d string, e int"), "s")
    assert seen == {"a": "int_like", "b": "float_like", "c": "bool_like", "d": "string", "e": "int"} and isinstance(r.get("s", "1"), T.StructType)
    old, new = {"a": "int", "b": "string", "c": "int"}, {"a": "float", "c": "bool", "d": "int"}
    assert not tables.check_compat(old, new)["compatible"] and tables.check_compat({"a": "int"}, {"a": "float", "z": "int"})["compatible"] and not tables.check_compat({}, {"z": "int"}, "full")["compatible"]
    assert {s["step"] for s in tables.suggest_migration(old, new)} == {"add_default", "safe_cast_or_null", "cast"}
    assert tables.migrate(spark.createDataFrame([("x", 1)], "c string, a int"), [{"field": "c", "step": "safe_cast_or_null", "to": "int"}, {"field": "b", "step": "add_default", "value": None}]).first().c is None
    table = tables.upsert_features(spark.createDataFrame([("k", 1, 1)], "id string, v int, t int"), spark.createDataFrame([("k", 2, 0), ("null", 3, 0), ("m", 4, 0)], "id string, v int, t int"), "id", "t")
    assert sorted(map(tuple, table.select("id", "v").collect())) == [("k", 2), ("m", 4)]


def test_sources_at_scale(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "quoted.csv").write_text('id,name\n1,"x\ny"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        got = load.load(spark, f"{tmp_path}/big.txt")
        assert spark.read.text(f"{tmp_path}/big.txt").rdd.getNumPartitions() > 5
        assert sorted((r.line_no, r.text) for r in got.collect()) == list(enumerate(lines, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert load.load(spark, f"{tmp_path}/quoted.csv", multi_line=True).first().name == "x\ny"
    calls = []

    def flaky(df):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return df.count()

    _, stats = load.load_stats(spark, f"{tmp_path}/big.txt", retries=3, wait_s=0.01, action=flaky)
    assert (stats["attempt"], stats["result"], len(stats["errors"])) == (3, 5000, 2)
    with pytest.raises(OSError):
        load.load(spark, f"{tmp_path}/big.txt", retries=1, wait_s=0.01, action=lambda df: (_ for _ in ()).throw(OSError("gone")))
    (tmp_path / "bad.jsonl").write_text('{"a": \n{"a": 1}\n')
    assert load.load_many(spark, [f"{tmp_path}/bad.jsonl"], schema="a int")[1] == [f"{tmp_path}/bad.jsonl"]


def test_typed_parquet_and_sqlite(spark, tmp_path):
    df = spark.createDataFrame([("1", "2.5", "true", "x", ""), ("-7", "3", "FALSE", "", " "), ("", None, None, "9", None)], "i string, f string, b string, s string, n string")
    assert load.infer_kinds(df) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "n": "string"}
    load.save(df, f"{tmp_path}/t.parquet", infer=True)
    got = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "double", "boolean", "string", "string"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2.5, True, "x", None), (-7, 3.0, False, None, None), (None, None, None, "9", None)], key=str)
    load.save(df.select("i", "s"), f"sqlite://{tmp_path}/x.db")
    load.save(df.select("i", "s"), f"sqlite://{tmp_path}/x.db")
    back = load.load(spark, f"sqlite://{tmp_path}/x.db", query="select payload, length(payload) as n, 1.5 as f from rows", rows=2)
    assert back.count() == 6 and [f.dataType.simpleString() for f in back.schema] == ["string", "bigint", "double"]
    assert load.load(spark, f"sqlite://{tmp_path}/x.db", query="select payload from rows", limit=2).count() == 2
    tables.write_parquet(spark.createDataFrame([(1, "a")], "x int, p string"), f"{tmp_path}/side", ["p"])
    assert tables.sidecar_schema(spark, f"{tmp_path}/side").fieldNames() == ["x", "p"] and tables.sidecar_schema(spark, f"{tmp_path}/none") is None


def test_headers():
    from rowlake.plans import headers

    pick = lambda h, **o: tuple(headers.map_header(h, **o)[k] for k in ("field", "confidence", "strategy"))
    assert pick("Total Amount") == ("amount", 1.0, "exact") and pick("金额（万元）") == ("amount", 1.0, "exact") and pick("客户姓名 (全)") == ("customer_name", 0.88, "substring")
    assert pick("交易日期") == ("biz_date", 1.0, "exact") and pick("交易日期", mode="auto") == (None, 0.55, "unresolved")  # two fields have the name
    assert pick("zzz") == (None, 0.55, "unresolved") and pick("") == (None, 0.0, "unresolved")
    field, confidence, strategy = pick("acount nr", mode="auto", profile=rules.PROFILES["bank_statement"])
    assert field is None or (field == "account_no" and confidence >= 0.82)
    bank = rules.PROFILES["bank_statement"]
    assert pick("balence", mode="auto", profile=bank) == ("balance", 0.857143, "fuzzy") and pick("balence", mode="auto", profile=bank, values=["1,200.5", "7"])[1:] == (0.907143, "fuzzy+value_affinity") and pick("balence") == (None, 0.55, "unresolved")
    assert headers.likeness("abc", "abc") == 100 and headers.likeness("abcd", "bcde") == pytest.approx(75) and headers._word_sets("a b c", "b a") == 100
    both = next(x for x in rules.recommend_profile(["客户", "姓名", "手机"]) if x["profile"] == "customer_contact")
    assert both["score"] == pytest.approx(0.55 + 0.25 + 0.2 - 0.08)


def test_registries(spark, tmp_path, monkeypatch):
    from rowlake.operators import enrichment, filters
    from rowlake.plans.registry import FIELD_TRANSFORMS, ROW_FILTERS, STAGES, Extensions, Registry

    r = Registry("thing")
    r.register("A", len, domain="d")
    with pytest.raises(ValueError):
        r.register("a", max)
    assert r.register("a", max, "keep") is len and r.register("a", max, "warn") is max and r.conflicts == ["a"] and r.domains() == {"custom": ["a"]} and r.unregister("a") and "a" not in r
    assert len(list(FIELD_TRANSFORMS)) >= 17 and set(enrichment.PIPELINE) <= set(STAGES)
    (tmp_path / "my_extension_module.py").write_text("from pyspark.sql import functions as F\nfrom rowlake.plans.registry import FIELD_TRANSFORMS, ROW_FILTERS\nFIELD_TRANSFORMS.register('shout', lambda c, s: F.concat(F.upper(c), F.lit('!')), 'replace')\nROW_FILTERS.register('longer', lambda df, s: F.length(s['field']) > s['value'], 'replace')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("ROWLAKE_EXTENSIONS", "my_extension_module, no_such_module")
    status = Extensions().load()
    assert status["loaded"] == ["my_extension_module"] and "no_such_module" in status["failed"]
    df = spark.createDataFrame([("ab", 1), ("abcd", 2), (" ", 3)], "text string, n int")
    out = enrichment.preprocess_rows(df, {"field_transforms": [{"field": "text", "op": "shout"}], "row_filters": [{"op": "longer", "field": "text", "value": 3}], "typed_filters": True}, ["n"])
    assert [r.text for r in out.collect()] == ["ABCD!"]
    typed = lambda **s: filters.apply_filters(spark.createDataFrame([(1, 10.0, "10", True), (2, None, None, None)], "k int, f double, s string, b boolean"), [s], typed=True).count()
    assert typed(op="eq", field="f", value=10) == 1 and typed(op="eq", field="s", value=10) == 0 and typed(op="eq", field="s", value="10") == 1 and typed(op="eq", field="b", value=True) == 1 and typed(op="eq", field="k", value=True) == 0
    assert typed(op="eq", field="f", value=None) == 1 and typed(op="ne", field="f", value="10") == 2 and typed(op="in", field="k", value=[1, "2"]) == 1 and typed(op="contains", field="s", value="one") == 1 and typed(op="gt", field="s", value="9") == 1
    with pytest.raises(ValueError):
        typed(op="blank_row")
    FIELD_TRANSFORMS.unregister("shout"), ROW_FILTERS.unregister("longer")


def test_result_cache_sees_changes(spark, tmp_path):
    from rowlake.plans.tasks import ResultCache

    spark.range(5).write.parquet(f"{tmp_path}/a")
    cache, made = ResultCache(), []
    ask = lambda: cache.get(spark.read.parquet(f"{tmp_path}/a"), {"x": 1}, lambda df: made.append(1) or df.filter("id > 1"))
    assert ask().count() == 3 and ask().count() == 3 and len(made) == 1
    spark.range(9).write.mode("append").parquet(f"{tmp_path}/a")
    assert ask().count() == 10 and len(made) == 2 and cache.stats()["hits"] == 1

    class Other:  # another plan of the same hash
        def __init__(self, df):
            self.df = df

        def semanticHash(self):
            return 7

        def sameSemantics(self, other):
            return self.df.sameSemantics(other.df)

    one, two = Other(spark.range(3)), Other(spark.range(4))
    get = lambda x: cache.get(x, {}, lambda o: o.df, stamp="s").count()
    assert (get(one), get(two), get(one)) == (3, 4, 3)
    assert cache.clear() == 3


def test_workflow_contract(spark, monkeypatch, tmp_path):
    from rowlake.plans import contracts

    good = {"workflow_id": "w", "version": "1.0", "nodes": [{"id": "a", "type": "aggregate_rows", "config": {"group_by": ["g"], "aggregates": [{"op": "count", "as": "n"}]}}, {"id": "m", "type": "md_output"}], "edges": [{"from": "a", "to": "m"}]}
    df = spark.createDataFrame([("x|y",), ("z",), ("z",)], "g string")
    out = workflow.reference_run(good, {"rows": df})
    assert out["ok"] and sorted(r.markdown for r in out["outputs"]["m"].collect()) == ["| x\\|y | 1 |", "| z | 2 |"]
    codes = lambda d, **o: sorted((e["path"], e["code"]) for e in contracts.check_workflow(d, **o)["errors"])
    assert codes([]) == [("workflow", "type_object")] and codes({"workflow_id": "w", "nodes": []}, migrate=True, need_nodes=True) == [("workflow.nodes", "empty")]
    bad = {"version": "x", "nodes": [{"id": "a", "type": "join_rows", "config": {"left_on": 3, "join_type": "cross"}}, {"id": "a", "type": "nope"}, {"id": "w", "type": "window_rows", "config": {"partition_by": [], "order_by": "t", "functions": [{"op": "ntile"}, 1]}}], "edges": [{"from": "a", "to": "q"}]}
    assert codes(bad) == sorted([("workflow.workflow_id", "required"), ("workflow.version", "format"), ("workflow.nodes[0].config.left_on", "type_text"), ("workflow.nodes[0].config.right_on", "required"), ("workflow.nodes[0].config.join_type", "enum_not_allowed"), ("workflow.nodes[1].id", "duplicate"), ("workflow.nodes[1].type", "unknown_operator"), ("workflow.nodes[2].config.functions[0].as", "required"), ("workflow.nodes[2].config.functions[0].op", "enum_not_allowed"), ("workflow.nodes[2].config.functions[1]", "type_object"), ("workflow.edges[0].to", "unknown_node")])
    assert ("workflow.nodes[1].type", "unknown_operator") not in codes(bad, scope="draft")
    with pytest.raises(workflow.WorkflowError, match="join_type"):
        workflow.reference_run(bad, {"rows": df})
    monkeypatch.setenv("ROWLAKE_FAULT", "aggregate_rows:fail")
    failed = workflow.run(good, {"rows": df})
    assert not failed["ok"] and "fault injected failure" in failed["trace"][0]["error"]
    monkeypatch.setenv("ROWLAKE_FAULT", "other:timeout")
    assert workflow.run(good, {"rows": df})["ok"]
    with pytest.raises(TimeoutError):
        governance.Faults(wait_s=0).check("OTHER")
    monkeypatch.delenv("ROWLAKE_FAULT")
    reviews = governance.Reviews(f"{tmp_path}/r")
    ask = lambda: workflow.run({"nodes": [{"id": "v", "type": "manual_review", "config": {"store": reviews, "run": "r1"}}]}, {"rows": df})
    assert ask()["outputs"]["v"].first().review_status == "pending" and len(reviews.list("pending")) == 1
    reviews.decide("r1", "review", True, "me")
    assert ask()["outputs"]["v"].first().review_status == "approved"
    with pytest.raises(ValueError):
        reviews.decide("r1", "review", False, "me")


def test_stores_and_plugins(spark, tmp_path):
    sets = governance.RuleSets(f"{tmp_path}/s")
    assert sets.save("a", {"x": 1})["version"] == 1 and sets.save("a", {"x": 2})["version"] == 2 and sets.get("a")["rules"] == {"x": 2} and [x["name"] for x in sets.list()] == ["a"] and sets.delete("a")
    base = governance.Baselines(f"{tmp_path}/b")
    base.save("q", {"rows": 100.0, "zero": 0.0, "gone": 1.0})
    assert {x["metric"] for x in base.compare("q", {"rows": 105.0, "zero": 1.0})} == {"zero", "gone"}
    apps = governance.Apps(f"{tmp_path}/a")
    assert apps.publish("f", {"nodes": [{"id": "a", "type": "x"}]}) == 1 and apps.publish("f", {"nodes": [{"id": "a", "type": "y"}, {"id": "b", "type": "x"}]}) == 2
    assert apps.diff("f", 1, 2) == {"added": ["b"], "removed": [], "changed": ["a"]} and apps.get("f", 1)["version"] == 1 and apps.list() == {"f": 2}
    code = "import json, sys; print(json.dumps([{'n': r['id'] * 2} for r in json.load(sys.stdin)]))"
    plugins = governance.Plugins({"twice": [sys.executable, "-c", code]}, enabled=True, secret="s", at_once=1)
    mark = governance.sign('{"command": %s, "name": "twice"}' % __import__("json").dumps(plugins.commands["twice"]), "s")
    assert plugins.run("twice", [{"id": 4}], signature=mark) == [{"n": 8}] and plugins.audit[-1]["ok"]
    assert sorted(r.n for r in plugins.apply(spark.range(25), "twice", "n long", signature=mark, rows=10).collect()) == [2 * i for i in range(25)]
    for error, options in ((PermissionError, {}), (ValueError, {"signature": mark, "payload": "x" * 2_000_000})):
        with pytest.raises(error):
            plugins.run("twice", options.pop("payload", []), **options)
    plugins.running["t"] = 1
    with pytest.raises(RuntimeError, match="at once"):
        plugins.run("twice", [], "t", mark)
    df = spark.createDataFrame([("2",)], "x string")
    assert governance.apply_udf_signed(df, "x", "double", token=governance.sign("double", "k"), secret="k").first().x == 4.0
    with pytest.raises(PermissionError):
        governance.apply_udf_signed(df, "x", "double", token="no", secret="k")
    with pytest.raises(ImportError):
        governance.apply_wasm(df, "x", b"")


def test_office_files(spark, tmp_path):
    from rowlake.sources import office

    (tmp_path / "a.docx").write_bytes(office.docx_bytes(["One & <two>", " ", "三\x07"]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {(r.source_path[-6:], r.chunk_index): (r.text, r.error is None) for r in load.load(spark, f"{tmp_path}/*.docx", "docx_text").collect()}
    assert got == {("a.docx", 0): ("One & <two>", True), ("a.docx", 1): ("三", True), ("b.docx", 0): (None, False)}
    (tmp_path / "c.xlsx").write_bytes(office.xlsx_bytes(["Report", None, None], [["id", "amount", "name"], [1, 2.5, "x & y"], [2, None, None]], "first"))
    cells = load.load(spark, f"{tmp_path}/c.xlsx", "xlsx_cells")
    assert [(r.sheet_name, r.row_index, r.cells) for r in cells.orderBy("row_index").collect()] == [("first", 1, ["Report", "", ""]), ("first", 2, ["id", "amount", "name"]), ("first", 3, ["1", "2.5", "x & y"]), ("first", 4, ["2", "", ""])]
    table = office.sheet_table(cells, {"id", "amount", "name"})
    assert table.columns == ["row_index", "id", "amount", "name"] and [tuple(r)[1:] for r in table.orderBy("row_index").collect()] == [("1", "2.5", "x & y"), ("2", "", "")]
    assert load.load(spark, f"{tmp_path}/c.xlsx", "xlsx_cells", sheets=["other"]).count() == 0
    with pytest.raises(ValueError, match="at most"):
        office.save_xlsx(spark.range(5), f"{tmp_path}/d.xlsx", most=3)


def test_tables_over_several_sheets(spark, tmp_path):
    """Rows beyond a sheet go on in the next one with the same header, and are read back as one table."""
    df = spark.range(0, 2500, 1, 3).select(F.col("id"), F.concat(F.lit("x & "), "id").alias("name"))
    for rows, sheets in ((1100, 3), (7, 358), (5000, 1), (office.SHEET_ROWS, 1)):
        path = f"{tmp_path}/{rows}.xlsx"
        office.save_xlsx(df, path, "a rather long name of some sheet", sheet_rows=rows)
        cells = load.load(spark, path, "xlsx_cells")
        found = {r.sheet_name: r.n for r in cells.groupBy("sheet_name").agg(F.count("*").alias("n")).collect()}
        assert max(found.values()) <= rows + 1 and sum(found.values()) == 2500 + len(found) and len(found) == sheets
        table = office.sheet_table(cells, {"id", "name"})
        assert sorted((int(r.id), r.name) for r in table.collect()) == [(i, f"x & {i}") for i in range(2500)]
    office.save_xlsx(spark.range(0), f"{tmp_path}/none.xlsx")
    assert [r.cells for r in load.load(spark, f"{tmp_path}/none.xlsx", "xlsx_cells").collect()] == [["id"]]
    (tmp_path / "bad.xlsx").write_bytes(office.xlsx_bytes(["id"], [[i] for i in range(3000)]).replace(b"sheet1.xml", b"sheet9.xml", 1))
    assert [r.error is None for r in load.load(spark, f"{tmp_path}/bad.xlsx", "xlsx_cells").collect()] == [False]
    gaps = spark.createDataFrame([("p", "s", n, c) for n, c in ((40, ["id", "name"]), (90, ["1", "a"]), (91, ["2"]), (2, ["Title"]))], "source_path string, sheet_name string, row_index int, cells array<string>")
    assert [tuple(r) for r in office.sheet_table(gaps, {"id", "name"}).orderBy("id").collect()] == [(90, "1", "a"), (91, "2", "")]
    two = load.load(spark, f"{tmp_path}/none.xlsx", "xlsx_cells").union(load.load(spark, f"{tmp_path}/7.xlsx", "xlsx_cells"))
    with pytest.raises(ValueError, match="another header"):
        office.sheet_table(two, {"id", "name"})
