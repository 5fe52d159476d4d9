import threading

import pytest
from pyspark.sql import functions as F
from rowlake.operators import enrichment, intelligence
from rowlake.plans.tasks import ResultCache, Tasks


def test_paragraphs(spark):
    page = "The first line goes\non until here.\n12\nA second paragraph\n\nwithout an end and long\n中文第一行很长很长很长很长\n第二行也很长很长很长很长。\nThe first line goes\non until here."
    got = enrichment.rebuild_paragraphs(spark.createDataFrame([(1, page), (2, None)], "k int, t string"), "k", "t").orderBy("paragraph_seq").collect()
    assert [r.paragraph for r in got] == ["The first line goes on until here.", "A second paragraph", "without an end and long中文第一行很长很长很长很长第二行也很长很长很长很长。"]


def test_claims(spark):
    rows = [("d", 1, "# Intro", None), ("d", 2, "Taxes help the", None), ("d", 3, "poor people.", None), ("d", 4, "Source: Gov", "http://g"), ("d", 5, "# Intro", None), ("d", 6, "As shown [2]", None), ("e", 1, "lower start", None)]
    df = spark.createDataFrame(rows, "doc string, n int, t string, source_url string")
    merged = enrichment.merge_wrapped(df, ["doc"], ["n"], "t")
    assert [(r.n, r.t) for r in merged.orderBy("doc", "n").collect()] == [(1, "# Intro"), (2, "Taxes help the poor people."), (4, "Source: Gov"), (5, "# Intro"), (6, "As shown [2]"), (1, "lower start")]
    assert enrichment.drop_structural_repeats(df, ["doc"], ["n"], "t").count() == 6
    filled = enrichment.fill_sources(df, ["doc"], ["n"])
    assert [r.source_url for r in filled.orderBy("doc", "n").collect()] == ["http://g"] * 6 + [None]
    refs = df.unionByName(spark.createDataFrame([("d", 9, "[2] A paper https://p.org/x", None)], df.schema))
    assert enrichment.resolve_citations(refs, ["doc"], "t").filter("n = 6").first().source_url == "https://p.org/x"
    signals = enrichment.text_signals(spark.createDataFrame([("Ann: we argue it [3] “quoted text” http://a.b",)], "t string"), "t").first()
    assert (signals.speaker, signals.argument_role, signals.citation, signals.quote, signals.source_url) == ("Ann", "claim", "3", "quoted text", "http://a.b")


def test_preprocess_rows(spark):
    df = spark.createDataFrame([("We support tax. It helps.", "a.txt", 1), ("We oppose tax.", "b.txt", 2), (" ", "c.txt", 3), ("We oppose tax.", "b.txt", 4)], "body string, path string, row int")
    spec = {"rename_map": {"body": "text"}, "chunk_mode": "sentence", "standardize_evidence": True, "deduplicate_by": ["source_path", "claim_text"], "detect_conflicts": True}
    out = enrichment.preprocess_rows(df, spec, ["row"])
    assert sorted(r.claim_text for r in out.collect()) == ["It helps.", "We oppose tax.", "We support tax."]


def test_grids(spark):
    boxes = spark.createDataFrame([("p", 50.0, 10.0, 10.0, "b"), ("p", 5.0, 14.0, 10.0, "a"), ("p", 5.0, 40.0, 10.0, "c")], "k string, x double, y double, h double, text string")
    assert sorted((r.line, r.cells) for r in enrichment.cluster_lines(boxes, "k").collect()) == [(1, ["a", "b"]), (2, ["c"])]
    assert enrichment.header_row([["Report", "", ""], ["id", "amount", "date"], ["1", "2", "3"]], {"id", "amount", "date"})[:2] == (1, 1)


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([("1", "red apple pie", "x"), ("2", "green apple", "y"), ("", "none", "x")], "id string, text string, kind string")
    intelligence.build_index(docs, f"{tmp_path}/i", "id", "text", ["kind"])
    intelligence.build_index(spark.createDataFrame([("3", "apple apple", "y")], docs.schema), f"{tmp_path}/i", "id", "text", ["kind"], mode="append")
    asked = spark.createDataFrame([("q", "apple")], "id string, text string")
    assert [r.id for r in intelligence.search_index(spark, f"{tmp_path}/i", asked).orderBy("rank").collect()] == ["3", "2", "1"]
    assert [r.id for r in intelligence.search_index(spark, f"{tmp_path}/i", asked, {"kind": "x"}).collect()] == ["1"]


def test_tasks(spark):
    tasks = Tasks(spark, slots=2)
    calls = []

    def work():
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("first")
        return spark.range(10).count()

    name = tasks.submit(work, "key")
    assert tasks.submit(work, "key") == name and tasks.wait(name)["result"] == 10 and tasks.status(name)["attempts"] == 2
    gate = threading.Event()
    blocked = tasks.submit(lambda: gate.wait(20) and (_ for _ in ()).throw(RuntimeError("late")))
    tasks.cancel(blocked)
    gate.set()
    assert tasks.wait(blocked)["state"] == "cancelled"
    cache = ResultCache(most=1)
    df = spark.range(5)
    double = lambda d: d.withColumn("y", F.col("id") * 2)
    assert cache.get(df, {"a": 1}, double) is cache.get(df, {"a": 1}, double) and cache.get(df, {"a": 2}, double).count() == 5
    assert cache.stats() == {"entries": 1, "hits": 1, "misses": 2} and cache.clear() == 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc string, n int, t string, source_url string")
    assert enrichment.merge_wrapped(none, ["doc"], ["n"], "t").count() == 0 and enrichment.rebuild_paragraphs(none, "doc", "t").count() == 0
    with pytest.raises(KeyError):
        Tasks(spark).status("nothing")
