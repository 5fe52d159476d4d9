import pytest
from pyspark.sql import functions as F
from rowlake.operators import aggregates, filters, intelligence, joins, quality, ranges, text, transform, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_join_shapes(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([("1", "p"), ("", "q"), ("9", "r")], "k string, w string")
    inner = [(1, "x", "1", "p"), (None, "n", "", "q")]
    assert rows(joins.join_rows(a, b, "k", "k")) == sorted(inner, key=str)
    assert rows(joins.join_rows(a, b, "k", "k", "left")) == sorted([*inner, (3, "z", None, None)], key=str)
    full = joins.join_rows(a, b, "k", "k", "full")
    assert full.columns == ["k", "v", "right_k", "w"] and ("9", None, None, "r") in rows(full) and full.count() == 4
    assert rows(joins.join_rows(a, b, "k", "k", "semi")) == [(1, "x"), (None, "n")] and rows(joins.join_rows(a, b, "k", "k", "anti")) == [(3, "z")]
    assert joins.join_rows_prefiltered(a, b, "k", "k", "left").count() == 2 and joins.join_rows_prefiltered(a, b, "k", "k", "left", enable_bloom=False).count() == 3
    for how in joins.TYPES:
        assert joins.join_stats(a, b, "k", "k", how).first().output_rows == joins.join_rows(a, b, "k", "k", how).count()
    for bad in ({"join_type": "cross"}, {"left_on": ["k", "v"]}):
        with pytest.raises(ValueError):
            joins.join_rows(a, b, **{"left_on": "k", "right_on": "k", **bad})


def test_aggregate_rules(spark):
    df = spark.createDataFrame([("a", "1"), ("a", None), ("a", "3"), ("b", "x"), (None, "4"), ("", "6")], "g string, v string")
    got = {r.g: r for r in aggregates.aggregate_stats(df, ["g"], [{"op": x, "field": "v", "as": x} for x in ("sum", "avg", "stddev", "count_distinct", "median", "percentile_p95")]).collect()}
    assert (got["a"].sum, got["a"].avg, got["a"].stddev, got["a"].count_distinct, got["a"].median) == (4.0, 2.0, 1.0, 3, 3.0)
    assert (got["b"].sum, got["b"].avg, got["b"].stddev, got["b"].median) == (0.0, None, None, None) and got[""].sum == 10.0
    basic = {r.g: r for r in aggregates.aggregate_basic(df, ["g"], [{"op": "avg", "field": "v"}, {"op": "median", "field": "v"}]).collect()}
    assert basic["a"].v_avg == pytest.approx(4 / 3) and "v_median" not in basic["a"]
    four = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert aggregates.aggregate_stats(four, [], [{"op": "p50", "field": "x"}]).first()[0] == 3.0
    top = aggregates.aggregate_stats(df, [], [{"op": "topk_2", "field": "g", "as": "t"}]).first().t
    assert [(x.value, x["count"]) for x in top] == [("a", 3), ("", 2)]
    for bad in ([], [{"op": "sum"}], [{"op": "mode", "field": "v"}]):
        with pytest.raises(ValueError):
            aggregates.parse_specs(bad)


def test_row_filters(spark):
    df = spark.createDataFrame([("1", "5", "ok"), ("", " ", "-"), ("Total", "9", ""), ("id", "amount", "date"), ("note: x", "1", "2")], "a string, b string, c string")
    kept = lambda op, **o: [r.a for r in filters.apply_filters(df, [{"op": op, **o}]).collect()]
    assert kept("blank_row") == ["1", "Total", "id", "note: x"] and kept("subtotal_row") == ["1", "", "id", "note: x"]
    assert kept("note_row") == ["1", "", "Total", "id"] and kept("header_repeat_row") == ["1", "", "Total", "note: x"]
    assert kept("regex", field="a", value="(") == [] and kept("gt", field="b", value="x") == [] and kept("gte", field="b", value=5) == ["1", "Total"]
    assert filters.query_lang(df, "where b > 4").count() == 2 and filters.query_lang(df, "limit x").count() == 5


RAW = [("1", " $1,200.50 ", "yes", "2024/1/2"), ("1", "10", "no", "2024-02-01"), ("2", "bad", "no", ""), ("3", "", "yes", "x"), ("NULL", "7", "yes", ""), ("4", "-5", "maybe", "")]


def raw(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(RAW)], "id string, amt string, active string, day string, n int")


def test_transform(spark):
    rules = {"rename_map": {"amt": "amount"}, "casts": {"amount": "float", "active": "bool"}, "null_values": ["null"], "required_fields": ["id"], "default_values": {"amount": "0"}, "date_ops": [{"field": "day", "op": "parse_ymd"}], "deduplicate_by": ["id"], "sort_by": [{"field": "amount", "order": "desc"}], "exclude_fields": ["n"]}
    out = transform.transform(raw(spark), rules, ["day"])
    assert out.df.columns == ["id", "amount", "active", "day"]
    assert [tuple(r) for r in out.df.collect()] == [("1", 10.0, False, "2024-02-01"), ("3", 0.0, True, None)]
    assert dict(map(tuple, out.audit.collect())) == {"ok": 3, "cast_failed": 2, "required_missing": 1}
    m = transform.quality_metrics(raw(spark), rules).first().asDict()
    assert (m["invalid_rows"], m["output_rows"], m["duplicate_rows_removed"]) == (2, 2, 1)
    with pytest.raises(transform.QualityGateError):
        transform.run_transform(raw(spark), rules, {"max_invalid_rows": 1})
    assert transform.run_transform(raw(spark), rules, {"max_invalid_rows": 2, "min_output_rows": 2}, order_by=["day"]).df.count() == 2
    assert transform.transform(raw(spark).limit(0), rules, ["day"]).df.count() == 0


def test_survivorship(spark):
    df = spark.createDataFrame([("a", "5", None, "2024-01-01", 1), ("a", "2024-03-01", "x", "2023-01-01", 2), ("b", "7", None, "2024-01-02", 3), ("b", "7", "y", "2020-01-01", 4), ("c", None, None, "2024-01-01", 5), ("c", None, None, "2024-02-01", 6)], "k string, s string, n string, d string, i int")
    rule = {"keys": ["k"], "score_fields": ["s"], "prefer_non_null_fields": ["n"], "prefer_latest_fields": ["d"]}
    assert sorted(r.i for r in transform.survivorship(df, rule, ["i"]).collect()) == [2, 4, 6]


def test_quality_and_drift(spark):
    df = spark.createDataFrame([(i, float(i % 5), None if i % 4 == 0 else "x") for i in range(40)] + [(39, 1000.0, "x")], "id int, v double, c string")
    rules = {"unique_fields": ["id"], "required_fields": ["c"], "max_null_ratio": 0.1, "outlier_zscore": {"field": "v"}, "anomaly_iqr": {"field": "v", "max_ratio": 0.01}, "range_checks": [{"field": "v", "min": 0, "max": 2000}], "dependency_checks": [{"if": "id", "then": "c"}]}
    got = {(r.check, r.field): r.passed for r in quality.quality_check(df, rules, 4).collect()}
    assert got == {("unique", "id"): False, ("null_ratio", "c"): False, ("outlier_zscore", "v"): False, ("anomaly_iqr", "v"): False, ("range", "v"): True, ("dependency", "c"): False}
    assert quality.score(quality.quality_check(df, rules, 4), 4).first().score == 100 - 5 * 8
    assert quality.psi(df, df, "v").first().psi == 0.0
    assert quality.parse_dsl("Required: A,b\nrange:x x >= 1 <= 2\nanomaly_iqr: field=v,max_ratio=0.2\nwhat") == {"required_fields": ["a", "b"], "range_checks": [{"field": "x", "min": 1.0, "max": 2.0}], "anomaly_iqr": {"field": "v", "max_ratio": 0.2}}


def test_windows(spark):
    df = spark.createDataFrame([("a", "2024-01", 1.0), ("a", "2024-02", None), ("a", "2024-03", 5.0), ("b", "2024-01", 2.0)], "g string, m string, v double")
    out = windows.window_rows(df, ["g"], "m", [{"op": "moving_avg", "field": "v", "as": "a"}, {"op": "lag", "field": "v", "as": "l"}, {"op": "x", "as": "none"}, {"op": "rank", "as": " "}])
    assert out.columns == ["g", "m", "v", "a", "l", "none"] and [(r.a, r.l) for r in out.filter("g = 'a'").orderBy("m").collect()] == [(1.0, None), (1.0, 1.0), (3.0, None)]
    assert [r.forecast for r in windows.forecast(df, "m", "v", ["g"], 2).filter("g = 'a'").orderBy("step").collect()] == [9.0, 13.0]
    bank = spark.createDataFrame([(1, "x", 10.0, 0.0, None, None), (2, "x", 12.0, 2.0, None, 2.0), (3, "x", 12.0, 2.0, 1.0, None)], "n int, acc string, balance double, amount double, debit_amount double, credit_amount double")
    assert [r.balance_gap for r in windows.balance_gaps(bank, "acc", ["n"]).orderBy("n").collect()] == [False, False, True]
    assert [r.signed_amount_conflict for r in windows.signed_amount_conflicts(bank).orderBy("n").collect()] == [False, False, True]


def test_texts(spark):
    df = spark.createDataFrame([(1, "A line of text\n[1] short\n\nReferences\n[2] gone"), (2, None), (3, "Ann: hello\nagain\nBob： I oppose this")], "id int, t string")
    assert {r.id: r.clean_text for r in text.preprocess(df, "t").collect()}[1] == "A line of text\n[1] short"
    assert [(r.speaker, r.said) for r in text.speaker_turns(df.filter("id = 3"), "t").collect()] == [("Ann", "hello"), ("Ann", "again"), ("Bob", "I oppose this")]
    assert [r.chunk_text for r in text.chunk(spark.createDataFrame([("One. Two! 三。四",)], "t string"), "t", "sentence").collect()] == ["One.", "Two!", "三。", "四"]
    table = text.reconstruct_table(spark.createDataFrame([(1, "a  b\nc\td  e")], "k int, t string"), "k", "t").collect()
    assert [list(r.cells) for r in table] == [["a", "b", ""], ["c", "d", "e"]]
    claims = spark.createDataFrame([("tax", "I support it"), ("tax", "we oppose"), ("war", "against it")], "topic_name string, claim string")
    assert rows(text.detect_conflicts(claims, "claim", "topic_name").select("topic", "conflict").distinct()) == [("tax", True), ("war", False)]
    filled = spark.createDataFrame([(1, "p", "s"), (2, "p", None), (3, "p", " "), (4, "q", None)], "i int, d string, s string")
    assert [r.s for r in text.propagate(filled, ["d"], ["i"], ["s"]).orderBy("i").collect()] == ["s", "s", "s", None]
    found = text.extract_entities(spark.createDataFrame([(1, "a@b.co http://x.y/z 1,200.5 -3")], "k int, t string"), "k", "t").collect()
    assert [(r.kind, r.value) for r in found] == [("email", "a@b.co"), ("url", "http://x.y/z"), ("number", "1,200.5"), ("number", "-3")]


def test_entities_of_long_texts(spark):
    df = spark.createDataFrame([(1, "a@b.co http://x.y/z 17 " * 2100)], "k int, t string")
    whole = {r.kind: r["count"] for r in text.extract_entities(df, "k", "t").groupBy("kind").count().collect()}
    assert whole == {"email": 2100, "url": 2100, "number": 2100}  # no cap unless one is given
    counts = {r.kind: r["count"] for r in text.extract_entities(df, "k", "t", most=2000).groupBy("kind").count().collect()}
    assert counts == {"email": 2100, "url": 2100, "number": 2000}


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.1), (2.0, 3.9), (3.0, 6.2), (4.0, 7.8), (5.0, 10.1)], "x double, y double")
    r = intelligence.regression(df, "x", "y")
    assert r["slope"] == pytest.approx(1.99) and r["intercept"] == pytest.approx(0.05) and r["p_value"] == pytest.approx(5.94e-5, rel=0.01)
    assert r["ci95_low"] < r["slope"] < r["ci95_high"] and intelligence.t_two_sided(2.0, 10) == pytest.approx(0.07339, abs=1e-4) and intelligence.t_quantile(0.975, 3) == pytest.approx(3.1824, abs=1e-3)
    with pytest.raises(ValueError):
        intelligence.regression(df.limit(1), "x", "y")
    assert intelligence.bind_template("{{ a.b }} {{x}}", {"a": {"b": 1}}) == ("1 {{x}}", 1) and len(intelligence.sign_provenance("", "t", "p")) == 64


def test_running_totals_match_one_sort(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 501).alias("k"), (F.col("id") % 7).alias("v")).groupBy("k").agg(F.sum("v").alias("v"))
    got = {r.k: r.upto for r in ranges.running_totals(df, "k", "v").collect()}
    total, want = 0, {}
    for r in sorted(df.collect()):
        total += r.v
        want[r.k] = total
    assert got == want


def test_chunks_of_wide_rows_over_many_ranges(spark):
    from rowlake.streaming.windows import chunk_ids

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        df = spark.range(0, 60000, 1, 7).select((F.col("id") * 7919 % 60000).alias("k"), F.concat(F.lit("text "), F.col("id")).alias("wide"), (F.col("id") % 3).alias("more"))
        got = chunk_ids(df, "k", 500).collect()
        assert all(r.chunk_id == r.k // 500 for r in got) and len(got) == 60000
        done, seen = -1, []
        for _ in range(9):  # resumed runs lose and repeat nothing
            out, state = transform.transform_chunks(df, {}, "k", 500, done=done, most=17)
            seen += [r.k for r in out.select("k").collect()]
            done = state["last_chunk"]
            if not state["has_more"]:
                break
        assert sorted(seen) == list(range(60000)) and done == 119
        hot = df.withColumn("k", F.when(F.col("k") < 30000, 5).otherwise(F.col("k")))  # one key has half of the rows
        sizes = {r.chunk_id: r["count"] for r in chunk_ids(hot, "k", 500).groupBy("chunk_id").count().collect()}
        assert sizes == {i: 500 for i in range(120)}
        nulls = df.withColumn("k", F.when(F.col("k") % 4 > 0, F.col("k")))
        assert {r.k for r in chunk_ids(nulls, "k", 15000).filter("chunk_id = 0").collect()} == {None}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_exact_percentiles(spark):
    import random

    rng = random.Random(3)
    values = [rng.choice([0.0, -1.5, 2.0, rng.lognormvariate(0, 3), -rng.lognormvariate(2, 2), 1e300, -1e-300, float(rng.randint(0, 9))]) for _ in range(4000)]
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), x if rng.random() > 0.05 else None) for x in values], "g string, x double")
    shares = {"q0": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "top": 1.0}
    for by in ([], ["g"]):
        for r in ranges.percentiles(df, by, "x", shares).collect():
            mine = sorted(y for g, y in map(tuple, df.collect()) if y is not None and (not by or g == r.g))
            assert [r[k] for k in shares] == [mine[int((len(mine) - 1) * p + 0.5)] for p in shares.values()]
    assert ranges.percentiles(df.limit(0), [], "x", shares).first() == (None,) * 5
    assert quality.quartiles(spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double"), "x", interpolated=True).first() == (4, 1.75, 3.25)


def test_windows_without_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 16)
    df = spark.createDataFrame([(i, f"2024-01-{1 + i * 7 % 28:02d}", float(i % 11) if i % 5 else None) for i in range(200)], "n int, d string, v double").repartition(5)
    made = [{"op": "row_number", "as": "rn"}, {"op": "rank", "as": "rk"}, {"op": "dense_rank", "as": "dr"}, {"op": "lag", "field": "v", "offset": 9, "as": "before"}, {"op": "lead", "field": "n", "as": "after"}, {"op": "moving_avg", "field": "v", "window": 7, "as": "avg"}, {"op": "what", "as": "none"}]
    one = windows.window_rows(df.withColumn("all", F.lit("x")), ["all"], "d", made, ["n"]).drop("all")
    whole = windows.window_rows(df, [], "d", made, ["n"])
    assert whole.columns == one.columns and rows(whole) == rows(one)
    assert rows(windows.time_series(df, "d", "v", tie=["n"])) == rows(windows.time_series(df.withColumn("all", F.lit(1)), "d", "v", ["all"], tie=["n"]).drop("all"))


def test_outer_joins_are_one_join(spark):
    a = spark.createDataFrame([(1, "x", 5), (None, "n", 6), (3, "z", 7), (None, "m", 8)], "k int, v string, c int")
    b = spark.createDataFrame([("1", "p", "c1"), ("", "q", "c2"), ("9", "r", "c3")], "k string, w string, c string")
    full = joins.join_rows(a, b, "k", "k", "full")
    assert full.columns == ["k", "v", "c", "right_k", "w", "right_c"]
    assert rows(full) == sorted([("1", "x", "5", "1", "p", "c1"), (None, "n", "6", "", "q", "c2"), (None, "m", "8", "", "q", "c2"), ("3", "z", "7", None, None, None), ("9", None, "c3", None, "r", None)], key=str)
    assert full._jdf.queryExecution().analyzed().toString().count("Join ") == 1
    assert rows(joins.join_rows(a, b, "k", "k", "right")) == sorted([x for x in rows(full) if x[0] != "3"], key=str)
    none = joins.join_rows(a, b, "k", "k", "full", match_missing=False)
    assert none.count() == 6 and rows(joins.join_rows(a, b, "k", "k", match_missing=False)) == [(1, "x", 5, "1", "p", "c1")]
    for how in ("inner", "left", "right", "full", "semi", "anti"):  # the rewritten join gives what the semi join before it gave
        kept = joins.join_rows(a, b, "k", "k", "semi")
        assert rows(joins.join_rows_prefiltered(a, b, "k", "k", how)) == rows(joins.join_rows(kept, b, "k", "k", how))
    two = joins.join_rows_prefiltered(a.withColumn("j", F.lit(1)), b.withColumn("j", F.lit(1)), ["k", "j"], ["k", "j"], "left")
    assert two.count() == 3


def test_chart_keeps_every_series(spark):
    df = spark.createDataFrame([(f"c{i % 5}", f"s{i:03d}", 1.0) for i in range(300)], "c string, s string, v double")
    out = aggregates.chart_data(df, "c", "s", "v", top_n=2)
    assert out.select("category").distinct().count() == 2 and out.select("series").distinct().count() == 120 and out.count() == 240


def test_gates_and_parse_rates(spark):
    df = spark.createDataFrame([("1", "5", "2024-01-02"), ("1", "x", "2024-01-03"), ("2", "7", "no"), ("2", "8", None), ("3", None, "2024/2/3"), ("4", "-1", "")], "id string, v string, d string")
    rules = {"casts": {"v": "float"}, "filters": [{"field": "v", "op": "gte", "value": 0}], "date_ops": [{"field": "d", "op": "parse_ymd"}], "deduplicate_by": ["id"], "required_fields": ["id"]}
    m = transform.quality_metrics(df, rules, ["v"]).first().asDict()
    assert (m["numeric_cells_total"], m["numeric_cells_parsed"], m["date_cells_total"], m["date_cells_parsed"]) == (5, 4, 2, 1)
    assert (m["numeric_parse_rate"], m["date_parse_rate"], m["duplicate_rows_removed"], m["output_rows"]) == (0.8, 0.5, 1, 2)
    assert m["required_missing_ratio"] == 0 and transform.quality_metrics(df, rules, ["v"], ["d"]).first().required_missing_ratio == 0.5
    for gate, bound in {"numeric_parse_rate_min": 0.9, "date_parse_rate_min": 0.6, "duplicate_key_ratio_max": 0.1, "max_invalid_rows": 0, "min_output_rows": 3}.items():
        with pytest.raises(transform.QualityGateError):
            transform.run_transform(df, rules, {gate: bound}, order_by=["v"])
    with pytest.raises(transform.QualityGateError):
        transform.run_transform(df, rules, {"max_required_missing_ratio": 0.4, "required_fields": ["d"]}, order_by=["v"])
    assert transform.run_transform(df, rules, {"numeric_parse_rate_min": 0.8, "date_parse_rate_min": 0.5, "max_required_missing_ratio": 0.0}, order_by=["v"]).df.count() == 2
    with pytest.raises(ValueError, match="unknown gate"):
        transform.run_transform(df, rules, {"whatever_min": 1})
    with pytest.raises(ValueError, match="metric"):
        transform.check_gates({"output_rows": 1}, {"numeric_parse_rate_min": 0.5})
    report = {r.gate: r.passed for r in transform.gate_report(transform.quality_metrics(df, rules, ["v"]), {"numeric_parse_rate_min": 0.9, "allow_empty_output": False, "max_invalid_rows": 1}).collect()}
    assert report == {"numeric_parse_rate_min": False, "allow_empty_output": True, "max_invalid_rows": True}
    assert dict(map(tuple, transform.rule_hits(df, rules, ["v"]).collect())) == {"cast_fail_v": 1, "filter_v": 2, "duplicate_removed": 1}
    assert sorted(r.status for r in transform.reason_samples(df, rules, ["v"]).collect()) == ["cast_failed", "duplicate_removed", "filter_rejected", "filter_rejected"]


def test_strict_casts_and_limits(spark):
    df = spark.createDataFrame([("1,200", "¥5"), (" 7 ", "1.5e3"), ("", "-.5"), ("1.5", "2")], "i string, f string")
    out = transform.transform(df, {"casts": {"i": "int", "f": "float", "z": "int"}, "strict_numbers": True})
    assert rows(out.df) == sorted([(7, 1500.0, None), (None, -0.5, None)], key=str) and dict(map(tuple, out.audit.collect())) == {"ok": 2, "cast_failed": 2}
    with pytest.raises(ValueError, match="more than 3 rows"):
        transform.transform(df, {"max_rows": 3})


def test_stats_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 2.1), ("a", 2.0, 3.9), ("a", 3.0, 6.2), ("a", 4.0, 7.8), ("a", 5.0, 10.1), ("b", 1.0, 5.0), ("b", 1.0, 7.0), ("c", 1.0, 1.0), (None, 1.0, 1.0), (None, 2.0, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in intelligence.stats_columns(df, ["g"], "x", "y").collect()}
    one = intelligence.regression(df.filter("g = 'a'"), "x", "y")
    assert set(got) == {"a", "b", None} and got["a"].median_y == 6.2 and got["b"].median_y == 7.0
    assert (got["a"].slope, got["a"].slope_stderr, got["a"].slope_t, got["a"].slope_p_value, got["a"].ci95_low) == pytest.approx((one["slope"], one["slope_stderr"], one["t"], one["p_value"], one["ci95_low"]))
    assert (got["b"].correlation, got["b"].slope, got["b"].intercept, got["b"].slope_stderr, got["b"].slope_t) == (0.0, 0.0, 6.0, None, 0.0) and got[None].correlation == 0.0
    assert intelligence.stats_columns(df, [], "x", "y", inference=False).first()["count"] == 10


def test_image_report(spark):
    blocks = spark.createDataFrame([("text", 0.9, "Hello  there"), ("text", 0.5, "hello there"), (None, None, " "), ("figure", 0.1, "##")], "block_type string, confidence double, text string")
    r = quality.image_report(blocks).first()
    assert tuple(r) == (4, 3, 0.7, 0.5, 0.5, 0.333333, 0.0)
