import pytest
from pyspark.sql import functions as F
from rowlake.functions import fields, values
from rowlake.functions.expressions import fields_of, mini_expression, tree_expression

AMOUNTS = {
    "10": 10.0, "$1,200.50": 1200.5, "": None, "bad": None, "(1,200)": -1200.0, "（5）": -5.0, "12-": -12.0, "-3.5": -3.5, "−4": -4.0, "1，234": 1234.0, "¥3万": 30000.0, "2亿": 2e8, "借 5": -5.0, "dr 7": -7.0,
    "+8": 8.0, "3 million": None, "12d": None, "inf": None, "nan": None, "0x1p3": None, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, None: None, "  9 元 ": 9.0, "1千": 1000.0,
}


def column(spark, items, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")


def evaluate(spark, items, f, kind="string"):
    rows = column(spark, items, kind).select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_money(spark):
    assert evaluate(spark, AMOUNTS, lambda c: values.num(c)) == list(AMOUNTS.values())
    assert evaluate(spark, ["3 million", "2 thousand"], lambda c: values.money(c, english_units=True)) == [3e6, 2e3]


def test_dates(spark):
    items = {"2024-01-02": "2024-01-02", "2024/1/2": "2024-01-02", "2024.1.2": "2024-01-02", "2024年1月2日": "2024-01-02", "20240102": "2024-01-02", "2026-02-31": "2026-02-31", "2024-13-01": None, "x": None, "2024-01-02 10:00": None, None: None, "2024-1-2-9": "2024-01-02"}
    assert evaluate(spark, items, values.iso_date) == list(items.values())


def test_time_keys(spark):
    got = evaluate(spark, ["7", "2024-01-02", "1970-01-01 00:00:05", "10.5", "", "2024-01"], values.time_key)
    assert got == [7, 1704153600, 5, values.MAX_KEY, values.MAX_KEY, 1704067200]


def test_rounding(spark):
    assert evaluate(spark, [1.005, -2.5, 2.345, None], lambda c: values.round_half_away(c, 2), "double") == [1.0, -2.5, 2.35, None]
    assert evaluate(spark, [0.5, -0.5], lambda c: values.round_half_away(c, 0), "double") == [1.0, -1.0]


def test_casts(spark):
    kind = values.T.StringType()
    assert evaluate(spark, ["1.9", "-1.9", "x", "(3)"], lambda c: values.cast_to(c, kind, "int")) == [1, -1, None, -3]
    assert evaluate(spark, ["Yes", "off", "2"], lambda c: values.cast_to(c, kind, "bool")) == [True, False, None]
    assert evaluate(spark, ["5"], lambda c: values.cast_to(c, kind, "decimal")) == ["5"]


def test_mini_expressions(spark):
    df = spark.createDataFrame([("5", None, " A "), ("x", "2", "")], "a string, b string, c string")
    run = lambda e: [r[0] for r in df.select(mini_expression(df, e)).collect()]
    assert run("add($a, $b)") == [5.0, 2.0] and run("mul(a, 3)") == [15.0, 0.0] and run("div(a, b)") == [None, 0.0]
    assert run("concat(a, '-', b)") == ["5-", "x-2"] and run("coalesce(b, c)") == [" A ", "2"] and run("trim(c)") == ["A", ""]
    assert run("nothing(a)") == [None, None] and run("$a") == ["5", "x"]


def test_trees(spark):
    df = spark.createDataFrame([(1, "2", None), (0, "x", "t")], "a int, b string, c string")
    run = lambda e: [r[0] for r in df.select(tree_expression(df, e)[0]).collect()]
    f = lambda x: {"field": x}
    assert run({"op": "add", "args": [f("a"), f("b"), f("c")]}) == [3.0, 0.0] and run({"op": "mul", "args": [f("a"), f("b")]}) == [2.0, 0.0]
    assert run({"op": "div", "args": [1, f("a")]}) == [1.0, None] and run({"op": "gt", "args": [f("b"), -1]}) == [True, True]
    assert run({"if": f("a"), "then": "y", "else": 2}) == ["y", "2"] and run({"op": "not", "args": [f("c")]}) == [True, False]
    assert run({"op": "eq", "args": [f("c"), ""]}) == [True, False] and run({"expr": {"const": 4}}) == [4, 4]
    assert fields_of({"op": "add", "args": [f("a"), {"if": f("z")}]}) == {"a"} and fields_of("add($a, $b.c)") == {"a", "b.c"}
    with pytest.raises(ValueError):
        run({"op": "sqrt", "args": []})


def test_field_ops(spark):
    df = spark.createDataFrame([(" a  b ", "1,234,567", "+86 138-0013-8000", "O1l", "支出", "7"), (None, "x", "123", "", "in", "3")], "t string, n string, p string, o string, txn_type string, amount string")
    run = lambda **s: [r[0] for r in fields.field_op(df, s).select(s.get("as", s["field"])).collect()]
    assert run(field="t", op="collapse_whitespace") == ["a b", None] and run(field="n", op="strip_thousands_sep") == ["1234567", "x"]
    assert run(field="p", op="normalize_phone_cn") == ["+8613800138000", "123"] and run(field="o", op="fix_ocr_digits") == ["011", ""]
    assert run(field="n", op="parse_number") == [1234567.0, None] and run(field="amount", op="sign_amount_from_debit_credit") == [-7.0, 3.0]
    assert run(field="n", op="map_value", mapping={"x": "y"}) == ["1,234,567", "y"] and run(field="n", op="scale_by_header_unit", header_text="金额(万元)", **{"as": "m"}) == [1.234567e10, None]
    assert run(field="t", op="regex_replace", pattern="a", replace="z") == [" z  b ", None] and run(field="p", op="extract_regex", pattern="[0-9]{3}") == ["138", "123"]


def test_normalize_by_name(spark):
    df = spark.createDataFrame([("１，２００", "7.0", "2024年1月2日 10:00", "138 0013 8000", "Ａ　 b​"), ("3 million", "x", "soon", "12", " ")], "amount string, id string, biz_date string, phone string, note string")
    got = [tuple(r) for r in fields.normalize_by_name(df, {"amount": "金额(万元)"}).collect()]
    assert got == [("1.2E7", "7", "2024-01-02", "+8613800138000", "A b"), ("3.0E10", "x", "soon", "12", None)]
