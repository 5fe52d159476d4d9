"""Operations on single fields: text, dates, amounts, phones and accounts, as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlake.functions.values import col, iso_date, kind_of, miss, money, num, number, once, round_half_away, vts, ymd

#: Patterns of links and addresses, and the units that a header may name.
URL, EMAIL = r"https?://[^\s]+|www\.[^\s]+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HEADER_UNITS = [("亿|billion", 1e8), ("百万|million", 1e6), ("万", 1e4), ("千|thousand", 1e3)]
OUT, IN = r"debit|dr|借|支出|付款|out|withdraw", r"credit|cr|贷|收入|收款|in|deposit"


def string_op(df: DataFrame, spec: dict) -> DataFrame:
    """trim, lower, upper, replace; the result is text, null becomes empty; absent columns are skipped."""
    name = spec["field"]
    if name not in df.columns:
        return df
    text = vts(col(name))
    out = {"trim": F.trim(text), "lower": F.lower(text), "upper": F.upper(text), "replace": F.replace(text, F.lit(spec.get("from", "")), F.lit(spec.get("to", ""))) if spec.get("from") else text}
    return df.withColumn(spec.get("as", name), out.get(spec["op"], text))


def date_op(df: DataFrame, spec: dict) -> DataFrame:
    """parse_ymd, year, month, day; null where there is no date or no such operation."""
    name = spec["field"]
    if name not in df.columns:
        return df
    p = ymd(col(name))
    out = {"parse_ymd": iso_date(col(name)), "year": p["y"], "month": p["m"], "day": p["d"]}
    return df.withColumn(spec.get("as", name), out.get(spec["op"], F.lit(None).cast("string")))


def header_unit(*headers: str) -> float:
    """The multiplier that a header such as 金额(万元) names."""
    import re

    for text in headers:
        for pattern, factor in HEADER_UNITS:
            if re.search(pattern, text or "", re.I):
                return factor
    return 1.0


def phone_cn(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^0-9]", "")
    bare = F.when(digits.rlike(r"^86[0-9]{11}$"), F.substring(digits, 3, 11)).when(digits.rlike(r"^0086[0-9]{11}$"), F.substring(digits, 5, 11)).otherwise(digits)
    return F.when(bare.rlike(r"^1[3-9][0-9]{9}$"), F.concat(F.lit("+86"), bare))


def signed_amount(df: DataFrame, spec: dict) -> Column:
    """credit - debit if either is there, else the amount with the sign of the direction."""
    debit, credit = number(df, spec.get("debit_field", "debit_amount")), number(df, spec.get("credit_field", "credit_amount"))
    amount = F.abs(number(df, spec.get("amount_field", spec["field"])))
    way = spec.get("direction_field", "txn_type")
    token = F.lower(vts(col(way))) if way in df.columns else F.lit("")
    by_token = F.when(token.rlike(OUT), -amount).when(token.rlike(IN), amount)
    return F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(credit, F.lit(0.0)) - F.coalesce(debit, F.lit(0.0))).otherwise(by_token)


def field_op(df: DataFrame, spec: dict) -> DataFrame:
    """One operation; where it gives nothing the value stays. parse_number and its like give doubles, with the text kept in <name>__raw."""
    name, op = spec["field"], spec["op"]
    if name not in df.columns and op != "sign_amount_from_debit_credit":
        return df
    c, to = (col(name), spec.get("as", name)) if name in df.columns else (F.lit(None).cast("string"), spec.get("as", name))
    kind = kind_of(df, name) if name in df.columns else T.StringType()
    text = vts(c)
    numbers = {
        "parse_number": lambda: num(c, kind), "round_number": lambda: round_half_away(num(c, kind), int(spec.get("digits", 2))), "scale_number": lambda: num(c, kind) * float(spec.get("multiplier", 1.0)),
        "scale_by_header_unit": lambda: num(c, kind) * float(spec.get("multiplier") or header_unit(spec.get("raw_header", ""), spec.get("header_text", ""), spec.get("unit", ""))),
        "sign_amount_from_debit_credit": lambda: F.coalesce(signed_amount(df, spec), num(c, kind)),
    }
    if op in numbers:
        out = df.withColumn("__number", numbers[op]())
        if isinstance(kind, T.StringType) and op == "parse_number":
            out = out.withColumn(f"{to}__raw", c)
        return out.withColumn(to, F.col("__number")).drop("__number")
    texts = {
        "trim": lambda: F.trim(text), "lower": lambda: F.lower(text), "upper": lambda: F.upper(text), "collapse_whitespace": lambda: F.trim(F.regexp_replace(text, r"\s+", " ")),
        "remove_urls": lambda: F.trim(F.regexp_replace(text, URL, "")), "remove_emails": lambda: F.trim(F.regexp_replace(text, EMAIL, "")),
        "regex_replace": lambda: F.regexp_replace(text, spec["pattern"], spec.get("replace", spec.get("to", ""))),
        "extract_regex": lambda: F.when(text.rlike(spec["pattern"]), F.regexp_extract(text, spec["pattern"], int(spec.get("group", 0)))),
        "strip_currency_symbol": lambda: F.trim(F.regexp_replace(text, r"[¥￥$€£]|(?i)\b(?:usd|cny|rmb|eur|gbp)\b", "")), "strip_thousands_sep": lambda: F.regexp_replace(text, r"(?<=[0-9])[,，](?=[0-9]{3})", ""),
        "map_value": lambda: F.create_map(*(F.lit(str(x)) for kv in spec["mapping"].items() for x in kv))[F.trim(text)] if spec.get("mapping") else None,
        "fix_ocr_digits": lambda: F.translate(text, "OoIl|SsB", "00111558"), "normalize_phone_cn": lambda: phone_cn(text), "normalize_account_no": lambda: F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")),
        "normalize_name": lambda: F.trim(F.regexp_replace(F.translate(text, "　", " "), r"\s+", " ")), "parse_date": lambda: iso_date(c),
    }
    if op not in texts or (new := texts[op]()) is None:
        return df if to == name else df.withColumn(to, c)
    return df.withColumn(to, F.when(c.isNull(), c.cast("string")).otherwise(F.coalesce(new, c.cast("string"))))


#: Words of the sides in a stance, and citations in round brackets.
STANCES = {"neutral": ["neutral", "mixed", "undecided", "unclear", "中立", "未表态", "待定"], "pro": ["support", "agree", "approve", "affirmative", "in favor", "positive", "pro", "支持", "赞成", "正方", "有利"], "con": ["oppose", "disagree", "reject", "negative", "against", "con", "anti", "反对", "不支持", "错误", "反方", "不利"]}
PAREN_CITATION = r"(?i)[(（](?:source|citation|according to|ref|reference|来源|引自|出处)[:：]?\s*[^)）]+[)）]"
QUOTE = "[\"“”'‘’](.{2,400}?)[\"“”'‘’]"
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss"]


def has_word(text: Column, words: list[str]) -> Column:
    """Whether one of the words occurs in a lower-case text: ASCII ones as whole words, others anywhere."""
    ascii_ = [re.escape(w) for w in words if re.fullmatch(r"[a-z0-9 ]+", w)]
    found = [text.rlike(r"\b(?:" + "|".join(ascii_) + r")\b")] if ascii_ else []
    return reduce(lambda a, b: a | b, [*found, *(text.contains(w) for w in words if not re.fullmatch(r"[a-z0-9 ]+", w))], F.lit(False))


def stance(text: Column) -> Column:
    """neutral, pro, con or unknown by whole words; a word of the neutral counts before all."""
    low = F.lower(F.trim(F.regexp_replace(vts(text), r"\s+", " ")))
    pro, con = has_word(low, STANCES["pro"]), has_word(low, STANCES["con"])
    return F.when(has_word(low, STANCES["neutral"]), "neutral").when(pro & ~con, "pro").when(con & ~pro, "con").otherwise("unknown")


def text_transform(name: str, c: Column, **options) -> Column:
    """The transforms of text pre-processing that have no rule of their own above; null stays null."""
    text = c.cast("string")
    spaced = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    if name == "clean_citation":
        return spaced(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]{1,40}\]", " "), PAREN_CITATION, " "))
    if name == "strip_ocr_noise":
        out = F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " ")
        out = F.regexp_replace(F.regexp_replace(out, r"(?i)^\s*(?:page|p\.)\s*\d+\s*$", " "), r"^\s*第?\s*\d+\s*页\s*$", " ")
        return spaced(F.regexp_replace(out, r"([A-Za-z一-鿿])\1{4,}", "$1"))
    if name == "collapse_duplicate_lines":  # the first of equal lines stays, whatever their case and blanks
        lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")
        keyed = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(spaced(x)).alias("k"), i.alias("i"), x.alias("x"))))
        firsts = once(keyed, lambda o: F.filter(o, lambda s, i: (i == 0) | (s["k"] != F.get(o, i - 1)["k"])))
        kept = F.transform(F.array_sort(F.transform(firsts, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])
        return F.when(F.size(lines) > 0, F.array_join(kept, "\n")).otherwise(text)
    if name == "extract_speaker_prefix":
        label = F.regexp_extract(text, r"^\s*([\p{L}][\p{L}\p{N} ._-]{0,40}?)\s*[:：]", 1)
        return F.when(text.isNotNull(), F.when(F.lower(label).isin("source", "citation", "claim", "quote", "reference", "http", "https"), "").otherwise(F.regexp_replace(label, r"(?i)^speaker\s+", "")))
    if name == "normalize_stance":
        return F.when(text.isNotNull(), stance(text))
    if name == "detect_quote_only":  # quote: little is left beside what stands in quotation marks
        rest = spaced(F.regexp_replace(text, QUOTE, " "))
        return F.when(text.isNotNull(), F.when(text.rlike(QUOTE) & (F.length(rest) <= 24), "quote").otherwise("claim"))
    if name == "parse_date":
        return F.coalesce(*(F.date_format(F.try_to_timestamp(F.trim(text), F.lit(f)), "yyyy-MM-dd") for f in options.get("formats", DATE_FORMATS)), text)
    if name == "round_number":
        return F.bround(money(text), int(options.get("digits", 2)))
    raise ValueError(f"no transform {name!r}")


#: Full-width ASCII and the space, and what stands for them.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def display_text(c: Column) -> Column:
    """Half-width ASCII, single spaces, no zero-width characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(c.cast("string"), _WIDE, _NARROW), "[​-‍﻿]", ""), r"\s+", " "))


def normalize_by_name(df: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Each text column by what its name says: amounts (times the unit of its header), ids, dates, phones, else display text. Unparsable cells stay as they are."""
    out: dict[str, Column] = {}
    for c in df.columns:
        if not isinstance(kind_of(df, c), T.StringType):
            continue
        low, x = c.lower(), display_text(col(c))
        if any(w in low for w in ("amount", "balance", "price", "total")):
            new = (money(x, english_units=True) * header_unit((headers or {}).get(c, ""))).cast("string")
        elif low == "id" or low.endswith("_id"):
            new = F.when(x.rlike(r"^[+-]?\d{1,18}(?:\.0+)?$"), F.regexp_replace(x, r"\.0+$", "")).try_cast("long").cast("string")
        elif "date" in low or low.endswith("_at"):
            new = iso_date(F.regexp_replace(x, r"[ T]\d{1,2}:.*$", ""))
        elif "phone" in low or "mobile" in low:
            new = phone_cn(x)
        else:
            new = x
        out[c] = F.when(miss(col(c)), None).otherwise(F.coalesce(new, x))
    return df.withColumns(out)
