"""Papers and plain rows as the desktop cleaner treats them: noise, references, citations, paragraphs, corruption, and its row cleaning.

All are Columns; what joins lines is a fold over the lines of one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlake.functions.values import col, once, round_half_away, vts

#: Titles behind which a paper has no body, beginnings of noise lines, and citations within a line.
STOP_TITLES = ["references", "bibliography", "works cited", "acknowledgments", "appendix", "notes", "参考文献", "引用文献", "文献目录", "致谢", "附录", "注释", "脚注"]
NOISE_PREFIXES = ["doi:", "收稿日期", "基金项目", "通讯作者"]
CITATIONS = [r"\[\s*\d+(?:\s*[-,，]\s*\d+)*\s*\]", r"（[^（）]{0,48}\d{4}[a-z]?(?:[;；，,][^（）]{0,48})?）", r"\([^()]{0,48}\d{4}[a-z]?(?:[;,][^()]{0,48})?\)"]
MOJIBAKE, WEIRD = "ÃÂ¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿", "聙聛聜聝聞聟聠聡聢聣聤聥聦聧聨聩聪"
REFERENCE_TITLE, OTHER_TITLE = r"^(?:references?|bibliography|works cited)(?:\b|[:：\s].*)$|^(?:参考文献|引用文献|文献目录).*$", r"^(?:acknowledg?ments?|appendix|notes)(?:\b|[:：\s].*)$|^(?:致谢|附录|注释|脚注)(?:[:：\s].*)?$"
NUMBERED, LINE_END, SENTENCE_END = r"^(?:\d+(?:\.\d+){0,3}\s+|[（(]?[一二三四五六七八九十]+[)）、.]\s*)", r"[。！？!?；;:]$", r"[。！？!?；;.]$"
_BLANK, _CJK = r"[\s\x{a0}\x{3000}\x{feff}]+", "一-鿿"


def plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(vts(line), _BLANK, " "))


def _any(flags) -> Column:
    return reduce(lambda a, b: a | b, flags)


def noise(line: Column) -> Column:
    """Page numbers, DOI lines, lines of a profile's beginnings, and lines of signs."""
    s = plain(line)
    letters, signs = F.regexp_count(s, F.lit(f"[A-Za-z{_CJK}]")), F.regexp_count(s, F.lit(rf"[^A-Za-z0-9{_CJK}\s]"))
    known = s.rlike(r"^\d{1,4}$|(?i)^(?:page|页)\s*\d+$|^--\s*\d+\s*of\s*\d+\s*--$|^doi[:\s]")
    return (F.length(s) <= 1) | known | _any(s.startswith(p) for p in NOISE_PREFIXES) | ((letters == 0) & (signs > 0)) | ((signs > 2 * letters) & (F.length(s) < 24))


def reference_title(line: Column) -> Column:
    s = F.lower(plain(line))
    return s.isin(STOP_TITLES) | s.rlike(REFERENCE_TITLE)


def other_title(line: Column) -> Column:
    """A title behind which no body comes: thanks, appendix, notes."""
    s = F.lower(plain(line))
    return s.isin(STOP_TITLES) | s.rlike(OTHER_TITLE)


def reference_entry(line: Column) -> Column:
    """An entry of a list of references, or its title."""
    s = plain(line)
    year = s.rlike(r"\b\d{4}[a-z]?\b")
    return (
        reference_title(s) | s.rlike(r"^\[\d{1,3}(?:[,-]\d{1,3})?\]") | (s.rlike(r"^\(?\d{1,3}\)?[.)]\s") & year) | s.rlike(r"(?i)\bdoi[:\s]|https?://")
        | (year & s.rlike(r"(?i)journal|vol\.?|no\.?|pp\.?|出版社|学报|期刊|会议|press|大学出版社")) | s.rlike(r"(?i)(?:et al\.?|等)\s*,?\s*\d{4}")
    )


def strip_citations(line: Column) -> Column:
    return plain(reduce(lambda x, p: F.regexp_replace(x, p, ""), CITATIONS, vts(line)))


def academic_line(line: Column) -> Column:
    """A line without footnote marks at its end, with words joined that a line end had parted, without editorial phrases."""
    s = plain(line)
    for pattern, new in ((r"\s*[†‡*]+\s*$", ""), (r"\s*\(\s*\d{1,2}\s*\)\s*$", ""), (r"\s*\[\s*\d{1,2}\s*\]\s*$", ""), (r"([A-Za-z])-\s+([A-Za-z])", "$1$2"), (r"(?i)\b(?:preprint|accepted manuscript|all rights reserved)\b", "")):
        s = F.regexp_replace(s, pattern, new)
    return plain(s)


def bare(text: Column) -> Column:
    """Letters, digits and CJK only, in lower case: what tells near-identical texts."""
    return F.regexp_replace(F.lower(vts(text)), f"[^a-z0-9{_CJK}]", "")


def _first_of_each(items: Column, least: int) -> Column:
    """The texts whose bare form is `least` long or longer, the first of each bare form, in order."""
    keyed = F.filter(F.transform(items, lambda x, i: F.struct(bare(x).alias("k"), i.alias("i"), x.alias("x"))), lambda s: F.length(s["k"]) >= least)
    firsts = once(F.array_sort(keyed), lambda o: F.filter(o, lambda s, i: (i == 0) | (s["k"] != F.get(o, i - 1)["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])


def _lines(text: Column) -> Column:
    return F.split(vts(text), r"\r?\n")


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, paragraph_seq and paragraph: lines that aren't noise, joined up to a sentence's end or over 260 characters; short ones (under 18) and repeats go."""
    lines = F.filter(F.transform(_lines(col(text)), lambda x: plain(x)), lambda x: (x != "") & ~noise(x))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        joined = F.when(a["open"] == "", x).when(a["open"].rlike(f"[{_CJK}]$") | x.rlike(f"^[{_CJK}]"), F.concat(a["open"], x)).otherwise(F.concat_ws(" ", a["open"], x))
        ends = joined.rlike(SENTENCE_END) | (F.length(joined) > 260)
        return F.struct(F.when(ends, F.lit("")).otherwise(joined).alias("open"), F.when(ends, F.concat(a["out"], F.array(joined))).otherwise(a["out"]).alias("out"))

    folded = F.aggregate(lines, start, step, lambda a: F.when(a["open"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["open"]))))
    rows = df.select(col(key), F.filter(folded, lambda x: F.length(x) >= 18).alias("__p"))
    return rows.select(col(key), F.posexplode(_first_of_each(F.col("__p"), 10)).alias("paragraph_seq", "paragraph"))


def clean_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunks and counts of a paper's lines: broken lines joined, nothing from a reference or closing title on, without references, noise and short lines, without citations and repeats.

    Where nothing is left, chunks are the joined lines without citations that have 10 characters or more.
    """
    heading = lambda x: reference_title(x) | other_title(x) | x.rlike(NUMBERED)
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        one = a["open"]
        joins = (one != "") & ~heading(one) & ~heading(x) & ~one.rlike(LINE_END) & (F.length(one) <= 140) & (F.length(x) <= 140)
        return F.struct(F.when(joins, plain(F.concat_ws(" ", one, x))).otherwise(x).alias("open"), F.when(joins | (one == ""), a["out"]).otherwise(F.concat(a["out"], F.array(one))).alias("out"))

    # each step is a column of its own, so that none is computed twice
    rows = df.select(col(key), F.filter(F.transform(_lines(col(text)), lambda x: academic_line(x)), lambda x: x != "").alias("lines"))
    rows = rows.withColumn("src", F.aggregate("lines", start, step, lambda a: F.when(a["open"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["open"])))))
    rows = rows.withColumn("body", F.filter(F.transform("src", lambda x: academic_line(x)), lambda x: x != ""))
    stop = F.array_position(F.transform("body", lambda x: reference_title(x) | other_title(x)), F.lit(True))
    rows = rows.withColumn("stop", stop.cast("int")).withColumn("body", F.when(F.col("stop") > 0, F.slice("body", F.lit(1), F.col("stop") - 1)).otherwise(F.col("body")))
    rows = rows.withColumn("kept", F.filter("body", lambda x: ~reference_entry(x)))
    rows = rows.withColumn("bare", F.filter(F.transform("kept", lambda x: F.struct(x.alias("was"), academic_line(strip_citations(x)).alias("x"))), lambda s: F.lit(True)))
    rows = rows.withColumn("quiet", F.filter("bare", lambda s: (s["x"] != "") & ~noise(s["x"])))
    rows = rows.withColumn("long", F.transform(F.filter("quiet", lambda s: F.length(s["x"]) >= 10), lambda s: s["x"]))
    rows = rows.withColumn("chunks", _first_of_each(F.col("long"), 12))
    spare = F.filter(F.transform("src", lambda x: academic_line(strip_citations(x))), lambda x: F.length(x) >= 10)
    rows = rows.withColumn("chunks", F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(spare))
    some = F.filter("bare", lambda s: s["x"] != "")
    return rows.select(
        col(key), "chunks", F.size("src").alias("raw_chunks"), F.size("chunks").alias("kept_chunks"), (F.size("body") - F.size("kept")).alias("removed_reference_lines"), (F.size(some) - F.size("quiet")).alias("removed_noise_lines"),
        (F.size("quiet") - F.size("long")).alias("removed_short_lines"), (F.col("stop") > 0).alias("stop_section_hit"), F.size(F.filter("bare", lambda s: s["was"] != s["x"])).alias("inline_citation_cleaned_lines"),
    )


def corruption_stats(df: DataFrame, text: str) -> DataFrame:
    """df with counts of kinds of characters, their ratios, and corrupted."""
    t, c = vts(col(text)), F.col
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    out = df.withColumns({
        "total": F.greatest(F.length(t), F.lit(1)).cast("long"), "cjk": count(f"[{_CJK}]"), "latin": count("[A-Za-z]"), "digits": count("[0-9]"), "ctrl": count(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"), "replacement": count("�"), "mojibake": count(f"[{MOJIBAKE}]"), "weird_han": count(f"[{WEIRD}]"),
        "symbol": count(rf"[^A-Za-z0-9{_CJK}\s]"),
    })
    out = out.withColumn("readable", c("cjk") + c("latin") + F.floor(c("digits") * 0.2).cast("long"))
    out = out.withColumns({"readable_ratio": c("readable") / c("total"), "ctrl_ratio": c("ctrl") / c("total"), "noise_ratio": (c("replacement") + c("mojibake") + c("weird_han") + F.floor(c("symbol") * 0.2)) / c("total")})
    bad = (F.trim(t) == "") | (c("ctrl_ratio") > 0.002) | ((c("noise_ratio") > 0.22) & (c("readable_ratio") < 0.3)) | ((c("readable_ratio") < 0.14) & (c("symbol") > c("readable") * 1.2))
    return out.withColumn("corrupted", bad)


def clean_rows(df: DataFrame, order_by: list[str], rename_map: dict | None = None, casts: dict | None = None, deduplicate_by: list[str] | None = None, keep: str = "first") -> DataFrame:
    """The desktop cleaner's rows: blank rows go, then near-identical texts (the first stays), then equal rows, then keys but for blank ones; casts read numbers without separators and currency signs, floats to two places, and what can't be read is null."""
    names = {k: v for k, v in (rename_map or {}).items() if k in df.columns}
    out = df.withColumnsRenamed(names)
    own = [c for c in out.columns if c not in order_by]
    order = [col(c) for c in order_by]
    out = out.filter(F.trim(F.concat_ws("", *(vts(col(c)) for c in own))) != "")
    if "text" in out.columns:
        key = F.when((F.length(F.trim(vts(col("text")))) >= 18) & (F.length(bare(col("text"))) > 16), F.md5(bare(col("text"))))
        out = out.withColumn("__k", key).withColumn("__rn", F.when(F.col("__k").isNull(), 1).otherwise(F.row_number().over(Window.partitionBy("__k", F.when(F.col("__k").isNull(), F.monotonically_increasing_id())).orderBy(*order)))).filter("__rn = 1").drop("__k", "__rn")
    out = out.withColumn("__rn", F.row_number().over(Window.partitionBy(*(vts(col(c)) for c in own)).orderBy(*order))).filter("__rn = 1").drop("__rn")
    if deduplicate_by:
        key = F.concat_ws("|", *(vts(col(c)) for c in deduplicate_by))
        spread = F.when(key == "", F.monotonically_increasing_id())  # rows without a key all stay
        pick = order if keep != "last" else [c.desc() for c in order]
        out = out.withColumn("__rn", F.row_number().over(Window.partitionBy(key, spread).orderBy(*pick))).filter("__rn = 1").drop("__rn")
    for c, kind in (casts or {}).items():
        if c not in out.columns:
            continue
        x = F.regexp_replace(vts(col(c)), r"[\s,，$¥￥]", "")
        n = F.when(x.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), x).try_cast("double")
        out = out.withColumn(c, {"int": F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long"), "float": round_half_away(n, 2)}.get(kind.lower(), vts(col(c))))
    return out
