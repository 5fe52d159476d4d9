"""Evidence text: paragraphs and claims put together from lines, sources and citations filled in, and the stages in order.

What looks at the rows of one document in order is a fold over an array or an ordered window of that document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlake.functions.fields import EMAIL, URL, text_transform
from rowlake.functions.values import NUMERIC, col, miss, money, vts
from rowlake.operators import claims, filters, text as texts, transform
from rowlake.operators.text import noise_line, propagate, standardize_evidence
from rowlake.plans.registry import FIELD_TRANSFORMS, STAGES

#: How a claim line begins, ends and names its parts.
SENTENCE_END = r"[.!?。！？；;:：\"”'’)）]\s*$"
SECTION = r"^(?:#{1,6}\s+|第[一二三四五六七八九十0-9]+[章节部分]|[IVX]+\.\s|[0-9]+(?:\.[0-9]+)*\.?\s+(?=\S{1,40}$))"
CARD = r"(?i)^\s*(?:\[?\d+\]?[.)]?\s+)?(?:source|来源|出处)\s*[:：]\s*(.+)$"
CITATION = r"\[(\d{1,3})\]"
CJK_END, CJK_BEGIN = r"[一-鿿]$", r"^[一-鿿]"
ARGUMENT = [("rebuttal", r"(?i)rebut|refute|反驳|驳论"), ("evidence", r"(?i)evidence|data shows|according to|根据|数据"), ("conclusion", r"(?i)therefore|in conclusion|综上|因此"), ("claim", r"(?i)we (?:believe|argue)|我方认为|主张")]


def rebuild_paragraphs(df: DataFrame, key: str, text: str, most: int = 260, least: int = 18, limit: int | None = None) -> DataFrame:
    """key, paragraph_seq and paragraph: wrapped lines joined (no space beside CJK) up to a sentence's end or `most` characters; noise and short ones go, repeats too."""
    lines = F.transform(F.split(vts(col(text)), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        joined = F.when(a["open"] == "", x).when(a["open"].rlike(CJK_END) | x.rlike(CJK_BEGIN), F.concat(a["open"], x)).otherwise(F.concat_ws(" ", a["open"], x))
        ends = (x == "") | joined.rlike(SENTENCE_END) | (F.length(joined) > most)
        done = F.when(x == "", a["open"]).otherwise(joined)
        return F.struct(F.when(ends, F.lit("")).otherwise(joined).alias("open"), F.when(ends & (done != ""), F.concat(a["out"], F.array(done))).otherwise(a["out"]).alias("out"))

    folded = F.aggregate(F.filter(lines, lambda x: (x == "") | ~noise_line(x)), start, step, lambda a: F.when(a["open"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["open"]))))
    kept = F.array_distinct(F.filter(folded, lambda x: F.length(x) >= least))
    kept = kept if limit is None else F.slice(kept, 1, limit)
    return df.select(col(key), F.posexplode(kept).alias("paragraph_seq", "paragraph"))


def text_signals(df: DataFrame, text: str) -> DataFrame:
    """speaker, argument_role, source_url, citation, quote, section, source_card, stance and ocr_noise of each line."""
    t = vts(col(text))
    none = lambda c: F.nullif(c, F.lit(""))
    role = F.coalesce(*(F.when(t.rlike(p), F.lit(name)) for name, p in ARGUMENT))
    return df.withColumns({
        "speaker": none(F.regexp_extract(t, r"^\s*([\p{L}][\p{L}\p{N} ._-]{0,40}?)\s*[:：]", 1)), "argument_role": role, "source_url": none(F.regexp_extract(t, URL, 0)), "citation": none(F.regexp_extract(t, CITATION, 1)),
        "quote": none(F.regexp_extract(t, "[“\"「]([^”\"」]{4,})[”\"」]", 1)), "section": F.when(t.rlike(SECTION), F.trim(F.regexp_replace(t, r"^#+\s*", ""))), "source_card": none(F.trim(F.regexp_extract(t, CARD, 1))), "stance": texts.polarity(col(text)), "ocr_noise": texts.corruption(t) > 0.02,
    })


def _ordered(partition_by: list[str], order_by: list[str]):
    return Window.partitionBy(*(col(c) for c in partition_by)).orderBy(*(col(c) for c in order_by))


def merge_wrapped(df: DataFrame, partition_by: list[str], order_by: list[str], text: str) -> DataFrame:
    """Rows that go on with the claim before them (it has no sentence end, and they begin in lower case or CJK) become one row, the first."""
    w = _ordered(partition_by, order_by)
    before = F.lag(vts(col(text))).over(w)
    goes_on = F.coalesce((before != "") & ~before.rlike(SENTENCE_END) & vts(col(text)).rlike(r"^(?:[a-z]|[一-鿿])") & ~before.rlike(SECTION), F.lit(False))
    marked = df.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__claim", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [col(c) for c in partition_by]
    parts = F.array_sort(F.collect_list(F.struct(*(col(c).alias(f"o{i}") for i, c in enumerate(order_by)), vts(col(text)).alias("t"))))
    joined = F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x["t"]).when(a.rlike(CJK_END) | x["t"].rlike(CJK_BEGIN), F.concat(a, x["t"])).otherwise(F.concat_ws(" ", a, x["t"])))
    merged = marked.groupBy(*keys, "__claim").agg(joined.alias("__text"))
    first = marked.filter("__new = 1").join(merged, [*partition_by, "__claim"])
    return first.withColumn(text, F.col("__text")).drop("__new", "__claim", "__text").select(*(col(c) for c in df.columns))


def drop_structural_repeats(df: DataFrame, partition_by: list[str], order_by: list[str], text: str) -> DataFrame:
    """Section headings and source cards that repeat an earlier one of their document go."""
    t = vts(col(text))
    structural = t.rlike(SECTION) | t.rlike(CARD)
    w = Window.partitionBy(*(col(c) for c in partition_by), F.when(structural, F.lower(F.trim(t)))).orderBy(*(col(c) for c in order_by))
    return df.withColumn("__rn", F.when(structural, F.row_number().over(w)).otherwise(1)).filter("__rn = 1").drop("__rn")


def fill_sources(df: DataFrame, partition_by: list[str], order_by: list[str], fields: list[str] = ("source_url", "source_title")) -> DataFrame:
    """Claims without a source take that of the source block after them, else of the one before."""
    there = [c for c in fields if c in df.columns]
    return propagate(propagate(df, partition_by, order_by, there, backward=True), partition_by, order_by, there)


def resolve_citations(df: DataFrame, partition_by: list[str], text: str, url: str = "source_url") -> DataFrame:
    """Rows that cite [n] and have no url take that of their document's reference entry [n]."""
    t = vts(col(text))
    entries = df.filter(t.rlike(r"^\s*\[\d{1,3}\].*https?://")).select(*(col(c) for c in partition_by), F.regexp_extract(t, CITATION, 1).alias("__n"), F.regexp_extract(t, URL, 0).alias("__url"))
    entries = entries.groupBy(*partition_by, "__n").agg(F.min("__url").alias("__url"))
    cited = df.withColumn("__n", F.when(t.rlike(CITATION), F.regexp_extract(t, CITATION, 1)).otherwise(F.lit("")))
    return cited.join(entries, [*partition_by, "__n"], "left").withColumn(url, F.when(miss(col(url)), F.col("__url")).otherwise(col(url))).drop("__n", "__url").select(*(col(c) for c in df.columns))


def propagate_sources(df: DataFrame, partition_by: list[str], order_by: list[str], text: str, fields: list[str] = ("source_url", "source_title", "source_domain", "citation_text")) -> DataFrame:
    """Claims before a block of source rows, up to a heading, take what they lack from it, the block's first value of each field; so do the block's own rows."""
    t = vts(col(text))
    role = F.lower(vts(col("argument_role"))) if "argument_role" in df.columns else F.lit("")
    stop = t.rlike(SECTION) | role.isin("metadata", "section")
    source = ~stop & (role.isin("citation", "evidence") | t.rlike(CARD) | t.rlike(r"^\s*(?:https?://\S+|\[\d{1,3}\].*https?://\S+)\s*$"))
    w = _ordered(partition_by, order_by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    one = lambda x: F.when(x, 1).otherwise(0)
    rows = df.withColumns({"__src": source, "__stop": stop}).withColumn("__seg", F.sum(one(F.col("__stop"))).over(upto))
    part = [*(col(c) for c in partition_by), F.col("__seg")]
    inner = Window.partitionBy(*part).orderBy(*(col(c) for c in order_by))
    begins = F.col("__src") & ~F.coalesce(F.lag("__src").over(inner), F.lit(False))
    rows = rows.withColumn("__begins", one(begins)).withColumn("__blocks", F.sum("__begins").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__block", F.when(F.col("__src"), F.col("__blocks")).otherwise(F.col("__blocks") + 1))
    block = Window.partitionBy(*part, "__block").orderBy(*(col(c) for c in order_by)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    there = [c for c in fields if c in df.columns]
    shown = {c: F.first(F.when(F.col("__src") & ~miss(col(c)), col(c)), ignorenulls=True).over(block) for c in there}
    taken = {c: F.when(F.col("__stop") | ~miss(col(c)), col(c)).otherwise(F.coalesce(x, col(c))) for c, x in shown.items()}
    return rows.withColumns(taken).select(*(col(c) for c in df.columns))


#: Radicals that stand for the character of the same shape.
RADICALS = {"⼀": "一", "⼆": "二", "⼈": "人", "⼊": "入", "⼋": "八", "⼒": "力", "⼗": "十", "⼜": "又", "⼝": "口", "⼟": "土", "⼤": "大", "⼥": "女", "⼦": "子", "⼩": "小", "⼭": "山", "⼯": "工", "⼰": "己", "⼲": "干", "⼴": "广", "⼼": "心", "⼿": "手", "⽀": "支", "⽂": "文", "⽅": "方", "⽇": "日", "⽉": "月", "⽊": "木", "⽌": "止", "⽐": "比", "⽔": "水", "⽕": "火", "⽗": "父", "⽚": "片", "⽜": "牛", "⽣": "生", "⽤": "用", "⽥": "田", "⽩": "白", "⽬": "目", "⽯": "石", "⽰": "示", "⽴": "立", "⾃": "自", "⾏": "行", "⾐": "衣", "⾔": "言", "⾜": "足", "⾝": "身", "⾞": "车", "⾥": "里", "⾦": "金", "⾨": "门", "⾯": "面", "⾳": "音", "⾷": "食", "⾸": "首", "⾼": "高"}


def repair_encoding(df: DataFrame) -> DataFrame:
    """Every text with radicals as characters and blanks for control characters; tabs and line ends stay."""
    fixed = lambda c: F.regexp_replace(F.translate(col(c), "".join(RADICALS), "".join(RADICALS.values())), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return df.withColumns({c: fixed(c) for c in df.columns if df.schema[c].dataType.typeName() == "string"})


def _builtin_transforms() -> None:
    """The transforms of single fields by name: f(column, spec) -> Column, null where the cell is."""
    builtin = {
        "trim": lambda c, s: F.trim(c), "lower": lambda c, s: F.lower(c), "upper": lambda c, s: F.upper(c), "collapse_whitespace": lambda c, s: F.trim(F.regexp_replace(c, r"\s+", " ")), "remove_urls": lambda c, s: F.trim(F.regexp_replace(c, URL, "")), "remove_emails": lambda c, s: F.trim(F.regexp_replace(c, EMAIL, "")),
        "regex_replace": lambda c, s: F.regexp_replace(c, s["pattern"], str(s.get("replace", ""))), "extract_regex": lambda c, s: F.when(c.rlike(s["pattern"]), F.regexp_extract(c, s["pattern"], int(s.get("group", 0)))).otherwise(c), "parse_number": lambda c, s: F.coalesce(money(c).cast("string"), c),
        "round_number": lambda c, s: F.coalesce(text_transform("round_number", c, digits=s.get("digits", 2)).cast("string"), c), "parse_date": lambda c, s: text_transform("parse_date", c, **({"formats": s["formats"]} if s.get("formats") else {})),
    }
    for name in ("clean_citation", "strip_ocr_noise", "collapse_duplicate_lines", "extract_speaker_prefix", "normalize_stance", "detect_quote_only"):
        builtin[name] = lambda c, s, name=name: text_transform(name, c).cast("string")
    for name, f in builtin.items():
        FIELD_TRANSFORMS.register(name, f, "replace", "preprocess")


_builtin_transforms()


def _headers_stage(df: DataFrame, spec: dict) -> DataFrame:
    names = spec.get("header_map", spec.get("rename_map", {}))
    rules = {"rename_map": names, "null_values": spec.get("null_values", ["null", "none", "na", "n/a"]), "trim_strings": spec.get("trim_strings", True)}
    out = transform.prepare(df, transform.Rules.of(rules), keep_rejected=False)
    for c, value in spec.get("default_values", {}).items():  # null cells only
        given = F.lit(value)
        out = out.withColumn(c, F.coalesce(col(c), given.cast(out.schema[c].dataType)) if c in out.columns else given)
    return out


def _cells_stage(df: DataFrame, spec: dict) -> DataFrame:
    digits, formats = int(spec.get("amount_round_digits", 2)), spec.get("date_input_formats", ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss"])
    for c in spec.get("amount_fields", ["amount"]):
        if c in df.columns:
            text = col(c).cast("string")
            df = df.withColumn(c, F.round(col(c), digits)) if isinstance(df.schema[c].dataType, NUMERIC) else df.withColumn(c, F.coalesce(F.round(money(text), digits).cast("string"), text))
    for c in spec.get("date_fields", []):
        if c in df.columns:
            df = df.withColumn(c, text_transform("parse_date", col(c), formats=formats))
    return df


def _transforms_stage(df: DataFrame, spec: dict) -> DataFrame:
    for one in spec.get("field_transforms", []):
        source = one.get("source_field", one["field"])
        if source in df.columns:
            df = df.withColumn(one["field"], FIELD_TRANSFORMS.get(one["op"])(col(source).cast("string"), one))
    rules = {k: spec[k] for k in ("casts", "date_ops", "field_ops", "include_fields", "exclude_fields") if k in spec}
    return transform.transform(df, {**rules, "trim_strings": False}, spec["__order"]).df if rules else df


def _filters_stage(df: DataFrame, spec: dict) -> DataFrame:
    df = filters.apply_filters(df, spec.get("row_filters", []), typed=spec.get("typed_filters", False))
    if not spec.get("drop_empty_rows", True):
        return df
    return filters.apply_filters(df, [{"op": "blank_row"}]) if not spec.get("typed_filters") else df.filter(F.trim(F.concat_ws("", *(vts(col(c)) for c in df.columns))) != "")


def _text_field(df: DataFrame, spec: dict) -> str:
    return spec.get("chunk_field") or spec.get("text_field") or ("claim_text" if "claim_text" in df.columns and spec.get("standardize_evidence") else "text")


def _chunks_stage(df: DataFrame, spec: dict) -> DataFrame:
    body = _text_field(df, spec)
    if spec.get("split_turns"):
        return texts.speaker_turns(df, body).withColumnRenamed("said", body).withColumnRenamed("turn_seq", "chunk_index")
    if spec.get("chunk_mode", "none") == "none":
        return df
    return texts.chunk(df, body, spec["chunk_mode"], int(spec.get("chunk_max_chars", spec.get("max_chars", 500)))).drop(body).withColumnRenamed("chunk_text", body)


def _evidence_stage(df: DataFrame, spec: dict) -> DataFrame:
    if spec.get("canonical"):
        return claims.canonical_evidence(df)
    if not spec.get("standardize_evidence"):
        return df
    body = _text_field(df, spec)
    return standardize_evidence(df.withColumnRenamed(body, "claim_text") if "claim_text" not in df.columns else df)


def _place(df: DataFrame, spec: dict) -> tuple[list[str], list[str]]:
    """The columns of a document and of the order of its rows."""
    part = [c for c in spec.get("document_fields", ["source_path", "page", "sheet_name"]) if c in df.columns]
    return part, [c for c in (*spec["__order"], "row_index", "chunk_index", "chunk_seq", "evidence_id") if c in df.columns]


def _enrichment_stage(df: DataFrame, spec: dict) -> DataFrame:
    if not spec.get("enrich"):
        return df
    (part, order), body = _place(df, spec), "claim_text" if "claim_text" in df.columns else _text_field(df, spec)
    df = merge_wrapped(drop_structural_repeats(df, part, order, body), part, order, body)
    there = [c for c in ("debate_topic", "stance", "speaker_role") if c in df.columns]
    df = propagate(df, part, order, there) if there else df
    return resolve_citations(df, part, body) if "source_url" in df.columns else df


def _sources_stage(df: DataFrame, spec: dict) -> DataFrame:
    if not spec.get("propagate_sources", spec.get("enrich")):
        return df
    part, order = _place(df, spec)
    return propagate_sources(df, part, order, "claim_text" if "claim_text" in df.columns else _text_field(df, spec))


def _repeats_stage(df: DataFrame, spec: dict) -> DataFrame:
    if not spec.get("deduplicate_by"):
        return df
    order = [c for c in (*spec["__order"], "source_path", "row_index", "chunk_index", "chunk_seq", "evidence_id") if c in df.columns]
    return transform.deduplicate(df, spec["deduplicate_by"], order, spec.get("deduplicate_keep", "first"))


def _conflicts_stage(df: DataFrame, spec: dict) -> DataFrame:
    if not spec.get("detect_conflicts"):
        return df
    body = "claim_text" if "claim_text" in df.columns else _text_field(df, spec)
    if spec.get("canonical") or spec.get("whole_words"):
        return claims.mark_conflicts(df, spec.get("topic_field", "debate_topic"), spec.get("stance_field", "stance"), body)
    return texts.detect_conflicts(df, body, spec.get("topic_field"))


#: The stages of text pre-processing in their order; each is f(df, spec) -> df and does nothing unless the spec asks for it.
PIPELINE = ["encoding", "headers", "cells", "transforms", "filters", "chunks", "evidence", "enrichment", "sources", "repeats", "conflicts"]
for _name, _stage in zip(PIPELINE, (lambda df, spec: repair_encoding(df) if spec.get("repair_encoding", True) else df, _headers_stage, _cells_stage, _transforms_stage, _filters_stage, _chunks_stage, _evidence_stage, _enrichment_stage, _sources_stage, _repeats_stage, _conflicts_stage)):
    STAGES.register(_name, _stage, "replace", "preprocess")


def preprocess_rows(df: DataFrame, spec: dict, order_by: list[str]) -> DataFrame:
    """The stages of text pre-processing in order: encoding, headers and defaults, amounts and dates, field transforms and projection, filters and blank rows, turns or chunks, evidence, enrichment, sources, deduplication (first stays), conflicts.

    spec["stages"] gives other names of registered stages, or another order.
    """
    for name in spec.get("stages", PIPELINE):
        df = STAGES.get(name)(df, {**spec, "__order": order_by})
    return df


def run_stages(df: DataFrame, stages: list[tuple[str, dict]], order_by: list[str]) -> DataFrame:
    """Stages one after the other, each with its own spec (extract, clean, structure, audit); nothing is written between them."""
    for name, spec in stages:
        df = STAGES.get(name)(df, {**spec, "__order": order_by}) if name in STAGES else preprocess_rows(df, spec, order_by)
    return df


def cluster_lines(df: DataFrame, key: str, x: str = "x", y: str = "y", height: str = "h", word: str = "text") -> DataFrame:
    """key, line and cells: boxes whose y is within max(12, 0.7 height) of the box before belong to one line, ordered by x."""
    w = Window.partitionBy(col(key)).orderBy(col(y), col(x))
    new = F.when(F.lag(col(y)).over(w).isNull() | (col(y) - F.lag(col(y)).over(w) > F.greatest(F.lit(12.0), col(height) * 0.7)), 1).otherwise(0)
    lines = df.withColumn("__new", new).withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.transform(F.array_sort(F.collect_list(F.struct(col(x).alias("x"), col(word).alias("t")))), lambda c: c["t"])
    return lines.groupBy(col(key), "line").agg(cells.alias("cells"))


def header_row(cells: list[list[str]], known: set[str], starts: int = 3, depth: int = 2) -> tuple[int, int, float]:
    """(start, rows, score) of the header of a grid: unique, recognised and non-data cells count for it, blanks and numbers against it."""
    best = (0, 1, float("-inf"))
    for start in range(min(starts, len(cells))):
        for rows in range(1, depth + 1):
            if start + rows > len(cells):
                continue
            names = [" ".join(x for x in (str(c or "").strip() for c in column) if x) for column in zip(*cells[start : start + rows])]
            n = max(1, len(names))
            filled = [x for x in names if x]
            data = sum(x.replace(",", "").replace(".", "").lstrip("-").isdigit() for x in filled) / n
            hits = sum(x.lower() in known for x in filled) / n
            score = 0.4 * len(set(filled)) / n + 1.6 * hits - 0.4 * (n - len(filled)) / n - 0.9 * data - (1.5 if start and data > 0.5 else 0)
            if score > best[2]:
                best = (start, rows, score)
    return best
