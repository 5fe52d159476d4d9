"""Texts: cleaning, chunks, entities, evidence rows, conflicts and tables in plain text, as Columns and explodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlake.functions.fields import EMAIL, URL
from rowlake.functions.values import col, miss, vts

#: Marks of reference sections and notes, words of the sides, and words that no topic has.
REFERENCE_HEAD = r"(?i)^\s*(?:#+\s*)?(?:references|bibliography|works cited|参考文献)\s*[:：]?\s*$"
NOTE_HEAD = r"(?i)^\s*(?:footnote|注释|脚注)"
NUMBER = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?"
PRO, CON = ["support", "true", "yes", "approve", "agree"], ["oppose", "false", "no", "reject", "disagree"]
STOP = ["the", "a", "an", "is", "are", "of", "to", "and", "or", "in", "on", "for", "we", "should", "it", "this", "that", "these", "those", "they", "them"]
ALIASES = {
    "claim_text": ["claim_text", "claim", "text", "content", "body"], "speaker": ["speaker", "author", "name"], "source_title": ["source_title", "title"], "source_url": ["source_url", "url", "link"],
    "source_path": ["source_path", "path", "file"], "published_at": ["published_at", "date", "published"], "stance": ["stance", "polarity", "position"], "page": ["page", "page_no"], "sheet_name": ["sheet_name", "sheet"], "row_index": ["row_index", "row"], "chunk_index": ["chunk_index", "chunk_seq"],
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(vts(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def preprocess(df: DataFrame, text: str, title: str | None = None) -> DataFrame:
    """clean_text without notes and all from a reference heading on, under a # title; and its sha256."""
    lines = F.transform(F.split(vts(col(text)), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(REFERENCE_HEAD)), F.lit(True))
    body = F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(lines)
    note = lambda x: (x.rlike(r"^\[.*\]$") & (F.octet_length(x) < 24)) | x.rlike(NOTE_HEAD)
    kept = F.array_join(F.filter(body, lambda x: (x != "") & ~note(x)), "\n")
    kept = F.concat(F.lit("# "), vts(col(title)), F.lit("\n\n"), kept) if title else kept
    return df.withColumn("clean_text", kept).withColumn("text_sha256", F.sha2(F.col("clean_text").cast("binary"), 256))


def chunk(df: DataFrame, text: str, mode: str = "paragraph", max_chars: int = 500) -> DataFrame:
    """A row for each chunk with chunk_text and chunk_seq: none, paragraph, sentence or fixed."""
    t = vts(col(text))
    parts = {
        "none": lambda: F.array(t), "paragraph": lambda: F.split(t, r"\n\s*\n"), "sentence": lambda: F.split(t, r"(?<=[.!?。！？])\s*"),
        "fixed": lambda: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / max_chars).cast("int") - 1, F.lit(0))), lambda i: F.substring(t, i * max_chars + 1, F.lit(max_chars))),
    }[mode]()
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return df.select(*(col(c) for c in df.columns), F.posexplode(parts).alias("chunk_seq", "chunk_text"))


def extract_entities(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """key, kind (email, url, number), position and value, repeats included, in order of occurrence; of the numbers the first `most`, if given."""
    t = vts(col(text))
    all_of = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    found = lambda kind, values: F.transform(values, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("position"), x.alias("value")))
    every = F.concat(found("email", all_of(EMAIL)), found("url", all_of(URL)), found("number", all_of(NUMBER) if most is None else F.slice(all_of(NUMBER), 1, most)))
    return df.select(col(key), F.explode(every).alias("x")).select(col(key), "x.*")


def link_entities(df: DataFrame, name: str) -> DataFrame:
    """canonical (letters and digits, lower-case, single spaces) and entity_id of a name."""
    canonical = F.trim(F.regexp_replace(F.regexp_replace(F.lower(vts(col(name))), r"[^\p{L}\p{N}]", " "), r"\s+", " "))
    return df.withColumn("canonical", canonical).withColumn("entity_id", F.substring(F.sha2(F.col("canonical").cast("binary"), 256), 1, 12))


def reconstruct_table(df: DataFrame, key: str, text: str, separator: str = r"\s{2,}|\t") -> DataFrame:
    """key, row (0 is the header) and cells, padded to the widest line of the text."""
    lines = F.filter(F.split(vts(col(text)), r"\r?\n"), lambda x: F.trim(x) != "")
    cells = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), separator), lambda y: F.trim(y)))
    width = F.aggregate(cells, F.lit(0), lambda a, x: F.greatest(a, F.size(x)))
    padded = F.transform(cells, lambda x: F.concat(x, F.array_repeat(F.lit(""), width - F.size(x))))
    return df.select(col(key), F.posexplode(padded).alias("row", "cells"))


def standardize_evidence(df: DataFrame) -> DataFrame:
    """The canonical evidence columns, each from the first alias that isn't missing, with evidence_id."""
    def pick(name: str) -> Column:
        there = [a for a in ALIASES[name] if a in df.columns]
        return F.coalesce(*(F.when(~miss(col(a)), F.trim(col(a).cast("string"))) for a in there), F.lit("")) if there else F.lit("")

    out = df.select(*(pick(c).alias(c) for c in ALIASES))
    place = F.when(F.col("row_index") != "", F.col("row_index")).otherwise(F.col("chunk_index"))
    parts = F.concat_ws("|", "source_path", "page", "sheet_name", place, "claim_text")
    domain = F.lower(F.regexp_extract("source_url", r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1))
    return out.withColumns({"evidence_id": F.substring(F.sha1(parts.cast("binary")), 1, 16), "source_domain": domain, "language": language(F.col("claim_text"))})


def language(text: Column) -> Column:
    cjk, latin = text.rlike("[一-鿿]"), text.rlike("[A-Za-z]")
    return F.when(cjk & latin, "mixed").when(cjk, "zh").when(latin, "en").otherwise("unknown")


def polarity(text: Column, positive: list[str] = PRO, negative: list[str] = CON) -> Column:
    """pro or con if words of one side occur anywhere and none of the other, else unknown."""
    low = F.lower(vts(text))
    has = lambda words: reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in words), F.lit(False))
    pro, con = has(positive), has(negative)
    return F.when(pro & ~con, "pro").when(con & ~pro, "con").otherwise("unknown")


def topic(df: DataFrame, text: str, explicit: str | None = None, words: int = 8, ignore: list[str] = ()) -> Column:
    """The explicit topic, or the first words that aren't stop words or words of a side, or src: and the source; empty if there is none."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(vts(col(text))), r"[^a-z0-9一-鿿\s]+", " ")), r"\s+")
    own = F.array_join(F.slice(F.filter(parts, lambda x: (x != "") & ~x.isin([*STOP, *ignore])), 1, words), " ")
    sources = [F.when(~miss(col(c)), F.concat(F.lit("src:"), F.lower(F.trim(col(c).cast("string"))))) for c in ("source_path", "source_file") if c in df.columns]
    own = F.coalesce(F.nullif(own, F.lit("")), *sources, F.lit(""))
    return F.coalesce(F.when(~miss(col(explicit)), F.lower(F.trim(col(explicit).cast("string")))), own) if explicit and explicit in df.columns else own


def detect_conflicts(df: DataFrame, text: str, topic_field: str | None = None, stance_field: str = "stance", positive: list[str] = PRO, negative: list[str] = CON) -> DataFrame:
    """df with topic, polarity and conflict: whether the topic has claims of both sides; polarity of the stance, or of the text. Topics are counted, not gathered."""
    said = F.coalesce(F.when(~miss(col(stance_field)), col(stance_field).cast("string")), vts(col(text))) if stance_field in df.columns else col(text)
    marked = df.withColumn("topic", topic(df, text, topic_field, ignore=[*positive, *negative])).withColumn("polarity", polarity(said, positive, negative))
    sides = marked.filter("topic <> '' and polarity <> 'unknown'").groupBy("topic").agg((F.count_distinct("polarity") > 1).alias("conflict")).filter("conflict")
    return marked.join(sides, "topic", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def speaker_turns(df: DataFrame, text: str) -> DataFrame:
    """A row for each `Name: words` line with speaker and said; lines without a speaker go on with the last one."""
    lines = F.filter(F.split(vts(col(text)), r"\r?\n"), lambda x: F.trim(x) != "")
    pattern = r"^\s*([\p{L}][\p{L}\p{N} ._-]{0,40}?)\s*[:：]\s*(.*)$"
    start = F.struct(F.lit("").alias("speaker"), F.array().cast("array<struct<speaker:string,said:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        has = x.rlike(pattern)
        who = F.when(has, F.regexp_extract(x, pattern, 1)).otherwise(a["speaker"])
        said = F.when(has, F.regexp_extract(x, pattern, 2)).otherwise(F.trim(x))
        return F.struct(who.alias("speaker"), F.concat(a["out"], F.array(F.struct(who.alias("speaker"), said.alias("said")))).alias("out"))

    return df.select(*(col(c) for c in df.columns if c != text), F.posexplode(F.aggregate(lines, start, step)["out"]).alias("turn_seq", "x")).select("*", "x.*").drop("x")


def propagate(df: DataFrame, partition_by: list[str], order_by: list[str], fields: list[str], backward: bool = False) -> DataFrame:
    """Missing cells take the last value before them (or the first after them) in their partition."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(col(c) for c in partition_by)).orderBy(*(col(c) for c in order_by))
    w = w.rowsBetween(0, Window.unboundedFollowing) if backward else w.rowsBetween(Window.unboundedPreceding, 0)
    value = lambda c: F.when(~miss(col(c)), col(c))
    return df.withColumns({c: (F.first(value(c), ignorenulls=True) if backward else F.last(value(c), ignorenulls=True)).over(w) for c in fields})


def noise_line(line: Column) -> Column:
    """Page numbers, DOI lines and short lines of symbols."""
    t = F.trim(line)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return t.rlike(r"^(?:-?\s*\d{1,4}\s*-?|(?i:page)\s+\d+(?:\s+of\s+\d+)?|第\s*\d+\s*页)$") | t.rlike(r"(?i)^(?:doi\s*:|https?://(?:dx\.)?doi\.org/)") | ((F.length(t) < 40) & (letters * 2 < F.length(t)))


def clean_lines(df: DataFrame, text: str, least: int = 18) -> DataFrame:
    """clean_text of the distinct lines that are neither noise, blank nor reference entries, and n_lines of them."""
    lines = F.split(vts(col(text)), r"\r?\n")
    entry = lambda x: x.rlike(r"^\s*(?:\[\d+\]|\d+\.)\s") & x.rlike(r"(?:19|20)\d{2}") & x.rlike(r"(?i)doi|https?://|journal|vol\.|pp\.|press|proceedings")
    kept = F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (F.length(x) >= least) & ~noise_line(x) & ~entry(x)))
    return df.withColumn("clean_text", F.array_join(kept, "\n")).withColumn("n_lines", F.size(kept))


def corruption(text: Column) -> Column:
    """The share of replacement characters, controls and mojibake pairs."""
    bad = F.regexp_count(text, F.lit(r"�|[\x00-\x08\x0b\x0c\x0e-\x1f]|[ÃÂ][\x80-\xbf]|â€"))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(0.0)


def drop_near_identical(df: DataFrame, text: str, order_by: list[str], least: int = 18) -> DataFrame:
    """Of texts equal but for letters' case and all but [a-z0-9] and CJK, the first stays; short texts all stay."""
    from pyspark.sql import Window

    bare = F.regexp_replace(F.lower(vts(col(text))), "[^a-z0-9一-鿿]", "")
    key = F.when((F.length(vts(col(text))) >= least) & (F.length(bare) > 16), F.md5(bare.cast("binary")))
    marked = df.withColumn("__key", F.coalesce(key, F.concat(F.lit("row"), F.xxhash64(*(col(c) for c in df.columns)).cast("string"))))
    w = Window.partitionBy("__key").orderBy(*(col(c) for c in order_by))
    return marked.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__key")


def preprocess_report(df: DataFrame) -> DataFrame:
    """One row of coverage ratios over canonical evidence rows, with the share of repeated claims."""
    rows = F.greatest(F.count("*"), F.lit(1))
    covered = [(F.sum(F.when(~miss(col(c)), 1).otherwise(0)) / rows).alias(f"{c}_coverage") for c in ("speaker", "stance", "source_url", "published_at", "language") if c in df.columns]
    claim = F.regexp_replace(F.lower(vts(col("claim_text"))), r"[^\p{L}\p{N}]+", " ")
    repeated = (1 - F.count_distinct(claim) / rows).alias("duplicate_claim_ratio")
    return df.agg(F.count("*").alias("rows"), *covered, repeated, F.avg(F.length(vts(col("claim_text")))).alias("mean_claim_chars"))
