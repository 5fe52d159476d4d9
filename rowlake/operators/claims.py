"""Claims of debates as Columns: topics and polarity by whole words, conflicts, the canonical evidence row, and its report.

Two rule sets exist side by side: text.detect_conflicts counts words anywhere in a text; here ASCII words count only
where they stand alone, some roles are left out, and there is a neutral side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlake.functions.fields import URL, has_word, text_transform
from rowlake.functions.values import col, miss, vts
from rowlake.operators.text import language

#: Words of the sides, words that no topic has, and roles that take no side.
POSITIVE = ["support", "true", "yes", "approve", "agree", "支持", "赞成", "正方"]
NEGATIVE = ["oppose", "false", "no", "reject", "disagree", "反对", "不支持", "反方"]
NEUTRAL = ["neutral", "中立", "mixed", "未表态"]
STOP = (
    "the a an is are of to and or in on for we should it this that these those they them because since due given but however though while he she his her their our your its "
    "speaker source claim citation quote support oppose agree disagree supports opposes"
).split()
QUIET_SPEAKERS = ["moderator", "judge"]
QUIET_ROLES = ["quote", "evidence", "citation", "moderation", "question", "metadata", "section"]
NOISE = ["锛", "鈥", "銆", "�"]
#: The columns that stand for a field of the canonical row, and its other columns.
NAMES = {
    "claim_text": ["claim_text", "text", "content", "body"], "speaker": ["speaker", "author", "name"], "speaker_role": ["speaker_role", "speaker_type"], "argument_role": ["argument_role", "claim_type"], "source_title": ["source_title", "title"], "source_url": ["source_url", "url", "link"],
    "published_at": ["published_at", "publish_date", "published_date", "date"], "stance": ["stance", "polarity", "position"], "confidence": ["confidence"], "citation_text": ["citation_text", "citation", "ref_text"], "quote_text": ["quote_text", "quote", "quoted_text"], "debate_topic": ["debate_topic", "topic"], "language": ["language", "lang"],
}
PLACES = ["source_file", "source_path", "source_type", "page", "sheet_name", "row_index", "chunk_index"]
ROLES = [("question", r"[?？]\s*$"), ("rebuttal", r"(?i)\b(?:rebut|refute)|反驳|驳论"), ("evidence", r"(?i)\b(?:evidence|data shows|according to)\b|根据|数据"), ("conclusion", r"(?i)\b(?:therefore|in conclusion)\b|综上|因此")]


def topic_key(text: Column, ignore: list[str] = (), words: int = 8) -> Column:
    """The first words of the motion, or of the text, up to a reason or a turn, without links, citations and stop words."""
    low = F.lower(vts(text))
    low = F.regexp_replace(F.regexp_replace(low, r"https?://\S+|www\.\S+", " "), r"\[[^\]]{1,40}\]", " ")
    motion = r"\b(?:motion|question|issue|topic)\b.*?\b(?:whether|if)\b\s+(.+)$"
    low = F.when(low.rlike(motion), F.regexp_extract(low, motion, 1)).otherwise(low)
    low = F.split(low, r"\b(?:because|since|as|due to|given that|but|however|though|while)\b|因为|由于|但是|但|然而", 2)[0]
    parts = F.split(F.trim(F.regexp_replace(low, r"[^a-z0-9一-鿿\s]+", " ")), r"\s+")
    return F.array_join(F.slice(F.filter(parts, lambda x: (x != "") & ~x.isin([*STOP, *(w.lower() for w in ignore)])), 1, words), " ")


def side(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """pro, con, neutral or unknown."""
    low = F.lower(F.trim(vts(text)))
    pro, con = has_word(low, positive), has_word(low, negative)
    return F.when(low.isin("pro", "con", "neutral", "unknown"), low).when(pro & ~con, "pro").when(con & ~pro, "con").when(has_word(low, NEUTRAL), "neutral").otherwise("unknown")


def _of(df: DataFrame, *names: str) -> Column:
    """The first of the columns that isn't missing, as trimmed text; empty if none is."""
    there = [F.when(~miss(col(c)), F.trim(col(c).cast("string"))) for c in names if c in df.columns]
    return F.coalesce(*there, F.lit(""))


def mark_conflicts(df: DataFrame, topic: str = "debate_topic", stance: str = "stance", text: str = "claim_text", positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> DataFrame:
    """df with conflict_topic, conflict_polarity and conflict_flag: claims of a topic that has both sides. Topics are counted, not gathered."""
    ignore = [*positive, *negative]
    said, told = _of(df, text, "claim_text", "text"), F.lower(_of(df, topic, "debate_topic"))
    place = _of(df, "source_path", "source_file")
    named = F.nullif(topic_key(said, ignore), F.lit(""))
    key = F.when(told != "", F.coalesce(F.nullif(topic_key(told, ignore), F.lit("")), told)).otherwise(F.coalesce(named, F.when(place != "", F.concat(F.lit("src:"), F.lower(place))), F.lit("")))
    quiet = F.lower(_of(df, "speaker_role")).isin(QUIET_SPEAKERS) | F.lower(_of(df, "argument_role")).isin(QUIET_ROLES) | (said == "")
    given = _of(df, stance, "stance")
    marked = df.withColumns({"conflict_topic": key, "conflict_polarity": side(F.when(given != "", given).otherwise(said), positive, negative), "__quiet": quiet})
    taking = (F.col("conflict_topic") != "") & ~F.col("__quiet") & F.col("conflict_polarity").isin("pro", "con")
    sides = marked.filter(taking).groupBy("conflict_topic").agg((F.count_distinct("conflict_polarity") > 1).alias("__both")).filter("__both").withColumnRenamed("conflict_topic", "__topic")
    out = marked.join(sides, F.col("conflict_topic") == F.col("__topic"), "left")
    return out.withColumn("conflict_flag", F.coalesce(F.col("__both"), F.lit(False)) & taking).drop("__both", "__topic", "__quiet")


def claim_key(text: Column) -> Column:
    """A claim without links, citations and signs, for telling repeats."""
    low = F.regexp_replace(F.regexp_replace(F.lower(vts(text)), r"https?://\S+|www\.\S+", " "), r"\[[^\]]{1,40}\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^0-9a-z一-鿿\s]+", " "), r"\s+", " "))


def noisy(text: Column) -> Column:
    """Marks of a wrong encoding, or over 35 % signs."""
    t = F.trim(vts(text))
    marks = reduce(lambda a, b: a | b, (t.contains(x) for x in NOISE))
    return F.when(t == "", False).otherwise(marks | (F.regexp_count(t, F.lit(r"[^0-9A-Za-z一-鿿\s]")) / F.length(t) > 0.35))


def canonical_evidence(df: DataFrame) -> DataFrame:
    """The 22 columns of a canonical evidence row: each from the first column that stands for it, else from what the claim's text shows.

    evidence_id goes by claim, speaker and source where there are a claim and one of these, else by place and claim.
    """
    pick = {name: _of(df, *others) for name, others in NAMES.items()}
    places = {c: (col(c) if c in df.columns else F.lit(None).cast("string")) for c in PLACES}
    rows = df.select(*(c.alias(f"p_{n}") for n, c in pick.items()), *(c.alias(n) for n, c in places.items()))
    raw, c = F.col("p_claim_text"), F.col
    speaker = r"^\s*([\p{L}][\p{L}\p{N} ._-]{0,40}?)\s*[:：]\s*(.+)$"
    label, body = F.regexp_extract(raw, speaker, 1), F.regexp_extract(raw, speaker, 2)
    labelled = (label != "") & ~F.lower(label).isin("source", "citation", "reference", "references", "http", "https", "note")
    said = F.when(labelled, body).otherwise(raw)
    citation = F.array_join(F.regexp_extract_all(raw, F.lit(r"\[\d{1,3}\]"), F.lit(0)), " | ")
    quote = F.regexp_extract(raw, "[“\"「]([^”\"」]{4,})[”\"」]", 1)
    card = F.trim(F.regexp_extract(raw, r"(?i)^\s*(?:source|来源|出处)\s*[:：]\s*(.+?)(?:https?://\S*)?$", 1))
    # the steps are columns of their own, so that none is written out twice
    rows = rows.withColumns({"__said": said, "__speaker": F.when(c("p_speaker") != "", c("p_speaker")).otherwise(F.when(labelled, label).otherwise("")), "__url": F.when(c("p_source_url") != "", c("p_source_url")).otherwise(F.rtrim(F.regexp_extract(raw, URL, 0), F.lit(".,;"))), "__title": F.when(c("p_source_title") != "", c("p_source_title")).otherwise(card)})
    url = F.regexp_replace(F.regexp_replace(c("__url"), r"^www\.", "https://www."), r"#.*$|/+$", "")
    clean = F.trim(F.regexp_replace(text_transform("clean_citation", text_transform("strip_ocr_noise", F.regexp_replace(c("__said"), URL, " "))), r"\s+", " "))
    rows = rows.withColumns({"__link": url, "__clean": clean})
    claim = F.when((c("__title") != "") & (c("__speaker") == "") & (c("p_source_title") == ""), c("__title")).when(c("__clean") != "", c("__clean")).when(c("__title") != "", c("__title")).otherwise(c("__link"))
    told = F.coalesce(*(F.when(c("__said").rlike(p), F.lit(n)) for n, p in ROLES), F.lit("claim"))
    role = F.when(c("p_argument_role") != "", c("p_argument_role")).when((told == "claim") & ((c("__title") != "") | (c("__link") != "")) & (c("__speaker") == ""), "evidence").otherwise(told)
    rows = rows.withColumns({"claim_text": claim, "argument_role": role, "source_domain": F.lower(F.regexp_extract(c("__link"), r"^(?i:[a-z]+://)?(?:www\.)?([^/:?#\s]+)", 1))})
    stance = F.when(c("p_stance") != "", side(c("p_stance"))).otherwise(side(raw))
    topic = F.when(c("p_debate_topic") != "", c("p_debate_topic")).otherwise(topic_key(c("claim_text"), words=6))
    lang = F.when(c("p_language") != "", c("p_language")).otherwise(language(F.concat_ws(" ", c("claim_text"), c("p_quote_text"))))
    rows = rows.withColumns({
        "speaker": c("__speaker"), "speaker_role": c("p_speaker_role"), "source_title": c("__title"), "source_url": c("__link"), "published_at": c("p_published_at"), "stance": stance, "confidence": c("p_confidence"), "citation_text": F.when(c("p_citation_text") != "", c("p_citation_text")).otherwise(citation),
        "quote_text": F.when(c("p_quote_text") != "", c("p_quote_text")).when(c("__title") != "", "").otherwise(quote), "debate_topic": topic, "language": lang,
    })
    key, who = claim_key(c("claim_text")), F.lower(c("speaker"))
    source = F.lower(F.coalesce(*(F.nullif(c(x), F.lit("")) for x in ("source_domain", "source_title", "source_url")), F.lit("")))
    place = F.coalesce(F.nullif(vts(c("row_index")), F.lit("")), vts(c("chunk_index")))
    text = F.when((key != "") & ((who != "") | (source != "")), F.concat_ws("|", key, who, source)).otherwise(F.concat_ws("|", vts(c("source_path")), vts(c("page")), vts(c("sheet_name")), place, c("claim_text")))
    rows = rows.withColumn("evidence_id", F.substring(F.sha1(text.cast("binary")), 1, 16))
    order = ["evidence_id", "claim_text", "speaker", "speaker_role", "argument_role", "source_title", "source_url", "source_domain", "published_at", "stance", "confidence", "citation_text", "quote_text", "debate_topic", "language", *PLACES]
    return rows.select(*order)


COVERED = ["speaker", "speaker_role", "stance", "debate_topic", "language", "source_ref"]


def evidence_report(df: DataFrame, required: list[str] = ("claim_text", "source_path")) -> DataFrame:
    """One row over canonical evidence rows: coverages, noise, quotes, repeated claims, claim lengths, missing required cells, and warnings.

    Headings, metadata and citation rows don't count for the ratios. A warning is a coverage below a quarter, or noise or repeats above a fifth.
    """
    has = lambda c: ~miss(col(c)) if c in df.columns else F.lit(False)
    role = F.lower(vts(col("argument_role"))) if "argument_role" in df.columns else F.lit("")
    counted, claimed = ~role.isin("metadata", "section", "citation"), ~role.isin(QUIET_ROLES) & has("claim_text")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    known = lambda c: has(c) & (F.lower(vts(col(c))) != "unknown") if c in df.columns else F.lit(False)
    flags = {"speaker": has("speaker"), "speaker_role": has("speaker_role"), "stance": known("stance"), "debate_topic": has("debate_topic"), "language": known("language"), "source_ref": has("source_url") | has("source_title") | has("citation_text")}
    length, key = F.when(has("claim_text"), F.length(F.trim(vts(col("claim_text"))))), F.when(claimed, F.nullif(claim_key(col("claim_text")), F.lit("")))
    one = df.agg(
        F.count("*").alias("row_count"), n(counted).alias("__m"), *(n(counted & flags[x]).alias(f"__{x}") for x in COVERED), n(counted & (role == "quote")).alias("__quote"), n(counted & noisy(col("claim_text"))).alias("__noise"), F.count(key).alias("__claims"), F.count_distinct(key).alias("__kinds"),
        n(counted & has("source_title")).alias("__titles"), F.min(length).alias("claim_min"), F.max(length).alias("claim_max"), F.avg(length).alias("claim_avg"), sum((n(~has(c)) for c in required), F.lit(0).cast("long")).alias("required_missing"),
    )
    rows = F.when(F.col("__m") > 0, F.col("__m")).otherwise(F.col("row_count"))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    out = one.withColumns({f"{x}_coverage": part(F.col(f"__{x}"), rows) for x in COVERED} | {"quote_only_ratio": part(F.col("__quote"), rows), "ocr_noise_ratio": part(F.col("__noise"), rows), "duplicate_claim_ratio": part(F.col("__claims") - F.col("__kinds"), F.col("__claims")), "source_title_resolution_rate": part(F.col("__titles"), F.col("__source_ref"))})
    low = [F.when((F.col("row_count") > 0) & (F.col(f"{x}_coverage") < 0.25), F.lit(f"low {x}_coverage")) for x in COVERED]
    high = [F.when(F.col(x) > 0.2, F.lit(f"high {x}")) for x in ("ocr_noise_ratio", "duplicate_claim_ratio")]
    out = out.withColumn("warnings", F.array_compact(F.array(*low, *high)))
    return out.drop(*(c for c in out.columns if c.startswith("__")))
