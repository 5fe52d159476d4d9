"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlake.llm import chat, decontaminate, neardup, packing, quality, resample, secrets, token_binary, tokens, toxicity, warc
from rowlake.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    frames = token_binary.write_ids(_table(spark, sf_dir, "documents"), scratch, tokens.vocabulary())
    return token_binary.read_ids(frames).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"), Scratch(spark, "op2")).select("doc_id", "class_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op4").path("archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "state")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(_table(spark, sf_dir, "documents"), Scratch(spark, "op5"), tokens.vocabulary())
    digests = pieces.select("task", "nth", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x"))
    return chat.digest(chat.format_conversations(rows.unionByName(more.select("conv_id", "x.*"))))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = quality.features(_table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return quality.verdicts(feats).drop("host", "content")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"), secrets.train(spark))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.concat_ws(",", "items"), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark, "op10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Words of op9, and the normal form of a line of op7.
_WORDS9 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS7 = r"'[^\x20\x09-\x0D]+'"

_OP9 = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS9} AS w FROM benchmark),
wins AS (SELECT item, list_aggregate(w[i : i + 9], 'string_agg', ' ') AS win, least(len(w), 10) AS size FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
items AS (SELECT win, size, list(DISTINCT item) AS names FROM wins GROUP BY 1, 2), sizes AS (SELECT DISTINCT size FROM items),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS9} AS w FROM documents),
p AS (SELECT r, size, i, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS win FROM d, sizes, unnest(range(1, len(w) - size + 2)) t(i) WHERE len(w) >= size),
h AS (SELECT r, i, p.size, names FROM p JOIN items USING (win, size)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM h) GROUP BY 1),
m AS (SELECT r, list_sort(list(DISTINCT x)) AS names FROM (SELECT r, unnest(names) AS x FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(names), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""

_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS7}) AS w FROM documents),
win AS (SELECT r, i, w[i : i + 7] AS x FROM d, unnest(range(1, len(w) - 6)) t(i) WHERE len(w) >= 8),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY 1),
line AS (SELECT r, host, text, x, regexp_extract_all(x, {_WORDS7}) AS lw FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS x FROM d)),
full_ AS (SELECT *, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS k FROM line WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM full_ GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY 1),
often AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS c FROM full_ GROUP BY 1, 2) JOIN hosts USING (host) WHERE c > {quality.MIN_DOCS} AND c > least({quality.MAX_DOCS}.0, {quality.MAX_SHARE} * n)),
gone AS (SELECT r, sum(len(lw)) AS n FROM full_ JOIN often USING (host, k) GROUP BY 1),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_removed_words <= n_words * {quality.MAX_LOSS} AS kept FROM base"""

_OP6 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
e AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, length(text) + length(text) - length(replace(text, chr(92), ''))
  + length(text) - length(replace(text, '<|', '<')) + length(text) - length(replace(text, '|>', '>')) + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
  + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 + length(role) + 13 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id, alone"""


_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1),
b AS (SELECT page_id, first, CAST(strlen(h) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p JOIN f USING (h))
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[i + 1] AS INTEGER) + 8 * CAST(bits[i + 2] AS INTEGER) + 4 * CAST(bits[i + 3] AS INTEGER) + 2 * CAST(bits[i + 4] AS INTEGER) + CAST(bits[i + 5] AS INTEGER) AS BIGINT), 1) FOR i IN range(0, 160, 5)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, 'ok' AS state FROM b"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against plain versions, round trips or held-out rows."""
    return {"op4_warc": _OP4, "op6_chat_format": _OP6, "op7_quality_rules": _OP7, "op9_decontamination": _OP9}
