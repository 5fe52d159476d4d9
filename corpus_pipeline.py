"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Between stages the rows are written to the shared folder as Parquet and read again, so a lost executor costs
no more than the stage that runs.

In every stage: extra columns stay, whatever their names; an empty table gives an empty one; texts of any length are
read whole; repeated rows are judged alike. Null texts have no words, so quality rules drop them; rows without doc_id
are kept or dropped by their text as others are. Ties are named in the stages' own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlake.llm import decontaminate, neardup, packing, quality, secrets, tokens
from rowlake.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and from the others the lines that are frequent on their host. A null or missing source is a host of its own; a share of just the limit stays."""
    return quality.filter_documents(docs, Scratch(spark, "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, that with the smallest doc_id; of repeated rows of one doc_id one, of equal texts without doc_id one."""
    return neardup.deduplicate(docs, Scratch(spark, "neardup"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs. Items without text have no windows; repeated items count once."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; a score of just a half is a secret. n_chars follows the text."""
    return secrets.redact(docs, secrets.train(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens. Repeated rows are packed as often as they occur; which of equal lengths goes where is open."""
    pieces = packing.cut_pieces(docs, Scratch(spark, "packing"), tokens.vocabulary())
    return packing.pack(pieces.select("task", "nth", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can express neither the consistent samples nor the forest nor the packing; the tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
