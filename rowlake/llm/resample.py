"""Quality by importance resampling: the ratio of two hashed n-gram models, and Gumbel top-k over it.

Words and pairs of adjacent words are hashed to BUCKETS; one categorical model is counted over the target texts, one over
all raw texts. A document's log weight is the sum, over its n-grams, of the log ratio of the two. Adding Gumbel noise
(from a hash of the document, so that a retried task draws the same) and taking the k largest draws k documents
without replacement by their weights. k is SHARE of the documents.

The target is labelled documents, at most SAMPLE of them by hash of doc_id; raw counts cover every document. Only the
two tables of BUCKETS counts and, for the k-th largest key, histograms of BINS counts reach the driver.

Nulls: a null or empty text has log weight 0; a null label is none. Ties at the k-th key are all kept. Repeated rows
get equal results. An empty table gives an empty one. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.llm import bytescan
from rowlake.llm.common import Scratch, map_arrow, slices, text_bytes

BUCKETS, SAMPLE, SMOOTH, SHARE = 1 << 16, 20_000, 1.0, 0.9
BINS, CHUNK = 1024, 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets and texts of the words and pairs; words are runs of non-blank characters, A-Z lower-cased."""
    w = bytescan.words(data, offsets, bytescan.NON_SPACE, bytescan.LOWER)
    doc = w.doc()
    same = doc[1:] == doc[:-1]
    pairs = bytescan.mix(w.hash[:-1] * np.uint64(bytescan.WINDOW) + w.hash[1:])[same]
    return (np.concatenate([w.hash, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    part = lambda x: np.log((x + SMOOTH) / (x.sum() + SMOOTH * BUCKETS))
    return part(target) - part(raw)


def models(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The log ratio of each bucket."""
    good = labels.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).dropna().groupBy("k").agg(F.min("y").alias("y"))
    chosen = [r.k for r in good.filter("y = 1").orderBy(F.xxhash64("k"), "k").limit(sample).collect()]
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(chosen, np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, any_rows = np.zeros((2, BUCKETS), np.int64), False
        for batch in batches:
            any_rows |= batch.num_rows > 0
            data, offsets = text_bytes(batch.column(1))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            target = np.isin(batch.column(0).fill_null(0).to_numpy(), wanted.value) & known
            for a, b in slices(offsets, CHUNK):
                x, doc = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                totals[1] += np.bincount(x, minlength=BUCKETS)
                totals[0] += np.bincount(x[target[a:b][doc]], minlength=BUCKETS)
        if any_rows:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(16), pa.int32()), "counts": pa.array([x.astype("<i8").tobytes() for x in totals.reshape(2, 16, -1).transpose(1, 0, 2)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(*(c.to_pylist() for c in batch.columns)):
                totals[s] = np.frombuffer(counts, "<i8") + totals.get(s, 0)
        if totals:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(totals), pa.int32()), "counts": pa.array([x.astype("<i8").tobytes() for x in totals.values()], pa.binary())})

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    parts = map_arrow(rows, count, "slice int, counts binary").repartition(16, "slice").mapInArrow(merge, "slice int, counts binary").collect()
    totals = np.zeros((2, BUCKETS), np.int64)
    for r in parts:
        totals[:, r.slice * BUCKETS // 16 : (r.slice + 1) * BUCKETS // 16] = np.frombuffer(r.counts, "<i8").reshape(2, -1)
    return ratios(*totals) if totals[0].sum() else np.zeros(BUCKETS)


def weigh(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, log_weight, and the key of the draw."""
    known = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            out = np.zeros(batch.num_rows)
            for a, b in slices(offsets, CHUNK):
                x, doc = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out[a:b] = np.bincount(doc, known.value[x], b - a)
            uniform = ((bytescan.mix(batch.column(1).to_numpy().view(np.uint64)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(out - np.log(-np.log(uniform)))], names=["doc_id", "log_weight", "draw"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{key}`").cast("long"), F.lit("gumbel")).alias("h"), F.col(f"`{text}`").cast("string").alias("t"))
    return map_arrow(rows, run, "doc_id long, log_weight double, draw double")


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest number, by histograms that narrow to it."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k:
        return low if n else 0.0
    above, x = 0, F.col(column)
    while low < high:
        width = (high - low) / BINS
        if not low + width > low:
            break
        bin_ = F.least(F.floor((x - low) / width), F.lit(BINS - 1))
        inside = rows.filter((x >= low) & (x <= high)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for r in sorted(inside.collect(), key=lambda r: -r.b):
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
    return low


def resample(docs: DataFrame, labels: DataFrame, scratch: Scratch, share: float = SHARE, **names) -> DataFrame:
    """One row per document: doc_id, log_weight, draw and kept."""
    weighed = scratch.write(weigh(docs, models(docs, labels, **names), **{k: v for k, v in names.items() if k in ("key", "text")}), "weighed")
    limit = kth_largest(weighed, "draw", int(np.ceil(share * weighed.count())))
    return weighed.withColumn("kept", F.col("draw") >= limit)
