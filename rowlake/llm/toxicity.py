"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text, its pairs of adjacent words and its pairs with one word between, lower-cased, hashed to
2**BITS coordinates; a feature counts once a text. The learner keeps a learning rate for each coordinate and an L1
penalty, so most weights are exactly 0 and the rest make a small table for the scoring tasks.

The fit reads at most SAMPLE labelled rows, those with the least hash of doc_id: a bound that doesn't grow with the
corpus. One task learns from them in that order; scoring is one pass over all documents without a shuffle. Labels,
language, source and doc_id are no inputs of a score.

Nulls: a null text is empty, and scores as the base rate; rows without doc_id are scored but never learned from; a null
label is none, and of several labels of a document the largest counts, of several texts the smallest. Without labels
every score is 0.5. Ties: a score of just the threshold is predicted 1. A text of any length is read whole, in steps of
about CHUNK bytes of whole texts. Repeated rows get equal scores and are learned from once. An empty table gives an empty one. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlake.llm import bytescan
from rowlake.llm.common import map_arrow, slices, text_bytes

BITS, SAMPLE, EPOCHS = 20, 24_000, 5
#: alpha, beta: the rates of coordinates; l1 (times the root of the rows, 1 at least) and l2: the penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.045, 1.0
THRESHOLD, CHUNK = 0.3, 1 << 20
_SHIFT = np.uint64(64 - BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and texts of all features, not yet distinct."""
    w = bytescan.words(data, offsets, bytescan.ALNUM, bytescan.LOWER)
    doc = w.doc()
    parts, docs = [bytescan.mix(w.hash + np.uint64(1))], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        parts.append(bytescan.mix(w.hash[:-gap] * np.uint64(bytescan.WINDOW) + w.hash[gap:] + np.uint64(gap))[same])
        docs.append(doc[gap:][same])
    return (np.concatenate(parts) >> _SHIFT).astype(np.int64), np.concatenate(docs)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """The bias, and the coordinates and weights that aren't 0, from the distinct features of each row."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    ones = float(labels.sum())
    bias = np.log((ones + 0.5) / (len(labels) - ones + 0.5))
    bias_n, l1 = 1.0, max(1.0, L1 * len(labels) ** 0.5)
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            zx, root = z[x], np.sqrt(n[x])
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((BETA + root) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y
            z[x] = zx + g - (np.sqrt(n[x] + g * g) - root) / ALPHA * w
            n[x] += g * g
            bias_n += g * g
            bias -= ALPHA * g / np.sqrt(bias_n)
    kept = np.flatnonzero(np.abs(z) > l1)
    return float(bias), kept, (np.sign(z[kept]) * l1 - z[kept]) / ((BETA + np.sqrt(n[kept])) / ALPHA + L2)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[float, np.ndarray, np.ndarray]:
    known = labels.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
    chosen = known.filter(~held_out(F.col("k"))).orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = rows.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))  # a labelled document once, however often it is there
    rows = rows.select(F.xxhash64("k").alias("h"), "k", "t", "y").repartition(1).sortWithinPartitions("h", "k", "t")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        marks: list[int] = []
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            marks += batch.column(1).to_pylist()
            for a, b in slices(offsets, CHUNK):
                x, doc = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                distinct = np.unique((doc << BITS) | x)
                cut = np.searchsorted(distinct, np.arange(b - a + 1) << BITS)
                found += [(distinct[i:j] & ((1 << BITS) - 1)).astype(np.int32) for i, j in zip(cut[:-1], cut[1:])]
        if found:
            bias, x, w = fit(found, np.array(marks, float))
            yield pa.RecordBatch.from_pydict({"x": pa.array([-1, *x.tolist()], pa.int32()), "w": pa.array([bias, *w.tolist()], pa.float64())})

    got = map_arrow(rows.select("t", "y"), learn, "x int, w double").collect()
    return next((r.w for r in got if r.x < 0), 0.0), np.array([r.x for r in got if r.x >= 0], np.int64), np.array([r.w for r in got if r.x >= 0])


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    table = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, x, w = table.value
        weights = np.zeros(1 << BITS)
        weights[x] = w
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            sums = np.full(batch.num_rows, bias)
            for a, b in slices(offsets, CHUNK):
                at, doc = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                real = np.flatnonzero(weights[at])
                distinct = np.unique((doc[real] << BITS) | at[real])
                sums[a:b] += np.bincount(distinct >> BITS, weights[distinct & ((1 << BITS) - 1)], b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), held_out(F.col(f"`{key}`").cast("long")).alias("held_out"), F.col(f"`{text}`").cast("string").alias("t"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
