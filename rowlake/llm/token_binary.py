"""Token ids in a compact binary form, in ascending order of doc_id.

The table is made of frames: one row holds the ids of some whole documents in Simple-8b words, with the offsets of
their blocks, the documents and their lengths, and how many ids of the shard lie before it. A shard is what one task
wrote, a range of doc_id; the manifest (the number of ids of each shard) gives the place of any document in the whole.

Nulls: a null text has only the end id; rows without doc_id come first. Rows of one doc_id, or without one, go by the hash of their text, so
that they can be parted into several ranges; equal rows stand side by side. An empty table
gives an empty one. Columns of the input besides key and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.llm import simple8b, tokens
from rowlake.llm.common import Scratch, map_arrow, partitions

#: Ids after which a frame is closed; a document is never cut.
FRAME = 1 << 20
FRAMES = "shard int, frame long, before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, blocks binary, words binary"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def _frames(path: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), tokens.encoder(path)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        docs: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        size = frame = before = 0

        def close():
            words, blocks = simple8b.encode(np.concatenate(parts))
            row = {"shard": [shard], "frame": [frame], "before": [before], "n_ids": [size], "doc_ids": [docs], "lengths": [lengths], "blocks": [blocks.astype("<u4").tobytes()], "words": [words.astype("<u8").tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("frame", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.binary()), ("words", pa.binary())]))

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, cut in coder.encode_column(batch.column(1)):
                docs += keys[first : first + len(cut) - 1]
                lengths += (np.diff(cut) + len(end)).tolist()
                parts.append(np.insert(ids, np.repeat(cut[1:], len(end)), np.tile(end, len(cut) - 1)))
                size += len(parts[-1])
                if size >= FRAME:
                    yield close()
                    frame, before, docs, lengths, parts, size = frame + 1, before + size, [], [], [], 0
        if docs:
            yield close()

    return write


def write_ids(docs: DataFrame, scratch: Scratch, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2, name: str = "ids") -> DataFrame:
    """Encodes each text and writes the table of frames to the shared folder; returns it as read again."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    order = [F.col("k").asc_nulls_first(), F.col("h").asc()]  # the hash lets the rows of one doc_id be parted too
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("k", "t")
    return scratch.write(map_arrow(rows, _frames(tokenizer, end_id), FRAMES), name, "uncompressed")


def manifest(frames: DataFrame) -> dict[int, int]:
    """How many ids lie before each shard: one entry for each task that wrote, not for each document."""
    total, out = 0, {}
    for shard, n in sorted(map(tuple, frames.groupBy("shard").agg(F.sum("n_ids")).collect())):
        out[shard] = total
        total += n
    return out


def read_ids(frames: DataFrame) -> DataFrame:
    """One row per document: its ids, little-endian unsigned 32-bit, and how many ids of all documents lie before it."""
    base = manifest(frames)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["blocks"], "<u4"), row["n_ids"]).astype("<u4")
                cut = np.concatenate([[0], np.cumsum(row["lengths"], dtype=np.int64)])
                start = cut[:-1] + base[row["shard"]] + row["before"]
                parts = [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return frames.select("shard", "before", "n_ids", "doc_ids", "lengths", "blocks", "words").mapInArrow(read, DOCS)
