"""What the corpus operators share: scratch tables in the cluster's shared folder and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that an operator takes at a time, and that Spark hands over at a time unless the session says otherwise.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_open: dict[str, "Scratch"] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else the checkpoint folder of its context.

    A session in one process without either gets a local one; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            base = context.getCheckpointDir().get()
        elif context.isLocal():
            base = "file://" + tempfile.mkdtemp(prefix="rowlake-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Tables that one call of an operator writes to the shared folder; they cut lineage and outlive executors.

    Results are lazy and read these tables, so they stay until close(), the end of a `with` block, close_all(), or the
    end of the process: no later call takes them away. drop() deletes one table at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/rowlake/{name}-{uuid.uuid4().hex[:12]}"
        _open[self.base] = self

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete_path(self.spark, self.path(name))

    def close(self) -> None:
        if _open.pop(self.base, None):
            delete_path(self.spark, self.base)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def close_all() -> None:
    """Closes every open Scratch of this process."""
    for scratch in list(_open.values()):
        scratch.close()


@atexit.register
def _at_exit() -> None:
    try:
        close_all()
    except Exception:  # the sessions have ended: the shared folder is theirs to clean
        _open.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bounded(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, without copying; a longer row stands alone."""
    for batch in batches:
        if batch.nbytes <= most:
            yield batch
            continue
        ends = np.zeros(batch.num_rows + 1, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
                ends += at - at[0]
            elif pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                at = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
                ends += at - at[0]
            else:
                ends += np.arange(batch.num_rows + 1) * (c.nbytes // max(1, batch.num_rows))
        for a, b in slices(ends, most):
            yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow in batches of bounded bytes. A session that doesn't set BATCH_KEY itself gets BATCH_BYTES, which bounds the JVM's side too."""
    conf = df.sparkSession.conf
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(BATCH_KEY):
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(lambda batches: run(bounded(batches)), schema)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow by position: columns may have any names, with dots too. What run gives has the schema's columns in order."""
    names = [f.name for f in schema]

    def renamed(batches):
        for batch in run(batches):
            yield batch.rename_columns(names)

    return map_arrow(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), renamed, schema)


def column_or_null(df: DataFrame, name: str, kind: str):
    """A column by name, as kind; null where the table lacks it."""
    from pyspark.sql import functions as F

    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges of consecutive texts of about `most` bytes; a longer text stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
