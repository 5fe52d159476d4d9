"""Event-time windows: tumbling, sliding and session, over a table with a given `now`, or over a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlake.functions.values import MAX_KEY, col, kind_of, number, time_key, vts


def event_ms(df: DataFrame, name: str) -> Column:
    """Milliseconds of a time: timestamps exactly, integers as they are, texts by the time formats; null if there is none."""
    kind = kind_of(df, name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(col(name).cast("timestamp"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col(name).cast("long")
    text = F.trim(vts(col(name)))
    whole = F.when(text.rlike(r"^[+-]?\d{1,18}$"), text).try_cast("long")
    key = time_key(F.when(text != "", text))
    return F.coalesce(whole, F.when((key < MAX_KEY) & (text != ""), key * 1000))


def _sums(df: DataFrame, value: str | None) -> list[Column]:
    x = number(df, value) if value else F.lit(None).cast("double")
    return [F.count("*").alias("count"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.avg(x).alias("avg")]


def split_late(df: DataFrame, time: str, now_ms: int, lateness_ms: int) -> tuple[DataFrame, DataFrame]:
    """The rows with an event time (__ts, in ms) in time, and those later than allowed."""
    timed = df.withColumn("__ts", event_ms(df, time)).filter("__ts is not null")
    late = F.lit(now_ms) - F.col("__ts") > lateness_ms
    return timed.filter(~late), timed.filter(late).drop("__ts")


def stream_window(df: DataFrame, time: str, window_ms: int, value: str | None = None, group_by: list[str] | None = None, window_type: str = "tumbling", slide_ms: int | None = None, gap_ms: int | None = None, now_ms: int | None = None, lateness_ms: int | None = None) -> DataFrame:
    """window_start_ms, window_end_ms, the group columns as text, count, sum and avg. Without now_ms nothing is late."""
    names = group_by or []
    rows = split_late(df, time, now_ms, window_ms if lateness_ms is None else lateness_ms)[0] if now_ms is not None else df.withColumn("__ts", event_ms(df, time)).filter("__ts is not null")
    keys = [vts(col(c)).alias(c) for c in names]
    if window_type == "session":
        return _sessions(rows, keys, names, value, gap_ms or window_ms)
    base = lambda w: F.floor(F.col("__ts") / w) * w
    if window_type == "sliding":
        slide = slide_ms or window_ms
        starts = F.transform(F.sequence(F.lit(0), F.lit(max(window_ms // slide, 1))), lambda j: (base(slide) - j * slide).cast("long"))
        inside = F.filter(starts, lambda s: (F.col("__ts") >= s) & (F.col("__ts") < s + window_ms))
        rows = rows.withColumn("__start", F.explode(inside))
    else:
        rows = rows.withColumn("__start", base(window_ms).cast("long"))
    out = rows.groupBy("__start", *keys).agg(*_sums(df, value))
    return out.select(F.col("__start").alias("window_start_ms"), (F.col("__start") + window_ms).alias("window_end_ms"), *(col(c) for c in names), "count", "sum", "avg")


def _sessions(rows: DataFrame, keys: list[Column], names: list[str], value: str | None, gap_ms: int) -> DataFrame:
    """Split where the gap is larger than gap_ms; a window ends one ms after its last event. session_window merges with partial sums."""
    x = number(rows, value) if value else F.lit(None).cast("double")
    at = F.timestamp_millis("__ts")
    timed = rows.select(*keys, at.alias("__at"), "__ts", x.alias("__x"))
    # session_window also merges events that lie just its gap apart
    sessions = timed.groupBy(F.session_window("__at", f"{gap_ms} milliseconds").alias("w"), *(col(c) for c in names))
    out = sessions.agg(F.min("__ts").alias("window_start_ms"), (F.max("__ts") + 1).alias("window_end_ms"), F.count("*").alias("count"), F.coalesce(F.sum("__x"), F.lit(0.0)).alias("sum"), F.avg("__x").alias("avg"))
    return out.select("window_start_ms", "window_end_ms", *(col(c) for c in names), "count", "sum", "avg")


def windowed_stream(stream: DataFrame, time: str, window: str, watermark: str, value: str | None = None, group_by: list[str] | None = None, slide: str | None = None, session_gap: str | None = None) -> DataFrame:
    """The same sums over a stream: rows later than the watermark are dropped, state is kept by Spark."""
    stream = stream.withColumn(time, col(time).cast("timestamp"))
    w = F.session_window(time, session_gap) if session_gap else F.window(time, window, slide) if slide else F.window(time, window)
    out = stream.withWatermark(time, watermark).groupBy(w.alias("w"), *(vts(col(c)).alias(c) for c in group_by or [])).agg(*_sums(stream, value))
    return out.select(F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), *(group_by or []), "count", "sum", "avg")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there, into Parquet, with its checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def distinct_stream(stream: DataFrame, keys: list[str], time: str, watermark: str) -> DataFrame:
    """Each message once: repeats within the watermark are dropped."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def transform_stream(stream: DataFrame, rules: dict, path: str, checkpoint: str, order_by: list[str] | None = None) -> None:
    """The row transform of each micro-batch (its deduplication, sort and aggregate are of the batch), exactly once by batch id."""
    from rowlake.operators.transform import transform

    def batch(df: DataFrame, number: int) -> None:
        transform(df, rules, order_by).df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def chunk_ids(df: DataFrame, order_by: str, size: int = 2000, after=None) -> DataFrame:
    """df after the watermark value, with chunk_id: `size` consecutive rows each in order_by, rows of equal keys by the hash of the row. Ranges are numbered, not one sorted task."""
    from rowlake.operators.ranges import numbered

    rows = df.filter(col(order_by) > F.lit(after)) if after is not None else df
    return numbered(rows, [col(order_by)]).withColumn("chunk_id", F.floor(F.col("__rn") / size).cast("long")).drop("__rn")


def session_ids(df: DataFrame, partition_by: list[str], time: str, gap_ms: int) -> DataFrame:
    """df with session_id: the number of gaps larger than gap_ms before each row of its partition."""
    ts = event_ms(df, time)
    w = Window.partitionBy(*(col(c) for c in partition_by)).orderBy(ts)
    gap = F.when(ts - F.lag(ts).over(w) > gap_ms, 1).otherwise(0)
    return df.withColumn("__gap", gap).withColumn("session_id", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")
