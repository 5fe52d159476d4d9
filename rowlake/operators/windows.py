"""Ranking and time-series windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlake.functions.values import col, kind_of, number, time_key, vts
from rowlake.operators.ranges import in_blocks, numbered, running_totals


def _order(df: DataFrame, order_by: str, tie: list[str] | None) -> list[Column]:
    return [time_key(col(order_by), kind_of(df, order_by)), *(col(c) for c in tie or [order_by])]


def _windowed(df: DataFrame, partition_by: list[str], order: list[Column], margin: int, make) -> DataFrame:
    """df with make(window): by partition, or, without any, over numbered rows in blocks with margins, so that no task has all rows."""
    if partition_by:
        return df.withColumns(make(Window.partitionBy(*(vts(col(c)) for c in partition_by)).orderBy(*order)))
    return in_blocks(numbered(df, order), "__rn", margin, lambda rows, w: rows.withColumns(make(w))).drop("__rn")


def window_rows(df: DataFrame, partition_by: list[str], order_by: str, functions: list[dict], tie: list[str] | None = None) -> DataFrame:
    """row_number, rank, dense_rank, lag, lead and moving_avg in order of the time key; ties go by `tie`, ranks by the text of order_by."""
    wanted = [f for f in functions if str(f.get("as", "")).strip()]
    op = lambda f: str(f.get("op", "")).lower()
    offset, size = (lambda f: int(f.get("offset", 1))), (lambda f: max(1, int(f.get("window", 3))))

    def make(w, ranks: dict[str, Column]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for f in wanted:
            name = f.get("field", "")
            value = col(name) if name in df.columns else F.lit(None).cast("string")
            out[f["as"]] = {
                **{k: (lambda c=c: c) for k, c in ranks.items()}, "lag": lambda: F.lag(value, offset(f)).over(w), "lead": lambda: F.lead(value, offset(f)).over(w), "moving_avg": lambda: F.avg(number(df, name)).over(w.rowsBetween(1 - size(f), 0)),
            }.get(op(f), lambda: F.lit(None).cast("string"))()
        return out

    key, text = time_key(col(order_by), kind_of(df, order_by)), vts(col(order_by))
    if partition_by:
        part = Window.partitionBy(*(vts(col(c)) for c in partition_by))
        w, by_text = part.orderBy(*_order(df, order_by, tie)), part.orderBy(key, text)
        return df.withColumns(make(w, {"row_number": F.row_number().over(w), "rank": F.rank().over(by_text), "dense_rank": F.dense_rank().over(by_text)}))
    rows = numbered(df.withColumns({"__key": key, "__text": text}), [F.col("__key"), F.col("__text"), *(col(c) for c in tie or [])])
    ranked = any(op(f) in ("rank", "dense_rank") for f in wanted)
    if ranked:
        runs = rows.groupBy("__key", "__text").agg(F.min("__rn").alias("__first")).withColumn("__one", F.lit(1))
        runs = running_totals(runs, "__first", "__one").select(F.col("__key").alias("__key2"), F.col("__text").alias("__text2"), "__first", F.col("upto").alias("__dense"))
        rows = rows.join(runs, (F.col("__key") == F.col("__key2")) & (F.col("__text") == F.col("__text2"))).drop("__key2", "__text2")
    ranks = {"row_number": (F.col("__rn") + 1).cast("int"), "rank": (F.col("__first") + 1).cast("int") if ranked else F.lit(None), "dense_rank": F.col("__dense").cast("int") if ranked else F.lit(None)}
    margin = max([0, *(offset(f) for f in wanted if op(f) in ("lag", "lead")), *(size(f) for f in wanted if op(f) == "moving_avg")])
    return in_blocks(rows, "__rn", margin, lambda r, w: r.withColumns(make(w, ranks))).drop("__rn", "__key", "__text", "__first", "__dense")


def time_series(df: DataFrame, time_field: str, value_field: str, group_by: list[str] | None = None, window: int = 3, tie: list[str] | None = None) -> DataFrame:
    """ts_moving_avg over the last rows, ts_mom (against the row before; missing is 0) and ts_yoy (against twelve rows before)."""
    x = F.coalesce(number(df, value_field), F.lit(0.0))

    def make(w) -> dict[str, Column]:
        before, year = F.lag(x, 1).over(w), F.lag(x, 12).over(w)
        return {"ts_moving_avg": F.avg(x).over(w.rowsBetween(1 - window, 0)), "ts_mom": x - before, "ts_yoy": F.when(F.abs(year) >= 2.220446049250313e-16, (x - year) / year)}

    return _windowed(df, group_by or [], _order(df, time_field, tie), max(12, window), make)


def forecast(df: DataFrame, time_field: str, value_field: str, group_by: list[str] | None = None, horizon: int = 3, method: str = "naive_drift") -> DataFrame:
    """group columns, step (1 to horizon) and forecast: the last value, with the mean step added for naive_drift."""
    names = group_by or []
    key, x = time_key(col(time_field), kind_of(df, time_field)), number(df, value_field)
    rows = df.select(*(vts(col(c)).alias(c) for c in names), key.alias("__t"), x.alias("__x")).filter("__x is not null")
    ends = rows.groupBy(*(col(c) for c in names)).agg(F.max_by("__x", "__t").alias("last"), F.min_by("__x", "__t").alias("first"), F.count("*").alias("n"))
    drift = F.when((F.col("n") > 1) & F.lit(method != "naive_last"), (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(0.0)
    return ends.select(*names, F.explode(F.sequence(F.lit(1), F.lit(min(60, max(1, horizon))))).alias("step"), "last", drift.alias("drift")).select(*names, "step", (F.col("last") + F.col("step") * F.col("drift")).alias("forecast"))


def balance_gaps(df: DataFrame, account: str, order_by: list[str], balance: str = "balance", amount: str = "amount", tolerance: float = 0.05) -> DataFrame:
    """balance_gap: the balance isn't the last one of the account plus the signed amount."""
    w = Window.partitionBy(col(account)).orderBy(*(col(c) for c in order_by)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(number(df, balance), ignorenulls=True).over(w)
    gap = F.abs(number(df, balance) - (before + F.coalesce(number(df, amount), F.lit(0.0)))) > tolerance
    return df.withColumns({"previous_balance": before, "balance_gap": F.coalesce(gap, F.lit(False))})


def signed_amount_conflicts(df: DataFrame, amount: str = "amount", debit: str = "debit_amount", credit: str = "credit_amount", tolerance: float = 0.01) -> DataFrame:
    want = F.coalesce(number(df, credit), F.lit(0.0)) - F.coalesce(number(df, debit), F.lit(0.0))
    there = number(df, debit).isNotNull() | number(df, credit).isNotNull()
    return df.withColumn("signed_amount_conflict", F.coalesce(there & (F.abs(number(df, amount) - want) > tolerance), F.lit(False)))
