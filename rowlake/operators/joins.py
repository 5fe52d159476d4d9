"""Equi-joins by the text of keys: null and blank keys match each other, and right columns that clash get right_."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.functions.values import col, kind_of, miss, vts

TYPES = ("inner", "left", "right", "full", "semi", "anti")


def keys(spec: str | list[str]) -> list[str]:
    return [x.strip() for x in ([spec] if isinstance(spec, str) else spec) if x.strip()]


def _equal(left: DataFrame, right: DataFrame, on: list[str], other: list[str], match_missing: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with key columns: the text of a key, or for integers on both sides the number and whether it is null.

    Without match_missing a row with a missing key gets a key of its own, so that such rows match nothing and don't meet in one task.
    """
    whole = {"byte", "short", "integer", "long"}
    mine, theirs, names = {}, {}, []
    for i, (a, b) in enumerate(zip(on, other)):
        if {kind_of(left, a).typeName(), kind_of(right, b).typeName()} <= whole:
            for made, c in ((mine, col(a)), (theirs, col(b))):
                made[f"__k{i}"], made[f"__n{i}"] = F.coalesce(c.cast("long"), F.lit(0).cast("long")), c.isNull()
            names += [f"__k{i}", f"__n{i}"]
        else:
            mine[f"__k{i}"], theirs[f"__k{i}"] = vts(col(a)), vts(col(b))
            names.append(f"__k{i}")
    if not match_missing:
        for made, fields, side in ((mine, on, 0), (theirs, other, 1)):
            made["__lone"] = F.when(reduce(lambda x, y: x | y, (miss(col(c)) for c in fields)), F.monotonically_increasing_id() * 2 + side).otherwise(F.lit(-1).cast("long"))
        names.append("__lone")
    return left.withColumns(mine), right.withColumns(theirs), names


def join_rows(left: DataFrame, right: DataFrame, left_on: str | list[str], right_on: str | list[str], join_type: str = "inner", strict: bool = True, match_missing: bool = True) -> DataFrame:
    """inner, left, right, full, semi or anti, in one join. Unmatched right rows of right and full joins keep their own column names.

    strict=False takes one key and treats any other type than left as inner. Missing keys match each other, which makes
    one key of all of them; match_missing=False lets them match nothing.
    """
    on, other, how = keys(left_on), keys(right_on), join_type.strip().lower()
    if not strict:
        how = "left" if how == "left" else "inner"
    if how not in TYPES:
        raise ValueError(f"unknown join type {join_type!r}")
    if not on or len(on) != len(other):
        raise ValueError("left_on and right_on must name as many keys")
    a, b, names = _equal(left, right, on, other, match_missing)
    if how in ("semi", "anti"):
        return a.join(b.select(*names), names, f"left_{how}").select(*(col(c) for c in left.columns))
    if how in ("inner", "left"):
        renamed = {c: f"right_{c}" if c in left.columns else c for c in right.columns}
        marked = b.select(*names, *(col(c).alias(renamed[c]) for c in right.columns))
        return a.join(marked, names, how).select(*(col(c) for c in left.columns), *(col(x) for x in renamed.values() if x not in left.columns))
    one = a.select(*names, F.lit(True).alias("__left"), *(col(c).alias(f"__a{i}") for i, c in enumerate(left.columns)))
    two = b.select(*names, *(col(c).alias(f"__b{i}") for i, c in enumerate(right.columns)))
    there, out = F.col("__left").isNotNull(), {}
    for i, c in enumerate(left.columns):
        out[c] = F.col(f"__a{i}")
    for i, c in enumerate(right.columns):
        if c not in left.columns:
            out[c] = F.col(f"__b{i}")
            continue
        same = kind_of(left, c) == kind_of(right, c)  # columns of one name and two types become text
        mine, theirs = (out[c], F.col(f"__b{i}")) if same else (out[c].cast("string"), F.col(f"__b{i}").cast("string"))
        out[c] = F.when(there, mine).otherwise(theirs)
        if f"right_{c}" not in left.columns:
            out[f"right_{c}"] = F.when(there, F.col(f"__b{i}"))
    return one.join(two, names, how).select(*(x.alias(c) for c, x in out.items()))


def join_rows_strategy(left: DataFrame, right: DataFrame, left_on, right_on, join_type: str = "inner", strategy: str = "auto", match_missing: bool = True) -> DataFrame:
    """With a hint: sort_merge, hash or broadcast; auto leaves the choice to Catalyst and AQE. broadcast is for a right side of a known size."""
    hint = {"sort_merge": "merge", "hash": "shuffle_hash", "broadcast": "broadcast"}.get(strategy)
    return join_rows(left, right.hint(hint) if hint else right, left_on, right_on, join_type, match_missing=match_missing)


#: What a join of one key gives when left rows without a match are gone before it.
_PREFILTERED = {"inner": "inner", "left": "inner", "right": "right", "full": "right", "semi": "semi"}


def join_rows_prefiltered(left: DataFrame, right: DataFrame, left_on, right_on, join_type: str = "inner", enable_bloom: bool = True, bloom_field: str | None = None, strategy: str = "auto") -> DataFrame:
    """Left rows whose first key (or bloom_field on both sides) isn't on the right go before the join, whatever its type.

    Where that key is the join's only one the same rows come of one join of another type, in which Spark may use its own
    bloom filter; else the rows go by a semi join.
    """
    how = join_type.strip().lower()
    if enable_bloom and how in TYPES:
        a, b = (bloom_field, bloom_field) if bloom_field else (keys(left_on)[0], keys(right_on)[0])
        if [a] == keys(left_on) and [b] == keys(right_on):
            if how == "anti":
                return left.filter(F.lit(False))
            return join_rows_strategy(left, right, left_on, right_on, _PREFILTERED[how], strategy)
        marked, other, names = _equal(left, right, [a], [b])
        left = marked.join(other.select(*names).distinct(), names, "left_semi").select(*(col(c) for c in left.columns))
    return join_rows_strategy(left, right, left_on, right_on, join_type, strategy)


def join_stats(left: DataFrame, right: DataFrame, left_on, right_on, join_type: str = "inner") -> DataFrame:
    """One row: matched_pairs and output_rows, from counts by key, without building the join."""
    a, b, names = _equal(left, right, keys(left_on), keys(right_on))
    ca = a.groupBy(*names).agg(F.count("*").alias("l"))
    cb = b.groupBy(*names).agg(F.count("*").alias("r"))
    both = ca.join(cb, names, "full").select(F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    matched = F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0))
    lone = lambda x, y: F.coalesce(F.sum(F.when(F.col(y) == 0, F.col(x))), F.lit(0))
    rows = {
        "inner": matched, "left": matched + lone("l", "r"), "right": matched + lone("r", "l"), "full": matched + lone("l", "r") + lone("r", "l"),
        "anti": lone("l", "r"), "semi": F.coalesce(F.sum(F.when(F.col("r") > 0, F.col("l"))), F.lit(0)),
    }[join_type]
    return both.agg(matched.alias("matched_pairs"), rows.alias("output_rows"))


def diff_audit(left: DataFrame, right: DataFrame, on: list[str], order_by: str | None = None) -> DataFrame:
    """added, removed and changed keys; of several rows of a key the last (by order_by) counts."""
    if not on:
        raise ValueError("keys are required")
    shared = [c for c in left.columns if c in right.columns and c not in on]

    def last(df: DataFrame) -> DataFrame:
        row = F.struct(*(col(c) for c in df.columns))
        pick = F.max_by(row, col(order_by)) if order_by else F.last(row)
        return df.groupBy(*(vts(col(k)).alias(k) for k in on)).agg(pick.alias("row"))

    a, b = last(left).withColumnRenamed("row", "a"), last(right).withColumnRenamed("row", "b")
    same = reduce(lambda x, y: x & y, (F.col("a")[c].eqNullSafe(F.col("b")[c]) for c in shared), F.lit(set(left.columns) == set(right.columns)))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~same, "changed")
    return a.join(b, on, "full").select(*on, kind.alias("change")).filter("change is not null")


