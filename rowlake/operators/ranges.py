"""Global order without one task for all rows: ranges of a key with fixed bounds, totals before them, and blocks with margins.

The bounds are values taken once, from a sample of a stated size, and every row's range is computed from them as a
column. So the ranges are the same however often, and with whatever columns, a plan is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlake.functions.values import col

#: Rows of the sample for each range, and rows of a block of numbered rows.
SAMPLE, BLOCK = 50, 1 << 18


def _after(x: list[Column], bound: tuple) -> Column:
    """Whether the columns, compared one after the other, come behind the bound; null comes first."""
    out = F.lit(False)
    for c, value in reversed(list(zip(x, bound))):
        if value is None:
            out = c.isNotNull() | (c.isNull() & out)
        else:
            out = F.coalesce((c > F.lit(value)) | ((c == F.lit(value)) & out), F.lit(False))
    return out


def range_of(df: DataFrame, order: list[Column], ranges: int | None = None) -> Column:
    """The number of each row's range: about as many rows in each, in order. Reads a sample of SAMPLE rows a range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"o{i}" for i in range(len(order))]
    keys = df.select(*(c.alias(x) for c, x in zip(order, names)))
    drawn = keys.withColumn("draw", F.xxhash64(*names, F.monotonically_increasing_id())).orderBy("draw").limit(n * SAMPLE).drop("draw")
    rows = [tuple(r) for r in drawn.orderBy(*(F.col(x).asc_nulls_first() for x in names)).collect()]  # at most n * SAMPLE
    bounds = list(dict.fromkeys(rows[i * len(rows) // n] for i in range(1, n))) if rows else []

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(_after(order, bounds[mid]), tree(mid + 1, b)).otherwise(tree(a, mid))

    return tree(0, len(bounds))


def running_totals(df: DataFrame, order: str, value: str, tie: list[Column] = ()) -> DataFrame:
    """df with upto, the sum of value over all rows up to this one: totals of ranges, then within each.

    Rows of equal keys have one total, unless `tie` orders them; a key of very many rows then is no single range.
    """
    keys = [col(order), *tie]
    parts = df.withColumn("__p", range_of(df, keys))
    sums = parts.groupBy("__p").agg(F.sum(value).alias("__s"))  # one row a range
    before = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__before"))
    w = Window.partitionBy("__p").orderBy(*(c.asc_nulls_first() for c in keys))
    w = w.rowsBetween(Window.unboundedPreceding, 0) if tie else w
    return parts.join(F.broadcast(before), "__p").withColumn("upto", F.sum(value).over(w) + F.col("__before")).drop("__p", "__before")


def numbered(df: DataFrame, order: list[Column], name: str = "__rn") -> DataFrame:
    """df with the place of each row, from 0, in an order of several columns; rows equal in all of them come in any order."""
    made = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(made, order)))
    out = running_totals(rows.withColumn("__one", F.lit(1)), made[0], "__one", [F.col(x) for x in made[1:]] + [F.xxhash64(*(col(c) for c in df.columns))])
    return out.withColumn(name, F.col("upto") - 1).drop("__one", "upto", *made)


def in_blocks(df: DataFrame, rn: str, margin: int, compute, block: int = BLOCK) -> DataFrame:
    """compute(rows, window) over blocks of numbered rows, each with `margin` rows of its neighbours on both sides."""
    size = max(block, 4 * margin, 1)
    own = F.floor(F.col(rn) / size)
    near = F.array_distinct(F.array(F.floor((F.col(rn) - margin) / size), own, F.floor((F.col(rn) + margin) / size)))
    rows = df.withColumn("__own", own).withColumn("__block", F.explode(near))
    return compute(rows, Window.partitionBy("__block").orderBy(rn)).filter("__block = __own").drop("__block", "__own")


def log_bucket(x: Column) -> Column:
    """A number's bucket in order: a thousandth of its size wide, zero and the signs apart, NaN last."""
    size = F.least(F.greatest(F.floor(F.log(F.abs(x)) * 1024), F.lit(-800_000)), F.lit(800_000)) + 900_000
    return F.when(F.isnan(x), 2_000_000).when(x == 0, 0).when(x > 0, size).otherwise(-size).cast("int")


def percentiles(df: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the number at place round((n - 1) share) of the sorted numbers x of the group; exact.

    First the group's numbers are counted by bucket, then only the values of the buckets that hold a wanted place are
    counted: no group is sorted by one task, however large. by may hold nulls, which are one group.
    """
    keys = [col(c) for c in by]
    rows = df.filter(col(x).isNotNull()).select(*keys, col(x).alias("__x")).withColumn("__b", log_bucket(F.col("__x")))
    groups = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # buckets, not rows
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__c")).withColumns({"__upto": F.sum("__c").over(groups.orderBy("__b")), "__n": F.sum("__c").over(groups)})
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.floor((F.col("__n") - 1) * p + 0.5).alias("at")) for i, p in enumerate(shares.values())))
    before = F.col("__upto") - F.col("__c")
    wanted = F.transform(F.filter(places, lambda w: (w["at"] >= before) & (w["at"] < F.col("__upto"))), lambda w: F.struct(w["i"].alias("i"), (w["at"] - before).alias("rest")))
    some = counts.withColumn("__w", wanted).filter(F.size("__w") > 0).select(*(col(c).alias(f"__g{i}") for i, c in enumerate(by)), F.col("__b").alias("__wb"), "__w")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & col(c).eqNullSafe(F.col(f"__g{i}"))
    held = rows.join(some.drop("__w"), same & (F.col("__b") == F.col("__wb")), "left_semi").groupBy(*keys, "__b", "__x").agg(F.count("*").alias("__c"))
    ranked = held.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__x")))
    found = ranked.join(some, same & (F.col("__b") == F.col("__wb"))).select(*keys, "__x", "__upto", F.explode("__w").alias("__w"))
    return found.groupBy(*keys).agg(*(F.min(F.when((F.col("__w.i") == i) & (F.col("__upto") > F.col("__w.rest")), F.col("__x"))).alias(name) for i, name in enumerate(shares)))
