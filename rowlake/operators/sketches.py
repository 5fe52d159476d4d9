"""Mergeable sketches: distinct counts, quantiles and frequent values, exact or of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.functions.values import col, number, vts


def distinct_sketch(df: DataFrame, group_by: list[str], field: str) -> DataFrame:
    return df.groupBy(*(col(c) for c in group_by)).agg(F.hll_sketch_agg(vts(col(field))).alias("sketch"))


def merge_distinct(sketches: DataFrame, group_by: list[str]) -> DataFrame:
    return sketches.groupBy(*(col(c) for c in group_by)).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate_distinct(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def quantile_sketch(df: DataFrame, group_by: list[str], field: str) -> DataFrame:
    return df.groupBy(*(col(c) for c in group_by)).agg(F.kll_sketch_agg_double(number(df, field)).alias("sketch"))


def merge_quantiles(sketches: DataFrame, group_by: list[str]) -> DataFrame:
    return sketches.groupBy(*(col(c) for c in group_by)).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def estimate_quantile(sketches: DataFrame, p: float = 0.5) -> DataFrame:
    return sketches.withColumn("estimate", F.kll_sketch_get_quantile_double("sketch", F.lit(p)))


def frequency_sketch(df: DataFrame, group_by: list[str], field: str) -> DataFrame:
    """The exact sketch of frequent values: a row for each value with its count; merging is a sum."""
    return df.groupBy(*(col(c) for c in group_by), vts(col(field)).alias("value")).agg(F.count("*").alias("count"))


def merge_frequencies(a: DataFrame, b: DataFrame, group_by: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*(col(c) for c in group_by), "value").agg(F.sum("count").alias("count"))


def exact_distinct(df: DataFrame, group_by: list[str], field: str) -> DataFrame:
    return df.groupBy(*(col(c) for c in group_by)).agg(F.count_distinct(vts(col(field))).alias("estimate"))
