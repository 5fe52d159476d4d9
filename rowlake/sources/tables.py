"""Partitioned Parquet with schema checks, the schema registry, and a keyed feature table."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlake.functions.values import col, money, vts
from rowlake.streaming.state import JsonStore

WIDER = {("integer", "long"), ("integer", "double"), ("long", "double"), ("float", "double")}


class SchemaError(ValueError):
    pass


def compatible(old: T.StructType, new: T.StructType, mode: str = "additive") -> None:
    """additive: old fields stay as they are; strict: no others come; widen: int to float and anything to text is fine."""
    if mode == "strict" and len(old) != len(new):
        raise SchemaError(f"{len(old)} fields became {len(new)}")
    names = {f.name: f.dataType for f in new}
    for f in old:
        if f.name not in names:
            raise SchemaError(f"{f.name} is gone")
        a, b = f.dataType.typeName(), names[f.name].typeName()
        if a != b and not (mode == "widen" and ((a, b) in WIDER or b == "string")):
            raise SchemaError(f"{f.name} was {a}, is {b}")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = (), codec: str = "snappy", evolution: str = "additive", mode: str = "append") -> None:
    """Checks the schema against what is there, then writes."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if mode == "append" and jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        compatible(spark.read.parquet(path).schema, df.schema, evolution)
    df.write.mode(mode).partitionBy(*partition_by).option("compression", codec).parquet(path)
    side = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_schema.json")  # readers skip names that begin so
    out = side.getFileSystem(spark._jsc.hadoopConfiguration()).create(side, True)
    out.write(bytearray(df.schema.json().encode()))
    out.close()


def sidecar_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema that the last write left beside the table."""
    side = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_schema.json")
    fs = side.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(side):
        return None
    stream = fs.open(side)
    try:
        return T.StructType.fromJson(json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
    finally:
        stream.close()


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: dict | None = None, merge: bool = False, limit: int | None = None) -> DataFrame:
    """Filters on partition columns prune folders, others reach the scan; only `columns` are read."""
    df = spark.read.option("mergeSchema", merge).parquet(path)
    for name, value in (where or {}).items():
        df = df.filter(col(name) == F.lit(value))
    df = df.select(*(col(c) for c in columns)) if columns else df
    return df.limit(limit) if limit else df


def inspect_parquet(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema]


def merge_small(spark: SparkSession, path: str, target: str, file_mb: int = 128) -> None:
    """The table again in files of about file_mb, at another path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()
    spark.read.parquet(path).repartition(max(1, -(-size // (file_mb << 20)))).write.parquet(target)


class SchemaRegistry:
    """Schemas under name@version, as JSON documents below a folder."""

    def __init__(self, folder: str):
        self.store = JsonStore(folder)

    def register(self, name: str, version: str, schema: T.StructType) -> None:
        self.store.put(f"{name}@{version}", schema.jsonValue())

    def get(self, name: str, version: str) -> T.StructType:
        found = self.store.get(f"{name}@{version}")
        if found is None:
            raise KeyError("schema not found")
        return T.StructType.fromJson(found)

    def infer(self, df: DataFrame, name: str | None = None, version: str = "1") -> dict[str, str]:
        """What each column holds; texts that are all numbers are int_like or float_like, all truths bool_like. One pass."""
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        flags = []
        for c in texts:
            v = F.lower(F.trim(col(c)))
            there = F.coalesce(v != "", F.lit(False))
            every = lambda ok: F.coalesce(F.bool_and(F.when(there, ok)), F.lit(False))  # noqa: B023, E731
            flags.append(F.when(every(v.rlike(r"^[+-]?\d+$")), "int_like").when(every(money(v).isNotNull()), "float_like").when(every(v.isin("true", "false", "yes", "no", "on", "off")), "bool_like").otherwise("string").alias(c))
        seen = df.agg(*flags).first().asDict() if flags else {}
        if name:
            self.register(name, version, df.schema)
        kinds = {"long": "int", "integer": "int", "short": "int", "byte": "int", "double": "float", "float": "float", "boolean": "bool", "array": "array", "struct": "object", "map": "object"}
        return {f.name: seen.get(f.name) or kinds.get(f.dataType.typeName(), f.dataType.typeName()) for f in df.schema}


def check_compat(old: dict[str, str], new: dict[str, str], mode: str = "backward") -> dict:
    """breaking and widening changes between two {field: kind} maps; an added field breaks only in mode full."""
    wider = {("int", "float"), ("int_like", "float"), ("int_like", "float_like"), ("bool_like", "string"), ("int_like", "string"), ("float_like", "string")}
    breaking, widening = [], []
    for name, kind in old.items():
        if name not in new:
            breaking.append({"field": name, "change": "removed"})
        elif new[name] != kind:
            (widening if (kind, new[name]) in wider else breaking).append({"field": name, "change": f"{kind} -> {new[name]}"})
    added = [n for n in new if n not in old]
    if mode == "full":
        breaking += [{"field": n, "change": "added"} for n in added]
    return {"compatible": not breaking, "breaking": breaking, "widening": widening, "added": added}


def suggest_migration(old: dict[str, str], new: dict[str, str]) -> list[dict]:
    report = check_compat(old, new)
    steps = [{"field": b["field"], "step": "add_default", "value": None} if b["change"] == "removed" else {"field": b["field"], "step": "safe_cast_or_null", "to": new[b["field"]]} for b in report["breaking"]]
    return steps + [{"field": w["field"], "step": "cast", "to": new[w["field"]]} for w in report["widening"]]


def migrate(df: DataFrame, steps: list[dict]) -> DataFrame:
    """The steps as casts that give null instead of errors."""
    kinds = {"int": "bigint", "int_like": "bigint", "float": "double", "float_like": "double", "bool": "boolean", "bool_like": "boolean"}

    def one(df: DataFrame, s: dict) -> DataFrame:
        if s["step"] == "add_default":
            return df if s["field"] in df.columns else df.withColumn(s["field"], F.lit(s["value"]).cast("string"))
        return df.withColumn(s["field"], col(s["field"]).try_cast(kinds.get(s["to"], "string")))

    return reduce(one, steps, df)


def upsert_features(table: DataFrame | None, rows: DataFrame, key: str, order_by: str) -> DataFrame:
    """The latest row of each key over the old table and the new rows; blank keys and the text null are skipped."""
    new = rows.filter(~F.lower(F.trim(vts(col(key)))).isin("", "null"))
    every = new.withColumn("__new", F.lit(1)) if table is None else table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(vts(col(key))).orderBy(F.desc("__new"), col(order_by).desc())
    return every.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new")
