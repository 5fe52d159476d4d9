"""Loading and saving tables by format or URI."""

from __future__ import annotations

import re
import sqlite3
import time
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlake.functions.values import col

READERS: dict[str, Callable] = {}
OFFICE = ("pdf", "docx", "xlsx", "png", "jpg", "jpeg")
#: Names of files that Spark unpacks, which have another length than their texts.
_PACKED = r"\.(?:gz|bz2|deflate|lz4|snappy|zst)$"


def register_reader(kind: str, on_conflict: str = "error"):
    """Registers read(spark, source, **options) for a format; on_conflict: error, replace or keep."""

    def put(read: Callable) -> Callable:
        if kind in READERS and on_conflict == "error":
            raise ValueError(f"a reader of {kind} is registered")
        if kind not in READERS or on_conflict == "replace":
            READERS[kind] = read
        return read

    return put


@register_reader("jsonl")
def read_jsonl(spark: SparkSession, source: str, schema=None, skip_bad: bool = False, **_) -> DataFrame:
    reader = spark.read.option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(source)


@register_reader("csv")
def read_csv(spark: SparkSession, source: str, naive: bool = False, delimiter: str = ",", schema=None, multi_line: bool = False, **_) -> DataFrame:
    """Texts with a header. naive: quotes are characters like others, cells are trimmed, absent cells are empty.

    multi_line allows line ends inside of quotes; a file is then one task, else large files are split.
    """
    reader = spark.read.option("header", True).option("sep", delimiter)
    if naive:
        reader = reader.option("quote", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("emptyValue", "").option("nullValue", "\u0000")
        df = reader.csv(source)
        return df.select(*(F.coalesce(col(c), F.lit("")).alias(c) for c in df.columns))
    reader = reader.option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(source)


@register_reader("parquet")
def read_parquet(spark: SparkSession, source: str, payload_schema=None, **_) -> DataFrame:
    """A table of one `payload` column of JSON is parsed by payload_schema."""
    df = spark.read.parquet(source)
    if df.columns == ["payload"] and payload_schema:
        return df.select(F.from_json("payload", payload_schema).alias("x")).select("x.*")
    return df


@register_reader("txt")
def read_txt(spark: SparkSession, source: str, paragraphs: bool = False, **_) -> DataFrame:
    """source_path, line_no and text. Large files are split; line numbers are those within a split plus the lines of the splits before.

    paragraphs: source_path, chunk_index and text of blank-line paragraphs, in no order. Large files are split here too; only packed ones are read whole.
    """
    if paragraphs:
        return _paragraphs(spark, source)
    lines = spark.read.text(source).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("__at"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("__i"))
    counts = spark.read.text(source).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("__at")).groupBy("source_path", "__at").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("source_path").orderBy("__at")) - F.col("__n")).drop("__n")
    numbered = lines.withColumn("__rn", F.row_number().over(Window.partitionBy("source_path", "__at").orderBy("__i")))
    return numbered.join(before, ["source_path", "__at"]).select("source_path", (F.col("__before") + F.col("__rn")).alias("line_no"), "text")


def _paragraphs(spark: SparkSession, source: str) -> DataFrame:
    """What parting each whole text by \\r?\\n\\s*\\r?\\n gives, trimmed and without empty ones, but from the lines of splits.

    A split's inner paragraphs stay in its task. Its first and last ones, and counts, are a row a split: these are put
    together file by file, which also numbers the paragraphs.
    """
    packed = F.col("_metadata.file_path").rlike(_PACKED)
    files = spark.read.text(source, wholetext=True).filter(packed).select(F.col("_metadata.file_path").alias("source_path"), F.col("value"))
    parts = F.filter(F.transform(F.split("value", r"\r?\n\s*\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    whole = files.select("source_path", F.posexplode(parts).alias("chunk_index", "text"))

    found = [F.col(f"_metadata.{x}").alias(x) for x in ("file_path", "file_block_start", "file_size")]
    lines = spark.read.text(source, lineSep="\n").filter(~packed).select(*found, F.col("value").cast("binary").alias("line"), F.col("value").rlike(r"\A\s*\z").alias("blank"))
    ends = lines.mapInArrow(_split_ends, "source_path string, at long, size long, bytes long, bare boolean, solid boolean, inner long, head binary, tail binary, loose binary")
    put = ends.repartition("source_path").sortWithinPartitions("source_path", "at").mapInArrow(_put_together, "source_path string, at long, chunk_index int, text binary")
    first = put.filter("text is null").select("source_path", "at", F.col("chunk_index").alias("first"))
    inner = lines.mapInArrow(_split_inner, "source_path string, at long, nth int, text binary").join(first, ["source_path", "at"])
    out = put.filter("text is not null").select("source_path", "chunk_index", "text").unionAll(inner.select("source_path", F.col("first") + F.col("nth"), "text"))
    return out.select("source_path", "chunk_index", F.trim(F.col("text").cast("string")).alias("text")).unionAll(whole)


class _Split:
    """The lines of one split of a text file, a batch at a time, as runs between blank lines.

    The last line waits: it may be the file's last, which is text even if blank unless a line end follows it. So is the
    file's first line, as there is none before it.
    """

    def __init__(self, at: int):
        self.at, self.lines, self.bytes, self.inner = at, 0, 0, 0
        self.head = self.open = self.held = self.leads = None  # leads: the run of the split's first line isn't closed yet

    def add(self, lines: pa.Array, blank: np.ndarray) -> pa.Array:
        """The inner runs that these lines close."""
        self.bytes += int(pc.sum(pc.binary_length(lines)).as_py()) + len(lines)
        if not self.lines and not self.at:
            blank = np.concatenate([[False], blank[1:]])
        self.lines += len(lines)
        if self.held:
            lines, blank = pa.concat_arrays([self.held[0], lines]), np.concatenate([self.held[1], blank])
        self.held = lines[-1:], blank[-1:]
        lines, blank, n = lines[:-1], blank[:-1], len(lines) - 1
        if not n:
            return pa.array([], pa.binary())
        turns = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts, stops = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
        cuts = np.concatenate([[0], np.cumsum(stops - starts)])
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), lines.filter(pa.array(~blank))), b"\n")
        if self.leads is None:
            self.leads = not blank[0]
        closed = []
        if self.open is not None:
            if not blank[0]:
                self.open.append(runs[0].as_py())
                runs, stops = runs[1:], stops[1:] if stops[0] < n else stops
            if blank.any():
                closed, self.open = [b"\n".join(self.open)], None
        if len(runs) and stops[-1] == n:
            runs, self.open = runs[:-1], [runs[-1].as_py()]
        out = pa.concat_arrays([pa.array(closed, pa.binary()), runs])
        if self.leads and len(out):
            self.head, self.leads, out = out[0].as_py(), False, out[1:]
        self.inner += len(out)
        return out

    def ends(self) -> tuple:
        """bytes, bare (one line), solid (the head is all but for a loose line), inner, head, tail, loose (a blank last line)."""
        last, blank = self.held[0][0].as_py(), bool(self.held[1][0])
        runs = (self.open or []) + ([] if blank else [last])
        tail = b"\n".join(runs) if runs else None
        solid = bool(self.leads) or self.lines == 1 and not blank
        head, tail = (tail, None) if solid else (self.head, tail)
        return self.bytes, self.lines == 1, solid, self.inner, head, tail, last if blank else None


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(path, at, size), the split so far, the inner runs before, and those that a batch closed; None at the split's end."""
    key = split = None
    for batch in batches:
        paths, at = batch.column(0), batch.column(1).to_numpy()
        blank = batch.column(4).to_numpy(zero_copy_only=False)
        new = np.flatnonzero((np.diff(at) != 0) | (np.diff(paths.dictionary_encode().indices.to_numpy()) != 0)) + 1
        for a, b in zip([0, *new], [*new, len(at)]):
            if a == b:
                continue
            mine = paths[a].as_py(), int(at[a]), batch.column(2)[a].as_py()
            if mine != key:
                if split:
                    yield key, split, split.inner, None
                key, split = mine, _Split(mine[1])
            before = split.inner
            yield key, split, before, split.add(batch.column(3).slice(a, b - a), blank[a:b])
    if split:
        yield key, split, split.inner, None


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["source_path", "at", "size", "bytes", "bare", "solid", "inner", "head", "tail", "loose"]
    for key, split, _, runs in _splits(batches):
        if runs is None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, *split.ends()), kinds)], names=names)


def _split_inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (path, at, _), _, before, runs in _splits(batches):
        if runs is not None and len(runs):
            n = len(runs)
            runs = pc.replace_substring_regex(runs, r"\r\z", "")
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([at] * n, pa.int64()), pa.array(np.arange(before, before + n), pa.int32()), runs], names=["source_path", "at", "nth", "text"])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the number of its first inner paragraph (text null), and the paragraphs at the splits' ends."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for path, group in groupby(rows, key=lambda r: r[0]):
        texts, first, n, flows = [], [], 0, False  # flows: the split before ended inside of a paragraph
        for _, at, size, _, bare, solid, inner, head, tail, loose in (splits := list(group)):
            flowed = flows
            if head is not None and flowed:
                texts[-1][1].append(head)
            elif head is not None:
                texts.append((n, [head]))
                n += 1
            first.append((at, n))
            n += inner
            if tail is not None:
                texts.append((n, [tail]))
                n += 1
            flows = loose is None
        read = sum(r[3] for r in splits)  # with a line end for each line; a mark of UTF-8, 3 bytes, isn't read
        ended = read in (size, size - 3)
        if loose is not None and not ended:
            if solid or tail is not None or bare and flowed:
                texts[-1][1].append(loose)
            else:
                texts.append((n, [loose]))
        elif loose is None and ended:
            texts[-1][1].append(b"")
        if read < size:
            texts[0][1][0] = b"\xef\xbb\xbf" + texts[0][1][0]
        whole = [(k, b"\n".join(x)) for k, x in texts]
        closed = len(whole) - (loose is None or not ended)  # those that a blank line follows
        whole = [(k, x.removesuffix(b"\r") if i < closed else x) for i, (k, x) in enumerate(whole)]
        skip = int(not whole[0][1].strip(b" "))
        whole = [x for x in whole if x[1].strip(b" ")]
        yield pa.RecordBatch.from_arrays([
            pa.array([path] * (len(first) + len(whole))), pa.array([at for at, _ in first] + [0] * len(whole), pa.int64()),
            pa.array([k - skip for _, k in first] + [k - skip for k, _ in whole], pa.int32()), pa.array([None] * len(first) + [x for _, x in whole], pa.binary()),
        ], names=["source_path", "at", "chunk_index", "text"])


@register_reader("sqlite")
def read_sqlite(spark: SparkSession, source: str, query: str = "", limit: int | None = None, rows: int = 10000, **_) -> DataFrame:
    """A checked SELECT of a SQLite file that the executors reach, `limit` rows at most if given. One task reads it, `rows` at a time; the driver sees only the first of them, for the types."""
    check_query(query)
    path = source.removeprefix("sqlite://")
    sql = f"SELECT * FROM ({query})" + (f" LIMIT {int(limit)}" if limit is not None else "")
    with sqlite3.connect(path) as db:
        cursor = db.execute(f"SELECT * FROM ({query}) LIMIT {int(rows)}")
        names, first = [c[0] for c in cursor.description], cursor.fetchall()
    kinds = []
    for column in zip(*first) if first else [()] * len(names):
        seen = {type(x) for x in column if x is not None}
        kinds.append("bigint" if seen == {int} else "double" if seen and seen <= {int, float} else "binary" if seen == {bytes} else "string")
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))

    def run(batches):
        import pyarrow as pa

        types = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
        fit = {"bigint": lambda x: x if isinstance(x, int) else None, "double": lambda x: float(x) if isinstance(x, (int, float)) else None, "binary": lambda x: x if isinstance(x, bytes) else str(x).encode(), "string": str}
        for batch in batches:
            if not batch.num_rows:
                continue
            with sqlite3.connect(path) as db:
                cursor = db.execute(sql)
                while some := cursor.fetchmany(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([None if x is None else fit[k](x) for x in c], types[k]) for c, k in zip(zip(*some), kinds)], names=names)

    return spark.range(1, numPartitions=1).mapInArrow(run, schema)


@register_reader("jdbc")
def read_jdbc(spark: SparkSession, source: str, query: str = "", **options) -> DataFrame:
    """Any JDBC database, SQL Server too; filters and aggregates are pushed down by Spark."""
    check_query(query)
    return spark.read.format("jdbc").option("url", source).option("query", query).options(**options).load()


@register_reader("json_rows")
def read_json_rows(spark: SparkSession, source: str, schema=None, multi_line: bool = True, **_) -> DataFrame:
    """Files that are a JSON array, or an object with `rows`: one value a file, read by one task. multi_line=False: a value a line, split."""
    df = spark.read.option("multiLine", multi_line).json(source)
    if "rows" in df.columns:
        df = df.select(F.explode("rows").alias("r")).select("r.*")
    return df.select(*(col(f.name).try_cast(f.dataType).alias(f.name) for f in schema)) if schema else df


def sniff_delimiter(spark: SparkSession, source: str) -> str:
    """The delimiter among , ; tab and | that parts the first line most often."""
    first = spark.read.text(source).first()
    return max([",", ";", "\t", "|"], key=lambda d: first[0].count(d)) if first else ","


def decode(data: bytes) -> str:
    """UTF-8, with or without a mark, else GB 18030, else what is readable of UTF-8."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def read_encoded(spark: SparkSession, source: str) -> DataFrame:
    """source_path and text of files of any of those encodings, in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.as_py() or b"") for x in batch.column(1)], pa.string())], names=["source_path", "text"])

    return spark.read.format("binaryFile").load(source).select("path", "content").mapInArrow(run, "source_path string, text string")


for _kind in OFFICE:

    @register_reader(_kind)
    def read_metadata(spark: SparkSession, source: str, _kind: str = _kind, **_) -> DataFrame:
        """One row of metadata a file; what it holds isn't read."""
        files = spark.read.format("binaryFile").load(source)
        return files.select(F.col("path").alias("source"), F.lit(_kind).alias("source_type"), F.col("length").alias("size_bytes"), F.lit("metadata_only").alias("extract_status"))


def kind_of_uri(uri: str) -> str:
    if uri.startswith("sqlite://"):
        return "sqlite"
    if uri.startswith(("jdbc:", "sqlserver://")):
        return "jdbc"
    m = re.search(r"\.(\w+)/?$", uri)
    kind = m[1].lower() if m else ""
    return {"json": "jsonl", "ndjson": "jsonl", "pq": "parquet", "md": "txt"}.get(kind, kind)


def load(spark: SparkSession, source: str, kind: str | None = None, limit: int | None = None, retries: int = 0, wait_s: float = 0.15, action: Callable[[DataFrame], object] | None = None, **options) -> DataFrame:
    """A table by its format or the ending of its URI; retries wait longer each time.

    Reading is lazy, so planning alone is retried unless there is an action: it is run inside the retries too (a count, a
    write, DataFrame.checkpoint), and a DataFrame that it gives is the result.
    """
    return load_stats(spark, source, kind, limit, retries, wait_s, action, **options)[0]


def load_stats(spark: SparkSession, source: str, kind: str | None = None, limit: int | None = None, retries: int = 2, wait_s: float = 0.15, action: Callable[[DataFrame], object] | None = None, **options) -> tuple[DataFrame, dict]:
    """load, and {attempt, errors, resume_token, result}: the token names source, format and attempt."""
    kind = kind or kind_of_uri(source)
    if kind not in READERS:
        raise ValueError(f"no reader of {kind!r}")
    most, errors = min(8, retries), []
    for attempt in range(1, most + 2):
        try:
            df = READERS[kind](spark, source, **options)
            df = df.limit(max(1, limit)) if limit else df
            result = action(df) if action else None
            return result if isinstance(result, DataFrame) else df, {"attempt": attempt, "errors": errors, "resume_token": f"{kind}:{source}:{attempt}", "result": None if isinstance(result, DataFrame) else result}
        except Exception as e:
            errors.append(str(e)[:300])
            if attempt > most:
                raise
            time.sleep(wait_s * attempt)
    raise AssertionError


def load_many(spark: SparkSession, sources: list[str], on_error: str = "skip", check: bool = True, **options) -> tuple[DataFrame | None, list[str]]:
    """The union of several tables by column names, and the sources that failed; check reads a row of each, as files are else opened only later."""
    out, failed = None, []
    for s in sources:
        try:
            df = load(spark, s, **{"action": (lambda df: len(df.take(1))) if check else None, **options})
        except Exception:
            if on_error == "raise":
                raise
            failed.append(s)
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed


def infer_kinds(df: DataFrame) -> dict[str, str]:
    """What each text column holds, empty texts aside: boolean, bigint, double or string. One pass."""
    texts = [c for c in df.columns if df.schema[c].dataType.typeName() == "string"]
    flags = []
    for c in texts:
        x = F.trim(col(c))
        some, every = F.count(F.when(x != "", 1)), lambda pattern: F.coalesce(F.bool_and(F.when(x != "", x.rlike(pattern))), F.lit(False))  # noqa: B023
        flags.append(F.when(some == 0, "string").when(every(r"^(?i:true|false)$"), "boolean").when(every(r"^[+-]?(?:0|[1-9][0-9]{0,17})$"), "bigint").when(every(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), "double").otherwise("string").alias(c))
    return df.agg(*flags).first().asDict() if flags else {}


def typed(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Text columns as what they hold, empty texts null."""
    kinds = infer_kinds(df) if kinds is None else kinds
    return df.select(*(F.when(F.trim(col(c)) != "", F.trim(col(c)) if kinds[c] != "string" else col(c)).cast(kinds[c]).alias(c) if c in kinds else col(c) for c in df.columns))


def save(df: DataFrame, target: str, kind: str | None = None, mode: str = "errorifexists", payload: bool = False, infer: bool = False, table: str = "rows") -> None:
    """jsonl, csv (columns by name, commas in cells become spaces), parquet (typed, empty texts null; or payload JSON), jdbc or sqlite (a table of payload texts).

    infer: text columns become booleans, whole numbers or numbers in Parquet if all their cells are. A SQLite file has one writer, so its rows pass through the driver, a partition at a time.
    """
    kind = kind or kind_of_uri(target)
    everything = F.to_json(F.struct(*(col(c) for c in df.columns)))
    if kind == "jsonl":
        df.write.mode(mode).json(target)
    elif kind == "csv":
        df.select(*(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), ",", " ").alias(c) for c in sorted(df.columns))).write.mode(mode).option("header", True).option("quote", "").option("emptyValue", "").csv(target)
    elif kind == "parquet":
        plain = {c: "string" for c in df.columns if df.schema[c].dataType.typeName() == "string"}
        (df.select(everything.alias("payload")) if payload else typed(df, None if infer else plain)).write.mode(mode).parquet(target)
    elif kind == "jdbc":
        df.select(everything.alias("payload")).write.mode("append").jdbc(target, table)
    elif kind == "sqlite":
        with sqlite3.connect(target.removeprefix("sqlite://")) as db:
            if mode == "overwrite":
                db.execute(f"DROP TABLE IF EXISTS {check_identifier(table)}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {check_identifier(table)} (payload TEXT)")
            db.executemany(f"INSERT INTO {check_identifier(table)} VALUES (?)", ((r[0],) for r in df.select(everything).toLocalIterator()))
    else:
        raise ValueError(f"no writer of {kind!r}")


#: Words that a query may not have.
BANNED = ["insert", "update", "delete", "drop", "alter", "create", "truncate", "merge", "exec", "execute", "grant", "revoke", "attach", "pragma"]


def check_identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def check_where(text: str) -> str:
    """ident op literal, joined by AND or OR."""
    one = r"[A-Za-z0-9_.]+\s*(?:=|!=|>=|<=|>|<|like)\s*(?:'[^']*'|-?\d+(?:\.\d+)?)"
    if not re.fullmatch(rf"\s*{one}(?:\s+(?:and|or)\s+{one})*\s*", text, re.I):
        raise ValueError(f"not a condition: {text!r}")
    return text


def check_query(text: str) -> str:
    low = text.strip().lower()
    if not low.startswith("select ") or ";" in low or any(re.search(rf"\b{w}\b", low) for w in BANNED):
        raise ValueError("only a plain SELECT is allowed")
    return text


def aggregate_pushdown(spark: SparkSession, table: str, group_by: list[str], aggregates: list[dict], where: str | None = None, limit: int | None = None) -> DataFrame:
    """SELECT keys, aggregates FROM a table or view, for its source to compute where it can."""
    if not group_by:
        raise ValueError("group_by is required")
    keys = ", ".join(map(check_identifier, group_by))
    parts = []
    for a in aggregates:
        op = a["op"].lower()
        if op not in ("count", "sum", "avg", "min", "max"):
            raise ValueError(f"no aggregate {op!r}")
        of = check_identifier(a["field"]) if a.get("field") else "*"
        parts.append(f"{op}({of}) AS {check_identifier(a.get('as') or f'{op}_{a.get('field', 'rows')}')}")
    condition = f" WHERE {check_where(where)}" if where else ""
    return spark.sql(f"SELECT {keys}, {', '.join(parts)} FROM {check_identifier(table)}{condition} GROUP BY {keys}" + (f" LIMIT {int(limit)}" if limit is not None else ""))


def browse(spark: SparkSession, action: str, name: str | None = None, limit: int = 20) -> DataFrame | list:
    """validate_connection, list_schemas, list_tables, describe_table or sample_rows of the catalog."""
    match action:
        case "validate_connection":
            return [spark.range(1).count() == 1]
        case "list_schemas":
            return sorted(d.name for d in spark.catalog.listDatabases())
        case "list_tables":
            return sorted(t.name for t in spark.catalog.listTables(name))
        case "describe_table":
            return [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(check_identifier(name))]
        case "sample_rows":
            return spark.table(check_identifier(name)).limit(min(200, max(1, limit)))
    raise ValueError(f"no action {action!r}")
