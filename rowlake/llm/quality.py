"""Quality rules: base counts of each document, and the frequency of lines across the documents of a host.

Words are runs of [^\\x20\\x09-\\x0D]+. A line is normalised to its words, A-Z lower-cased and digits made 0, and hashed.
For each host the distinct documents that have the line are counted; documents of one and the same text count once, so
that copies don't make each other's lines frequent. Lines in more than MAX_SHARE of the host's documents, MIN_DOCS at
least and MAX_DOCS at most, are removed: so a line of a fifth of a small host goes, and one of thousands of documents
of a very large host too; and a document that loses more than MAX_LOSS of its words is depleted and rejected. Counts go by
(host, line) with partial sums in every task; no host, line or document group meets in one task.

Nulls: a null text is empty and fails the base rules; a null host is a host of its own, as is a missing host column.
Repeated rows get equal results. An empty table gives an empty one. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.llm import bytescan
from rowlake.llm.common import Scratch, column_or_null, free_name, map_arrow, map_batches, slices, text_bytes

MIN_DOCS, MAX_SHARE, MAX_DOCS, MAX_LOSS = 10, 0.05, 1000, 0.7
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
#: Frequent lines that are broadcast for the removal of lines; beyond, the lists of lines are joined to the documents.
MAX_BROADCAST = 200_000
CHUNK = 1 << 20
FEATURES = "row long, doc_id long, host string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<bigint>, line_words array<int>"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NORMAL = bytescan.LOWER.copy()
_NORMAL[0x30:0x3A] = 0x30
_FIELDS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), ("content", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])


class Counted:
    """Counts of the texts of a chunk; lines are those with a word, in order: text, byte span, words and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        w = bytescan.words(data, offsets, bytescan.NON_SPACE)
        doc = w.doc()
        self.n_words = np.diff(w.first)
        self.word_chars = bytescan.sums(bytescan.NON_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
        self.n_symbols = bytescan.sums(_SYMBOLS[data], offsets)
        starts, owner = bytescan.inside(w.first, WINDOW)
        keys = bytescan.windows(w.hash, WINDOW)[starts] if len(starts) else np.zeros(0, np.uint64)
        order = np.lexsort((keys, owner))
        again = (np.diff(keys[order]) == 0) & (np.diff(owner[order]) == 0) if len(order) else np.zeros(0, bool)
        twice = np.zeros(len(order), bool)
        twice[1:] |= again
        twice[:-1] |= again
        repeated = bytescan.covered(starts[order[twice]], WINDOW, len(doc))
        self.n_repeat_words = np.bincount(doc[repeated], minlength=n)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEATED * self.n_words)
        breaks = np.flatnonzero(data == 10)
        bounds = np.unique(np.concatenate([offsets[:-1], breaks]))
        line = np.searchsorted(bounds, w.start, side="right") - 1
        first = np.flatnonzero(np.diff(line, prepend=-1))
        self.line_doc, line = doc[first], line[first]
        self.line_start = bounds[line] + (data[bounds[line]] == 10)
        self.line_end = np.append(bounds, len(data))[line + 1]
        raw = bytescan.hash_spans(data, self.line_start, self.line_end)
        order = np.lexsort((raw, self.line_doc))
        equal = (np.diff(raw[order]) == 0) & (np.diff(self.line_doc[order]) == 0)
        self.n_dup_lines = np.bincount(self.line_doc[order][1:][equal], minlength=n)
        folded = bytescan.hash_spans(_NORMAL[data], w.start, w.end)
        ends = np.append(first, len(doc))[1:]
        self.line_hash = bytescan.span_hashes(bytescan.prefix_hashes(folded), first, ends).view(np.int64)
        self.line_words = ends - first
        self.line_first = np.searchsorted(self.line_doc, np.arange(n + 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        for a, b in slices(offsets, CHUNK):
            c = Counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(c.line_first, pa.int32()), pa.array(x, kind))  # noqa: B023, E731
            numbers = [pa.array(x, pa.int64()) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)]
            head = [batch.column(i).slice(a, b - a) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), *head, *numbers, pa.array(c.base_failed), lists(c.line_hash, pa.int64()), lists(c.line_words, pa.int32())], schema=_FIELDS)
            row += b - a


def features(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document with its counts and the hashes of its lines, written to the shared folder."""
    rows = docs.select(
        column_or_null(docs, key, "long").alias("k"), F.coalesce(column_or_null(docs, host, "string"), F.lit("")).alias("h"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("c"), F.col(f"`{text}`").cast("string").alias("t"),
    )
    return scratch.write(map_arrow(rows, _features, FEATURES), "features")


def frequent_lines(feats: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, n_docs) of the lines above the limit of their host."""
    hosts = feats.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of"))
    lines = feats.select("host", "content", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    limit = F.least(F.lit(float(max_docs)), F.col("of") * max_share)
    return lines.filter(F.col("n_docs") > min_docs).join(hosts, "host").filter(F.col("n_docs") > limit).drop("of")


def verdicts(feats: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, max_docs: int = MAX_DOCS) -> DataFrame:
    """feats without lines, with n_removed_words and kept."""
    lines = feats.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    removed = lines.join(frequent_lines(feats, min_docs, max_share, max_docs), ["host", "line"]).groupBy("row").agg(F.sum("n").alias("n_removed_words"))
    out = feats.drop("lines", "line_words").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= F.col("n_words") * max_loss)).drop("row")


def filter_documents(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, max_docs: int = MAX_DOCS) -> DataFrame:
    """The documents that are kept, without their frequent lines; the columns stay, and n_chars follows the text."""
    feats = features(docs, scratch, key, text, host)
    frequent = scratch.write(frequent_lines(feats, min_docs, max_share, max_docs), "frequent")
    columns, at, schema = docs.columns, docs.columns.index(text), docs.schema
    chars = columns.index("n_chars") if "n_chars" in columns else None
    host_column = F.coalesce(column_or_null(docs, host, "string"), F.lit(""))
    if frequent.count() <= MAX_BROADCAST:
        known: dict[str, list[int]] = {}
        for r in frequent.select("host", "line").collect():
            known.setdefault(r.host, []).append(r.line)
        table = docs.sparkSession.sparkContext.broadcast({k: np.sort(np.array(v, np.int64)) for k, v in known.items()})
        rows = docs.select("*", host_column.alias(free_name(docs, "__host")))
    else:
        table = None
        lists = feats.select("host", "content", F.explode(F.array_distinct("lines")).alias("line")).distinct().join(frequent, ["host", "line"]).groupBy("host", "content").agg(F.collect_list("line").alias("__lines"))
        h, c, mine = (free_name(docs, x) for x in ("__host", "__content", "__lines"))
        rows = docs.select("*", host_column.alias(h), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias(c))
        rows = rows.join(lists.toDF(h, c, mine), [h, c], "left").select(*(F.col(f"`{x}`") for x in columns), h, mine)
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, edits = np.zeros(batch.num_rows, bool), {}
            hosts = batch.column(len(columns)).to_pylist()
            lists = batch.column(len(columns) + 1).to_pylist() if table is None else None
            data, offsets = text_bytes(batch.column(at))
            for a, b in slices(offsets, CHUNK):
                part = data[offsets[a] : offsets[b]]
                c = Counted(part, offsets[a : b + 1] - offsets[a])
                kept[a:b] = ~c.base_failed
                for i in np.flatnonzero(~c.base_failed):
                    x, y = c.line_first[i], c.line_first[i + 1]
                    gone = np.isin(c.line_hash[x:y], table.value.get(hosts[a + i], none) if table else np.array(lists[a + i] or [], np.int64))
                    if not gone.any():
                        continue
                    if c.line_words[x:y][gone].sum() > max_loss * c.n_words[i]:
                        kept[a + i] = False
                        continue
                    end, parts, base, stop = offsets[a + i] - offsets[a], [], offsets[a], offsets[a + i + 1] - offsets[a]
                    for s, e in zip(c.line_start[x:y][gone], c.line_end[x:y][gone]):
                        parts.append(data[base + end : base + s])
                        end = min(e + 1, stop)
                    edits[a + i] = np.concatenate([*parts, data[base + end : base + stop]]).tobytes().decode()
            out = batch.select(range(len(columns)))
            if edits:
                texts = out.column(at).to_pylist()
                for i, new in edits.items():
                    texts[i] = new
                out = out.set_column(at, out.schema.field(at), pa.array(texts, out.column(at).type))
                if chars is not None:
                    numbers = out.column(chars).to_pylist()
                    for i, new in edits.items():
                        numbers[i] = len(new)
                    out = out.set_column(chars, out.schema.field(chars), pa.array(numbers, out.column(chars).type))
            yield out.filter(pa.array(kept))

    return map_batches(rows, run, schema)
