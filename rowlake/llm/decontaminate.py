"""Benchmark decontamination: windows of words that documents share with test items.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased. A window is WIDTH consecutive words of an
item; an item of fewer words, but not none, is one window. The hashes of all windows are broadcast, the documents are
scanned once and nothing is shuffled. Items are a test set; should their text exceed BLOCK_CHARS, they are split into
blocks by hash, and the documents, written with a number for each row, are held against one block after the other: so
no more than one block is ever collected, broadcast or in a worker's memory, and the hits of the blocks are joined by
row. A hash that is found is a candidate: its words are then compared, byte for byte, with those of
the item's window, so only equal windows count, whatever the hashes do.

Nulls: a null text has no words; a null item text has no windows; an item without id goes by the empty string. Items
of one id count once. Rows are judged each for itself, so repeated rows get equal results. Empty tables on either side
are fine. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.llm import bytescan
from rowlake.llm.common import Scratch, free_name, map_arrow, map_batches, slices, text_bytes

WIDTH = 10
#: Text of test items in one broadcast block: about 25 bytes of index a character.
BLOCK_CHARS = 8_000_000
CHUNK = 1 << 20
_SHIFT = np.uint64(44)


def _equal(one: bytescan.Words, i: np.ndarray, two: bytescan.Words, j: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` words from each of i have the bytes of those from each of j."""
    out = np.ones(len(i), bool)
    for k in range(size):
        some = np.flatnonzero(out)
        a, b = i[some] + k, j[some] + k
        length = one.end[a] - one.start[a]
        same = length == two.end[b] - two.start[b]
        some, a, b, length = some[same], a[same], b[same], length[same]
        out[:] = False
        if not len(some):
            break
        before = np.cumsum(length) - length
        at = np.arange(int(length.sum())) - np.repeat(before, length)
        equal = one.data[np.repeat(one.start[a], length) + at] == two.data[np.repeat(two.start[b], length) + at]
        out[some] = np.logical_and.reduceat(equal, before)
    return out


class Index:
    """The words of the items and, for each width, their distinct windows in order of hash, each with the items that have it."""

    def __init__(self, rows: list[tuple[str, str | None]], width: int = WIDTH):
        self.names = sorted({x or "" for x, _ in rows})
        number = {x: i for i, x in enumerate(self.names)}
        data, offsets = text_bytes(pa.array([x for _, x in rows], pa.string()))
        self.words = w = bytescan.words(data, offsets, bytescan.ALNUM, bytescan.LOWER)
        owner = np.array([number[x or ""] for x, _ in rows], np.int64)
        counts = np.diff(w.first)
        self.by: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({min(width, int(n)) for n in counts if n}):
            starts, doc = bytescan.inside(w.first, size)
            mine = np.minimum(counts[doc], width) == size
            starts, item = starts[mine], owner[doc[mine]]
            hashes = bytescan.windows(w.hash, size)[starts]
            order = np.argsort(hashes, kind="stable")
            hashes, starts, item = hashes[order], starts[order], item[order]
            text = self._texts(hashes, starts, size)
            order = np.lexsort((item, text, hashes))
            hashes, starts, item, text = hashes[order], starts[order], item[order], text[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            flags = np.zeros(1 << 20, bool)
            flags[(hashes >> _SHIFT).astype(np.int64)] = True
            self.by[size] = hashes[first], starts[first], np.append(first, len(hashes)), item, flags

    def _texts(self, hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Numbers that are equal, among windows of one hash (they stand together), where the words are."""
        out = np.zeros(len(hashes), np.int64)
        same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        other = same[~_equal(self.words, starts[same - 1], self.words, starts[same], size)]
        w = self.words
        for h in np.unique(hashes[other]):  # different words of one hash
            a, b = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            seen: dict[tuple, int] = {}
            for i in range(a, b):
                key = tuple(w.data[w.start[x] : w.end[x]].tobytes() for x in range(starts[i], starts[i] + size))
                out[i] = seen.setdefault(key, len(seen))
        return out

    def scan(self, w: bytescan.Words, hit: np.ndarray, found: dict[int, set[str]]) -> None:
        """Marks the hit words and adds each text's items."""
        for size, (hashes, origin, cut, item, flags) in self.by.items():
            starts, doc = bytescan.inside(w.first, size)
            h = bytescan.windows(w.hash, size)[starts] if len(starts) else np.zeros(0, np.uint64)
            maybe = np.flatnonzero(flags[(h >> _SHIFT).astype(np.int64)])
            at, end = np.searchsorted(hashes, h[maybe]), np.searchsorted(hashes, h[maybe], side="right")
            while len(maybe):  # one round, but for different windows of one hash
                real = at < end
                maybe, at, end = maybe[real], at[real], end[real]
                good = _equal(w, starts[maybe], self.words, origin[at], size)
                hit |= bytescan.covered(starts[maybe[good]], size, len(hit))
                for d, x in set(zip(doc[maybe[good]].tolist(), at[good].tolist())):
                    found.setdefault(d, set()).update(self.names[i] for i in set(item[cut[x] : cut[x + 1]].tolist()))
                maybe, at, end = maybe[~good], at[~good] + 1, end[~good]


def _blocks(benchmark: DataFrame, key: str, text: str) -> list[DataFrame]:
    """(k, t) of the items, in blocks of about BLOCK_CHARS."""
    rows = benchmark.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-chars // BLOCK_CHARS))
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b) for b in range(n)]


def _broadcast(block: DataFrame, width: int):
    return block.sparkSession.sparkContext.broadcast(Index([(r.k, r.t) for r in block.collect()], width))


def _scan(block, column: pa.Array):
    """For each chunk of texts: first text, words, hit words, and the items of the texts that have some."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, CHUNK):
        w = bytescan.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bytescan.ALNUM, bytescan.LOWER)
        hit, found = np.zeros(len(w.start), bool), {}
        block.value.scan(w, hit, found)
        yield a, w, hit, found


def _runs(w: bytescan.Words, hit: np.ndarray, doc: int) -> list[tuple[int, int, int, int]]:
    """The longest runs of hit words of a text: first and last word, counted in the text, and their byte span from the start of the chunk."""
    a, b = w.first[doc], w.first[doc + 1]
    h = np.concatenate([[False], hit[a:b], [False]])
    first, last = np.flatnonzero(h[1:] & ~h[:-1]), np.flatnonzero(h[:-1] & ~h[1:]) - 1
    return list(zip(first.tolist(), last.tolist(), w.start[a + first].tolist(), w.end[a + last].tolist()))


_RUN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_RUNS = "array<struct<first: int, last: int, start: int, end: int>>"


def _hits(block):
    """(k, t) -> k, n_words, items and runs (words, and spans in characters) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words = np.zeros(n, np.int64)
            items: list[list[str]] = [[] for _ in range(n)]
            runs: list[list[dict]] = [[] for _ in range(n)]
            _, offsets = text_bytes(batch.column(1))
            for a, w, hit, found in _scan(block, batch.column(1)):
                k = len(w.first) - 1
                n_words[a : a + k] = np.diff(w.first)
                for doc, names in found.items():
                    items[a + doc] = sorted(names)
                    base = int(offsets[a + doc] - offsets[a])
                    mine, at, chars = _runs(w, hit, doc), 0, 0
                    for first, last, x, y in mine:
                        chars += int(np.count_nonzero((w.data[base + at : x] & 0xC0) != 0x80))
                        wide = int(np.count_nonzero((w.data[x:y] & 0xC0) != 0x80))
                        runs[a + doc].append({"first": first, "last": last, "start": chars, "end": chars + wide})
                        chars, at = chars + wide, y - base
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(items, pa.list_(pa.string())), pa.array(runs, _RUN)], names=["k", "n_words", "items", "runs"])

    return run


def _merged(runs: list[dict]) -> list[dict]:
    """Runs that meet or follow each other without a word between them, as one."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["first"], r["last"])):
        if out and r["first"] <= out[-1]["last"] + 1:
            if r["last"] > out[-1]["last"]:
                out[-1] |= {"last": r["last"], "end": r["end"]}
        else:
            out.append(dict(r))
    return out


def _all_hits(docs: DataFrame, blocks: list[DataFrame], width: int, scratch: Scratch | None) -> DataFrame:
    """_hits of (k, t) over all blocks; k is unique where there are several."""
    kind = f"k long, n_words long, items array<string>, runs {_RUNS}"
    if len(blocks) == 1:
        return map_arrow(docs, _hits(_broadcast(blocks[0], width)), kind)
    parts = []
    for i, block in enumerate(blocks):
        index = _broadcast(block, width)
        found = map_arrow(docs, _hits(index), kind)
        parts.append(scratch.write(found if not i else found.filter(F.size("runs") > 0), f"hits-{i}"))
        index.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    grouped = every.groupBy("k").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))  # a row a block at most

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(3, "runs", pa.array([_merged(x) for x in batch.column(3).to_pylist()], _RUN))

    return map_arrow(grouped, merge, kind)


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: its words, hit words, items whose windows occur in it, and the hit spans in characters."""
    blocks, spark = _blocks(benchmark, "item_id", "text"), docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    if len(blocks) == 1:
        hits = _all_hits(rows, blocks, width, None)
    else:
        scratch = Scratch(spark, "decontaminate")
        rows = scratch.write(rows.withColumn("r", F.monotonically_increasing_id()), "rows")
        hits = _all_hits(rows.select(F.col("r").alias("k"), "t"), blocks, width, scratch).withColumnRenamed("k", "r").join(rows.select("r", "k"), "r")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return hits.select(F.col("k").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "items", F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The same columns: without the documents that have a hit (mode document), or without the hit spans (mode span)."""
    if mode not in ("document", "span"):
        raise ValueError("mode must be document or span")
    blocks, at, schema = _blocks(benchmark, "item_id", "text"), docs.columns.index(text), docs.schema
    if len(blocks) > 1:
        return _decontaminate_blocks(docs, blocks, mode, text, width)
    block = _broadcast(blocks[0], width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, kept, edits = batch.column(at), np.ones(batch.num_rows, bool), {}
            _, offsets = text_bytes(column)
            for a, w, hit, found in _scan(block, column):
                for doc in found:
                    kept[a + doc] = False
                    base = int(offsets[a + doc] - offsets[a])
                    edits[a + doc] = [(x - base, y - base) for _, _, x, y in _runs(w, hit, doc)]
            if mode == "document":
                yield batch.filter(pa.array(kept))
                continue
            texts = column.to_pylist()
            for i, cuts in edits.items():
                raw, end, parts = texts[i].encode(), 0, []
                for x, y in cuts:
                    parts.append(raw[end:x])
                    end = y
                texts[i] = b"".join([*parts, raw[end:]]).decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))

    return map_batches(docs, run, schema)


def _decontaminate_blocks(docs: DataFrame, blocks: list[DataFrame], mode: str, text: str, width: int) -> DataFrame:
    """decontaminate where the items don't fit into one block: the rows are written with a number, which the hits are joined by."""
    scratch, r, spans = Scratch(docs.sparkSession, "decontaminate"), free_name(docs, "__row"), free_name(docs, "__spans")
    rows = scratch.write(docs.withColumn(r, F.monotonically_increasing_id()), "rows")
    hits = _all_hits(rows.select(F.col(r).alias("k"), F.col(f"`{text}`").cast("string").alias("t")), blocks, width, scratch).filter(F.size("runs") > 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if mode == "document":
        return rows.join(hits.select(F.col("k").alias(r)), r, "left_anti").select(*columns)
    marked = rows.join(hits.select(F.col("k").alias(r), F.col("runs").alias(spans)), r, "left").select(*columns, spans)
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, runs in enumerate(batch.column(len(schema)).to_pylist()):
                if runs:
                    ends = [0, *(x["end"] for x in runs)]
                    texts[i] = "".join(texts[i][a:b] for a, b in zip(ends, [*(x["start"] for x in runs), len(texts[i])]))
            yield batch.select(range(len(schema))).set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    return map_batches(marked, run, schema)
