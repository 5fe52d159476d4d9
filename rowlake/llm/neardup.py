"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded, verified, and joined into classes.

Words are runs of ASCII letters and digits, A-Z lower-cased, and of non-ASCII characters. A shingle is WIDTH words; a
text of fewer, but not none, is one shingle. Its weight in a text is its count there times its inverse document
frequency. Document frequencies of all documents are gathered in a sketch of SKETCH counters (a shingle's counter is an
upper bound of its frequency, above it by well under a thousandth of the documents). The idf is 1 up to a share of
COMMON of the documents, or FEW of them, and falls as log(documents / frequency) beyond, so that passages which many
documents carry count less, and near copies of a group that isn't larger don't lose weight against their own edits.

Improved consistent weighted sampling gives each text BANDS * ROWS samples; two texts agree in a sample with the
probability of their weighted Jaccard similarity. The gamma and uniform variates of (shingle, sample) come from a pool
of POOL triples by hash. Texts that agree in all samples of a band meet in a bucket. A bucket's members are held
against its leader, its smallest doc_id, so a group of n near copies costs n comparisons; links merge into components.
Buckets that hold several then get a second round: their minor components are held against a leader drawn from the
largest one, and against the first of themselves. What is still apart is settled exactly and without all pairs, by
prefixes: shingles are ordered by how few of the texts at issue have them, and of two texts of similarity THRESHOLD the
first shingle in this order that both have lies within the first 1 - THRESHOLD of the heavier one's weight, within the
first (1 - THRESHOLD) / (1 + THRESHOLD) of the lighter one's, and with enough weight behind it in both for the overlap
that such a similarity needs; and the lighter one weighs at least THRESHOLD of the heavier one, so texts meet under a
shingle and a range of weight. Texts of different components for which that holds are compared. So a pair of a bucket is
left out only if its texts are in one component, or are proven apart. A pair counts if its exact weighted Jaccard
similarity is THRESHOLD or more. Texts go to the comparison by pair; a leader of many is dealt to several keys.

The driver sees the sketch (a fixed size) and counts, never documents, links or components. Tables that are read again
are written to the shared folder.

Nulls: a null text is no copy of anything; equal texts, also empty ones, are copies. A text without words is near
nothing else. Rows without doc_id join the class of an equal text, and class_id is null if none of it has a doc_id.
Repeated rows are in one class. Ties: a similarity of just THRESHOLD counts, and of equal texts the smallest doc_id goes
for all. A text of any length is shingled whole; one of more than CHUNK bytes stands alone in its step, with some 20
bytes of memory a byte. An empty table gives an empty one. Other columns may have any names. Links that take more than
ROUNDS rounds of label passing (which halves paths, so chains of 2**ROUNDS) end in an error, not in a wrong class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.llm import bytescan
from rowlake.llm.common import Scratch, free_name, map_arrow, slices, text_bytes

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
SKETCH, COMMON, FEW, SLICE = 1 << 20, 0.01, 20, 1 << 14
POOL = 1 << 18
#: Texts at issue for each part of the shingles' hashes, which one task counts.
PART = 2000
#: Texts whose ids and digests (some 100 bytes each) are broadcast, so that only their texts move, and not all.
BROADCAST = 300_000
#: Pairs of one leader that are compared under one key.
LEADER = 1000
CHUNK = 1 << 19
ROUNDS = 200
_SLOT, _PLACE = np.uint64(64 - 20), np.uint64(64 - 18)
_SEEDS = bytescan.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_state: dict[str, np.ndarray] = {}


def variates() -> dict[str, np.ndarray]:
    """The pool: r and c of Gamma(2, 1), b uniform, and for weight 1 the ordering key of c exp(r b - r)."""
    if not _state:
        rng = np.random.Generator(np.random.PCG64(20240229))
        r, c, b = rng.gamma(2, 1, POOL), rng.gamma(2, 1, POOL), rng.random(POOL)
        _state.update(r=r, c=c, b=b, unit=_ordered(c * np.exp(r * b - r)))
    return _state


def _ordered(x: np.ndarray) -> np.ndarray:
    """Positive numbers as integers of the same order, in the upper half of 64 bits."""
    return x.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of each text, and their texts, in order of text."""
    w = bytescan.words(data, offsets, bytescan.ALNUM, bytescan.LOWER)
    starts, doc = bytescan.inside(w.first, WIDTH)
    hashes = bytescan.windows(w.hash, WIDTH)[starts] if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        mine = [bytescan.windows(w.hash[w.first[i] : w.first[i + 1]], int(counts[i]))[0] + np.uint64(counts[i]) for i in short]
        hashes, doc = np.concatenate([hashes, np.array(mine, np.uint64)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    return hashes, doc


def counted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their texts and counts, in order of text."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return hashes[first], doc[first], np.diff(np.append(first, len(hashes)))


def common(documents: int) -> float:
    """The number of documents above which a shingle's idf is less than 1; none has more where the table is that small."""
    most = max(COMMON * documents, FEW)
    return most if most < documents else float("inf")


class Frequencies:
    """The idf of shingles: only counters above COMMON of the documents (and FEW) differ from 1, fewer than shingles a text / COMMON."""

    def __init__(self, documents: int, counters: dict[int, int]):
        self.slots = np.array(sorted(counters), np.int64)
        share = np.array([counters[x] for x in sorted(counters)]) / max(1, documents)
        self.idf = np.clip(np.log(np.minimum(1, share)) / np.log(common(documents) / max(1, documents)), 0.01, 1.0)
        self.table = None

    def of(self, hashes: np.ndarray) -> np.ndarray | None:
        """None if all are 1."""
        if not len(self.slots):
            return None
        if self.table is None:
            self.table = np.ones(SKETCH)
            self.table[self.slots] = self.idf
        return self.table[(hashes >> _SLOT).astype(np.int64)]

    def __getstate__(self):
        return self.__dict__ | {"table": None}


def frequencies(rows: DataFrame) -> Frequencies:
    """Of a DataFrame of texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            n += batch.num_rows
            for a, b in slices(offsets, CHUNK):
                hashes, _, _ = counted(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                total += np.bincount((hashes >> _SLOT).astype(np.int64), minlength=SKETCH)
        if n:
            parts = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in total.reshape(-1, SLICE)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([-1, *range(len(parts))], pa.int32()), "n": pa.array([n, *[0] * len(parts)], pa.int64()), "counts": pa.array([b"", *parts], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        numbers: dict[int, int] = {}
        for batch in batches:
            for s, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
                numbers[s] = numbers.get(s, 0) + n
                if s >= 0:
                    totals[s] = np.frombuffer(zlib.decompress(counts), "<i8") + totals.get(s, 0)
        if numbers:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(numbers), pa.int32()), "n": pa.array(list(numbers.values()), pa.int64()), "counts": pa.array([zlib.compress(totals[s].astype("<i8").tobytes(), 1) if s >= 0 else b"" for s in numbers], pa.binary())})

    kind = "slice int, n long, counts binary"
    parts = map_arrow(rows, gather, kind).repartition(SKETCH // SLICE, "slice").mapInArrow(merge, kind).collect()  # one row a slice
    documents = sum(r.n for r in parts)
    counters = {}
    for r in parts:
        if r.slice >= 0:
            total = np.frombuffer(zlib.decompress(r.counts), "<i8")
            for i in np.flatnonzero(total > common(documents)).tolist():
                counters[r.slice * SLICE + i] = int(total[i])
    return Frequencies(documents, counters)


def samples(hashes: np.ndarray, doc: np.ndarray, counts: np.ndarray, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles and, for each, its BANDS * ROWS samples (32-bit names of shingle and level)."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.zeros((len(first), BANDS * ROWS), np.uint64)
    if not len(first):
        return doc[first], out
    v = variates()
    weights = counts if idf is None else counts * idf
    other = np.flatnonzero(weights != 1)
    log, low, mine = np.log(weights[other]), hashes & _LOW, hashes[other]
    for k, seed in enumerate(_SEEDS):
        keys = v["unit"][((hashes * seed) >> _PLACE).astype(np.int64)] | low
        if len(other):
            at = ((mine * seed) >> _PLACE).astype(np.int64)
            r, b = v["r"][at], v["b"][at]
            level = np.floor(log / r + b)
            a = v["c"][at] * np.exp(-r * (level - b) - r)
            keys[other] = _ordered(a) | ((mine + level.astype(np.int64).view(np.uint64) * np.uint64(bytescan.WINDOW)) & _LOW)
        out[:, k] = np.minimum.reduceat(keys, first) & _LOW
    return doc[first], out


def bands(sampled: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sampled), BANDS), np.uint64)
    for j in range(BANDS):
        h = np.full(len(sampled), j + 1, np.uint64)
        for i in range(ROWS):
            h = bytescan.mix(h * np.uint64(bytescan.WINDOW) + sampled[:, j * ROWS + i])
        out[:, j] = h
    return out.view(np.int64)


def _signatures(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            found = np.zeros((batch.num_rows, BANDS), np.int64)
            has = np.zeros(batch.num_rows, np.int64)
            for a, b in slices(offsets, CHUNK):
                hashes, doc, counts = counted(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                docs, sampled = samples(hashes, doc, counts, known.of(hashes))
                found[a + docs] = bands(sampled)
                has[a + docs] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]), pa.int32()), pa.array(found[has > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "content", "bands"])

    return run


def similarities(first: pa.Array, second: pa.Array, weights: Frequencies) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts; 0 where both have no words."""
    n = len(first)
    low, high = np.zeros(n), np.zeros(n)
    (data, cut), (data2, cut2) = text_bytes(first), text_bytes(second)
    for a, b in slices(cut + cut2, 2 * CHUNK):
        h, doc, tf = counted(*shingles(data[cut[a] : cut[b]], cut[a : b + 1] - cut[a]))
        h2, doc2, tf2 = counted(*shingles(data2[cut2[a] : cut2[b]], cut2[a : b + 1] - cut2[a]))
        idf, idf2 = weights.of(h), weights.of(h2)
        w, w2 = tf if idf is None else tf * idf, tf2 if idf2 is None else tf2 * idf2
        total = np.bincount(doc, w, b - a) + np.bincount(doc2, w2, b - a)
        keys, owner, both = np.concatenate([h, h2]), np.concatenate([doc, doc2]), np.concatenate([w, w2])
        order = np.lexsort((keys, owner))
        keys, owner, both = keys[order], owner[order], both[order]
        equal = np.flatnonzero((keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1]))
        shared = np.bincount(owner[equal], np.minimum(both[equal], both[equal + 1]), b - a)
        low[a:b], high[a:b] = shared, total - shared
    return np.divide(low, high, out=np.zeros(n), where=high > 0)


def _links(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value
        for batch in batches:
            kept = pa.array(similarities(batch.column(2), batch.column(3), known) >= threshold - 1e-9)
            yield batch.select([0, 1]).filter(kept)

    # a leader of very many pairs is dealt to several keys, with a copy of its text for each
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / LEADER).cast("int").alias("parts"))
    shown = texts.join(parts.withColumnRenamed("b", "rep"), "rep").select(F.col("rep").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("tb"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    one = dealt.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(shown, ["b", "part"])
    return map_arrow(two.select("a", "b", "ta", "tb"), run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(rep, comp): the smallest rep that links lead to; only reps with links. Repeats until nothing changes."""
    both = scratch.write(links.union(links.select("b", "a")).toDF("u", "v").distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "rep"), f"{name}-0")
    for i in range(1, ROUNDS):
        near = both.join(labels.toDF("v", "c"), "v").groupBy("u").agg(F.min("c").alias("c"))
        new = labels.join(near.withColumnRenamed("u", "rep"), "rep").select("rep", F.least("comp", "c").alias("comp"), F.col("comp").alias("was"))
        new = new.join(labels.toDF("comp", "up"), "comp", "left")  # the label of the label
        new = scratch.write(new.select("rep", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was"), f"{name}-{i}")
        changed = new.filter("comp <> was").limit(1).count()
        labels = new.select("rep", "comp")
        scratch.drop(f"{name}-{i - 1}")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _mixed(buckets: DataFrame, comps: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the buckets that hold several components, with comp, the bucket's largest (top) and a member of it (leader)."""
    rows = buckets.select("rep", "bucket").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.max(F.struct(F.xxhash64("rep", F.lit(name)), "rep")).alias("pick"))
    several = sizes.groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp", "pick")).alias("x")).filter("comps > 1")
    several = scratch.write(several.select("bucket", F.col("x.comp").alias("top"), F.col("x.pick.rep").alias("leader")), f"{name}-top")
    return scratch.write(rows.join(several, "bucket"), name), several


_ITEM = np.dtype([("hash", "<u8"), ("weight", "<f4"), ("texts", "<u4"), ("mixed", "?")])


def _even_names(spark, n: int) -> np.ndarray:
    """n numbers that Spark's hash deals to n partitions, one to each."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(40 * n).groupBy(place.alias("p")).agg(F.min("id").alias("id")).collect()
    names = [r.id for r in found]
    return np.array(names + [40 * n + i for i in range(n - len(names))], np.int64)


def _prefix_pairs(apart: DataFrame, texts: DataFrame, weights, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that can be similar enough, of apart (rep, comp), by prefixes of rare shingles."""
    parts = max(8, -(-apart.count() // PART))
    names = _even_names(apart.sparkSession, parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            reps, comps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in slices(offsets, CHUNK):
                h, doc, tf = counted(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                idf = known.of(h)
                part = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                items = np.zeros(len(h), _ITEM)
                items["hash"], items["weight"] = h, tf if idf is None else tf * idf
                order = np.lexsort((part, doc))
                items, key = items[order], (doc * parts + part)[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                ends = np.append(first, len(key))[1:]
                at = key[first]
                yield pa.RecordBatch.from_pydict({"part": pa.array(names[at % parts], pa.int32()), "rep": pa.array(reps[a + at // parts]), "comp": pa.array(comps[a + at // parts]), "items": pa.array([items[x:y].tobytes() for x, y in zip(first, ends)], pa.binary())})

    def grouped(batches: Iterator[pa.RecordBatch]):
        """Consecutive rows of one key: the key, and their other columns."""
        from itertools import groupby

        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for key, group in groupby(rows, key=lambda r: r[0]):
            yield key, list(zip(*group))[1:]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (reps, comps, raw) in grouped(batches):
            each = [np.frombuffer(x, _ITEM) for x in raw]
            items, sizes = np.concatenate(each), np.array([len(x) for x in each])
            comp = np.repeat(np.array(comps), sizes)
            _, inverse, number = np.unique(items["hash"], return_inverse=True, return_counts=True)
            low, high = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
            np.minimum.at(low, inverse, comp)
            np.maximum.at(high, inverse, comp)
            items["texts"], items["mixed"] = number[inverse], (low < high)[inverse]
            cut = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "comp": pa.array(comps, pa.int64()), "items": pa.array([items[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())})

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, (comps, raw) in grouped(batches):
            items = np.frombuffer(b"".join(raw), _ITEM)
            items = items[np.lexsort((items["hash"], items["texts"]))]
            total = np.cumsum(items["weight"].astype(float))
            n = int(np.searchsorted(total, (1 - threshold) * total[-1] + 1e-4, side="right")) + 1
            kept = np.flatnonzero(items["mixed"][:n])
            full = lambda x, kind: pa.array(np.full(len(kept), x, kind))
            yield pa.RecordBatch.from_pydict({"rep": full(rep, np.int64), "comp": full(comps[0], np.int64), "shingle": pa.array(items["hash"][kept].view(np.int64)), "weight": full(total[-1], np.float64), "behind": pa.array(total[-1] - total[kept] + items["weight"][kept])})

    kind = "rep long, comp long, items binary"
    rows = map_arrow(apart.join(texts, "rep").select("rep", "comp", "text"), spread, f"part int, {kind}")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, kind)
    rows = rows.repartition("rep").sortWithinPartitions("rep").mapInArrow(prefixes, "rep long, comp long, shingle long, weight double, behind double")
    rows = scratch.write(rows, "prefixes")
    # behind: the weight of the shingle and those after it. The lighter text is the left side of the join.
    least = threshold / (1 + threshold)
    # Similar texts weigh within a factor of the threshold, so only texts of one or two neighbouring ranges of weight meet.
    step = -float(np.log(threshold)) + 1e-6
    at = F.floor(F.log("weight") / step).cast("int")
    light = rows.filter(F.col("behind") >= 2 * least * F.col("weight") - 1e-4).withColumn("range", F.explode(F.array(at, at + 1)))
    heavy = rows.withColumn("range", at).toDF("rep2", "comp2", "shingle", "weight2", "behind2", "range")
    order = "(weight < weight2 or (weight = weight2 and rep < rep2))"
    met = light.join(heavy, ["shingle", "range"]).filter(f"comp <> comp2 and {order} and least(behind, behind2) >= {least!r}D * (weight + weight2) - 1e-4D")
    return met.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")).distinct()


def classes(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class) and content (its text's md5)."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    weights = spark.sparkContext.broadcast(frequencies(source.select("text")))
    hashed = source.select("doc_id", F.md5(F.col("text").cast("binary")).alias("content"), "text")
    signed = scratch.write(map_arrow(hashed, _signatures(weights), "doc_id long, content string, bands array<bigint>"), "signed")
    reps = signed.filter("content is not null").groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    reps = scratch.write(reps, "reps")
    every = reps.filter("rep is not null").select("rep", F.explode("bands").alias("bucket"))
    leaders = every.groupBy("bucket").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    leaders = scratch.write(leaders, "leaders")  # apart from the join, so that Spark can split a bucket of very many texts
    buckets = scratch.write(every.join(leaders, "bucket"), "buckets")
    pairs = scratch.write(buckets.filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "pairs-0")
    wanted = scratch.write(buckets.select("rep").distinct().join(reps.select("rep", F.col("content").alias("md5")), "rep"), "wanted")
    if wanted.count() <= BROADCAST:  # ids and digests; else the texts move to them
        wanted = F.broadcast(wanted)
    found = source.withColumnRenamed("doc_id", "rep").join(wanted, "rep").filter(F.md5(F.col("text").cast("binary")) == F.col("md5"))
    texts = scratch.write(found.groupBy("rep").agg(F.first("text").alias("text")), "texts")
    links = scratch.write(_links(pairs, texts, weights, threshold), "links-0")
    comps = components(links, scratch, "comps-0")

    members, _ = _mixed(buckets, comps, scratch, "mixed-1")
    smallest = members.filter("comp <> top").groupBy("bucket").agg(F.min("rep").alias("second"))
    new = members.filter("comp <> top").join(smallest, "bucket").select("rep", F.explode(F.array("leader", "second")).alias("other")).filter("rep <> other")
    new = new.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct()
    second = scratch.write(new.join(pairs, ["a", "b"], "left_anti"), "pairs-1")
    links = links.union(scratch.write(_links(second, texts, weights, threshold), "links-1"))
    comps = components(links, scratch, "comps-1")

    members, _ = _mixed(members.select("rep", "bucket"), comps, scratch, "mixed-2")
    apart = scratch.write(members.select("rep", "comp").distinct(), "apart")
    new = _prefix_pairs(apart, texts, weights, threshold, scratch)
    last = scratch.write(new.join(pairs.union(second), ["a", "b"], "left_anti"), "pairs-2")
    found = scratch.write(_links(last, texts, weights, threshold), "links-2")
    if found.limit(1).count():
        comps = components(links.union(found), scratch, "comps-2")
    scratch.drop("texts")
    of = reps.select("content", "rep").join(comps, "rep", "left").select("content", F.coalesce("comp", "rep").alias("class"))
    out = signed.select("doc_id", "content").join(of, "content", "left")
    return out.select("doc_id", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("class")).alias("class_id"), "content")


def deduplicate(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each class: that with the smallest doc_id; rows without doc_id stay only where their class has none.

    The columns stay. Of repeated rows of one doc_id one stays.
    """
    found = classes(docs, scratch, key, text, threshold)
    kept = found.filter("doc_id = class_id").select("doc_id").distinct()
    k, m = free_name(docs, "__key"), free_name(docs, "__md5")
    rows = docs.withColumn(k, F.col(f"`{key}`").cast("long"))
    rows = rows.join(kept.withColumnRenamed("doc_id", k), k, "left_semi").dropDuplicates([k]).select(*(F.col(f"`{c}`") for c in docs.columns))
    unknown = found.filter("doc_id is null and class_id is null").select("content").distinct()
    bare = docs.filter(F.col(f"`{key}`").isNull()).withColumn(m, F.md5(F.col(f"`{text}`").cast("binary")))
    nulls = bare.filter(F.col(m).isNull()).drop(m)
    bare = bare.join(unknown.withColumnRenamed("content", m), m, "left_semi").dropDuplicates([m]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return rows.unionAll(bare).unionAll(nulls)
