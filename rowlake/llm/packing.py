"""Packing of documents into sequences of a fixed number of tokens, by a configuration linear program.

Only the histogram of piece lengths is brought to the driver: at most `room` numbers, whatever the corpus. Over it the
covering program (least number of sequences so that the chosen configurations hold every piece) is solved by
multiplicative weights, at every size: the weights begin at the lengths' own shares of a sequence and each is multiplied
down as its length is covered, a knapsack dynamic program finds the best configuration with each length, and each is
used as often as a quarter of what is left allows, rounded up. Weights over the value of the best configuration are a
dual solution, so every round gives a lower bound of the program; the best of them, and a plain combinatorial bound,
are reported beside the number of sequences, and their ratio is the gap. A configuration never holds more of a length than is left: the next best takes its place. So all that is
chosen is kept, in whole numbers, and the program goes on until it leaves at most ERROR of the tokens. These are placed
by best fit, longest first, each arrangement repeated while the counts allow. A plan is a list of (configuration,
repetitions); its size depends on the number of lengths, not of pieces.

Which piece goes where is arithmetic: the r-th piece of a length belongs to the plan's interval that holds r. Ranks
come from counts by task and length, so no length's pieces meet in one task.

Nulls: a null text is empty and has only the end id. Repeated rows are packed as often as they occur. An empty table
gives an empty one. Columns besides key and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlake.llm import tokens
from rowlake.llm.common import Scratch, map_arrow

PIECES = "task int, nth long, doc_id long, piece int, start long, length long, ids binary"
#: The share of the tokens that the program may leave to best fit, the learning rate of the weights, and how much more a token of a long piece counts.
ERROR, RATE, LONG = 0.02, 1e-4, 1e-4


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """The length (a place in sizes, which ascend) that the most valuable configuration of each room takes first, -1 leaves one place empty; and the value of the whole room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c], k = best[c - 1], upto[c]
        if k:
            gain = best[c - sizes[:k]] + values[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], took[c] = gain[i], i
    return took, float(best[room])


def plain_bound(sizes: np.ndarray, counts: np.ndarray, room: int) -> int:
    """A lower bound of the sequences without any program: pieces too long to share, and the tokens of the rest, for each limit."""
    best = 0
    for k in range(1, room // 2 + 2):
        alone, large, small = sizes > room - k, (sizes <= room - k) & (sizes > room // 2), (sizes <= room // 2) & (sizes >= k)
        free = int(counts[large].sum()) * room - int((counts * sizes)[large].sum())
        best = max(best, int(counts[alone].sum() + counts[large].sum()) + max(0, -(-(int((counts * sizes)[small].sum()) - free) // room)))
    return best


def program(sizes: np.ndarray, left: np.ndarray, room: int, use, error: float = ERROR) -> float:
    """Chooses configurations until those that hold at most `error` of the tokens are left in `left`; use(counts, times) takes them out of it. Gives the best dual bound."""
    demand, total, waste, bound = left.copy(), int(left @ sizes), 0, 0.0
    while int(left @ sizes) > error * total:
        some = np.flatnonzero(left)
        mine, share = sizes[some], 1 - left[some] / demand[some]
        weights, before = mine / room * (1 + LONG * mine / room) * np.exp(-RATE * share), int(left.sum())
        took, most = price(weights, mine, room)
        bound = max(bound, float(demand[some] @ weights) / most)
        took, lengths = took.tolist(), mine.tolist()
        for i in range(len(lengths) - 1, -1, -1):  # the best configuration with each length
            if not left[some[i]]:
                continue
            counts, c = {i: 1}, room - lengths[i]
            while c > 0:
                k = took[c]
                if k < 0 or counts.get(k, 0) == left[some[k]]:  # no more of it: the next room's choice
                    c -= 1
                else:
                    counts[k] = counts.get(k, 0) + 1
                    c -= lengths[k]
            if room - sum(lengths[k] * n for k, n in counts.items()) <= waste:
                whole = np.zeros(len(sizes), np.int64)
                whole[[some[k] for k in counts]] = list(counts.values())
                use(whole, -(-min(int(left[some[k]]) // n for k, n in counts.items()) // 4))
        if before - int(left.sum()) <= before // 400:  # a slow round: the next may waste more; all may be wasted at last, so this ends
            waste = min(room, 2 * waste + 1)
    return bound


def solve(histogram: dict[int, int], room: int, error: float = ERROR, report: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """A plan that holds each length exactly as often as the histogram says: (length -> how many, repetitions). report gets the shares that the program places, both bounds, the sequences and the gap between them."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[x] for x in sizes.tolist()], np.int64)
    if len(sizes) and (sizes[0] < 1 or sizes[-1] > room):
        raise ValueError(f"lengths must lie between 1 and {room}")
    plan: dict[tuple, int] = {}

    def use(counts: np.ndarray, times: int) -> None:
        held = np.flatnonzero(counts)
        key = tuple(zip(sizes[held].tolist(), counts[held].tolist()))
        plan[key] = plan.get(key, 0) + times
        left[:] -= counts * times

    whole = np.flatnonzero(sizes == room)
    for i in whole:  # fills a sequence alone
        use(np.eye(len(sizes), dtype=np.int64)[i], int(left[i]))
    pieces, held, alone, counts = int(left.sum()), int(left @ sizes), sum(plan.values()), left.copy()
    dual = program(sizes, left, room, use, error)
    if report is not None:
        report.update(pieces=1 - int(left.sum()) / max(pieces, 1), tokens=1 - int(left @ sizes) / max(held, 1), dual_bound=alone + int(np.ceil(dual - 1e-6)), plain_bound=alone + plain_bound(sizes, counts, room))
    while left.any():
        counts, space, i = np.zeros(len(sizes), np.int64), room, len(sizes) - 1
        while space > 0 and i >= 0:
            i = min(i, int(np.searchsorted(sizes, space, side="right")) - 1)
            while i >= 0 and left[i] == counts[i]:
                i -= 1
            if i < 0:
                break
            n = min(space // sizes[i], left[i] - counts[i])
            counts[i] += n
            space -= n * sizes[i]
            i -= 1
        held = counts > 0
        use(counts, int((left[held] // counts[held]).min()))
    if report is not None:
        report["sequences"] = sum(plan.values())
        report["gap"] = report["sequences"] / max(1, report["dual_bound"], report["plain_bound"]) - 1
    return [(dict(key), times) for key, times in plan.items()]


class Places:
    """Where the r-th piece of a length goes under a plan."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        intervals: dict[int, list] = {}
        sequence = 0
        for counts, times in plan:
            offset = 0
            for size, k in sorted(counts.items(), reverse=True):
                intervals.setdefault(size, []).append((k * times, k, sequence, offset))
                offset += size * k
            sequence += times
        self.sequences = sequence
        self.by = {size: tuple(np.array(x, np.int64) for x in zip(*rows)) for size, rows in intervals.items()}
        self.ends = {size: np.cumsum(rows[0]) for size, rows in self.by.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cut = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(order))):
            mine, size = order[a:b], int(lengths[order[a]])
            n, k, first, place = self.by[size]
            i = np.searchsorted(self.ends[size], ranks[mine], side="right")
            at = ranks[mine] - (self.ends[size][i] - n[i])
            sequence[mine] = first[i] + at // k[i]
            offset[mine] = place[i] + at % k[i] * size
        return sequence, offset


def _cut(path: str, end_id: int, room: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, coder, seen = TaskContext.get().partitionId(), tokens.encoder(path), [0] * (room + 1)
        end = np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("task", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, cut in coder.encode_column(batch.column(1)):
                rows = []
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    raw, n, at = ids[a:b].astype("<u4").tobytes() + end, b - a + 1, 0
                    for piece in range(-(-n // room)):
                        stop = n - (-(-n // room) - 1 - piece) * room
                        rows.append((task, seen[stop - at], keys[first + i], piece, at, stop - at, raw[4 * at : 4 * stop]))
                        seen[stop - at] += 1
                        at = stop
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return cut


def cut_pieces(docs: DataFrame, scratch: Scratch, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, room: int = 2048) -> DataFrame:
    """Encodes each text, cuts what is longer than `room`, and writes the pieces to the shared folder."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return scratch.write(map_arrow(rows, _cut(tokenizer, end_id, room), PIECES), "pieces")


def pack(pieces: DataFrame, room: int = 2048) -> DataFrame:
    """The pieces, without task and nth, with sequence_id and offset; every other column stays."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {size: n for size, n in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `room` rows
    places = Places(solve(histogram, room))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    joined = pieces.join(before, ["task", "length"])
    others = [c for c in pieces.columns if c not in ("task", "nth")]
    joined = joined.select(*others, (F.col("before") + F.col("nth")).alias("rank"))
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "rank"), "sequence_id long", "offset long"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, o = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(s), pa.array(o)], names=[*others, "sequence_id", "offset"])

    return joined.mapInArrow(place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: (sequence_id, ids binary), from packed pieces that carry ids. A group is at most `room` ids."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
