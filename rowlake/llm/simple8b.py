"""Simple-8b: ids packed into 64-bit words, in blocks that decode independently.

The top four bits of a word select how many values of how many bits fill the other sixty. Selectors 1 to 13 pack
60 x 1 up to 2 x 30 bits; 14 is the escape, a lone value of up to 60 bits which its neighbours would have to be widened
for; 0 isn't used. Ids lie in blocks of BLOCK; every block begins a new word, and the offsets of the blocks' first
words make them decodable side by side. All steps work on all blocks of a frame at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: How many values of how many bits a selector stands for.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_TABLE = BITS[np.searchsorted(1 << BITS[1:], np.arange(1 << 16), side="right") + 1].astype(np.int8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """The least of BITS that holds each id."""
    if int(ids.max()) < len(_TABLE):
        return _TABLE[ids.astype(np.int64)]
    return BITS[np.searchsorted(np.uint64(1) << BITS[1:].astype(np.uint64), ids, side="right") + 1].astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and for each block the index of its first word with their number at the end."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    if int(ids.max()) >> 60:
        raise ValueError("an id has more than 60 bits")
    blocks = -(-n // BLOCK)
    lanes = np.zeros(blocks * BLOCK, np.uint64)
    lanes[:n] = ids
    lanes = lanes.reshape(blocks, BLOCK)
    choice = np.full((blocks, BLOCK), 14, np.int8)
    at = np.arange(BLOCK, dtype=np.int16)
    width = _widths(lanes)
    for s in range(13, 0, -1):  # narrower selectors overwrite wider ones, as they hold more
        narrow, rows = width <= BITS[s], slice(None)
        if COUNTS[s] >= 8:  # a run of 8 has four of a group; most blocks have none that is so narrow
            rows = np.flatnonzero(np.ascontiguousarray(narrow).view(np.uint32).reshape(blocks, -1).max(axis=1) == 0x01010101)
            narrow = narrow[rows]
        if not narrow.size:
            continue
        stop = np.where(narrow, np.int16(BLOCK), at)
        stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]  # the next value that is too wide
        fits = stop - at >= np.minimum(COUNTS[s], BLOCK - at).astype(np.int16)  # zeros lie behind the block's end
        choice[rows] = np.where(fits, np.int8(s), choice[rows])
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    cursor, lane = np.zeros(blocks, np.int64), np.arange(blocks)
    firsts, chosen, owners = [], [], []
    while len(lane):
        s = choice[lane, cursor]
        firsts.append(lane * BLOCK + cursor)
        chosen.append(s)
        owners.append(lane)
        cursor = cursor + COUNTS[s]
        left = cursor < lengths[lane]
        lane, cursor = lane[left], cursor[left]
    first, chosen = np.concatenate(firsts), np.concatenate(chosen)
    order = np.argsort(first, kind="stable")
    first, chosen = first[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([lanes.ravel(), np.zeros(60, np.uint64)])
    ends = (first // BLOCK + 1) * BLOCK
    for s in range(1, 15):
        mine = np.flatnonzero(chosen == s)
        for i in range(COUNTS[s] if len(mine) else 0):
            p = first[mine] + i
            words[mine] |= np.where(p < ends[mine], padded[p], np.uint64(0)) << np.uint64(i * BITS[s])
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(np.bincount(np.concatenate(owners), minlength=blocks), out=starts[1:])
    return words, starts


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a frame."""
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts.astype(np.int64)))
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    first = before - before[starts[:-1].astype(np.int64)][block] + block * BLOCK
    ends = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in range(1, 15):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        value, mask, p, end = words[mine], np.uint64((1 << int(BITS[s])) - 1), first[mine], ends[mine]
        for i in range(COUNTS[s]):
            kept = p + i < end
            if kept.all():
                out[p + i] = (value >> np.uint64(i * BITS[s])) & mask
            else:
                out[p[kept] + i] = (value[kept] >> np.uint64(i * BITS[s])) & mask
    return out
