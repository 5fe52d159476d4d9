"""Words, lines and their 64-bit hashes, found in the UTF-8 bytes of many texts at once.

A word is a longest run of bytes that a table of 256 flags admits. Non-ASCII bytes are either all admitted or all
refused, so that a character is never cut. Hashes are polynomials over the bytes modulo 2**64, then mixed: two given
strings share one with a chance of about 2**-64.

Texts have any length: bytes are hashed BLOCK at a time, and a word that goes on in the next block carries its sum along.
So a text costs a few bytes of flags a byte and some 24 bytes a word, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WINDOW = 0xD1342543DE82EF95
BLOCK = 1 << 18

#: [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
#: A-Z to a-z
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 4 << 20:
        return _accumulated(BASE, n), _accumulated(_INVERSE, n)
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[:] = [_accumulated(BASE, size), _accumulated(_INVERSE, size)]
    return _powers[0][:n], _powers[1][:n]


def _accumulated(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power(max(1, len(data)))[0][: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _power(len(prefix))[1][start])


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int | None = None) -> np.ndarray:
    """The hashes of ascending spans of bytes that don't overlap."""
    block = block or BLOCK
    out = np.zeros(len(start), np.uint64)
    prefix = np.zeros(min(block, len(data)) + 1, np.uint64)
    power, inverse = _power(min(block, len(data)) + 1)
    for a in range(0, len(data), block):
        b = min(len(data), a + block)
        i, j = np.searchsorted(end, a, side="right"), np.searchsorted(start, b)
        if i >= j:
            continue
        terms = data[a:b].astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: b - a]
        np.cumsum(terms, out=prefix[1 : b - a + 1])
        low, high = np.maximum(start[i:j], a) - a, np.minimum(end[i:j], b) - a
        part = (prefix[high] - prefix[low]) * inverse[low]
        if start[i] < a:  # it began in a block before
            part[:1] *= np.array([pow(int(BASE), int(a - start[i]), 1 << 64)], np.uint64)
        out[i:j] += part
    return mix(out)


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64)
    found = np.add.reduceat(np.append(flags, False), offsets[:-1], dtype=np.int64)
    found[np.diff(offsets) == 0] = 0
    return found


@dataclass
class Words:
    """start, end: byte spans of the words; first: for each text the index of its first word, and their number at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans(admitted: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest admitted runs; none goes over the bounds of a text."""
    n = len(admitted)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = admitted[:-1]
    before[inner] = False
    after = np.zeros(n, bool)
    after[:-1] = admitted[1:]
    after[inner - 1] = False
    return np.flatnonzero(admitted & ~before), np.flatnonzero(admitted & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, admitted: np.ndarray, fold: np.ndarray = IDENTITY) -> Words:
    """offsets begin at 0 and end at len(data)."""
    if fold is not IDENTITY:
        data = fold[data]
    start, end = spans(admitted[data], offsets)
    return Words(data, start, end, np.searchsorted(start, offsets), hash_spans(data, start, end))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, by its first word; runs over the bounds of texts are included."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(WINDOW)
        out += hashes[i : i + n]
    return mix(out)


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """The first words of the runs of `size` words that lie inside a text, and each run's text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    skipped = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.arange(counts.sum()) - skipped[doc] + first[:-1][doc], doc


def covered(hit: np.ndarray, size: int, n: int) -> np.ndarray:
    """Flags of the n words that lie in a run of `size` words that begins at one of `hit`."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, np.minimum(hit + size, n), -1)
    return np.cumsum(steps[:n]) > 0
