"""Token ids of texts, by the tokenizers library.

A byte-level BPE never merges over the bounds of its pre-tokens, so the ids of a text are those of its pre-tokens in a
row. Texts of plain bytes are split here, all at once, and a table remembers the ids that the library gave for each
distinct pre-token (by its 64-bit hash); any other text goes to the library whole, and so does a text that holds the
string of one of the vocabulary's added tokens, which the library cuts out before it splits. Both give the same ids,
which the tests check.

Nulls: a null text is empty and has no ids. A text of any length is encoded whole: plain ones in steps of about STEP
bytes of whole texts, so that one of more bytes than that takes a step alone, with some 20 bytes of memory a byte.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from rowlake.llm import bytescan
from rowlake.llm.common import slices, text_bytes

#: Classes of bytes: letter, digit, white space, other. Plain texts are ASCII without controls, and the letters from
#: U+00C0 to U+027F (their first bytes are C3 to C9), whose class no Unicode version or library disputes.
LETTER, DIGIT, SPACE, OTHER, STRANGE = range(5)
CLASS = np.full(256, STRANGE, np.uint8)
CLASS[0x21:0x7F] = OTHER
CLASS[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
CLASS[0x30:0x3A] = DIGIT
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
#: Bytes of text in one step, slots of the table, ids that it holds before it is emptied, pre-tokens in one call.
STEP, SLOTS, POOL, CALL = 1 << 20, 1 << 20, 6 << 20, 4000
_encoders: dict[str, "Encoder"] = {}


def strange(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the texts that aren't plain."""
    flags = CLASS[data] == STRANGE
    signs = np.flatnonzero(data[:-1] == 0xC3)
    flags[signs] |= (data[signs + 1] == 0x97) | (data[signs + 1] == 0xB7)  # multiplication and division signs
    return bytescan.sums(flags, offsets) > 0


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The starts of the pre-tokens of plain texts, by the rules of byte-level BPE vocabularies.

    A pre-token is a contraction ('s 't 'm 'd 're 've 'll), or a run of letters, of digits or of other characters, each
    with one space before it if there is one, or white space: of a run of it before something else, the last character
    stands apart, or goes with what follows if it is a space.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = CLASS[data]
    begins = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:n])
    begins[offsets] = True
    at = np.flatnonzero(begins)  # runs of one class, and n
    first, after = at[:-1], at[1:]
    text_end = np.zeros(n + 1, bool)
    text_end[offsets] = True
    blank = (kind[first] == SPACE) & ~text_end[after]
    last = after[blank] - 1
    begins[last] = True
    joined = last[data[last] == 0x20] + 1
    begins[joined] = False
    quote = first[(data[first] == 0x27) & (after - first == 1) & ~text_end[after]]
    quote = quote[begins[quote]]
    if len(quote):
        x, y = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
        inner = ~text_end[np.minimum(quote + 2, n)]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ~one & inner & (((y == 0x65) & ((x == 0x72) | (x == 0x76))) | ((x == 0x6C) & (y == 0x6C)))
        begins[quote[one | two] + 1] = False
        begins[quote[one] + 2] = True
        begins[quote[two] + 3] = True
    return np.flatnonzero(begins[:n])


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        state = json.loads(self.tokenizer.to_str())
        self.added = [x["content"].encode() for x in state.get("added_tokens") or []]
        before = state.get("pre_tokenizer") or {}
        self.split = state.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and state["model"]["type"] == "BPE"
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.split = self.split and len(self.newline) == 1
        self.reset()

    def odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Flags of the texts that go to the library whole: those that aren't plain or hold an added token's string."""
        flags, raw = strange(data, offsets), data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                flags[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        return flags

    def reset(self) -> None:
        self.keys, self.offset, self.count = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the pool and counts of the ids of pre-tokens; line feeds part them in the library's calls."""
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        alone = [i for i, x in enumerate(parts) if b"\n" in x or x.isspace()]
        rest = np.setdiff1d(np.arange(len(parts)), alone)
        counts, ids = np.zeros(len(parts), np.int64), [np.zeros(0, np.uint32)]
        calls = [rest[i : i + CALL] for i in range(0, len(rest), CALL)]
        for mine, got in zip(calls, self.library([b"\n".join([parts[i] for i in c]).decode() for c in calls])):
            cut = np.concatenate([[-1], np.flatnonzero(got == self.newline[0]), [len(got)]])
            if len(cut) != len(mine) + 1:
                raise AssertionError("the library splits the text in another way")
            counts[mine] = np.diff(cut) - 1
            ids.append(got[got != self.newline[0]])
        for i, got in zip(alone, self.library([parts[i].decode() for i in alone])):
            counts[i] = len(got)
            ids.append(got)
        order = np.concatenate([rest, np.array(alone, np.int64)]).astype(np.int64)
        flat = np.concatenate(ids)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(flat) + POOL // 4, np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        places = np.zeros(len(parts), np.int64)
        places[order] = self.used + np.concatenate([[0], np.cumsum(counts[order])])[:-1]
        self.used += len(flat)
        return places, counts

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > POOL:
            self.reset()
        start = split(data, offsets)
        end = np.append(start, len(data))[1:]
        hashes = bytescan.hash_spans(data, start, end)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        places, counts = self.offset[slot], self.count[slot].astype(np.int64)
        missed = np.flatnonzero(self.keys[slot] != hashes)
        if len(missed):
            new, first, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            p, c = self._learn(data, start[missed[first]], end[missed[first]])
            places[missed], counts[missed] = p[inverse], c[inverse]
            slot = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            self.keys[slot], self.offset[slot], self.count[slot] = new, p, c
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(places - before[:-1], counts) + np.arange(before[-1])]
        return ids, before[np.searchsorted(start, offsets)]

    def encode_column(self, column: pa.Array):
        """Yields (first text, ids, offsets of the texts' ids) for consecutive texts; null is empty."""
        data, offsets = text_bytes(column)
        for a, b in slices(offsets, STEP):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            odd = self.odd(part, bounds) if self.split and len(part) else np.ones(b - a, bool)
            if not odd.any():
                yield a, *self._plain(part, bounds)
                continue
            lengths = np.diff(bounds)
            kept = np.where(odd, 0, lengths)
            ids, cut = self._plain(part[np.repeat(~odd, lengths)], np.concatenate([[0], np.cumsum(kept)]))
            whole = iter(self.library([part[bounds[i] : bounds[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)]))
            parts = [next(whole) if o else ids[x:y] for o, x, y in zip(odd, cut[:-1], cut[1:])]
            yield a, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode(self, text: str | None) -> list[int]:
        return np.concatenate([np.zeros(0, np.uint32), *(ids for _, ids, _ in self.encode_column(pa.array([text], pa.string())))]).tolist()


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
