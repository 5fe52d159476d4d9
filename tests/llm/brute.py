"""Plain, slow versions of what the corpus operators compute, and small tables to hold them against."""

from __future__ import annotations

import zlib
from array import array

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3), (2, None), (3, ""), (4, "één twee\ndrie"), (5, "x " * 3000),
    (6, "日本語 テキスト 😀 <|endoftext|>"), (7, "tie"), (7, "tie"), (None, "no key"), (9, "a" * 5000), (10, " \n\t "),
]


def frame(spark, rows=TEXTS):
    """documents with clashing extra columns."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, ids string, length string, start string, task string, k string, t string"
    return spark.createDataFrame([(k, t, "en", f"src{i % 2}", len(t or ""), "x", "y", "z", "w", "k", "t") for i, (k, t) in enumerate(rows)], kind)


def ids_of(text: str | None, path: str) -> list[int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(array("I", ids).tobytes())
