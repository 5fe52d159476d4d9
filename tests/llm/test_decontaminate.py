import random
import re

import numpy as np
import pyarrow as pa
import pytest
from rowlake.llm import decontaminate

from tests.llm.brute import TEXTS, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    wins = {}
    for key, text in items:
        words = WORD.findall(low(text))
        for i in range(max(1, len(words) - 9) if words else 0):
            wins.setdefault(tuple(words[i : i + 10]), set()).add(key or "")
    out = []
    for key, text in docs:
        words, hit, found = WORD.findall(low(text)), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(words) - size + 1):
                if names := wins.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= names
        out.append((key, len(words), len(hit), sorted(found)))
    return out


def tables():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(i), say(rng.choice([3, 10, 14, 30]))) for i in range(25)] + [("25", "x"), ("26", None), (None, say(12)), ("3", say(15)), ("28", ""), ("4", None)]
    docs = list(TEXTS)
    for i in range(60):
        parts = [say(rng.randint(0, 40))]
        for _ in range(i % 3):
            words = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 4)
            parts += [", ".join(words[a : a + 16]).upper() if i % 2 else "\n".join(words), say(5)]
        docs.append((100 + i, "! ".join(parts)))
    docs.append((300, say(60000)))
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 500])
def test_hits(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    docs, items = tables()
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id string, text string, k string")
    got = decontaminate.find_hits(frame(spark, docs), bench).collect()
    want = brute(docs, items)
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got])) == sorted(map(str, want))
    texts = {k: t for k, t in docs if k is not None}
    for r in got:
        if r.n_hit:
            assert sum(len(WORD.findall(low(texts[r.doc_id][a:b]))) for a, b in r.spans) == r.n_hit
    dotted = frame(spark, docs).withColumnRenamed("k", "a.b")
    assert decontaminate.decontaminate(dotted, bench).columns == dotted.columns
    clean = {x[0] for x in want if not x[2]}
    assert {r.doc_id for r in decontaminate.decontaminate(frame(spark, docs), bench).collect()} == clean
    spans = decontaminate.decontaminate(frame(spark, docs), bench, "span").collect()
    for r in spans:
        cuts = next(g.spans for g in got if g.doc_id == r.doc_id)
        text, end, out = next(t for k, t in docs if k == r.doc_id), 0, ""
        for a, b in cuts:
            out, end = out + text[end:a], b
        assert r.text == (None if text is None else out + text[end:])


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_hits(frame(spark), none).filter("n_hit > 0").count() == 0
    assert decontaminate.find_hits(frame(spark, []), none).count() == 0
    assert decontaminate.decontaminate(frame(spark), none).count() == len(TEXTS)


def test_equal_hashes_are_verified(spark, monkeypatch):
    docs, items = tables()
    docs, items = docs[:60], items[:12] + items[-6:]
    monkeypatch.setattr(decontaminate.bytescan, "windows", lambda hashes, size: np.full(max(0, len(hashes) - size + 1), 7 << 44, np.uint64))
    index = decontaminate.Index(items)
    got = []
    for key, text in docs:
        w = decontaminate.bytescan.words(*decontaminate.text_bytes(pa.array([text], pa.string())), decontaminate.bytescan.ALNUM, decontaminate.bytescan.LOWER)
        hit, found = np.zeros(len(w.start), bool), {}
        index.scan(w, hit, found)
        got.append((key, len(w.start), int(hit.sum()), sorted(found.get(0, ()))))
    assert got == brute(docs, items) and any(x[2] for x in got)
