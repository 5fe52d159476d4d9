import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from rowlake.llm import neardup
from rowlake.llm.common import Scratch

from tests.llm.brute import TEXTS, frame


def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)


def brute(docs, threshold=0.8):
    """Classes by all pairs: equal texts, and weighted Jaccard similarity of the threshold or more."""
    bags = [bag(t) for _, t in docs]
    df, n = Counter(x for b in bags for x in b), len(docs)
    idf = {x: min(1, max(0.01, np.log(min(1, c / n)) / np.log(0.2))) if c > max(2, 0.2 * n) else 1 for x, c in df.items()}
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(n), 2):
        a, b = bags[i], bags[j]
        if docs[i][1] is None or docs[j][1] is None:
            continue
        low = sum(min(a[x], b[x]) * idf[x] for x in a.keys() & b.keys())
        high = sum(max(a[x], b[x]) * idf[x] for x in a.keys() | b.keys())
        if docs[i][1] == docs[j][1] or high and low / high >= threshold:
            parent[find(j)] = find(i)
    out = {}
    for i, (k, _) in enumerate(docs):
        out.setdefault(find(i), []).append(k)
    return sorted((k, min((x for x in g if x is not None), default=None)) for g in out.values() for k in g if k is not None)


def corpus():
    rng = random.Random(3)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]
    docs, common = list(TEXTS), say(30)
    for g in range(12):
        words = say(rng.choice([30, 120, 400]))
        for c in range(rng.choice([1, 2, 5, 30])):
            new = list(words)
            for _ in range(rng.choice([0, 0, 1, len(words) // 60, len(words) // 25])):
                new[rng.randrange(len(new))] = "edited"
            docs.append((1000 + 100 * g + c, " ".join(new).capitalize() if c % 2 else ", ".join(new)))
    docs += [(3000 + i, " ".join(common + say(15 + i % 40))) for i in range(120)]
    docs += [(5000 + i, "same five words here twice same five words here twice") for i in range(40)]
    return docs


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 300))]
    words = texts[0].split()
    texts += [" ".join(words[:k] + [f"z{i}" for i in range(300 - k)]) for k in (290, 240, 150, 40)] + [" ".join(words * 3)]
    column = pa.array(texts)
    data, offsets = neardup.text_bytes(column)
    hashes, doc, tf = neardup.counted(*neardup.shingles(data, offsets))
    idf = np.where(hashes % np.uint64(3) == 0, 0.3, 1.0)

    class Third(neardup.Frequencies):
        def of(self, h):
            return np.where(h % np.uint64(3) == 0, 0.3, 1.0)

    many = []
    seeds = neardup._SEEDS
    for i in range(30):
        neardup._SEEDS = neardup.bytescan.mix(np.arange(48, dtype=np.uint64) + np.uint64(1000 * i + 77)) | np.uint64(1)
        many.append(neardup.samples(hashes, doc, tf, idf)[1])
    neardup._SEEDS = seeds
    many = np.concatenate(many, axis=1)
    want = neardup.similarities(pa.array(texts[:1] * 6), column, Third(1, {}))
    assert np.abs((many == many[0]).mean(axis=1) - want).max() < 0.05


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    docs = corpus()
    want = brute(docs)
    for part, most in ((neardup.PART, neardup.BROADCAST), (5, 0)):
        monkeypatch.setattr(neardup, "PART", part)
        monkeypatch.setattr(neardup, "BROADCAST", most)
        got = neardup.classes(frame(spark, docs), Scratch(spark, "t")).collect()
        assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == want
        assert len(got) == len(docs)


def test_prefixes_lose_no_pair(spark):
    docs = [(k, t) for k, t in corpus() if k and k >= 1000]
    texts = spark.createDataFrame(docs, "rep long, text string")
    apart = texts.select("rep", (texts.rep / 1).cast("long").alias("comp"))
    weights = spark.sparkContext.broadcast(neardup.Frequencies(len(docs), {}))
    met = {(r.a, r.b) for r in neardup._prefix_pairs(apart, texts, weights, 0.8, Scratch(spark, "t")).collect()}
    bags = {k: bag(t) for k, t in docs}
    similar = {(max(i, j), min(i, j)) for i, j in combinations(bags, 2) if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    assert similar <= met and len(met) < len(docs) ** 2 / 4


def test_deduplicate(spark):
    docs = corpus() + [(None, "no key"), (None, "tie"), (None, None)]
    df = frame(spark, docs).withColumnsRenamed({"ids": "__key", "task": "__md5", "t": "a.b"})
    got = neardup.deduplicate(df, Scratch(spark, "t"))
    assert got.columns == df.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(k for k, _ in rows if k is not None) == sorted({c for _, c in brute(docs)})
    assert sorted(map(str, (t for k, t in rows if k is None))) == ["None", "no key"]


def test_empty(spark):
    assert neardup.classes(frame(spark, []), Scratch(spark, "t")).count() == 0
    assert neardup.deduplicate(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_idf_acts_on_passages_of_very_many_documents(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(n))
    notice = say(90)
    docs = [(i, f"{notice} {say(18)}") for i in range(60)] + [(100 + i, say(60)) for i in range(30)]
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, docs), Scratch(spark, "t")).collect()}
    assert got == {k: k for k, _ in docs} == dict(brute(docs))  # the notice alone makes nothing similar
    plain = [(bag(a), bag(b)) for (_, a), (_, b) in combinations(docs[:10], 2)]
    tf = max(sum((a & b).values()) / sum((a | b).values()) for a, b in plain)
    found = neardup.frequencies(spark.createDataFrame(docs, "k long, text string").select("text"))
    words, doc, n = neardup.counted(*neardup.shingles(*neardup.text_bytes(pa.array([docs[0][1]]))))
    idf = found.of(words)
    assert tf > 0.6 and idf is not None and (idf < 0.3).sum() == 86 and (idf == 1).sum() == len(words) - 86


def test_idf_acts_on_passages_of_a_tenth_of_the_documents(spark):
    """Without idf the texts that carry the notice are similar (0.82), with it they aren't (0.73); near copies stay together."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(n))
    notice = say(154)
    docs = [(i, f"{notice} {say(12)}") for i in range(100)] + [(100 + i, say(60)) for i in range(895)]
    words = docs[500][1].split()
    docs += [(2000 + i, " ".join(words[: 58 - i] + ["edit"] + words[59 - i :])) for i in range(2)] + [(3000 + i, docs[600][1]) for i in range(3)]
    plain = [sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values()) for (_, a), (_, b) in combinations(docs[:5], 2)]
    found = neardup.frequencies(spark.createDataFrame(docs, "k long, text string").select("text"))
    idf = found.of(neardup.counted(*neardup.shingles(*neardup.text_bytes(pa.array([docs[0][1]]))))[0])
    assert min(plain) > 0.8 and (abs(idf - np.log(0.1) / np.log(20 / len(docs))) < 0.01).sum() == 150 and (idf == 1).sum() == 12
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, docs), Scratch(spark, "t")).collect()}
    assert got == {k: 500 if 2000 <= k < 3000 else 600 if k >= 3000 else k for k, _ in docs}


def test_thousands_of_texts_from_templates(spark, monkeypatch):
    """Texts that share one long passage and aren't similar: neither one leader's key nor one shingle's takes them all."""
    monkeypatch.setattr(neardup, "LEADER", 50)
    rng = random.Random(5)
    say = lambda n: " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(n))
    passage = say(60)
    docs = [(i, f"{passage} {say(15 + i % 60)}") for i in range(2000)]
    copy = docs[7][1].split()
    docs += [(5000 + i, " ".join(copy[: 10 + i] + ["edit"] + copy[11 + i :])) for i in range(3)]
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, docs), Scratch(spark, "t")).collect()}
    bags = {k: bag(t) for k, t in docs}
    near = lambda a, b: sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())
    assert all(got[5000 + i] == 7 for i in range(3) if near(7, 5000 + i)) and any(near(7, 5000 + i) for i in range(3))
    assert all(got[k] == k for k, _ in docs[:2000])


def test_long_texts(spark):
    words = [f"v{i % 7919}" for i in range(20000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-9] + ["new"] * 9)), (3, " ".join(words[10000:])), (4, "x" * 200_000), (5, "x" * 200_000), (6, "x" * 199_999)]
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, docs), Scratch(spark, "t")).collect()}
    assert got == dict(brute(docs))
