import zlib

import numpy as np
import pyarrow as pa
import pytest
from rowlake.llm import resample, toxicity
from rowlake.llm.common import Scratch

from tests.llm.brute import TEXTS, frame


def corpus(n=900):
    rng = np.random.default_rng(4)
    docs, labels = list(TEXTS), []
    for i in range(1000, 1000 + n):
        words = [f"w{x}" for x in rng.integers(0, 500, rng.integers(1, 120))]
        bad, junk = i % 7 == 0, i % 5 == 0
        if bad:
            words.insert(int(rng.integers(len(words) + 1)), str(rng.choice(["Nasty", "vile"])))
        if junk:
            words = [x + "$$$" for x in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(bad), "x"))
    return docs, [*labels, (None, 1, 1, "x"), (1000, None, None, "x"), (1001, 1, None, "x"), (10**9, 1, 1, "x")]


def test_toxicity_held_out(spark):
    docs, labels = corpus(2500)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    df = frame(spark, docs)
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.train(df, known)).collect()}
    truth = {k: t for k, _, t, _ in labels if k and t is not None and k in got}
    out = [(got[k].score, t, got[k].predicted) for k, t in truth.items() if got[k].held_out]
    assert all(r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert np.mean([p == t for _, t, p in out]) > 0.97 and min(s for s, t, _ in out if t) > max(0.1, np.median([s for s, t, _ in out if not t]))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_score_is_the_sum_of_distinct_features(spark):
    text = "a b c a b c a"
    x, doc = toxicity.features(*toxicity.text_bytes(pa.array([text])))
    assert len(set(x.tolist())) == 3 + 3 + 3 and len(x) == 7 + 6 + 5
    model = (-1.0, np.unique(x), np.full(len(np.unique(x)), 0.25))
    assert toxicity.score(frame(spark, [(1, text)]), model).first().score == pytest.approx(1 / (1 + np.exp(1.0 - 9 * 0.25)))


def plain_ftrl(rows, labels, epochs=toxicity.EPOCHS):
    """FTRL-proximal as its paper writes it, a coordinate at a time."""
    from math import exp, log, sqrt

    z, n, ones = {}, {}, sum(labels)
    bias, bias_n, l1 = log((ones + 0.5) / (len(labels) - ones + 0.5)), 1.0, max(1.0, 0.045 * len(labels) ** 0.5)
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((1.0 + sqrt(n[i])) / 1.0 + 1.0)
    for _ in range(epochs):
        for row, y in zip(rows, labels):
            w = {i: weight(i) for i in row.tolist()}
            g = 1 / (1 + exp(-max(-30, min(30, bias + sum(w.values()))))) - y
            for i, x in w.items():
                sigma = sqrt(n.get(i, 0.0) + g * g) - sqrt(n.get(i, 0.0))
                z[i], n[i] = z.get(i, 0.0) + g - sigma * x, n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= g / sqrt(bias_n)
    return bias, {i: weight(i) for i in z if abs(z[i]) > l1}


def test_fit_is_plain_ftrl_proximal():
    rng = np.random.default_rng(9)
    marks = (rng.random(150) < 0.3).astype(float)
    rows = [np.unique(np.append(rng.integers(0, 400, 20), [7] if y else [9])).astype(np.int32) for y in marks]
    bias, at, w = toxicity.fit(rows, marks)
    want_bias, want = plain_ftrl(rows, marks.tolist())
    assert bias == pytest.approx(want_bias) and dict(zip(at.tolist(), w.tolist())) == pytest.approx(want)
    assert 0 < len(want) < 400  # L1 leaves most coordinates at 0


def test_repeated_labelled_rows_are_learned_once(spark):
    docs, labels = corpus(300)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    once, again = toxicity.train(frame(spark, docs), known), toxicity.train(frame(spark, docs + docs[50:150] * 3), known)
    assert once[0] == again[0] and once[1].tolist() == again[1].tolist() and once[2].tolist() == again[2].tolist()


def test_long_texts_and_texts_without_blanks(spark):
    docs, labels = corpus(400)
    long = [(1, "fine " * 20000 + "Nasty"), (2, "y" * 300_000), (3, "fine " * 20000)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    df = frame(spark, docs[len(TEXTS) :] + long)
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, known)).collect()}
    assert all(0 <= got[k] <= 1 for k, _ in long) and got[1] >= got[3]
    assert {r.doc_id for r in resample.resample(df, known, Scratch(spark, "t")).collect()} >= {1, 2, 3}


def test_resampling_prefers_the_target(spark):
    """Of the sample tables' labelled rows, those of quality 1 stay more often."""
    import duckdb
    from rowlake.llm import queries

    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in queries.op10_importance_resampling(spark, sf).collect()}
    rows = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet' where quality is not null").fetchall()
    share = {q: np.mean([kept[k] for k, y in rows if y == q]) for q in (0, 1)}
    assert share[1] >= 0.97 and share[0] <= 0.7


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(frame(spark), toxicity.train(frame(spark), none)).collect()} == {0.5}
    assert toxicity.score(frame(spark, []), toxicity.train(frame(spark, []), none)).count() == 0


def test_resampling(spark):
    docs, labels = corpus()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = resample.resample(frame(spark, docs), known, Scratch(spark, "t"), share=0.8).collect()
    draws = sorted((r.draw for r in got), reverse=True)
    k = int(np.ceil(0.8 * len(docs)))
    assert {r.draw for r in got if r.kept} == set(draws[:k])
    junk = {k for k, q, _, _ in labels if q == 0}
    assert np.mean([r.kept for r in got if r.doc_id not in junk]) > 0.97 > 0.5 > np.mean([r.kept for r in got if r.doc_id in junk])


def test_resampling_weight_is_the_log_ratio(spark):
    docs, labels = corpus(200)
    good = {k for k, q, _, _ in labels if q and k}
    table = resample.models(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    data, offsets = resample.text_bytes(pa.array([t for _, t in docs], pa.string()))
    x, doc = resample.grams(data, offsets)
    raw, target = np.bincount(x, minlength=resample.BUCKETS), np.bincount(x[np.array([k in good for k, _ in docs])[doc]], minlength=resample.BUCKETS)
    want = np.log((target + 1) / (target.sum() + resample.BUCKETS)) - np.log((raw + 1) / (raw.sum() + resample.BUCKETS))
    assert np.allclose(table, want)
    got = sorted(r.log_weight for r in resample.weigh(frame(spark, docs), table).collect())
    assert np.allclose(got, sorted(np.bincount(doc, want[x], len(docs))))


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert resample.resample(frame(spark, []), none, Scratch(spark, "t")).count() == 0
    assert resample.resample(frame(spark), none, Scratch(spark, "t"), share=1.0).filter("kept").count() == len(TEXTS)


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(size=3000)] + [0.5] * 2000 + [1e9, -1e9]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (1, 2, 700, 2500, len(values)):
        assert resample.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
