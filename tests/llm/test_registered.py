"""The registered queries over the smallest tables: against SQL where there is some, else against plain versions."""

import duckdb
import numpy as np
import pytest
from rowlake.llm import queries, secrets, tokens

from tests.llm import test_neardup
from tests.llm.brute import crc, ids_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("select doc_id, text from documents order by doc_id").fetchall()


def test_names():
    assert sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])) == [f"op{i}_{n}" for i, n in enumerate(["token_binary", "near_duplicates", "toxicity", "warc", "packing", "chat_format", "quality_rules", "secret_scan", "decontamination", "importance_resampling"], 1)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = duck.sql(queries.oracle_sql()[name])
    at = [got.columns.index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in got.fetchall())


def test_op1(spark, docs):
    start, want = 0, []
    for key, text in docs:
        ids = [*ids_of(text, tokens.vocabulary()), 2]
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.op1_token_binary(spark, SF).collect())) == want


def test_op5(spark, docs):
    got: dict = {}
    room: dict = {}
    rows = queries.op5_packing(spark, SF).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for key, text in docs:
        ids = [*ids_of(text, tokens.vocabulary()), 0]
        total += len(ids)
        cuts = [0, *range(len(ids) - (-(-len(ids) // 2048) - 1) * 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        assert sorted(got[key]) == [(i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(room) <= -(-total // 2048) + 1


def test_op2(spark, docs):
    got = sorted((r.doc_id, r.class_id) for r in queries.op2_near_duplicates(spark, SF).collect())
    assert got == test_neardup.brute(docs)


def test_op3(spark, duck):
    rows = {r.doc_id: r for r in queries.op3_toxicity(spark, SF).collect()}
    known = [(rows[k].score, t) for k, t in duck.sql("select doc_id, toxic from labels").fetchall() if not rows[k].held_out]
    assert len(rows) == 200 and np.mean([s for s, t in known if t]) > np.mean([s for s, t in known if not t])


def test_op8(spark, docs):
    import re

    got = [(r.doc_id, r.start, r.end) for r in queries.op8_secret_scan(spark, SF).collect()]
    assert sorted(got) == [(k, m.start(), m.end()) for k, t in docs for m in re.finditer(secrets.PATTERN, t or "")]


def test_op10(spark):
    rows = queries.op10_importance_resampling(spark, SF).collect()
    assert len(rows) == 200 and sum(r.kept for r in rows) == 180 and min(r.draw for r in rows if r.kept) > max(r.draw for r in rows if not r.kept)
