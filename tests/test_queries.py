"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest
from rowlake import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(x):
    return float(f"{x:.9g}") + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    got = duck.sql(sql)
    assert sorted(got.columns) == columns
    assert {c: KINDS[df.schema[c].dataType.simpleString()] for c in columns} == {c: str(t) for c, t in zip(got.columns, got.types)}
    at = [got.columns.index(c) for c in columns]
    assert rows == sorted(repr([norm(r[i]) for i in at]) for r in got.fetchall())
