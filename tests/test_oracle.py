"""Every registered query of the library itself against its SQL."""

from decimal import Decimal

import duckdb
import pytest

import inspectra.queries as Q
import inspectra.index_queries  # noqa: F401
import inspectra.state_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return f"{float(v):.6f}" if isinstance(v, (float, Decimal)) else repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, sf_dir, con, name):
    got = Q.QUERIES[name](spark, sf_dir)
    want = con.sql(Q.ORACLE_SQL[name])
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert a[0] == b[0]
    assert a[1] == b[1]
    assert a[1]


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0
