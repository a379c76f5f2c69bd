"""Top-k inner products against brute force."""

import duckdb
import numpy as np
import pytest

from inspectra.llm import ball_tree as T


def brute(rows, k, step):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(object)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(ok):
        if q % step == 0:
            got = sorted((-int(sum(int(a) * int(b) for a, b in zip(v, w))), i) for m, (i, w) in enumerate(ok) if m != n and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(got[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("big", [False, True])
def test_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(T, "SHARD_ROWS", 100)
    monkeypatch.setattr(T, "BLOCK_ROWS", 5)
    monkeypatch.setattr(T, "LEAF_ROWS", 8)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * (1e6 if big else 1)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[20][1]) for i in range(300)]  # one large group of equal vectors
    rows += [(2000, [1.0, None] * 3), (2010, None), (2020, []), (2030, [float("nan")] * 6), (2040, [float("inf")] * 6), (None, [1.0] * 6), (2050, [1.0, 2.0]), (2051, [3.0, 2.0]), rows[10]]
    rows += [(0, [3.0, 0.0] * 3), (0, [-1.0, 5.0] * 3), rows[20], rows[20], (7, rows[20][1])]  # ids that come again, with other and with the same vectors
    rows += [(5000, rng.normal(size=6).tolist()) for _ in range(400)]  # and one that many rows have
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    v = T.numbered(T.scaled(df))
    got = sorted(map(tuple, T.top_k(v, v.where("vec_id % 10 = 0"), 5).collect()))
    assert got == brute(rows, 5, 10)


def test_empty(spark):
    v = T.numbered(T.scaled(spark.createDataFrame([], "vec_id long, embedding array<float>")))
    assert T.top_k(v, v).count() == 0


def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, T.op4_ball_tree_topk(spark, sf_dir).collect())) == sorted(con.sql(T.OP4_SQL).fetchall())


def test_tree_prunes():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 8)) * 500
    v = (np.repeat(centres, 64, 0) + rng.normal(size=(1024, 8))).astype(np.int64)
    order, bounds, middle, radii = T.build_tree(v)
    best = T.Best(np.array([-1]), v[:1].astype(float), np.array([-(1 << 63)]), 5)
    assert T.search(best, np.arange(1024)[order], np.arange(1024)[order], v[order].astype(float), bounds, middle, radii) < len(radii) // 4
    want = sorted(zip((-(v @ v[0])).tolist(), range(1024)))[:5]
    assert list(zip((-best.scores[0]).tolist(), best.found[0].tolist())) == want


def test_rows_of_one_id(spark):
    """Every row but the query's own is a candidate."""
    rows = [(1, [3.0, 0.0]), (1, [3.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 1.0])]
    v = T.numbered(T.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1))
    got = sorted(map(tuple, T.top_k(v, v.where("vec_id = 0"), 5).collect()))
    assert got == sorted([(0, 1, 1, 3), (0, 2, 1, 3), (0, 3, 0, 2), (0, 1, 1, 6), (0, 2, 1, 6), (0, 3, 0, 2)])
