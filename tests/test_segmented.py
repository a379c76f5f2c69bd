"""Carried values against a plain loop, with a key that has most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from inspectra.operators.incidents import history, previously_flagged
from inspectra.operators.reports import latency_quantiles
from inspectra.operators.segmented import last_before


@pytest.mark.parametrize("segments", [1, 7, 40])
def test_last_before(spark, segments):
    rng = random.Random(segments)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randint(0, 300), i, rng.choice([None, None, i]), rng.choice([None, f"v{i}"])) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, at int, id long, x long, y string")
    want, last = [], {}
    for k, at, i, x, y in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        have = last.setdefault(k, [None, None])
        want.append((k, at, i, x, y, *have))
        last[k] = [have[0] if x is None else x, have[1] if y is None else y]
    got = last_before(df, "key", ["at", "id"], ["x", "y"], segments)
    assert got.columns == [*df.columns, "before_x", "before_y"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_a_hot_key_is_several_segments(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("key"), "id", F.when(F.col("id") % 5000 == 0, F.col("id")).alias("x"))
    got = last_before(rows, "key", ["id"], ["x"], 8)
    assert got.where("before_x <> ((id - 1) div 5000) * 5000 OR (before_x IS NULL AND id > 0)").count() == 0
    assert got.count() == 20_000


def test_nothing(spark):
    assert last_before(spark.createDataFrame([], "key string, at int, x int"), "key", ["at"], ["x"]).count() == 0


def test_users_of_it(spark):
    log = spark.createDataFrame([("k", 1, "a", 1), ("k", 2, None, 2), ("k", 3, "b", 2), ("k", 4, "b", None), ("j", 1, None, 5)], "id string, at int, status string, n int")
    assert sorted(map(tuple, history(log, "id", "at", ["status", "n"]).collect())) == [("k", 2, "n", "1", "2"), ("k", 3, "status", "a", "b")]
    seen = lambda rows: spark.createDataFrame(rows, "id long, user string, created_at int")
    got = previously_flagged(seen([(1, "u", 5), (2, "u", 1), (3, None, 9), (4, "w", 3)]), seen([(9, "u", 2), (8, "u", 5), (7, "u", 6)]))
    assert sorted(map(tuple, got.collect())) == [(1, "u", 5, 8), (2, "u", 1, None), (4, "w", 3, None)]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_quantiles(spark, q):
    rng = random.Random(14)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1.0, rng.random(), rng.random()])) for _ in range(700)] + [("none", None), ("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: (r.x, r.n) for r in df.groupBy("g").agg(F.percentile("v", F.lit(q)).alias("x"), F.count("*").alias("n")).collect()}
    got = {r.g: (r.quantile, r.n) for r in latency_quantiles(df, "g", "v", q).collect()}
    assert got.keys() == want.keys()
    assert all(got[g][1] == want[g][1] and got[g][0] == (want[g][0] if want[g][0] is None else pytest.approx(want[g][0], abs=1e-12)) for g in want)
