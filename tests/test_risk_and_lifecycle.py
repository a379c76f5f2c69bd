"""Incremental risk against the full computation; cascades and folds against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inspectra.operators import reports
from inspectra.operators.lifecycle import SCAN_TRANSITIONS, cascade, current_states, fold_states
from inspectra.operators.risk_store import RiskStore


def test_risk_of_any_reference_day(spark, tmp_path):
    rng = random.Random(11)
    t0 = datetime(2024, 1, 1)
    rows = [(rng.choice(["info", "low", "medium", "high", "critical", "odd"]), t0 + timedelta(seconds=rng.randint(0, 150 * 86400)), rng.choice(["a", "b", "", None])) for _ in range(500)] + [("low", t0 + timedelta(days=40), "a"), ("low", None, "a")]
    df = spark.createDataFrame(rows, "severity string, created_at timestamp_ntz, user string").withColumn("n", F.monotonically_increasing_id()).cache()
    store = RiskStore(spark, f"file://{tmp_path}/risk")
    for k in (0, 1, 2, 1):  # one batch comes again
        store.add(df.where(F.col("n") % 3 == k), k)
    with pytest.raises(ValueError):
        store.scores("2024-03-01 12:00:00")

    def same():
        for day in ("2024-01-01", "2024-02-10", "2024-03-31", "2024-05-20", "2024-09-01"):
            got, want = (sorted(map(tuple, x.collect())) for x in (store.scores(day), reports.risk(df, f"{day} 00:00:00")))
            assert [(*r[:1], *r[2:]) for r in got] == [(*r[:1], *r[2:]) for r in want]
            assert [r[1] for r in got] == pytest.approx([r[1] for r in want], abs=2e-4)

    same()
    with pytest.raises(ValueError):
        store.compact([0, 1], 1)
    store.compact([0, 1], 5)
    same()


def test_cascade(spark):
    rng = random.Random(12)
    parents = {i: rng.choice([None, rng.randint(0, i - 1) if i else None, i - 1 if i else None, 5000 + i]) for i in range(200)}
    parents |= {i: i - 1 for i in range(300, 400)} | {600: 601, 601: 602, 602: 600, 700: 700}  # a chain, rings
    gone = {3, 17, 300, 601, 9999}

    def deleted(i, seen=()):
        return i in gone or (i not in seen and parents.get(i) is not None and deleted(parents[i], (*seen, i)))

    got = cascade(spark.createDataFrame(list(parents.items()), "id long, parent_id long"), spark.createDataFrame([(g,) for g in [*gone, 3]], "id long"))
    assert got.columns == ["id", "parent_id", "deleted"]
    assert {r.id: r.deleted for r in got.collect()} == {i: deleted(i) for i in parents}
    assert cascade(spark.createDataFrame([], "id long, parent_id long"), spark.createDataFrame([(1,)], "id long")).count() == 0


@pytest.mark.parametrize("segment_rows", [7, 20_000])
def test_states(spark, segment_rows):
    rng = random.Random(13)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 50), i, rng.choice([*SCAN_TRANSITIONS, "odd", None])) for i in range(600)]
    got = fold_states(spark.createDataFrame(rows, "scan string, at int, id long, event string"), "scan", ["at", "id"], "event", segment_rows=segment_rows)
    want, state = [], {}
    for k, at, i, e in sorted(rows, key=lambda r: (r[1], r[2])):
        now = state.get(k, "pending")
        to = SCAN_TRANSITIONS.get(e, {}).get(now)
        want.append((k, at, i, e, now, to or now, to is not None))
        state[k] = to or now
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    ends = {r.scan: (r.state, r.n_allowed, r.n_refused) for r in current_states(got, "scan", ["at", "id"]).collect()}
    assert ends == {k: (s, sum(w[6] for w in want if w[0] == k), sum(not w[6] for w in want if w[0] == k)) for k, s in state.items()}


def test_no_events(spark):
    assert fold_states(spark.createDataFrame([], "scan string, id long, event string"), "scan", ["id"], "event").count() == 0
