"""The stored fingerprint index against an index that is built anew."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from inspectra.operators import fingerprint
from inspectra.operators.fingerprint import build_index
from inspectra.operators.fingerprint_store import FingerprintStore

SCHEMA = "fingerprint_id bigint, simhash bigint, text_length int, preview string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def near(rng, x, bits):
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x - (1 << 64) if x >= 1 << 63 else x


def entries(rng, n, first=0):
    base = [rng.getrandbits(64) for _ in range(max(1, n // 4))]
    return [(first + i, near(rng, rng.choice(base), rng.randint(0, 9)), 60 + i, f"p{i}") for i in range(n)]


def brute(seen, kept, threshold):
    score = lambda x, y: 1 - bin((x ^ y) & (1 << 64) - 1).count("1") / 64
    return sorted((s[0], e[0], score(s[1], e[1])) for s in seen for e in kept if score(s[1], e[1]) >= threshold)


def test_adds_and_removes(spark, tmp_path):
    rng, threshold = random.Random(3), 0.84
    store, have = FingerprintStore(spark, f"file://{tmp_path / 'index'}", threshold, shards=3), {}
    assert store.load().count() == 0
    store.remove(spark.createDataFrame([(1,)], "fingerprint_id long"))
    for batch in range(2):
        new = entries(rng, 60, 45 * batch)  # overlaps with the batch before: those are replaced
        store.add(spark.createDataFrame([*new, (None, 5, 5, "x"), (7777, None, 5, "x")], SCHEMA), batch)
        have |= {e[0]: e for e in new}
        gone = rng.sample(sorted(have), 8)
        store.remove(spark.createDataFrame([(i,) for i in [*gone, gone[0], 99_999]], "fingerprint_id long"))
        have = {k: v for k, v in have.items() if k not in gone}
        assert rows_of(store.load()) == sorted(have.values())
    seen = entries(rng, 10, 500) + [(i, *v[1:]) for i, v in enumerate(list(have.values())[:20], 600)]
    got = store.search(spark.createDataFrame(seen, SCHEMA))
    assert rows_of(got) == brute(seen, have.values(), threshold)
    assert rows_of(store.search(spark.createDataFrame(seen, SCHEMA), 0.97)) == brute(seen, have.values(), 0.97)
    with pytest.raises(ValueError):
        store.search(spark.createDataFrame(seen, SCHEMA), 0.5)


def test_a_repeated_batch_and_an_emptied_index(spark, tmp_path):
    rng = random.Random(4)
    store = FingerprintStore(spark, f"file://{tmp_path / 'index'}", shards=2)
    some = entries(rng, 12)
    for _ in range(2):
        store.add(spark.createDataFrame(some, SCHEMA), 0)
    assert rows_of(store.load()) == sorted(some)
    assert store._read("bands").count() == 12 * (len(store.edges) - 1)
    store.remove(spark.createDataFrame(some, SCHEMA))
    assert store.load().count() == 0 and store._read("bands").count() == 0


def test_a_deletion_touches_its_folders_only(spark, tmp_path):
    store = FingerprintStore(spark, f"file://{tmp_path / 'index'}", shards=8)
    store.add(spark.createDataFrame(entries(random.Random(5), 60), SCHEMA), 0)
    stamps = lambda: {p: p.stat().st_mtime_ns for p in pathlib.Path(tmp_path / "index").rglob("*.parquet")}
    before = stamps()
    store.remove(spark.createDataFrame([(5,)], "fingerprint_id long"))
    after = stamps()
    assert len(before) - len(before.keys() & after.keys()) <= len(store.edges)  # one folder of each band, one of the entries


@pytest.mark.parametrize("selective", [0.0, 1e9])  # blocks of all rows; blocks of equal bands
def test_pairs_of_equal_fingerprints_are_many_tasks(spark, tmp_path, monkeypatch, selective):
    for name, value in (("BLOCK", 16), ("TASK_PAIRS", 500), ("STEP_PAIRS", 50), ("SENT_KEYS", 0), ("SELECTIVE", selective)):
        monkeypatch.setattr(fingerprint, name, value, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    rng = random.Random(6)
    common = rng.getrandbits(63)
    have, seen = ([(i, near(rng, common, rng.choice([0] * 9 + [2, 6, 9])), 60, "p") for i in range(a, z)] for a, z in ((0, 120), (200, 260)))
    store = FingerprintStore(spark, f"file://{tmp_path / 'index'}", shards=2)
    store.add(spark.createDataFrame(have, SCHEMA), 0)
    got = store.search(spark.createDataFrame([*seen, (999, None, 5, "x")], SCHEMA))
    assert rows_of(got) == brute(seen, have, 0.9)
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert rows_of(store.search(spark.createDataFrame(seen, SCHEMA), 1.0)) == brute(seen, have, 1.0)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(parts) < sum(parts) / 3


def test_parts_of_messages_near_an_index(spark):
    """Identifiers of two columns, on the path of blocks."""
    words = [" ".join(random.Random(i % 4).choices("one two three four five six seven eight nine ten".split(), k=40)) for i in range(24)]
    index = build_index(spark.createDataFrame(list(enumerate(words[:4])), "id long, text string"), "id", "text")
    parts = spark.createDataFrame([(f"m{i}", i % 3, ("body", "attachment", "subject")[i % 3], t) for i, t in enumerate([*words, None, "short"])], "message_id string, component_idx int, component_type string, content string")
    got = fingerprint.scan_fingerprints(parts, index, 0.97)
    assert rows_of(got) == sorted((f"m{i}", i % 3, i % 4, 1.0) for i in range(24) if i % 3 < 2)


def test_load_equals_build(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    store = FingerprintStore(spark, f"file://{tmp_path / 'index'}", 0.9, 2)
    for k in range(2):
        store.add(build_index(docs.where(f"doc_id % 2 = {k}"), "doc_id", "text"), k)
    store.remove(docs.where("doc_id % 5 = 0").selectExpr("doc_id AS fingerprint_id"))
    assert rows_of(store.load()) == rows_of(build_index(docs.where("doc_id % 5 > 0"), "doc_id", "text"))
