"""Streams against the same functions on tables."""

import shutil

from pyspark.sql import functions as F

from inspectra.streaming import monitor


def drained(stream, mode="append"):
    name = f"t{abs(hash(str(stream.schema)))}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def source(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events.parquet")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"file://{tmp_path}")


def test_windows_and_sessions(spark, sf_dir, tmp_path):
    stream, batch = source(spark, sf_dir, tmp_path), spark.read.parquet(f"{sf_dir}/events.parquet")
    got = drained(monitor.window_counts(stream, "event_type"), "complete")
    want = monitor.window_counts(batch, "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    closed = drained(monitor.user_sessions(stream))
    every = set(map(tuple, monitor.user_sessions(batch).collect()))
    assert 0 < closed.count() <= len(every) and set(map(tuple, closed.collect())) <= every


def test_dedup_and_limits(spark, sf_dir, tmp_path):
    stream = source(spark, sf_dir, tmp_path)
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    queued = lambda df: df.select((F.col("user_id") % 5).alias("policy_name"), "event_type", F.col("ts").cast("timestamp").alias("queued_at"))
    got = drained(monitor.dedup_queue(queued(stream), "60 days", columns=("policy_name", "event_type")))
    assert got.count() == queued(batch).select("policy_name", "event_type").distinct().count()
    asked = lambda df: df.select(F.concat(F.lit("u"), "user_id").alias("caller"), F.col("event_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    streamed = sorted(map(tuple, drained(monitor.rate_limit_stream(asked(stream), 1)).collect()))
    table = sorted(map(tuple, monitor.rate_limit(asked(batch), 1).collect()))
    buckets, plain = {}, []
    for r in asked(batch).orderBy("caller", "at", "request_id").collect():
        plain.append((*r, buckets.setdefault(r["caller"], monitor.TokenBucket(1)).take(r["at"])))
    assert streamed == table == sorted(plain)


def test_agents_and_bucket(spark):
    beats = spark.createDataFrame([("a", "2026-01-01 00:00:00", 1), ("a", "2026-01-01 00:09:00", 2), ("b", "2026-01-01 00:00:00", 1)], "agent string, ts string, version int")
    got = {r["agent"]: (r["version"], r["age_seconds"], r["status"]) for r in monitor.agents(beats, "2026-01-01 00:10:00").collect()}
    assert got == {"a": (2, 60, "online"), "b": (1, 600, "stale")}
    bucket = monitor.TokenBucket(2)
    assert [bucket.take(t) for t in (0, 0, 0, 30, 30)] == [True, True, False, True, False]
