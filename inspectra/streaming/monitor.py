"""Streams: windows and sessions of incidents, deduplication, limits, and folds that need state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What makes two queued incidents the same.
QUEUE_KEY = ("policy_name", "file_name", "file_path", "user", "match_count", "channel", "action_taken")


def event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """The stream with its time as TIMESTAMP, which watermarks ask for (session time zone UTC)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def window_counts(stream: DataFrame, by: str, window: str = "1 hour", late: str = "2 hours", ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or, with slide, sliding) windows; rows later than `late` are left out."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = event_time(stream, ts).withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def user_sessions(stream: DataFrame, user: str = "user_id", gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Sessions of each user's events with no longer gap between them."""
    w = F.session_window(ts, gap)
    out = event_time(stream, ts).withWatermark(ts, late).groupBy(w.alias("w"), user).agg(F.count("*").alias("n_events"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def queue_hash(columns: tuple[str, ...] = QUEUE_KEY) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def dedup_queue(stream: DataFrame, within: str = "1 hour", ts: str = "queued_at", columns: tuple[str, ...] = QUEUE_KEY) -> DataFrame:
    """Incidents without those whose equal has come within the watermark."""
    return stream.withColumn("hash", queue_hash(columns)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["hash"])


def bounded_queue(queue: DataFrame, most: int, order: str = "queued_at", key: str = "hash") -> DataFrame:
    """The newest `most` entries (a top-k, merged from the partitions' own)."""
    return queue.orderBy(F.desc(order), F.desc(key)).limit(most)


def drain(queue: DataFrame, n: int, order: str = "queued_at", key: str = "hash") -> DataFrame:
    return queue.orderBy(order, key).limit(n)


class TokenBucket:
    """Requests of one caller: `rate` a minute, saved up to `rate`."""

    def __init__(self, rate: int, tokens: float | None = None, last: float | None = None):
        self.rate, self.tokens, self.last = rate, float(rate) if tokens is None else tokens, last

    def take(self, at: float) -> bool:
        if self.last is not None:
            self.tokens = min(self.rate, self.tokens + max(0.0, at - self.last) * self.rate / 60)
        self.last = at if self.last is None else max(self.last, at)
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


_LIMITED = T.StructType([T.StructField("caller", T.StringType()), T.StructField("request_id", T.LongType()), T.StructField("at", T.DoubleType()), T.StructField("allowed", T.BooleanType())])
_STATE = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("last", T.DoubleType())])


def rate_limit_stream(requests: DataFrame, rate: int) -> DataFrame:
    """caller, request_id, at (seconds) and whether each request is allowed; a caller's bucket is kept between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(rate, *state.get) if state.exists else TokenBucket(rate)
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"])
        allowed = [bucket.take(t) for t in rows["at"]]
        state.update((bucket.tokens, bucket.last))
        yield rows.assign(allowed=allowed)[["caller", "request_id", "at", "allowed"]]

    return requests.select("caller", "request_id", "at").groupBy("caller").applyInPandasWithState(run, _LIMITED, _STATE, "append", GroupStateTimeout.NoTimeout)


def rate_limit(requests: DataFrame, rate: int) -> DataFrame:
    """The same of a table. Rows come sorted by caller and time; a task holds one caller's bucket, not its requests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, bucket = None, TokenBucket(rate)
        for f in frames:
            allowed = []
            for c, t in zip(f["caller"], f["at"]):
                if c != caller:
                    caller, bucket = c, TokenBucket(rate)
                allowed.append(bucket.take(t))
            yield f.assign(allowed=allowed)

    rows = requests.select("caller", "request_id", "at").repartition("caller").sortWithinPartitions("caller", "at", "request_id")
    return rows.mapInPandas(run, _LIMITED)


def agents(heartbeats: DataFrame, now: str, stale_minutes: int = 5) -> DataFrame:
    """Each agent's last heartbeat and version, its age in seconds and whether it is online."""
    last = heartbeats.groupBy("agent").agg(F.max("ts").alias("last_seen"), F.max_by("version", "ts").alias("version"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    return last.select("agent", "last_seen", "version", age.alias("age_seconds"), F.when(age <= 60 * stale_minutes, "online").otherwise("stale").alias("status"))


def correlate_streams(incidents: DataFrame, alerts: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Stream-stream join of incidents (id, user, created_at) and alerts (other_id, user, other_at) within so many minutes."""
    a = incidents.withWatermark("created_at", late)
    b = alerts.withColumnRenamed("user", "other_user").withWatermark("other_at", late)
    span = F.expr(f"interval {int(minutes)} minutes")
    near = (F.col("user") == F.col("other_user")) & (F.col("other_at") >= F.col("created_at") - span) & (F.col("other_at") <= F.col("created_at") + span)
    return a.join(b, near).drop("other_user")


def evicted(queue: DataFrame, most: int) -> DataFrame:
    """What falls out of a bounded queue: all but the newest `most` entries."""
    return queue.join(bounded_queue(queue, most).select("hash", "queued_at"), ["hash", "queued_at"], "left_anti")
