"""Monitors as whole flows: requests and mails in, incidents out, in batch and as streams whose sink takes each batch once.

A flow is a function of rows: what is to be inspected becomes components, one scan finds the matches, they are counted for each
message, and messages with matches are incidents with a verdict. A stream runs it on every micro-batch, without state of its own, and writes
what comes out to the batch's own folder, replacing what an interrupted run of the same batch left there. Only folders that were
written to their end are read, so a restart at any moment gives every incident once. Old batches can be folded into one folder.

Edge cases: requests without a body, of other methods or to allowed hosts, and mails without content give nothing; a batch without incidents
leaves a folder without rows; a message that comes again in a later batch is a second row with the same id (see dedup_queue).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inspectra.operators.incidents import http_verdict, smtp_verdict
from inspectra.operators.scan import scan_identifiers
from inspectra.sources.messages import BODY_METHODS, allowed_host, http_messages, smtp_messages
from inspectra.storage import exists, removed

#: Matches that an incident shows, and characters of each.
MOST_SHOWN, MOST_SHOWN_CHARS = 10, 100
INCIDENTS = "id string, message_id string, channel string, source_type string, about map<string,string>, match_count long, matches string, action_taken string"
Flow = Callable[[DataFrame], DataFrame]


def _incidents(rows: DataFrame, key: str, components: DataFrame, detect: Flow, channel: str, about: dict[str, Column], verdict: Callable[[Column], Column]) -> DataFrame:
    matches = detect(components)
    # the first few of each message; Spark cuts each partition to so many before it shuffles
    nth = F.row_number().over(Window.partitionBy("message_id").orderBy("component_idx", "start_offset", "rule_name", "end_offset"))
    text = F.substring("matched_text", 1, MOST_SHOWN_CHARS).alias("matched_text")
    shown = matches.withColumn("nth", nth).where(F.col("nth") <= MOST_SHOWN).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct("analyzer_name", "rule_name", "component_type", text, "confidence").alias("m")))).alias("m"))
    counts = matches.groupBy("message_id").agg(F.count("*").alias("match_count"))
    facts = rows.select(F.col(key).cast("string").alias("message_id"), F.map_from_arrays(F.array(*map(F.lit, about)), F.array(*(c.cast("string") for c in about.values()))).alias("about"))
    return (
        counts.join(shown, "message_id").join(facts, "message_id")
        .select(
            F.sha2(F.concat_ws("|", F.lit(channel), "message_id"), 256).alias("id"), "message_id", F.lit(channel).alias("channel"), F.lit("network").alias("source_type"), "about", "match_count",
            F.to_json(F.transform("m", lambda x: x["m"])).alias("matches"), verdict(F.col("match_count")).alias("action_taken"),
        )
    )


def http_flow(requests: DataFrame, allowed: Iterable[str] = (), detect: Flow = scan_identifiers, block_at: int = 1, prevent: bool = False) -> DataFrame:
    """Incidents of requests (request_id, method, url, client_ip, content_type, body): their action is log, or the verdict where `prevent` is set."""
    watched = requests.where(F.upper("method").isin(*BODY_METHODS) & (F.octet_length("body") > 0) & ~allowed_host(F.col("url"), list(allowed)))
    about = {"url": F.col("url"), "source_ip": F.col("client_ip"), "method": F.upper("method")}
    return _incidents(watched, "request_id", http_messages(watched), detect, "http_upload", about, lambda n: http_verdict(n, block_at) if prevent else F.lit("log"))


def smtp_flow(mails: DataFrame, detect: Flow = scan_identifiers, block_at: int = 5, modify_at: int = 1, action: str = "modify") -> DataFrame:
    """Incidents of mails (mail_id, mail_from, rcpt_tos, raw)."""
    about = {"mail_from": F.col("mail_from"), "rcpt_tos": F.array_join("rcpt_tos", ", ")}
    return _incidents(mails, "mail_id", smtp_messages(mails), detect, "email", about, lambda n: smtp_verdict(n, block_at, modify_at, action))


def put_batch(rows: DataFrame, sink: str, batch_id: int) -> None:
    """The rows of a batch, whatever an earlier run of it has left."""
    rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")


def start_monitor(stream: DataFrame, flow: Flow, sink: str, checkpoint: str, once: bool = False, every: str = "10 seconds", put: Callable[[DataFrame, str, int], None] = put_batch) -> StreamingQuery:
    """Runs the flow on every micro-batch of the stream. once: on what is there, then ends."""

    def run(rows: DataFrame, batch_id: int) -> None:
        put(flow(rows), sink, batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _folders(spark: SparkSession, sink: str) -> tuple[int, list[str]]:
    """The last batch that is folded (-1: none), and the whole folders: that of the folded batches and those of later ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [n for n in names if re.fullmatch(r"(?:batch|upto)=\d+", n) and exists(spark, f"{sink}/{n}/_SUCCESS")]
    number = lambda n: int(n.split("=")[1])
    base = max((number(n) for n in whole if n.startswith("upto")), default=-1)
    return base, [f"{sink}/{n}" for n in sorted(whole) if n == f"upto={base}" or (n.startswith("batch") and number(n) > base)]


def read_sink(spark: SparkSession, sink: str, schema: str = INCIDENTS) -> DataFrame:
    """The rows of all batches that were written to their end."""
    _, folders = _folders(spark, sink)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def fold_batches(spark: SparkSession, sink: str, last: int, schema: str = INCIDENTS) -> None:
    """Batches up to `last`, which the stream has committed, into one folder; a fold that is interrupted leaves all as it was."""
    base, folders = _folders(spark, sink)
    some = [f for f in folders if f.endswith(f"/upto={base}") or int(f.rsplit("=", 1)[1]) <= last]
    if last > base and some:
        spark.read.schema(schema).parquet(*some).write.mode("overwrite").parquet(f"{sink}/upto={last}")
        for f in some:
            removed(spark, f)
