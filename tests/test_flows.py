"""Monitor flows, and their streams interrupted at every stage of a batch."""

import json

import pytest
from pyspark.sql import functions as F

from inspectra.operators.scan import scan_regex
from inspectra.streaming.flows import fold_batches, http_flow, put_batch, read_sink, smtp_flow, start_monitor

CARD = "4532015112830366"
CARDS = {"card": r"\b4[0-9]{15}\b"}
REQUESTS = "request_id long, method string, url string, client_ip string, content_type string, body binary"


def cheap(rows):
    """The flow with one pattern."""
    return http_flow(rows, detect=lambda c: scan_regex(c, CARDS))


def requests(spark, n, start=0):
    rows = [(i, ["POST", "get", "put"][i % 3], f"https://{'ok.example.com' if i % 5 == 0 else 'out.example.org'}/{i}", "gateway", "text/plain", bytearray(f"card {CARD} and more {i} {CARD}".encode() if i % 2 else b"nothing")) for i in range(start, start + n)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None), (-1, "POST", "https://x.y", None, None, bytearray(b""))], REQUESTS)


def test_http_flow(spark):
    got = {r.message_id: r for r in http_flow(requests(spark, 30), ["example.com"]).collect()}
    assert sorted(map(int, got)) == [i for i in range(30) if i % 2 and i % 3 != 1 and i % 5]
    one = got["3"]
    assert (one.match_count, one.action_taken, one.channel, one.about["method"]) == (2, "log", "http_upload", "POST")
    assert [m["matched_text"] for m in json.loads(one.matches)] == [CARD, CARD]
    assert {r.action_taken for r in http_flow(requests(spark, 9), prevent=True, detect=lambda c: scan_regex(c, CARDS)).collect()} == {"block"}
    assert {r.action_taken for r in http_flow(requests(spark, 9), prevent=True, block_at=3, detect=lambda c: scan_regex(c, CARDS)).collect()} == {"allow"}


def test_many_matches_are_shown_in_part(spark):
    rows = spark.createDataFrame([(1, "POST", "https://a.b", "", "text/plain", bytearray(f"{CARD} ".encode() * 5000))], REQUESTS)
    (got,) = cheap(rows).collect()
    assert got.match_count == 5000 and len(json.loads(got.matches)) == 10


def test_smtp_flow(spark):
    raw = lambda text: bytearray(f"From: a@example.com\r\nTo: b@example.org\r\nSubject: s\r\n\r\n{text}\r\n".encode())
    mails = spark.createDataFrame([(1, "a@example.com", ["b@example.org"], raw(CARD)), (2, "a@example.com", ["b@example.org"], raw(f"{CARD} " * 9)), (3, None, None, None)], "mail_id long, mail_from string, rcpt_tos array<string>, raw binary")
    got = {r.message_id: r.action_taken for r in smtp_flow(mails, lambda c: scan_regex(c, CARDS)).collect()}
    assert got == {"1": "modify", "2": "block"}


def folder(tmp_path, name):
    return f"file://{tmp_path / name}"


def staged(spark, tmp_path):
    """Three files of requests as a stream of three batches."""
    for k in range(3):
        requests(spark, 20, 20 * k).coalesce(1).write.mode("append").parquet(folder(tmp_path, "in"))
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(folder(tmp_path, "in"))


def all_of(spark, tmp_path):
    return sorted(map(str, cheap(spark.read.schema(REQUESTS).parquet(folder(tmp_path, "in"))).collect()))


@pytest.mark.parametrize("when", ["before", "half", "after"])
def test_a_restart_gives_each_incident_once(spark, tmp_path, when):
    stream, sink, checkpoint = staged(spark, tmp_path), folder(tmp_path, "sink"), folder(tmp_path, "checkpoint")

    def fails(rows, to, batch_id):
        if batch_id == 1:
            if when == "half":  # a job that died: some files, no mark of its end
                rows.limit(3).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{to}/batch=1")
            elif when == "after":
                put_batch(rows, to, batch_id)
            raise RuntimeError("lost")
        put_batch(rows, to, batch_id)

    with pytest.raises(Exception, match="lost"):
        start_monitor(stream, cheap, sink, checkpoint, once=True, put=fails).awaitTermination()
    first = read_sink(spark, sink).count()
    assert 0 < first < len(all_of(spark, tmp_path))
    start_monitor(stream, cheap, sink, checkpoint, once=True).awaitTermination()
    assert sorted(map(str, read_sink(spark, sink).collect())) == all_of(spark, tmp_path)
    # nothing new: nothing more
    start_monitor(stream, cheap, sink, checkpoint, once=True).awaitTermination()
    assert sorted(map(str, read_sink(spark, sink).collect())) == all_of(spark, tmp_path)


def test_folded_batches(spark, tmp_path):
    stream, sink = staged(spark, tmp_path), folder(tmp_path, "sink")
    start_monitor(stream, cheap, sink, folder(tmp_path, "checkpoint"), once=True).awaitTermination()
    want = all_of(spark, tmp_path)
    rows = read_sink(spark, sink)
    # a fold that was interrupted is not read
    rows.limit(2).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{sink}/upto=1")
    assert sorted(map(str, read_sink(spark, sink).collect())) == want
    for last in (1, 1, 2):
        fold_batches(spark, sink, last)
        assert sorted(map(str, read_sink(spark, sink).collect())) == want
    assert sorted(p.name for p in (tmp_path / "sink").iterdir()) == ["upto=2"]


def test_an_empty_sink(spark, tmp_path):
    assert read_sink(spark, folder(tmp_path, "none")).count() == 0
    put_batch(cheap(requests(spark, 0)), folder(tmp_path, "sink"), 0)
    assert read_sink(spark, folder(tmp_path, "sink")).select(F.col("id")).count() == 0
