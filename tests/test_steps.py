"""UDFs go through a batch in steps: what they hold is a step's, and results leave one by one."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectra.functions import normalize, steps
from inspectra.operators import fingerprint, multiscan, scan
from inspectra.sources import archives, files

TEXT = "some words of no use, and a token%20of them; " * 50


def in_parts(udf, *columns):
    """The results of one batch, after a look at the steps in which they come."""
    batch = columns[0] if len(columns) == 1 else columns
    parts = list(udf.func(iter([batch])))
    assert len(parts) > 1 and sum(map(len, parts)) == len(columns[0])
    assert max(map(len, parts)) <= steps.STEP_ROWS and len(max(parts, key=len)) < len(columns[0])
    return [x for p in parts for x in p.to_pylist()]


def test_cuts():
    assert steps.cuts((pa.array([], pa.string()),)) == []
    assert steps.cuts((pa.array([None, "", None]),)) == [(0, 3)]
    big = "x" * steps.STEP_BYTES
    assert steps.cuts((pa.array(["a", big, big, "b", None]),)) == [(0, 2), (2, 1), (3, 2)]
    assert steps.cuts((pa.array(range(2 * steps.STEP_ROWS + 1)),)) == [(0, steps.STEP_ROWS), (steps.STEP_ROWS, steps.STEP_ROWS), (2 * steps.STEP_ROWS, 1)]
    # a member of a few bytes may say that it is large
    assert steps.cuts((pa.array([b"", b"", b""]), pa.array([10**15, None, 1])), expected=1) == [(0, 1), (1, 2)]


def test_results_are_those_of_one_step(spark):
    twice = steps.each_in_steps(T.ArrayType(T.StringType()), lambda t, n: None if t is None else [t[:3]] * n)
    rows = spark.range(9_000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 300))).alias("t"), (F.col("id") % 3).cast("int").alias("n")).coalesce(1)
    got = {r["id"]: r["v"] for r in rows.select("id", twice("t", "n").alias("v")).collect()}
    assert got == {i: [f"{i}xxx"[:3]] * (i % 3) if i % 7 else None for i in range(9_000)}


def test_members_of_archives_are_unpacked_in_steps():
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = b"0" * 100_000
    data = deflate.compress(raw) + deflate.flush()
    got = in_parts(archives._unpacked, pa.array([data] * 40), pa.array([archives.DEFLATED] * 40), pa.array([len(raw)] * 40), pa.array([None, zlib.crc32(raw)] * 19 + [1, 2], pa.int64()))
    assert [g["content"] == raw and g["error"] is None for g in got] == [True] * 38 + [False] * 2 and got[-1] == {"content": None, "error": "damaged"}


def test_variants_are_made_in_steps():
    assert in_parts(normalize.variants, pa.array([TEXT, None] * 2_000)) == [normalize.variant_list(TEXT), []] * 2_000


def test_variants_are_made_once(spark):
    parts = spark.createDataFrame([("a", "body", "x%20y"), ("b", "envelope", "x%20y")], "message_id string, component_type string, content string")
    got = normalize.with_variants(parts)
    assert sorted(map(tuple, got.collect())) == [("a", "body", "x y", True), ("a", "body", "x%20y", False), ("b", "envelope", "x%20y", False)]
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_places_of_patterns_are_found_in_steps(spark):
    got = in_parts(multiscan.pieces_of([r"token%\d+", "nothing"]), pa.array([TEXT, None] * 1_000))
    assert got[1] == [] and got[0] and got == got[:2] * 1_000
    found = multiscan.scan_many(spark.createDataFrame([("a", 0, "body", "body", TEXT)], "message_id string, component_idx int, component_type string, component_name string, content string"), {"t": r"token%\d+"})
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert found.count() == 50


def test_dictionary_hits_are_found_in_steps(spark, monkeypatch):
    made = []
    monkeypatch.setattr(scan, "in_steps", lambda *a: made.append(steps.in_steps(*a)) or made[-1])
    scan.scan_large_dictionary(spark.createDataFrame([], "message_id string, component_idx int, component_type string, component_name string, content string"), "d", ["token", "use"], False, False)
    got = in_parts(made[0], pa.array([TEXT, None] * 1_000))
    assert len(got[0]) == 100 and got[0][0] == {"rule_name": "d:use", "matched_text": "use", "start_offset": 17, "end_offset": 20} and got == [got[0], []] * 1_000


def test_pages_and_files_are_read_in_steps():
    page = "<p>one</p><script>two</script>" + "three " * 200
    assert in_parts(files.html_text, pa.array([page, None] * 1_000)) == [files.html_to_text(page), None] * 1_000
    got = in_parts(files.extracted, pa.array([page.encode(), None] * 1_000), pa.array(["a.html", "b.txt"] * 1_000))
    assert got == [files.extract(page.encode(), "a.html"), []] * 1_000


def test_texts_are_put_in_lower_case_once_for_all_words(spark):
    parts = spark.createDataFrame([("a", 0, "body", "body", "Mask, TOſS and masK; task"), ("b", 0, "body", "body", "no such word"), ("c", 0, "body", "body", None)], "message_id string, component_idx int, component_type string, component_name string, content string")
    found = scan.scan_keywords(parts, "d", ["mask", "toss", "task", "été"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(content") == 1
    assert sorted((r["matched_text"], r["start_offset"]) for r in found.collect()) == [("Mask", 0), ("TOſS", 6), ("masK", 15), ("task", 21)]


def test_fingerprints_are_made_in_steps_of_texts_made_once(spark):
    texts = [TEXT, None, "", "abc", "é", "žluťoučký 𝄞 kůň " * 100, "x" * 256, "日本" * 300]
    got = in_parts(fingerprint.simhash, pa.array(texts * 500))
    assert got == [fingerprint.simhash_text(t) if t else None for t in texts] * 500
    assert len(set(got)) == 7
    plan = fingerprint.build_index(spark.createDataFrame([(1, TEXT)], "id long, text string"), "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1


def test_the_text_of_fingerprints(spark):
    """Of every character alone, and of runs, by the two patterns that say what it is."""
    kept = F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}_\s\x{85}\p{Z}\x1c-\x1f]", "")
    want = F.trim(F.regexp_replace(kept, r"[\s\x{85}\p{Z}\x1c-\x1f]+", " "))
    c = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    chars = spark.range(0x110000, numPartitions=8).where("id NOT BETWEEN 55296 AND 57343")
    runs = chars.select(F.explode(F.array(F.concat(F.lit("a"), c, F.lit("b")), F.concat(F.lit(" "), c, F.lit(" "), c, F.lit("\n\t"), c, c, F.lit("Z - ")))).alias("t"))
    assert runs.where(~normalize.fingerprint_text(F.col("t")).eqNullSafe(want)).count() == 0


def test_near_hashes_come_in_steps_and_hashes_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "STEP_PAIRS", 12)
    known = np.array([0, 0b111, -1], np.int64).view(np.uint64)
    got = in_parts(fingerprint._within(known, 3), pa.array([0, None, 0b1, -1, 2**62] * 3, pa.int64()))
    hit = lambda i, n: {"i": i, "differing": n}
    assert got == [[hit(0, 0), hit(1, 3)], [], [hit(0, 1), hit(1, 2)], [hit(2, 0)], [hit(0, 1)]] * 3
    index = fingerprint.build_index(spark.createDataFrame([(1, TEXT), (2, TEXT + "more"), (3, None)], "id long, text string"), "id", "text")
    near = fingerprint.fingerprint_pairs(index, index, fingerprint.THRESHOLD)
    assert near._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [simhash") == 1
    assert {(r["left_id"], r["right_id"]) for r in near.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
