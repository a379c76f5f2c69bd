"""The trigram index against scans, and deep pages against the sorted list."""

import random
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from inspectra.operators.paging import PagedList
from inspectra.operators.search_index import SearchIndex, literal_runs


def test_literal_runs():
    assert literal_runs(r"ab%c_d\%e\\f") == ["ab", "c", r"d%e\f"]
    assert literal_runs("%_") == [] and literal_runs("") == []


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abABé1%_ ", k=rng.randint(0, 9)))
    rows = [(i, word() if i % 7 else None, word() + (" Report" if i % 3 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, title string, subtitle string")
    index = SearchIndex(spark, f"file://{tmp_path_factory.mktemp('search')}/index", "id", ("title", "subtitle"))
    for k in (0, 1, 1):  # the second one twice
        index.add(df.where(F.col("id") % 2 == k), k)
    return df, index


@pytest.mark.parametrize("words", ["aba", "ABÉ", "report", "repor_", "a%b", "bab%rep", "xyzzy", "", "ab", r"\%", "b1 ", "aaaa", "éé", r"a\_b"])
def test_same_rows_as_a_scan(searched, words):
    df, index = searched
    want = df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{words}%") for c in ("title", "subtitle")]))
    assert sorted(map(tuple, index.find(words).collect())) == sorted(map(tuple, want.collect()))


def test_only_the_grams_postings_are_read(searched):
    plan = searched[1].find("report")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram," in plan


def test_no_index(spark, tmp_path):
    with pytest.raises(ValueError):
        SearchIndex(spark, f"file://{tmp_path}/none", "id", ("a",)).find("abc")


@pytest.mark.parametrize("descending", [True, False])
def test_pages(spark, tmp_path, descending):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3, rng.randint(0, 50)]), f"x{i}") for i in range(997)]
    df = spark.createDataFrame(rows, "id long, n int, name string")
    want = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[0]))
    pages = PagedList(spark, f"file://{tmp_path}/list", "n", "id", descending)
    pages.write(df, 16)
    assert pages.total() == 997 and len(pages.counts()) > 8
    for number, size in ((1, 20), (2, 20), (25, 20), (50, 20), (51, 20), (1, 997), (1, 2000), (3, 400)):
        assert [tuple(r) for r in pages.page(number, size).collect()] == want[(number - 1) * size : number * size]
    for at in (0, 19, 500, 990, 996):
        last = spark.createDataFrame([want[at]], df.schema).first()
        assert [tuple(r) for r in pages.after(last, 30).collect()] == want[at + 1 : at + 31]
    with pytest.raises(ValueError):
        pages.page(0)


def test_a_page_reads_its_range(spark, tmp_path):
    pages = PagedList(spark, f"file://{tmp_path}/list", "n", "id", False)
    pages.write(spark.range(10_000).select("id", (F.col("id") % 10).alias("n")), 50)
    page = pages.page(300, 20)
    assert page.count() == 20
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[(?:isnotnull\(range#\d+\), )?\(?range#\d+ (?:= \d+|IN \(\d+,\d+\))", plan), plan


def test_an_empty_list(spark, tmp_path):
    pages = PagedList(spark, f"file://{tmp_path}/list", "n", "id")
    pages.write(spark.createDataFrame([], "id long, n int"), 4)
    assert pages.total() == 0 and pages.counts() == []


def test_an_index_makes_its_rows_once(spark, tmp_path):
    from inspectra.operators.search_index import SearchIndex

    seen = spark.sparkContext.accumulator(0)

    def named(i):
        seen.add(1)
        return f"name {i}"

    rows = spark.range(40).select("id", F.udf(named)("id").alias("name"), F.lit("same").alias("other"))
    index = SearchIndex(spark, str(tmp_path / "index"), "id", ("name", "other"))
    index.add(rows, 0)
    index.add(rows.where("id < 0"), 1)
    assert seen.value == 40
    assert {r["id"] for r in index.find("ame 1").collect()} == {1, *range(10, 20)} and index.find("same").count() == 40
