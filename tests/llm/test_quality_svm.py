"""The quality classifier: n-grams against plain loops, the descent against its optimum, and held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectra.llm import quality_svm as Q

HARD = [None, "", " ", "a", "The THE the", "x1 22!! %%%", "\tone  two\nthree ", "|", "Éa ñ ÇÇ", "a\0b c", "漢字 \U0001f600 x", "a b a b a b"]


def shape(word):
    kinds = [{"Lu": "A", "Ll": "a"}.get(__import__("unicodedata").category(c), "a" if c.isalpha() else "0" if c.isdigit() else c) for c in word]
    return "".join(k for i, k in enumerate(kinds) if i < 2 or not kinds[i - 1] == kinds[i - 2] == k)


def plain(text):
    words = (text or "").replace("\0", "").split() if "\0" not in (text or "") else text.split()
    low, shapes = ["".join(c.lower() for c in w if c.isalnum()) for w in words], [shape(w) for w in words]
    return (
        {("word", x) for x in low if x} | {("pair", x, y) for x, y in zip(low, low[1:]) if x and y} | {("shape", x) for x in shapes}
        | {("shapes", *x) for x in zip(shapes, shapes[1:])} | {("shapes", *x) for x in zip(shapes, shapes[1:], shapes[2:])}
    )


def test_ngrams_are_those_of_plain_loops():
    doc, h = Q.ngrams(HARD, bits=40)
    got = [set(h[doc == i].tolist()) for i in range(len(HARD))]
    assert [len(x) for x in got] == [len(plain(t)) for t in HARD]
    for i, a in enumerate(HARD):
        for j, b in enumerate(HARD):
            assert len(got[i] & got[j]) == len(plain(a) & plain(b))
    again = Q.ngrams(HARD[5:7], bits=40)[1]
    assert set(again.tolist()) == got[5] | got[6]  # whatever stands beside a text


def test_no_text_and_one_long_text():
    assert len(Q.ngrams([None, ""])[1]) == 0
    assert len(Q.ngrams(["a " * 1_000_000])[1]) == 5


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    good = np.array([(3 in r) or (5 in r and 7 not in r) for r in rows])
    ratios = rng.normal(size=30)
    w, constant = Q.descend(rows, ratios, good, passes=5000)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    x[:, 30] = 1
    y, cost = np.where(good, 1.0, -1.0), np.where(good, 60 / (2 * good.sum()), 60 / (2 * (~good).sum()))

    def loss(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    best, at = np.inf, np.zeros(31)
    for k in range(200_000):  # subgradient steps
        at = at - (at - ((cost * y * (y * (x @ at) < 1))[:, None] * x).sum(0)) / (k + 10)
        best = min(best, loss(at)) if k % 100 == 0 else best
    assert loss(np.append(w, constant)) <= best * 1.02 + 1e-6


def test_sigmoid_and_one_kind():
    m = np.linspace(-2, 2, 200)
    slope, shift = Q.sigmoid(m, m > 0.5)
    assert slope > 3 and abs(shift / slope + 0.5) < 0.1
    slope, shift = Q.sigmoid(m, np.ones(200, bool))
    assert np.isfinite([slope, shift]).all()


def test_held_out_accuracy(spark, sf_dir):
    got = Q.op13_quality_svm(spark, sf_dir)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 100
    assert rows[rows.quality == 1].predicted.mean() > 0.97
    assert (rows[rows.quality == 0].predicted == 0).mean() > 0.9
    assert rows.score.between(0, 1).all()


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, ""), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert Q.train(docs, none) == 0.5
    ids = [i for i in range(40) if not spark.range(1).select(Q.held_out(F.lit(i))).first()[0]][:4]
    texts = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    assert Q.train(texts, spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")) == pytest.approx(5 / 6)
    assert [r["_quality"] for r in Q.score(docs, 0.5).collect()] == [0.5] * 4


def test_edges_of_a_fitted_model(spark):
    rows = [(i, "fine words here" if i % 2 else "BAD!! WORDS!! HERE!!", "x", 1.0) for i in range(60)]
    docs = spark.createDataFrame([*rows, (1, None, None, None), (None, "", None, 2.0), (1, "fine words here", "x", 1.0)], "doc_id long, text string, good string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (3, None)], "doc_id long, quality int")
    out = Q.score(docs, Q.train(docs, labels))
    assert out.columns == [*docs.columns, "_quality"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 63
    of = {t: {r[4] for r in got if r[1] == t} for t in {r[1] for r in got}}
    assert all(len(v) == 1 for v in of.values()) and of[None] == of[""]
    assert min(of["fine words here"]) > 0.5 > max(of["BAD!! WORDS!! HERE!!"])
    assert Q.score(docs.limit(0), Q.train(docs, labels)).count() == 0
