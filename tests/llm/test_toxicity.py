"""Fuzzy lexicon lookups against a plain edit distance, quotation, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from inspectra.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_kind(word, terms):
    found = []
    for t in terms:
        if t.endswith("$"):
            t = t[:-1]
            if word == t:
                found.append(1)
            elif len(t) >= T.FUZZY_FROM and distance(word, t) <= 1:
                found.append(3)
        elif word.startswith(t):
            found.append(2)
        elif len(t) >= T.FUZZY_FROM and any(distance(word[:n], t) <= 1 for n in range(len(t) - 1, len(t) + 2) if n <= len(word)):
            found.append(4)
    return min(found, default=0)


def test_fuzzy_trie():
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    terms = [word(4, 7) + "$" for _ in range(8)] + [word(4, 6) for _ in range(4)]
    trie = T.FuzzyTrie(terms)
    for _ in range(20_000):
        w = word(1, 9)
        assert trie.kind(w) == brute_kind(w, terms), (w, terms)


def test_quoted():
    text = 'he said "you idiot" and left\n« moron » idiot "open'
    place = lambda w, n=0: (text.index(w, n), text.index(w, n) + len(w))
    assert T.quoted(text, *place("idiot")) and T.quoted(text, *place("moron"))
    assert not T.quoted(text, *place("idiot", 30)) and not T.quoted(text, *place("left"))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = T.op8_lexicon_toxicity(spark, sf).join(T.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    toxic, predicted = got["toxic"] == 1, got["predicted"] == 1
    assert (toxic & predicted).sum() >= 0.9 * toxic.sum() and (~toxic & predicted).sum() <= 0.01 * (~toxic).sum()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == predicted).all()


def test_edges(spark, sf_dir):
    docs = spark.createDataFrame([(None, "You idiot, you moron", 1.0), (1, None, 1.0), (1, "", 1.0), (2, 'they said "idiot"', 1.0)], "doc_id long, text string, score double")
    model = (("idiot$", "moron$"), np.array([-3.0, 2.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0]))
    got = T.score(docs, model).collect()
    assert [r["_toxicity"] > 0.3 for r in got] == [True, False, False, False] and got[1]["_toxicity"] == got[2]["_toxicity"] and got[0]["score"] == 1.0
    empty = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.score(empty, model).count() == 0
    assert T.train(docs, labels) == ((), None)
    assert {r["_toxicity"] for r in T.score(docs, T.train(docs, labels)).collect()} == {0.0}
    held = {r["doc_id"]: r["h"] for r in spark.range(50).select(F.col("id").alias("doc_id"), T.held_out(F.col("id")).alias("h")).collect()}
    import zlib

    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items())


def test_quotes_of_many_places():
    """100,000 hits on one line, and quotation marks of several kinds on several."""
    import re

    from inspectra.llm.toxicity import in_quotes

    text = '"hit" ' * 100_000
    assert in_quotes(text, [m.span() for m in re.finditer(r"\w+", text)]).all()
    text = 'a "b" c „d“ e «f» g\n"h i\nj" k “l” m «n\no» “p'
    places = [m.span() for m in re.finditer(r"\w+", text)]
    assert [text[a:b] for (a, b), q in zip(places, in_quotes(text, places)) if q] == ["b", "d", "f", "l"]
