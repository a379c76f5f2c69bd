"""Weighted signatures, and near-duplicate classes against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from inspectra.llm import bag_minhash as B


def multiset(text):
    words = (text or "").lower().split()
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return Counter(runs)


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def test_registers_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    b[:200] = a[:200]
    of = np.repeat([0, 1], 300)
    w = np.concatenate([a, b])
    got = B.signatures(2, of[w > 0], np.concatenate([h, h])[w > 0], w[w > 0], 20_000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.015


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    texts += ["", None, " \n", "one", "One", "two words", "a a a a a a a a", "a a a a a a a a a"]
    rng.shuffle(texts)
    return [(10 + i, t) for i, t in enumerate(texts)]


def brute_classes(docs):
    sets = [multiset(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            same = docs[i][0] == docs[j][0] or (not sets[i] and not sets[j]) or similarity(sets[i], sets[j]) >= 0.8
            if same:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("most", [4096, 4])
def test_classes(spark, monkeypatch, most):
    """Families that fit one task, and larger ones."""
    monkeypatch.setattr(B, "GROUP_DOCS", most)
    monkeypatch.setattr(B, "BLOCK", 3)
    docs = made()
    docs += [docs[0], docs[5], (docs[7][0], docs[9][1])]
    df = spark.createDataFrame([(*d, b"x", "y") for d in docs], "doc_id long, text string, digest binary, label string")
    want = brute_classes(docs)
    assert sorted(map(tuple, B.near_classes(df).collect())) == want
    left = B.one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in left) == sorted({c for _, c in want}) and len(left[0]) == 4


def test_ids_on_several_texts(spark):
    """One document may have several rows; none of its links is lost, whatever the order of rows."""
    rng = random.Random(5)
    texts = [[rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(80)] for _ in range(2)]
    near = [[*t[:-1], "end"] for t in texts]
    docs = [(7, " ".join(texts[0])), (7, " ".join(texts[1])), (8, " ".join(near[1])), (9, " ".join(near[0])), (-(1 << 63), "other"), (None, " ".join(near[0])), (None, "alone")]
    for rows in (docs, docs[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = B.near_classes(df).collect()
        assert sorted((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None) == [(-(1 << 63), -(1 << 63)), (7, 7), (7, 7), (8, 7), (9, 7)]
        assert sorted(str(r["class_id"]) for r in got if r["doc_id"] is None) == ["7", "None"]
        assert sorted((str(r["doc_id"]), r["text"]) for r in B.one_of_each(df).collect())[::2] == [("-9223372036854775808", "other"), ("None", "alone")]


def test_long_text(spark):
    words = ["w%d" % (i * i % 9973) for i in range(30_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[:100])), (4, " ".join(words[:9000]))]
    assert sorted(map(tuple, B.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == brute_classes(docs)


@pytest.mark.parametrize("most", [4096, 100])
def test_one_large_group(spark, monkeypatch, most):
    monkeypatch.setattr(B, "GROUP_DOCS", most)
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    docs = []
    for i in range(400):
        t = list(base)
        for _ in range(rng.randint(2, 8)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        docs.append((i, " ".join(t)))
    assert sorted(map(tuple, B.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == brute_classes(docs)


def test_query_and_empty(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = dict(map(tuple, B.op5_bag_minhash(spark, sf_dir).collect()))
    sets = {r[0]: multiset(r[1]) for r in rows}
    ids = sorted(sets)
    assert set(got) == set(ids)
    by_run = {}
    for d in ids:
        for x in sets[d]:
            by_run.setdefault(x, []).append(d)
    pairs = {(a, b) for group in by_run.values() for i, a in enumerate(group) for b in group[:i]}
    linked = {p for p in pairs if similarity(sets[p[0]], sets[p[1]]) >= 0.8}
    assert linked and all(got[a] == got[b] for a, b in linked)
    assert len(set(got.values())) == len({c for _, c in brute_from(ids, linked, sets)})
    assert B.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_from(ids, links, sets):
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    empty = [d for d in ids if not sets[d]]
    for a, b in [*links, *zip(empty, empty[1:])]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(d, find(d)) for d in ids]
