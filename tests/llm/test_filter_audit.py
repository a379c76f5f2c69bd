"""The filter audit against plain loops over documents and orders."""

import itertools
import re
from collections import Counter

import duckdb
import pyarrow as pa

from inspectra.llm import filter_audit as A

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failing = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i)
        mine = [x for x in labels if x[0] == i and i is not None]
        failing.append((part or "", {c for c, f in zip("ABCDE", fails) if f}, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out, shapley = [], Counter()
    for part in {f[0] for f in failing}:
        mine = [f for f in failing if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(order):
                left = [f for f in mine if not f[1] & set(order[:k])]
                gone = [f for f in left if c in f[1]]
                shapley[part, c] += len(gone)
                out.append((part, order, k + 1, len(left) - len(gone), len(gone), sum(c in f[1] for f in mine) - len(gone), sum(f[1] == {c} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


LONG = " ".join(f"w{i}" for i in range(120))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, None, "de"), (4, "", "de"), (5, "ABC " * 150, "en"), (6, "a|b", None), (6, "another text", None), (6, "another text", ""), (None, "a|b", "fr"), (None, None, None),
    (7, LONG + " $", "fr"), (8, LONG.upper(), "fr"), (9, "same " * 300, "fr"), (10, "\x0bone\x1ctwo\x85three four ", "fr"), (11, "É" * 9 + "A", "fr"), (12, "É" * 8 + "A", "fr"), (13, "x y " * 200_000, "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (5, 0, None), (6, None, 1), (99, 1, 1), (None, 1, 1), (8, 1, 0)]


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, lang string, part long").repartition(3)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")  # noqa: E741
    return sorted(map(tuple, A.audit(A.mask_counts(A.flags(d), l)).select(*COLUMNS).collect()))


def test_hard_rows(spark):
    assert run(spark, DOCS, LABELS) == brute(DOCS, LABELS)


def test_no_labels_and_no_documents(spark):
    assert run(spark, DOCS[:5], []) == brute(DOCS[:5], [])
    assert run(spark, [], LABELS) == []


def test_one_group_of_copies(spark):
    docs = [(i, LONG if i % 3 else f"own {i}", "en") for i in range(300)]
    assert run(spark, docs, []) == brute(docs, [])


def test_sql_says_the_same():
    con = duckdb.connect()
    con.register("documents", pa.table({n: [r[i] for r in DOCS] for i, n in enumerate(("doc_id", "text", "lang"))}))
    con.register("labels", pa.table({n: [r[i] for r in LABELS] for i, n in enumerate(("doc_id", "quality", "toxic"))}))
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({A.OP12_SQL})").fetchall()) == brute(DOCS, LABELS)


def test_the_words_are_not_shuffled(spark, sf_dir):
    plan = A.word_counts(spark.createDataFrame([(1, 2, "a b")], "_k1 long, _k2 long, _text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
