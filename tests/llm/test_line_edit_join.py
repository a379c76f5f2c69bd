"""Line dedup against a brute-force version."""

import hashlib
import random

import pytest

from inspectra.llm import line_edit_join as L


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute(spark, docs):
    first, of = {}, {}
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "i int, t string").selectExpr("i", "xxhash64(t) AS h").collect()
    for r in rows:
        d = docs[r["i"]][0]
        of[r["i"]] = (d is not None, d or 0, r["h"])
    for i, (d, t) in enumerate(docs):
        for x in (t or "").split("\n"):
            if len(x) >= L.LEAST_CHARS:
                first[x] = min(first.get(x, of[i]), of[i])
    lines = [*first]
    h = {r["x"]: r["h"] for r in spark.createDataFrame([(x,) for x in lines], "x string").selectExpr("x", "xxhash64(x) AS h").collect()}
    covered = {x for x in lines for y in lines if x != y and (first[y], h[y], y) < (first[x], h[x], x) and distance_at_most_one(x, y)}
    out = {}
    for i, (d, t) in enumerate(docs):
        if t is None:
            out.setdefault((d, t), None)
            continue
        seen, left = set(), []
        for x in t.split("\n"):
            if len(x) < L.LEAST_CHARS or (x not in covered and first[x] == of[i] and x not in seen):
                left.append(x)
            seen.add(x)
        out[d, t] = "\n".join(left)
    return out, len(covered)


def made(n, seed):
    rng = random.Random(seed)
    alphabet = "abcé中 "
    bases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 60))) for _ in range(12)]
    docs = [(None, "a null id has this line in it\nshort"), (1, None), (2, ""), (3, "\n\n"), (4, bases[0] + "\n" + bases[0]), (4, bases[1])]
    for d in range(5, n):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(x))
                kind = rng.randrange(3)
                if kind == 0:
                    x[k] = rng.choice(alphabet)
                elif kind == 1:
                    x.insert(k, rng.choice(alphabet))
                else:
                    del x[k]
            lines.append("".join(x))
        docs.append((d, "\n".join(lines)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot", [2, 32])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT", hot)
    docs = made(250, hot)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, line string, key int")
    want, covered = brute(spark, docs)
    got = {}
    rows = L.dedup_lines(df).collect()
    assert len(rows) == len(docs) and set(rows[0].asDict()) == {"doc_id", "text", "line", "key"}
    assert covered > 50
    texts = sorted((repr(d), repr(want[d, t])) for d, t in docs)
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in rows) == texts


def test_rest_of_one_hot_group(spark):
    docs = [(i, "one common beginning of a line, number %03d" % i) for i in range(200)] + [(500 + i, "one common beginning of a line, number %03d" % (i * 3) + "x") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, _ = brute(spark, docs)
    assert {(r["doc_id"], r["text"]) for r in L.dedup_lines(df).collect()} == {(d, x) for (d, _), x in want.items()}


def test_empty_and_query(spark, sf_dir):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(df).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in L.op7_line_edit_join(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) == set(texts)
    left = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    h = {r["x"]: r["h"] for r in spark.createDataFrame([(x,) for t in left.values() for x in set(t.split("\n")) if len(x) >= L.LEAST_CHARS], "x string").selectExpr("x", "xxhash64(x) AS h").collect()}
    for d, t in texts.items():
        assert rows[d]["n_lines"] == len(t.split("\n"))
        long = [x for x in left[d].split("\n") if len(x) >= L.LEAST_CHARS]
        short = [x for x in t.split("\n") if len(x) < L.LEAST_CHARS]
        assert rows[d]["n_kept"] == len(long) + len(short)
        assert rows[d]["kept_sha256"] == hashlib.sha256(",".join(str(v) for v in sorted(h[x] for x in long)).encode()).hexdigest()


def test_short_lines(spark):
    docs = [(1, "Les.\n\nLes.\nOf, edti oner."), (2, "Lea.\nLes.\n\nOf, edti oner.\nx"), (3, "x\ny\nOf, edti oner!")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()}
    assert got == {1: "Les.\n\nOf, edti oner.", 2: "Lea.\n\nx", 3: "y"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("hot", [2, 32])
def test_a_few_edits_in_long_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT", hot)
    rng = random.Random(hot)
    words = ["".join(rng.choice("abcdé中") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bases = [" ".join(rng.choice(words) for _ in range(n)) for n in (10, 14, 20, 30, 45, 60)] + ["".join(rng.choice("ab中") for _ in range(n)) for n in (64, 100, 300)] + ["-" * 70]
    texts = {"Onlyhe this then erin " + "and so on to the end of the line " * 4, "Onlyhe this atshsh erin " + "and so on to the end of the line " * 4}
    for b in bases * 9:
        x = list(b)
        for _ in range(rng.randint(0, 7)):
            k, kind = rng.randrange(len(x)), rng.randrange(3)
            x[k : k + (kind != 1)] = [] if kind == 2 else [rng.choice("ab 中")]
        texts.add("".join(x))
    docs = list(enumerate(sorted(texts)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lines = L.distinct_lines(L._each_line(df, "doc_id", "text", 1))
    rows = sorted((r["doc"]["id"], r["h"], r["line"]) for r in lines.collect())
    near = lambda a, b: abs(len(a) - len(b)) <= 8 and distance(a, b) <= min(8, max(1, min(len(a), len(b)) // 32))
    want = {x[1] for i, x in enumerate(rows) if any(near(x[2], y[2]) for y in rows[:i])}
    assert {r["_line_h"] for r in L.covered_lines(lines).collect()} == want and 20 < len(want) < len(rows)
    for often in (64, 2):
        monkeypatch.setattr(L, "FREQUENT", often)
        kept = {r["_line_h"] for x in L.kept_lines(df).collect() for r in x["_line_kept"]}
        assert kept == {x[1] for x in rows} - want
    monkeypatch.setattr(L, "BROADCAST", 0)
    assert {r["_line_h"] for x in L.kept_lines(df).collect() for r in x["_line_kept"]} == kept


def test_few_pairs_of_a_family_that_is_not_near(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlugwb") for _ in range(rng.randint(4, 8)))
    base, docs = [word() for _ in range(70)], []
    for i in range(150):
        x = list(base)
        for k in rng.sample(range(70), 4):
            x[k] = word()
        docs.append((i, " ".join(x)))
    docs += [(200 + i, docs[i][1][:100] + "xy" + docs[i][1][101:]) for i in range(0, 150, 10)]
    lines = L.distinct_lines(L._each_line(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 1)).cache()
    met, verified = [], L._verified
    monkeypatch.setattr(L, "_verified", lambda lines, pairs, most: met.append(pairs.count()) or verified(lines, pairs, most))
    covered = {r["_line_h"] for r in L._long_covered(lines, L.MOST).collect()}
    assert {r["doc"]["id"] for r in lines.collect() if r["h"] in covered} == {200 + i for i in range(0, 150, 10)}
    assert sum(met) < 1000  # of 13,530 pairs


def test_many_lines_in_one_text(spark):
    lines = [f"line number {i * 7919 % 100_003} of this text and {i}" for i in range(100_000)]
    kept = [(i, line) for i, line in enumerate(lines) if i % 3]
    df = spark.createDataFrame([("\n".join(lines), [line for _, line in kept])], "text string, kept array<string>")
    from pyspark.sql import functions as F

    has = F.transform("kept", lambda x: F.struct(L._h(x).alias("_line_h"), L._g(x).alias("_line_g")))
    assert df.select(L._left(F.col("text"), has)).first()[0].split("\n") == [line for _, line in kept]


def test_letters_of_two_parts_tell_lines_apart(spark, monkeypatch):
    """Words changed in both halves whose letters make up for each other within a half, and letters outside of LETTERS."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlugwbcmfkyvp") for _ in range(6))
    base, docs = [word() for _ in range(70)], []
    for i in range(120):
        x = list(base)
        for k in rng.sample(range(70), 3):
            x[k] = word()
        docs.append((i, " ".join(x)))
    docs += [(200 + i, docs[i][1][:100] + "kv" + docs[i][1][102:300] + "q" + docs[i][1][300:]) for i in range(0, 120, 10)]
    lines = L.distinct_lines(L._each_line(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 1)).cache()
    met, verified = [], L._verified
    monkeypatch.setattr(L, "_verified", lambda lines, pairs, most: met.append(pairs.count()) or verified(lines, pairs, most))
    covered = {r["_line_h"] for r in L._long_covered(lines, L.MOST).collect()}
    assert {r["doc"]["id"] for r in lines.collect() if r["h"] in covered} == {200 + i for i in range(0, 120, 10)}
    assert sum(met) < 1500


def test_distance_without_common_ends(spark):
    rng = random.Random(7)
    pairs = [("a" * 300, "a" * 301), ("ab" * 50, "ba" * 50), ("", "abc"), ("中é" * 600 + "x", "中é" * 600), ("x" + "b" * 2000, "b" * 2000 + "y")]
    for _ in range(300):
        x = [rng.choice("abé中 ") for _ in range(rng.randint(0, 90))]
        y = list(x)
        for _ in range(rng.randint(1, 6)):
            y[(k := rng.randint(0, len(y))) : k + rng.randint(0, 1)] = rng.choice(["", "a", "中"])
        pairs.append(("".join(x), "".join(y)))
    pairs = [p for p in pairs if p[0] != p[1]]
    df = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    rows = df.select("a", "b", L._distance(F.col("a"), F.col("b"), 4).alias("d")).collect()
    assert all(r["d"] == (d if (d := distance(r["a"], r["b"])) <= 4 else -1) for r in rows) and len(rows) > 250
