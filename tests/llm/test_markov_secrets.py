"""Spans of secrets against Python's regular expressions; the models; redaction."""

import hashlib
import random
import re
import string

from inspectra.llm import markov_secrets as M

ASSIGN = re.compile(M.ASSIGN)


def base(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


HARD = [
    None, "", "token", "é😀 token = abcdef", "TOKEN:'abcdef' apiKEY=\"x\" api_key = \"123456\"", "secret=token: abcdefgh", "password=secret=abcdefgh", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA",
    "0123456789abcdef0123456", "0123456789abcdef01234567é" + "f" * 30, "token=" + "a" * 40 + "\nsecret = short", "x" * 50_000 + " passwd: hunter22", "key 9fQ2xL0vT7rZk3WbN8sYpA1dGh5JcM4e here", "a_perfectly_ordinary_identifier_name_of_some_length",
]


def test_base_spans(spark, sf_dir):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)] + [(3, HARD[3], "x")], "doc_id long, text string, s string")
    model = [0.0] * len(M.ALPHABET) ** 2
    got = M.scan(df, model).select("doc_id", "s", M.listed("_secret_base").alias("base"), M.listed("_secret_spans").alias("spans")).collect()
    assert len(got) == len(HARD) + 1 and all(r["base"] == r["spans"] == base(HARD[r["doc_id"]] or "") for r in got)
    assert M.scan(df.limit(0), model).count() == 0 and M.scan(df.limit(0)).count() == 0
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = M.op9_markov_secrets(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k) for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_models_tell_random_from_ordinary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = M.train(M.samples(docs))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in M.scan(df, model).select("doc_id", M.listed("_secret_spans").alias("spans")).collect()}
    assert got[12] == "random:4:36" and got[13] == ""
    left = {r["doc_id"]: r["text"] for r in M.redact(df, model).collect()}
    assert left[12] == "key [SECRET] here" and left[13] == HARD[13] and left[0] is None
    assert left[10] == "[SECRET]\nsecret = short" and left[3] == "é😀 [SECRET]"
    # held-out strings: hashes of other numbers against words of the documents
    made = spark.range(5000, 5400).selectExpr("sha2(CAST(id AS STRING), 256) AS s").selectExpr("base64(unhex(s)) AS s")
    words = docs.selectExpr("explode(split(text, '[^A-Za-z0-9+/_=-]+')) AS s").where("length(s) >= 12").distinct()
    hit = lambda d: d.where(M.ratio(M.F.col("s"), model) > M.LEAST_RATIO).count() / d.count()
    assert hit(made) > 0.95
    assert hit(words.where("s rlike '^[A-Za-z]+$'")) < 0.01


def brute_random(text, model):
    """Runs outside of base spans that the models take for random, by plain loops."""
    for s in filter(None, base(text).split(",")):
        _, i, j = s.split(":")
        text = text[: int(i)] + " " * (int(j) - int(i)) + text[int(j) :]
    n, at = len(M.ALPHABET), {c: i for i, c in enumerate(M.ALPHABET)}
    out = []
    for m in re.finditer(M.RUN, text):
        ratio = sum(round(model[at[a] * n + at[b]], 6) for a, b in zip(m[0], m[0][1:]))
        if ratio > M.LEAST_RATIO + M.MORE_RATIO * max(0, M.SURE_LENGTH - len(m[0])):
            out.append(f"random:{m.start()}:{m.end()}")
    return out


def test_random_spans_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = M.train(M.samples(docs))
    mixed = " ".join(f"Qz{i}xL0vT7rZk3WbN8sYpA1d{i * 7919 % 97}Gh token=abc{i}def0 {'0a1b' * 7} plain_words_of_an_identifier qzxv{i % 7}kwjhqpfz {'c0ffee' * 4}-Zk3WbN8sYpA{i} Xq{i}=password=abcdefgh" for i in range(60))
    df = docs.unionByName(spark.createDataFrame([(-1, mixed), (-2, "é" + mixed[::-1])], docs.schema))
    rows = M.scan(df, model).select("text", M.listed("_secret_spans").alias("spans")).collect()
    found = 0
    for r in rows:
        want = brute_random(r["text"] or "", model)
        assert [s for s in r["spans"].split(",") if s.startswith("random")] == want
        found += len(want)
    assert found > 60


def test_short_and_one_case_secrets(spark, sf_dir):
    """Held-out strings of one case and of twelve characters on, in text; and ordinary words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, rng = M.train(M.samples(docs)), random.Random(17)
    alphabets = {"lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "both": string.ascii_letters + string.digits}
    for name, alphabet in alphabets.items():
        for length, least in ((12, 0.75), (16, 0.88), (24, 0.95)):
            rows = [(i, "the key is " + "".join(rng.choices(alphabet, k=length)) + " of it") for i in range(300)]
            spans = [r[0] for r in M.scan(spark.createDataFrame(rows, "id long, text string"), model).select(M.listed("_secret_spans")).collect()]
            assert sum(s == f"random:11:{11 + length}" for s in spans) >= least * 300, (name, length)
    ordinary = docs.select(M.F.regexp_replace("text", "[^a-z ]", " ").alias("text"))
    assert M.scan(ordinary, model).where("size(_secret_spans) > 0").count() <= 5


def test_parts_beside_a_base_span(spark):
    text = "é Q9fQ2xL0vT7rZk3WbN8s-" + "0123456789abcdef" * 2 + "-Xk3WbN8sYpA1dGh5 token=abcdefgh"
    df = spark.createDataFrame([(text,)], "text string")
    spans = M.scan(df, [1.0] * len(M.ALPHABET) ** 2).select(M.listed("_secret_spans")).first()[0]
    assert spans == "random:2:23,hex:23:55,random:55:72,assign:73:87"
    assert M.redact(df, [1.0] * len(M.ALPHABET) ** 2).first()[0] == "é [SECRET][SECRET][SECRET] [SECRET]"


def test_many_spans_in_one_text(spark):
    text = "é " + " ".join(f"token=abcdef{i} Q9fQ2xL0vT7rZk3WbN8sYpA{i}" for i in range(20_000))
    model = [1.0] * len(M.ALPHABET) ** 2
    df = spark.createDataFrame([(text,)], "text string")
    assert M.scan(df, model).select(M.F.size("_secret_base"), M.F.size("_secret_spans")).first()[:] == (20_000, 40_000)
    assert M.redact(df, model).first()[0] == "é " + " ".join(["[SECRET] [SECRET]"] * 20_000)
