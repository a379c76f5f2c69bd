"""Secret scans: patterns, and Markov models of random strings and ordinary identifiers for what no pattern names.

All in DataFrame functions. A pattern's matches get their places from the lengths of the matches and of the pieces between
them. What they find is blanked, and every run of RUN characters that is left, parts beside a pattern's match included, is a
secret if the log-likelihood ratio of the two first-order character models exceeds LEAST_RATIO, and MORE_RATIO more for each character that it is
short of SURE_LENGTH. The models are trained from labelled samples: random strings are what the patterns find and hashes
made for it, ordinary identifiers the other runs, both of about SAMPLE_DOCS documents at most, chosen by hash.

Edge cases: a null text is empty and has no spans; an empty table gives an empty result and no models are needed; rows are
independent, so repeated rows repeat; positions count code points, ends are exclusive; other columns are kept, whatever
their names, if they don't begin with `_secret_`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions.patterns import let, running, running_sums
from inspectra.llm.common import hash_sample, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{10,}"
SAMPLE_RUN = r"[A-Za-z0-9+/_=-]{6,}"
SAMPLE_DOCS = 2000
MADE = 1000
#: Log odds that a run must have in favour of random: random runs are taken to be rarer than ordinary ones by about e^12.
LEAST_RATIO = 12.0
#: Short runs are many, so they need more.
SURE_LENGTH, MORE_RATIO = 16, 0.5
SMOOTHING = 0.5
KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"
NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def match_spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """(start, kind, end) of the pattern's leftmost non-overlapping matches. keep: an array of booleans, one for each match."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    kept = keep if keep is not None else F.array().cast("array<boolean>")
    both = let(found, lambda f: F.arrays_zip(F.slice(gaps, 1, F.size(f)).alias("gap"), f.alias("n"), kept.alias("keep")))

    def placed(m: Column, at: Column) -> Column:
        start = at + m["gap"]
        return F.when(F.coalesce(m["keep"], F.lit(True)), F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["n"]).alias("end")))

    spans = let(both, lambda b: F.filter(F.zip_with(b, running_sums(F.transform(b, lambda m: m["gap"] + m["n"])), placed), lambda s: s.isNotNull()))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(NO_SPANS))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def replaced(text: Column, spans: Column, filler: Callable[[Column, Column], Column]) -> Column:
    """The text with filler(span, place) for each of the sorted spans; place: how far the spans before it reach."""

    def fill(raw: Column) -> Column:
        cut = lambda a, n: F.decode(F.substr(raw, a * 4 + 1, n * 4), "UTF-32")  # noqa: E731  four bytes for each character
        shown = lambda s, at: F.concat(F.when(s["start"] > at, cut(at, s["start"] - at)).otherwise(""), filler(s, at))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        parts = F.zip_with(spans, running(F.transform(spans, lambda s: s["end"]), 0, _larger), shown)
        return F.concat(F.array_join(parts, ""), cut(last, F.length(text) - last))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), fill)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans' characters, so that all others keep their places."""
    return replaced(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], at))))


def is_random(s: Column, model: list[float]) -> Column:
    return ratio(s, model) > LEAST_RATIO + MORE_RATIO * F.greatest(F.lit(0), SURE_LENGTH - F.length(s))


def base_spans(text: Column) -> Column:
    """The three patterns' spans in order of start, then kind."""
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE)
    return F.sort_array(F.concat(match_spans(text, ASSIGN, 0, values), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2)))


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled strings (random boolean, s string) from a bounded number of documents, and from hashes of numbers."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = hash_sample(docs, SAMPLE_DOCS).select(text.alias("t"))
    secret = F.concat(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    secret = F.filter(secret, lambda s: F.length(s) >= 16)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    found = some.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), secret.alias("all")), F.struct(F.lit(False).alias("random"), F.regexp_extract_all(rest, F.lit(SAMPLE_RUN), F.lit(0)).alias("all")))).alias("x"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = docs.sparkSession.range(MADE).select(F.explode(F.array(digest, F.base64(F.unhex(digest)), F.upper(digest), F.regexp_replace(F.upper(F.base64(F.unhex(digest))), "[+/=]", "7"))).alias("s"))
    return found.select("x.random", F.explode("x.all").alias("s")).unionByName(made.select(F.lit(True).alias("random"), "s"))


def train(sample: DataFrame) -> list[float]:
    """For each pair of ALPHABET's characters, log P(second | first) among random strings less that among ordinary ones.

    The driver gets twice the alphabet's square of counts at most.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))
    counts = sample.where(F.length("s") > 1).select("random", F.explode(pairs).alias("pair")).where(~F.col("pair").rlike("[^A-Za-z0-9+/_=-]")).groupBy("random", "pair").count().collect()
    n = len(ALPHABET)
    tables = {True: [[SMOOTHING] * n for _ in range(n)], False: [[SMOOTHING] * n for _ in range(n)]}
    at = {c: i for i, c in enumerate(ALPHABET)}
    for r in counts:
        tables[r["random"]][at[r["pair"][0]]][at[r["pair"][1]]] += r["count"]
    logs = {k: [[math.log(x / sum(row)) for x in row] for row in t] for k, t in tables.items()}
    return [a - b for x, y in zip(logs[True], logs[False]) for a, b in zip(x, y)]


def ratio(s: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string over ALPHABET, its first character left out."""
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1)))
    terms = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.element_at(weights, ((place(i) - 1) * len(ALPHABET) + place(i + 1)).cast("int")))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def scan(docs: DataFrame, model: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """docs with two more columns: _secret_base and _secret_spans, arrays of (start, kind's number, end)."""
    model = train(samples(docs, text_col)) if model is None else model
    text = F.coalesce(F.col("_secret_text"), F.lit(""))
    out = docs.withColumn("_secret_text", docs[text_col].cast("string")).withColumn("_secret_base", base_spans(text))
    rest = F.col("_secret_rest")
    random = F.transform(F.regexp_extract_all(rest, F.lit(RUN), F.lit(0)), lambda s: is_random(s, model))
    out = out.withColumn("_secret_rest", blanked(text, F.col("_secret_base")))
    return out.withColumn("_secret_spans", F.sort_array(F.concat("_secret_base", match_spans(rest, RUN, 3, random)))).drop("_secret_text", "_secret_rest")


def listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """docs with every secret of the text replaced by MASK; spans that overlap become one."""
    found = scan(docs, model, text_col)
    masked = replaced(F.coalesce(F.col(text_col), F.lit("")), F.col("_secret_spans"), lambda s, at: F.when(s["start"] >= at, F.lit(MASK)).otherwise(""))
    return found.withColumn(text_col, F.when(F.size("_secret_spans") > 0, masked).otherwise(F.col(text_col))).drop("_secret_base", "_secret_spans")


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = lambda kind: F.size(F.filter("_secret_base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(F.col("doc_id").cast("long").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("_secret_base")), 256).alias("base_sha256"), listed(F.col("_secret_spans")).alias("spans"))
