"""Filter interaction audit: what each quality filter removes in every order in which the filters could be applied.

A relational pipeline. Words are exploded and aggregated by (document, word), then by document, for totals and distinct words; the texts
are dealt by document before that, so that the many rows of words never cross the network. The other flags come from one pass over the
texts (characters) and from the least id of each text (repeats), and are joined to the word counts. What five filters do to a
document is one of 32 sets of failed filters; 32 conditional counts for each part (of all documents, of good and of toxic ones) hold all
that the 120 orders need, and the orders are rows made from those counts.

Edge cases: a null text is empty; a null part is the empty string; rows of one id with different texts are documents of their own; equal
rows count as often as they occur and don't fail E for one another; a null id is smaller than none; a document is good or toxic if any of
its labels says so, null labels don't count; parts without documents, and so an empty table, have no rows; an empty labels table gives zeros; extra
columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm.common import table

LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = "[#$%&*|]"
LETTERS = "ABCDE"
_KEY = ["_k1", "_k2"]


def _keys(doc_id: Column, digest: Column) -> list[Column]:
    """128 bits that stand for an id and a text, from the text's SHA-256."""
    return [F.xxhash64(doc_id, digest).alias("_k1"), F.xxhash64(digest, doc_id, F.lit(1)).alias("_k2")]


def word_counts(texts: DataFrame) -> DataFrame:
    """Words and distinct words of the rows (_k1, _k2, _text) that share their key; those without words have no row."""
    dealt = texts.repartition("_k1")  # a row for each document is shuffled, not one for each word
    words = dealt.select(*_KEY, F.explode(F.split("_text", "[ \t-\r]+")).alias("_word")).where("_word <> ''")
    by_word = words.groupBy(*_KEY, "_word").agg(F.count("*").alias("_n"))
    return by_word.groupBy(*_KEY).agg(F.sum("_n").alias("_words"), F.count("*").alias("_distinct"))


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, copies (equal rows) and whether each filter fails: booleans A to E."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digest", F.sha2("_text", 256))
    texts = rows.select(*_keys(F.col("doc_id"), F.col("_digest")), "_text")
    capitals = 100 * F.length(F.regexp_replace("_text", "[^A-Z]+", "")) > MOST_CAPITAL_PERCENT * F.length("_text")
    flagged = rows.select(*_keys(F.col("doc_id"), F.col("_digest")), "doc_id", "part", capitals.alias("C"), F.col("_text").rlike(SYMBOLS).alias("D"))
    flagged = flagged.groupBy(*_KEY, "doc_id", "part", "C", "D").agg(F.count("*").alias("copies"))
    rows_of = flagged.groupBy(*_KEY).agg(F.sum("copies").alias("_rows"))  # of an id and text, whatever their parts
    least = rows.where("doc_id IS NOT NULL").groupBy("_digest").agg(F.min("doc_id").alias("_least"))
    first = least.select(*_keys(F.col("_least"), F.col("_digest")), F.lit(True).alias("_first"))
    words = F.coalesce(F.col("_words"), F.lit(0)) / F.col("_rows")
    return (
        flagged.join(rows_of, _KEY)
        .join(word_counts(texts), _KEY, "left")
        .join(first, _KEY, "left")
        .select(
            "doc_id", "part", "copies",
            (words < LEAST_WORDS).alias("A"), (100 * F.coalesce("_distinct", F.lit(0)) < LEAST_DISTINCT_PERCENT * words).alias("B"),
            "C", "D", (F.col("doc_id").isNotNull() & F.col("_first").isNull()).alias("E"),
        )
    )


def mask_counts(flagged: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For each part three arrays with an entry for each set of failed filters (bit i: the i-th letter): all, good and toxic documents."""
    said = lambda c: F.coalesce(F.max(F.col(c).cast("int") == 1), F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("_good"), said("toxic").alias("_toxic"))
    mask = sum((F.col(c).cast("int") * (1 << i) for i, c in enumerate(letters)), F.lit(0))
    met = flagged.join(known, "doc_id", "left").select("part", "copies", mask.alias("_mask"), "_good", "_toxic")

    def counts(kind: str, also: Column) -> list[Column]:
        return [F.sum(F.when((F.col("_mask") == m) & also, F.col("copies")).otherwise(0)).alias(f"{kind}{m}") for m in range(1 << len(letters))]

    kinds = {"n": F.lit(True), "good": F.col("_good"), "toxic": F.col("_toxic")}
    wide = met.groupBy("part").agg(*(c for kind, also in kinds.items() for c in counts(kind, also)))
    return wide.select("part", *(F.array(*(f"{kind}{m}" for m in range(1 << len(letters)))).alias(kind) for kind in kinds))


def orders(letters: str = LETTERS) -> Column:
    """All orders of the letters, as an array of strings."""
    out = F.array(F.lit(""))
    for _ in letters:
        longer = lambda s: F.transform(F.filter(F.array(*map(F.lit, letters)), lambda c: ~F.contains(s, c)), lambda c: F.concat(s, c))
        out = F.flatten(F.transform(out, longer))
    return out


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order and step, from the counts by sets of failed filters."""
    sets = F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))
    places = F.sequence(F.lit(1), F.lit(len(letters)))
    bit = lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.substring("filter_order", i, F.lit(1))) - 1)
    before = F.aggregate(F.filter(places, lambda i: i < F.col("step")), F.lit(0), lambda b, i: b.bitwiseOR(bit(i)))
    steps = counts.select("*", F.explode(orders(letters)).alias("filter_order")).select("*", F.explode(places).alias("step"))
    steps = steps.withColumn("_own", bit(F.col("step"))).withColumn("_before", before)

    def total(kind: str, which) -> Column:  # noqa: ANN001
        return F.aggregate(F.filter(sets, which), F.lit(0).cast("long"), lambda s, m: s + F.element_at(kind, m + 1))

    own, earlier = F.col("_own"), F.col("_before")
    passes, fails = lambda m: m.bitwiseAND(earlier) == 0, lambda m: m.bitwiseAND(own) != 0
    removed = lambda m: passes(m) & fails(m)
    out = steps.select(
        "part", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("_letter"),
        total("n", lambda m: passes(m) & ~fails(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: ~passes(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    )
    shares = out.groupBy("part", "_letter").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "_letter"]).drop("_letter")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT k, count(*) AS n, count(DISTINCT word) AS u FROM (SELECT k, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM d) GROUP BY k),
    least AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
    l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(coalesce(n, 0) < 100 AS INT) AS a, CAST(100 * coalesce(u, 0) < 80 * coalesce(n, 0) AS INT) AS b,
            CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS dd, CAST(coalesce(doc_id > first_id, false) AS INT) AS e
        FROM d LEFT JOIN w USING (k) JOIN least USING (text) LEFT JOIN l USING (doc_id)),
    x AS (SELECT part, a + 2 * b + 4 * c + 8 * dd + 16 * e AS m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
    i AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
    z AS (SELECT *, 1 << (instr('ABCDE', filter_order[step]) - 1) AS own, CAST(coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (instr('ABCDE', filter_order[j]) - 1))), 0) AS INT) AS before FROM i),
    r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (m & before = 0 AND m & own = 0), 0) AS kept, coalesce(sum(n) FILTER (m & before = 0 AND m & own <> 0), 0) AS removed,
            coalesce(sum(n) FILTER (m & before <> 0 AND m & own <> 0), 0) AS redundant, coalesce(sum(n) FILTER (m = own), 0) AS unique_fails,
            coalesce(sum(g) FILTER (m & before = 0 AND m & own <> 0), 0) AS good_lost, coalesce(sum(t) FILTER (m & before = 0 AND m & own <> 0), 0) AS toxic_lost
        FROM x, z GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
