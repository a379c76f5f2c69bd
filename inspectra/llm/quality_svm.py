"""Text quality by naive Bayes support vectors.

A text's n-grams are indicators: words, pairs of words, and one to three neighbouring shapes of words (capital, small, digit, the
mark itself; runs of a class count as two), hashed into 2^BITS places. From labelled documents come the log ratios of how often each
n-gram is met in good and in other documents; the indicators are scaled by them and each text's vector to length 1. A linear model
with hinge loss is fitted to those by dual coordinate descent, the rarer class weighing more. A sigmoid, fitted to the margins of documents that a first model hasn't
seen, makes a score of a margin.

About MOST_LABELLED labelled documents, chosen by hash, train ratios, weights and sigmoid; that is the only sample. The ratios are counted in
Spark; the fit, whose input the sample bounds, is one task. No label, language, source or id is an input of a score.

Edge cases: null and empty texts have no n-grams and get the score of the model's constant; without labels every score is 0.5, and where
labels have only one value, its share (one added to either); an empty table gives an empty result; repeated rows get equal scores; a document with
several labels counts as good if one says so, null labels don't count; a text of which no n-gram has been met likewise has the constant's score; texts of
any length are taken whole; other columns are kept, whatever their names, but for `_quality`.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm.common import hash_sample, steps, table, written

MOST_LABELLED = 10_000
BITS = 18
#: Added to every count of an n-gram; cost of a violated margin; passes of the descent at most, and the change that ends them.
SMOOTHING, COST, PASSES, STILL = 1.0, 1.0, 40, 0.05
THRESHOLD = 0.5
#: Of so many training documents one is kept for the sigmoid.
FOLDS = 5
SPACE, CAPITAL, SMALL, DIGIT, FIRST_MARK = range(5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Class (marks: a number of their own) and lower case of every code point."""
    kind, low = np.zeros(0x110000, np.uint32), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c, of = chr(i), unicodedata.category(chr(i))
        if c.isspace():
            continue
        kind[i] = CAPITAL if of in ("Lu", "Lt") else SMALL if of[0] in "LM" else DIGIT if of[0] == "N" else FIRST_MARK + i
        if of in ("Lu", "Lt") and len(c.lower()) == 1:
            low[i] = ord(c.lower())
    return kind, low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(2)
def _powers(base: int, bits: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, base, np.uint64)]))


def _hashes(codes: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
    """A hash of each word's codes in turn; 0 for words without any. word: of each code, ascending."""
    bits = max(10, int(len(codes)).bit_length())
    up, down = _powers(_BASE, bits), _powers(pow(_BASE, -1, 1 << 64), bits)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed((codes.astype(np.uint64) + np.uint64(1)) * _ODD) * up[: len(codes)])])
    cut = np.searchsorted(word, np.arange(n_words + 1))
    return np.where(cut[1:] > cut[:-1], _mixed((sums[cut[1:]] - sums[cut[:-1]]) * down[np.minimum(cut[:-1], len(down) - 1)]) | np.uint64(1), np.uint64(0))


def ngrams(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of each text, as (number of the text, hash), ascending."""
    texts = [t or "" for t in texts]
    ends = np.cumsum([len(t) + 1 for t in texts])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, lower = characters()
    kind = kinds[points]
    inside = kind != SPACE
    before = np.concatenate([[SPACE], kind[:-1]])
    begins = inside & (before == SPACE)
    word = np.cumsum(begins) - 1
    n_words = int(word[-1]) + 1
    doc = np.searchsorted(ends, np.flatnonzero(begins), "right")
    plain = inside & (kind < FIRST_MARK)
    letters = _hashes(lower[points[plain]], word[plain], n_words)
    two = np.concatenate([[SPACE], before[:-1]])
    shown = inside & ((kind != before) | (kind != two))
    shapes = _hashes(kind[shown], word[shown], n_words)

    found = []

    def put(h: np.ndarray, of: np.ndarray, salt: int) -> None:
        found.append(of.astype(np.int64) << bits | (_mixed(h + np.uint64(salt * int(_ODD) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64))

    has = letters > 0
    put(letters[has], doc[has], 1)
    together = doc[1:] == doc[:-1]
    both = together & has[1:] & has[:-1]
    put((letters[:-1] * np.uint64(3) + _mixed(letters[1:]))[both], doc[1:][both], 2)
    put(shapes, doc, 3)
    pairs = shapes[:-1] * np.uint64(3) + _mixed(shapes[1:])
    put(pairs[together], doc[1:][together], 4)
    three = together[1:] & together[:-1]
    put((pairs[:-1] * np.uint64(5) + _mixed(shapes[2:]))[three], doc[2:][three], 5)
    every = np.sort(np.concatenate(found))
    every = every[np.diff(every, prepend=-1) > 0]
    return every >> bits, every & ((1 << bits) - 1)


@dataclass
class Model:
    """Weights of the scaled indicators (ratio times the linear model's), squared ratios, constant, and the sigmoid."""

    weights: np.ndarray
    squares: np.ndarray
    constant: float
    slope: float
    shift: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        doc, h = ngrams(texts)
        total = np.bincount(doc, self.weights[h], len(texts))
        size = np.sqrt(np.bincount(doc, self.squares[h], len(texts)))
        return total / np.where(size > 0, size, 1) + self.constant

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], ratios: np.ndarray, good: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and constant of the hinge-loss model of the scaled, normalised rows (hashes of each), by dual coordinate descent.

    One dual variable for each row, between 0 and its class's cost; a step sets one to its best value with the others fixed. The
    constant is the weight of a feature that every row has.
    """
    n, y = len(rows), np.where(good, 1.0, -1.0)
    upper = cost * np.where(good, n / (2 * max(1, good.sum())), n / (2 * max(1, (~good).sum())))
    values = [ratios[r] for r in rows]
    values = [v / s if (s := np.sqrt(v @ v)) > 0 else v for v in values]
    square = np.array([v @ v + 1.0 for v in values])
    dual, w, constant, order = np.zeros(n), np.zeros(len(ratios)), 0.0, np.random.default_rng(0)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(n).tolist():
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + constant) - 1
            if (slope > 0 and dual[i] == 0) or (slope < 0 and dual[i] == upper[i]):
                continue
            most = max(most, abs(slope))
            to = min(max(dual[i] - slope / square[i], 0.0), upper[i])
            by, dual[i] = (to - dual[i]) * y[i], to
            w[r] += by * v  # the hashes of a row are different
            constant += by
        if most < STILL:
            break
    return w, constant


def sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton steps; labels are drawn in by one count each, so both stay finite."""
    up, down = (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2)
    want, x, at = np.where(good, up, down), np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - want) + 1e-4 * (at - [1.0, 0.0]))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def fit(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray) -> Model:
    """The model, and its sigmoid from another one that has not seen every FOLDS-th row. Both classes must be there."""
    w, constant = descend(rows, ratios, good)
    slope, shift = 1.0, 0.0
    kept = np.arange(len(rows)) % FOLDS == 0
    if len({*good[kept].tolist()}) == 2 == len({*good[~kept].tolist()}):
        part, own = descend([r for r, k in zip(rows, kept) if not k], ratios, good[~kept])
        scaled = [(ratios[r], r) for r, k in zip(rows, kept) if k]
        slope, shift = sigmoid(np.array([part[r] @ v / max(np.sqrt(v @ v), 1e-12) + own for v, r in scaled]), good[kept])
    return Model((ratios * w).astype(np.float32), (ratios**2).astype(np.float32), constant, slope, shift)


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or one score for all texts where labels say only one thing or nothing."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("quality").alias("_quality"))
    known = hash_sample(known, MOST_LABELLED)  # of a bounded size, so it can be broadcast
    some = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "_doc").select("text", "_doc", (F.col("_quality") > 0).alias("good"))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            doc, h = ngrams(b.column(0).to_pylist())
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            h = h.astype("<u4")
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["doc", "good", "ngrams"])

    rows = written(some.mapInArrow(indexed, "doc long, good boolean, ngrams binary"), "quality-ngrams")
    n = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return (n.get(True, 0) + 1) / (sum(n.values()) + 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for good, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                met[int(good), np.frombuffer(raw, "<u4")] += 1
        has = np.flatnonzero(met.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(met[1, has]), pa.array(met[0, has])], ["ngram", "good", "other"])

    counts = rows.select("good", "ngrams").mapInArrow(count, "ngram long, good long, other long").groupBy("ngram").agg(F.sum("good").alias("good"), F.sum("other").alias("other"))
    met = counts.toPandas()  # 2^BITS rows at most
    p, q = np.full(1 << BITS, SMOOTHING), np.full(1 << BITS, SMOOTHING)
    p[met["ngram"]] += met["good"]
    q[met["ngram"]] += met["other"]
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    ratios[(p == SMOOTHING) & (q == SMOOTHING)] = 0.0

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(list(batches)).sort_by([("doc", "ascending"), ("ngrams", "ascending")])
        hashes = [np.frombuffer(x, "<u4").astype(np.int64) for x in every.column("ngrams").to_pylist()]
        m = fit(hashes, np.array(every.column("good").to_pylist()), ratios)
        yield pa.RecordBatch.from_pylist([{"weights": m.weights.tobytes(), "squares": m.squares.tobytes(), "constant": m.constant, "slope": m.slope, "shift": m.shift}])

    m = rows.repartition(1).mapInArrow(fitted, "weights binary, squares binary, constant double, slope double, shift double").first()
    return Model(np.frombuffer(m["weights"], np.float32), np.frombuffer(m["squares"], np.float32), m["constant"], m["slope"], m["shift"])


def score(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """docs with the column _quality, from 0 to 1."""
    if isinstance(model, float):
        return docs.withColumn("_quality", F.lit(model))

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            parts = [model.score(b.column(0).to_pylist()) for b in steps(iter([pa.RecordBatch.from_arrays([pa.array(s, pa.string())], ["text"])]))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("_quality", quality(docs[text_col].cast("string")))


def op13_quality_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted"))
