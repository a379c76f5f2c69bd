"""Toxicity scores: a learned lexicon, met with up to one edit, and the context in which its terms stand.

From labelled documents: the lexicon's terms are words, or beginnings of words, found in toxic documents and almost nowhere
else. They form a trie; its product with the Levenshtein automata of edit distance 1 is made deterministic as words are read, so a
word costs one lookup for each letter. Each hit is looked at in its window: is it quoted, how many others are near. A logistic
regression on the counts (unquoted and quoted apart) gives the score.

About MOST_LABELLED labelled documents at most, chosen by hash, train lexicon and weights; that is the only sample.
No label, language, source or id is an input of a score.

Edge cases: null and empty texts get the score of a text without hits; without labels every score is 0; an empty table gives an
empty result; repeated rows get equal scores; a document with several labels counts as toxic if one says so; null labels don't
count; texts of any length are taken whole; other columns are kept, whatever
their names, but for `_toxicity`.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm.common import hash_sample, steps, table

MOST_LABELLED = 20_000
#: Shortest and longest beginnings of words that can be terms, and the length from which a term is met with an edit.
SHORTEST, LONGEST, FUZZY_FROM = 4, 8, 5
LEAST_DOCS, LEAST_SHARE, LEAST_LOG_ODDS = 4, 0.01, 3.0
#: Words on either side that make a hit's window.
WINDOW = 12
THRESHOLD = 0.3
RIDGE = 1.0
WORD = re.compile(r"\w+")
#: Words, and states of the automaton, kept in a worker.
MOST_WORDS, MOST_STATES = 1_000_000, 200_000
#: Opening and closing quotation marks.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›"}
FEATURES = ("one", "word", "stem", "near_word", "near_stem", "quoted", "crowd", "density")


def prefixes(word: str) -> list[str]:
    """The beginnings of a word that may be terms, and the word itself with $ after it."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + "$"] * (len(word) >= SHORTEST)


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[str]:
    """Terms from the numbers of toxic and clean documents with each beginning: the longest that lose little of the shortest pure one."""
    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    odds = lambda a, b: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    pure = {p: a for p, (a, b) in counts.items() if a >= least and odds(a, b) >= LEAST_LOG_ODDS}
    longer: dict[str, list[str]] = {}
    for p in pure:
        whole = p.endswith("$")
        parent = p[:-1] if whole and len(p) - 1 <= LONGEST else p[:LONGEST] if whole else p[:-1]
        if parent in pure:
            longer.setdefault(parent, []).append(p)
    inner = {p for v in longer.values() for p in v}
    terms = []
    for p in pure:
        if p not in inner:
            while (best := max(longer.get(p, ()), key=pure.get, default=None)) and pure[best] >= 0.9 * pure[p]:
                p = best
            terms.append(p)
    return sorted(set(terms), key=lambda p: (-pure[p], p))


class FuzzyTrie:
    """What a word hits: (kind) 1 a whole word, 2 a beginning, 3 and 4 the same with one edit, 0 nothing.

    A state is the set of (node, edits) that the letters read may have led to; an edit is a letter replaced, added or left out.
    """

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # of a node: 1 a whole word ends, 2 a beginning ends
        self.depth = [0]
        for t in terms:
            node = 0
            for c in t.removesuffix("$"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(0)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[node][c]
            self.ends[node] |= 1 if t.endswith("$") else 2
        self.kept: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        start = frozenset({(0, 0)}) | {(n, 1) for n in self.child[0].values()}
        self.states = [start]
        self.numbers = {start: 0}
        self.next: list[dict[str, int]] = [{}]
        self.at_end = [self._end(start)]
        self.stem = [0]

    def _end(self, state: frozenset[tuple[int, int]]) -> int:
        kinds = [1 if e == 0 else 3 for n, e in state if self.ends[n] & 1 and (e == 0 or self.depth[n] >= FUZZY_FROM)]
        return min(kinds, default=0)

    def _step(self, i: int, c: str) -> int:
        to = set()
        for n, e in self.states[i]:
            if (m := self.child[n].get(c)) is not None:
                to.add((m, e))
            if e == 0:
                to.add((n, 1))
                for m in self.child[n].values():
                    to.add((m, 1))
        # a letter that the word leaves out: the node after the one just reached costs the edit
        to |= {(m, 1) for n, e in to if e == 0 for m in self.child[n].values()}
        state = frozenset((n, e) for n, e in to if e == 0 or (n, 0) not in to)
        j = self.numbers.get(state)
        if j is None:
            j = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
            self.at_end.append(self._end(state))
            stems = [2 if e == 0 else 4 for n, e in state if self.ends[n] & 2 and (e == 0 or self.depth[n] >= FUZZY_FROM)]
            self.stem.append(min(stems, default=0))
        self.next[i][c] = j
        return j

    def kind(self, word: str) -> int:
        state, stem = 0, 9
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if self.stem[state]:
                stem = min(stem, self.stem[state])
            elif not self.states[state]:
                break
        return min([k for k in (stem % 9, self.at_end[state]) if k], default=0)

    def learn(self, words: set[str]) -> dict[str, int]:
        if len(self.kept) > MOST_WORDS:
            self.kept.clear()
        for w in words.difference(self.kept):
            if len(self.states) > MOST_STATES:
                self.reset()
            self.kept[w] = self.kind(w)
        return self.kept


def in_quotes(text: str, places: list[tuple[int, int]]) -> np.ndarray:
    """Whether each place lies between quotation marks on its line, from the places of all marks and line ends."""
    begin, end = np.array(places).reshape(-1, 2).T
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    found = functools.cache(lambda c: np.flatnonzero(points == ord(c)))
    breaks = np.concatenate([[-1], found("\n"), [len(text)]])
    first, last = breaks[np.searchsorted(breaks, begin) - 1] + 1, breaks[np.searchsorted(breaks, end)]
    before = lambda c: np.concatenate([[-1], found(c)])[np.searchsorted(found(c), begin)]  # noqa: E731  the mark's last place
    between = lambda c, i, j: np.searchsorted(found(c), j) - np.searchsorted(found(c), i)
    out = np.zeros(len(begin), bool)
    for left, right in QUOTES.items():
        closes = between(right, end, last) > 0
        if left == right:
            out |= (between(left, first, begin) % 2 == 1) & closes
        else:
            out |= (before(left) >= first) & (before(left) > before(right)) & closes
    return out


def quoted(text: str, at: int, end: int) -> bool:
    """in_quotes of one place."""
    return bool(in_quotes(text, [(at, end)])[0])


def features(trie: FuzzyTrie, texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    low = [(t or "").lower() for t in texts]
    words = [WORD.findall(t) for t in low]
    kept = trie.learn(set().union(*words)) if words else {}
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = 1
    for i, (t, w) in enumerate(zip(low, words)):
        kinds = np.fromiter(map(kept.__getitem__, w), np.int8, len(w))
        hits = np.flatnonzero(kinds)
        if not len(hits):
            continue
        places, k = [], 0
        for n, m in enumerate(WORD.finditer(t)):
            if n == hits[k]:
                places.append(m.span())
                k += 1
                if k == len(hits):
                    break
        plain = ~in_quotes(t, places)
        own = hits[plain]
        by_kind = np.bincount(kinds[own], minlength=5)[1:5]
        crowd = (np.searchsorted(own, own + WINDOW, "right") - np.searchsorted(own, own - WINDOW)).max(initial=0)
        out[i, 1:5] = np.log1p(by_kind)
        out[i, 5:] = math.log1p(len(hits) - len(own)), math.log1p(crowd), math.log1p(100 * (by_kind[0] + by_kind[1]) / len(w))
    return out


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge penalty (but for the constant), by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@functools.lru_cache(maxsize=4)
def _trie(terms: tuple[str, ...]) -> FuzzyTrie:
    """One for each lexicon and Python worker, kept between tasks."""
    return FuzzyTrie(list(terms))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[tuple[str, ...], np.ndarray | None]:
    """Terms and weights. The driver gets the chosen rows' counts and features: both bounded."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("toxic").alias("_toxic"))
    known = hash_sample(known, MOST_LABELLED)
    some = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "_doc").select("text", (F.col("_toxic") > 0).alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {"": [0, 0]}  # "" counts the documents
        for b in steps(batches):
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[""][toxic] += 1
                for p in {p for w in set(WORD.findall((t or "").lower())) for p in prefixes(w)}:
                    found.setdefault(p, [0, 0])[toxic] += 1
        got = [(p, a, b) for p, (b, a) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["term", "a", "b"])

    counts = some.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # pure terms only: their number is bounded by the toxic documents' words; the bound on labelled documents bounds it
    rows = counts.where(f"term = '' OR (a >= {LEAST_DOCS} AND b <= 0.05 * a)").collect()
    by_term = {r["term"]: (r["a"], r["b"]) for r in rows}
    toxic, clean = by_term.pop("", (0, 0))
    if not toxic or not clean:
        return (), None
    terms = tuple(choose_terms(by_term, toxic, clean))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            x = features(_trie(terms), b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    got = some.mapInArrow(featured, "x array<double>, toxic boolean").toPandas()
    return terms, fit_weights(np.stack(got["x"].to_numpy()), got["toxic"].to_numpy().astype(float))


def score(docs: DataFrame, model: tuple[tuple[str, ...], np.ndarray | None]) -> DataFrame:
    """docs with the column _toxicity, from 0 to 1."""
    terms, weights = model
    if weights is None:
        return docs.withColumn("_toxicity", F.lit(0.0))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts, out, at = s.tolist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                z = features(_trie(terms), texts[at:end]) @ weights
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                at = end
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("_toxicity", toxicity(docs["text"].cast("string")))


def op8_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose score is under the threshold."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("_toxicity") < THRESHOLD).select(*docs.columns)
