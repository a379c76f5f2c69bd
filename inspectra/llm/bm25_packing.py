"""Lexical retrieval packing: a sharded BM25 index hands each seed document its unused neighbours, which fill the seed's window.

Documents are dealt into shards of a bounded size by their content: each has two keys, the least hashes of its terms that several
documents but not many have, and shards are ranges of the keys; so documents that share terms meet, and what is too much for one shard is split.
Each shard builds an inverted index over its documents; document frequencies and the mean length come from all documents. A seed's window is filled with its unused neighbours, best score first
(ties to the earlier row); the document that crosses the window's end is cut there and seeds the next window, so only a shard's
end is ragged. That end is cut into lengths that are powers of two, which take no padding.

Edge cases: a null or empty text is its end id alone; an empty table gives an empty result; repeated rows and doc_ids are packed
as often as they occur; documents over a window fill whole windows of their own first, and only the rest fills windows with others; what it is matched
by is still the whole document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm.common import steps, written
from inspectra.llm.word_ids import token_ids

WINDOW = 2048
K1, B = 1.2, 0.75
#: Terms that at least one in so many documents of a shard has are added as whole rows, others posting by posting.
DENSE = 8
SHARD_DOCS, SHARD_IDS = 4096, 4_000_000
#: The postings are laid out anew when fewer than this share of those in them are unused.
SHRINK = 0.75
#: Terms count for the keys if at most one in so many documents has them.
RARE = 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def corpus_statistics(ids: DataFrame, dtype: str, vocab: int) -> tuple[np.ndarray, int, int]:
    """Document frequency of each id, number of documents and of ids. The driver gets vocab + 1 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(vocab + 1, np.int64), 0, 0
        seen = np.zeros(vocab, bool)
        for b in steps(batches, "ids"):
            for raw in b.column(0).to_pylist():
                x = np.frombuffer(raw, dtype)
                seen[x] = True
                has = x[seen[x]]
                df[np.unique(has) if len(has) < 4096 else np.flatnonzero(seen)] += 1
                seen[x] = False
                docs, total = docs + 1, total + len(x)
        df[vocab] = total
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(df[has]), pa.array(np.where(has == vocab, docs, 0))], ["id", "n", "docs"])

    got = ids.select("ids").mapInArrow(run, "id long, n long, docs long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()
    df, docs, total = np.zeros(vocab, np.int64), 0, 0
    for r in got:
        if r["id"] == vocab:
            docs, total = r["docs"], r["n"]
        else:
            df[r["id"]] = r["n"]
    return df, docs, total


def content_keys(ids: DataFrame, dtype: str, df: np.ndarray, n_docs: int) -> DataFrame:
    """doc_id, ids and two keys, k and l, that documents with rare terms in common are likely to share."""
    term = np.arange(len(df), dtype=np.uint64)
    known = (df >= 2) & (df <= max(2, n_docs // RARE))
    none = np.uint64(1 << 63) - np.uint64(1)
    order = [np.where(known, (((term + np.uint64(1)) * np.uint64(m)) ^ ((term + np.uint64(1)) * np.uint64(m) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1), none).view(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "ids"):
            raw = b.column(1).to_pylist()
            x = np.frombuffer(b"".join(raw), dtype)
            at = np.cumsum([0] + [len(r) // np.dtype(dtype).itemsize for r in raw])[:-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.minimum.reduceat(o[x], at)) for o in order)], ["doc_id", "ids", "k", "l"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, k long, l long")


class ShardIndex:
    """BM25 postings of one shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(docs)
        lens = np.array([len(d) for d in docs], np.int64)
        key, tf = np.unique(np.concatenate([d.astype(np.int64) for d in docs]) * n + np.repeat(np.arange(n), lens), return_counts=True)
        term, self.doc = key // n, key % n
        norm = K1 * (1 - B + B * lens / mean)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.terms, first = np.unique(term, return_index=True)
        self.ends = np.append(first[1:], len(term))
        self.first = first
        by_doc = np.argsort(self.doc, kind="stable")
        self.of_doc = np.searchsorted(self.terms, term[by_doc])
        self.doc_at = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.n, self.kept = n, np.arange(n)
        self.lay_out()

    def lay_out(self) -> None:
        common = np.flatnonzero((self.ends - self.first) * DENSE >= max(self.n, 1))
        self.row_of = np.full(len(self.terms), -1)
        self.row_of[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        for row, t in zip(self.rows, common.tolist()):
            row[self.doc[self.first[t] : self.ends[t]]] = self.weight[self.first[t] : self.ends[t]]

    def keep(self, some: np.ndarray) -> None:
        """Drops the postings of all documents but those for which `some` holds; scores are then those of `kept`, in order."""
        number = np.cumsum(some) - 1
        stay = some[self.doc]
        before = np.append(0, np.cumsum(stay))
        self.first, self.ends = before[self.first], before[self.ends]
        self.doc, self.weight = number[self.doc[stay]], self.weight[stay]
        self.kept = self.kept[some]
        self.n = len(self.kept)
        self.lay_out()

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every kept document for all terms of the seed."""
        t = self.of_doc[self.doc_at[seed] : self.doc_at[seed + 1]]
        row = self.row_of[t]
        i, size = self.first[t[row < 0]], (self.ends - self.first)[t[row < 0]]
        at = np.repeat(i - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.rows[row[row >= 0]].sum(axis=0) + np.bincount(self.doc[at], self.weight[at], self.n)


def packing_order(docs: list[np.ndarray], lens: list[int], idf: np.ndarray, mean: float, window: int) -> list[int]:
    """The order in which documents follow each other, matched as they are, when `lens` ids of each (at most `window`) are packed."""
    index = ShardIndex(docs, idf, mean)
    unused, order, filled, nxt, seed = np.ones(len(docs), bool), [], 0, 0, None
    while len(order) < len(docs):
        if seed is None:
            while not unused[nxt]:
                nxt += 1
            seed = nxt
            unused[seed] = False
            order.append(seed)
            filled += lens[seed]
        end = (filled // window + 1) * window
        if len(order) > len(docs) - index.n * SHRINK:
            index.keep(unused[index.kept])
        score = index.scores(seed) * unused[index.kept]
        seed = None
        for d in best_first(score):
            d = int(index.kept[d])
            unused[d] = False
            order.append(d)
            filled += lens[d]
            if filled >= end:
                seed = d
                break
    return order


def best_first(score: np.ndarray) -> Iterator[int]:
    """The places of scores over 0, best first and ties by place; sorted as far as they are asked for."""
    n, done = 16, 0
    while True:
        least = max(np.partition(score, len(score) - n)[len(score) - n], 0) if n < len(score) else 0
        some = np.flatnonzero((score >= least) & (score > 0))
        yield from some[np.argsort(-score[some], kind="stable")][done:].tolist()
        if not least:
            return
        n, done = 4 * n, len(some)


def pieces(order_lens: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Where the documents, laid end to end, are cut: document, start in it, length, sequence, offset of each piece."""
    ends = np.cumsum(order_lens)
    total = int(ends[-1])
    whole = total // window * window
    cuts = list(range(window, whole + 1, window))
    rest, at = total - whole, whole
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
        cuts.append(at)
    seq_ends = np.array(cuts, np.int64)
    stops = np.union1d(ends, seq_ends)
    begins = np.append(0, stops[:-1])
    doc, seq = np.searchsorted(ends, begins, "right"), np.searchsorted(seq_ends, begins, "right")
    return doc, begins - (ends - order_lens)[doc], stops - begins, seq, begins - np.append(0, seq_ends)[seq]


def pack(ids: DataFrame, dtype: str, vocab: int, window: int = WINDOW) -> DataFrame:
    """Packs (doc_id, n_tokens, ids) rows; every id lies in exactly one piece."""
    df, n_docs, total = corpus_statistics(ids, dtype, vocab)
    idf, mean = np.log1p((n_docs - df + 0.5) / (df + 0.5)), max(total / max(n_docs, 1), 1.0)
    shards = max(1, -(-n_docs // SHARD_DOCS), -(-total // SHARD_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from packed(pa.Table.from_batches(got), TaskContext.get().partitionId()).to_batches()

    def packed(got: pa.Table, shard: int) -> pa.Table:
        got = got.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        doc_id, whole = got.column("doc_id").combine_chunks(), [np.frombuffer(x, dtype) for x in got.column("ids").to_pylist()]
        lens = np.array([len(x) for x in whole], np.int64)
        full = lens // window
        # whole windows of long documents, each a sequence
        doc0 = np.repeat(np.arange(len(whole)), full)
        start0 = (np.arange(len(doc0)) - np.repeat(np.cumsum(full) - full, full)) * window
        out = [(doc0, start0, np.full(len(doc0), window), np.arange(len(doc0)), np.zeros(len(doc0), np.int64))]
        rest = np.flatnonzero(lens % window)
        if len(rest):
            order = np.array(packing_order([whole[i] for i in rest], (lens % window)[rest].tolist(), idf, mean, window))
            d, start, length, seq, offset = pieces((lens % window)[rest[order]], window)
            d = rest[order][d]
            out.append((d, start + full[d] * window, length, seq + len(doc0), offset))
        d, start, length, seq, offset = (np.concatenate(x).astype(np.int64) for x in zip(*out))
        crc = [zlib.crc32(whole[i][a : a + k].astype("<u4").tobytes()) for i, a, k in zip(d.tolist(), start.tolist(), length.tolist())]
        return pa.table({"doc_id": doc_id.take(pa.array(d)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": lens[d], "sequence_id": (shard << 40) + seq, "offset": offset})

    # repeated rows part by the number of the row
    keyed = content_keys(ids, dtype, df, n_docs).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    return keyed.repartitionByRange(shards, "k", "l", "row").select("doc_id", "ids").mapInArrow(run, SCHEMA)


def packed_documents(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Tokenizes and packs every document of docs."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab_size()
    return pack(written(token_ids(docs, path, end_id), "packing-ids"), "<u2" if vocab <= 65_536 else "<u4", vocab, window)


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
