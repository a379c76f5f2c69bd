"""Cross-tokenizer alignment: how the tokens of two tokenizers overlap in each document, and which partners are a token's usual ones.

Each document is encoded by a byte-level BPE (A) and by a piece model (B). Byte offsets where tokens of both end cut it into groups;
two tokens are linked where their byte ranges overlap, so each stretch between neighbouring ends of either is one link. Links are dealt by
A's id into stripes. A stripe's counts of documents by pair are a dense matrix (its A ids times all B ids), into which the counts of
all chunks are added with np.add.at; row maxima give each A id's best partners. Scoring is dealt like the links: a stripe's counts
go to the tasks that hold its links, which return sums for each document.

A chunk is about CHUNK_BYTES of one task's texts. It gives one row for each stripe with its different pairs, the numbers of its
documents that hold them (the combining before the shuffle), and those documents. Stripes take every STRIPES-th id, as neighbouring ids
are alike in frequency, and a stripe with more links than others is scored by several tasks. A matrix has (ids of A / STRIPES) times
(ids of B) numbers, whatever the corpus is.

Edge cases: null and empty texts, and texts that either tokenizer doesn't give back byte for byte (normalised ones, say), have no tokens: zeros and an
empty groups_sha256; an empty table gives an empty result; repeated rows and ids are documents of their own; ties for best are all best;
other columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm.common import steps, table, written

STRIPES = 256
CHUNK_BYTES, CHUNK_DOCS = 8_000_000, 1 << 14
#: Bytes of text that are tokenized at a time.
STEP_BYTES = 500_000
#: Bytes of packed links that one task scores at a time, at most and at least.
MOST_LINKS, LEAST_LINKS = 32_000_000, 100_000
_LINKS = "chunk long, stripe int, pairs binary, links binary, size long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in the narrowest type that holds it, compressed."""
    parts, head = [], [len(arrays)]
    for x in arrays:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        head += [kind.itemsize, len(x)]
        parts.append(x.astype(kind).tobytes())
    raw = np.array(head, "<i8").tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for size, count in head.reshape(n, 2).tolist():
        out.append(np.frombuffer(raw, f"<u{size}", count, at).astype(np.int64))
        at += size * count
    return out


def byte_characters() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            said = json.load(f)
        if said["model"]["type"] != "BPE" or said["normalizer"] or said["pre_tokenizer"]["type"] != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{a_path}: a byte-level BPE without normalizer is needed")
        # the ranks of a byte-level BPE are its ids, and both libraries split alike, so tiktoken gives the same ids, only faster
        to_byte, special = byte_characters(), {t["content"] for t in said["added_tokens"]}
        vocab = {bytes(to_byte[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelled = {i: t for t, i in vocab.items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece(i) for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 20:
            raise ValueError("ids of over 20 bits")
        top = max(len(self.a_bytes), len(self.b_bytes))
        n = np.arange(top)
        self.n_digits = np.searchsorted(10 ** np.arange(1, 8), n, "right") + 1
        self.digits = [(n // 10**k % 10 + 48).astype(np.uint8) for k in range(7)]  # from the last one on

    def encode(self, texts: list[str]) -> tuple[list[int], list[list[int]], list[list[int]], list[int]]:
        """Numbers of the texts that both give back, their ids, and their bytes with the blank before them."""
        where = [i for i, t in enumerate(texts) if t]
        raw = [(" " + texts[i]).encode() for i in where]
        a = [self.a.encode_ordinary(" " + texts[i]) for i in where]
        b = self.b.encode([texts[i] for i in where], num_threads=1)
        spell_a, spell_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        kept = [i for i in range(len(where)) if b"".join(map(spell_a, a[i])) == raw[i] == b"".join(map(spell_b, b[i]))]
        return [where[i] for i in kept], [a[i] for i in kept], [b[i] for i in kept], [len(raw[i]) for i in kept]

    def align(self, a: list[list[int]], b: list[list[int]], size: list[int]) -> tuple[np.ndarray, ...]:
        """Of documents without gaps: numbers of groups and links, texts of groups as SHA-256, and the links (document, id of A, id of B)."""
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        ids_a = np.fromiter(itertools.chain.from_iterable(a), np.int64, n_a.sum())
        ids_b = np.fromiter(itertools.chain.from_iterable(b), np.int64, n_b.sum())
        stop = np.cumsum(size)
        mark = np.zeros(stop[-1] + 1, np.uint8)
        mark[np.cumsum(self.a_size[ids_a])] = 1
        mark[np.cumsum(self.b_size[ids_b])] += 2
        ends = np.flatnonzero(mark)
        mark = mark[ends]
        is_a, is_b, both = (mark & 1).astype(np.int64), (mark >> 1).astype(np.int64), mark == 3
        upto_a, upto_b, upto_g = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(both)
        at = np.searchsorted(ends, stop)  # the last link of each document
        n_links, n_groups = np.diff(at, prepend=-1), np.diff(upto_g[at], prepend=0)
        doc = np.repeat(np.arange(len(size)), n_links)
        last_a, last_b = upto_a[both], upto_b[both]  # tokens up to each group's end
        # a group's tokens of A come after the tokens of B of all groups before it
        group_a, group_b = (upto_g - both)[is_a > 0], (upto_g - both)[is_b > 0]
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b])[group_a]
        place_b = np.arange(len(ids_b)) + last_a[group_b]
        ids, mark_after = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark_after[place_a[last_a - 1]], mark_after[place_b[last_b - 1]] = ord("|"), ord(";")
        wide = self.n_digits[ids]
        close = np.cumsum(wide + 1) - 1
        text = np.zeros(close[-1] + 1, np.uint8)
        text[close] = mark_after
        for k in range(int(wide.max())):
            long = wide > k
            text[close[long] - 1 - k] = self.digits[k][ids[long]]
        cut = close[np.cumsum(n_a + n_b) - 1]
        view = memoryview(text)
        shas = [hashlib.sha256(view[i:j]).hexdigest() for i, j in zip([0, *(cut[:-1] + 1).tolist()], cut.tolist())]
        return n_groups, n_links, np.array(shas), doc, ids_a[upto_a - is_a], ids_b[upto_b - is_b]


@functools.cache
def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    """One for each Python worker, kept between tasks."""
    return Pair(a_path, b_path)


_A_SHIFT, _B_SHIFT = 34, 14  # a key: stripe, id of A, id of B, document in the chunk
_A_MASK, _B_MASK, _DOC_MASK = (1 << 20) - 1, (1 << 20) - 1, CHUNK_DOCS - 1


def chunk_rows(chunk: int, keys: list[np.ndarray], b_ids: int, stripes: int) -> Iterator[tuple]:
    """(chunk, stripe, pairs, links, size) for each stripe: cells of its matrix with numbers of documents; documents with numbers of links."""
    if not keys:
        return
    every = np.concatenate(keys)
    stripe_of = (every >> _A_SHIFT) % stripes
    order = np.argsort(stripe_of.astype(np.uint16), kind="stable")  # a counting sort
    every, cuts = every[order], np.concatenate([[0], np.cumsum(np.bincount(stripe_of, minlength=stripes))])
    for s in range(stripes):
        mine = np.sort(every[cuts[s] : cuts[s + 1]])
        if not len(mine):
            continue
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        times, mine = np.diff(first, append=len(mine)), mine[first]
        cell = (mine >> _A_SHIFT) // stripes * b_ids + (mine >> _B_SHIFT & _B_MASK)
        doc = mine & _DOC_MASK
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        held = np.diff(start, append=len(cell))
        step = np.diff(doc, prepend=0)
        step[start] = doc[start]
        pairs, links = packed(np.diff(cell[start], prepend=0), held), packed(step, times)
        yield chunk, s, pairs, links, len(pairs) + len(links)


def linked(docs: DataFrame, a_path: str, b_path: str, stripes: int = STRIPES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (stripe is null) and of links, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a_path, b_path)
        number, docs_in, bytes_in, keys = 0, 0, 0, []
        names = [x.split()[0] for x in _LINKS.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in _LINKS.split(", ")]

        def batch(**columns: list) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in zip(names, kinds)], names)

        def flushed(chunk: int) -> Iterator[pa.RecordBatch]:
            for some in itertools.batched(chunk_rows(chunk, keys, len(pair.b_bytes), stripes), 64):
                yield batch(**dict(zip(names, map(list, zip(*some)))))

        for whole in steps(batches, limit=STEP_BYTES):
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                n = b.num_rows
                if docs_in and (docs_in + n > CHUNK_DOCS or bytes_in > CHUNK_BYTES):
                    yield from flushed(TaskContext.get().partitionId() << 33 | number)
                    number, docs_in, bytes_in, keys = number + 1, 0, 0, []
                texts = b.column(1).to_pylist()
                kept, a, bb, size = pair.encode([t or "" for t in texts])
                n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
                sha = np.full(n, "", "U64")
                if kept:
                    n_a[kept], n_b[kept] = list(map(len, a)), list(map(len, bb))
                    n_groups[kept], n_links[kept], sha[kept], doc, link_a, link_b = pair.align(a, bb, size)
                    keys.append(link_a << _A_SHIFT | link_b << _B_SHIFT | docs_in + np.array(kept)[doc])
                chunk = TaskContext.get().partitionId() << 33 | number
                yield batch(chunk=[chunk] * n, doc=np.arange(docs_in, docs_in + n), doc_id=b.column(0).to_pylist(), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=sha.tolist())
                docs_in, bytes_in = docs_in + n, bytes_in + sum(size)
        yield from flushed(TaskContext.get().partitionId() << 33 | number)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _LINKS)


def counted(links: DataFrame, a_path: str, b_path: str, stripes: int = STRIPES) -> DataFrame:
    """stripe, cells (of its matrix that aren't 0, packed with their counts and whether they are their row's greatest) and size of its links.

    A task holds one matrix and adds to it what the chunks send, batch by batch.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(a_path, b_path)
        matrix, size = np.zeros((-(-len(pair.a_bytes) // stripes), len(pair.b_bytes)), np.int64), 0
        flat = matrix.reshape(-1)
        for b in batches:
            for blob in b.column(1).to_pylist():
                step, held = unpacked(blob)
                np.add.at(flat, np.cumsum(step), held)
            size += sum(b.column(2).to_pylist())
        best = matrix.max(1)
        cells = np.flatnonzero(flat)
        blob = packed(np.diff(cells, prepend=0), flat[cells], (flat[cells] == best[cells // len(pair.b_bytes)]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], ["stripe", "cells", "size"])

    return links.select("stripe", "pairs", "size").groupBy("stripe").applyInArrow(run, "stripe int, cells binary, size long")


def pair_counts(counts: DataFrame, b_ids: int, stripes: int = STRIPES) -> DataFrame:
    """a_id, b_id, n_docs, best: the counts as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stripe, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                step, n, best = unpacked(blob)
                cell = np.cumsum(step)
                yield pa.RecordBatch.from_arrays([pa.array(cell // b_ids * stripes + stripe), pa.array(cell % b_ids), pa.array(n), pa.array(best > 0)], ["a_id", "b_id", "n_docs", "best"])

    return counts.select("stripe", "cells").mapInArrow(run, "a_id long, b_id long, n_docs long, best boolean")


def scored(links: DataFrame, counts: DataFrame, stripes: int = STRIPES) -> DataFrame:
    """chunk, doc, n_best and count_sum of the documents that have links. `counts` is a written table."""
    sizes = counts.select("stripe", "size")  # a row for each stripe
    mean = (sizes.agg(F.sum("size")).first()[0] or 0) / stripes
    split = sizes.select("stripe", F.ceil(F.col("size") / max(LEAST_LINKS, min(MOST_LINKS, mean))).cast("int").alias("splits"))
    left = links.select("chunk", "stripe", "pairs", "links").join(F.broadcast(split), "stripe").select("stripe", F.pmod(F.xxhash64("chunk"), F.col("splits")).cast("int").alias("split"), "chunk", "pairs", "links")
    right = counts.join(F.broadcast(split), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), "cells")

    def score(mine: pa.Table, block: pa.Table) -> pa.Table:
        chunks, sums = [], []
        if mine.num_rows:
            step, n, best = unpacked(block.column("cells")[0].as_py())
            cells = np.cumsum(step)
            for chunk, pairs, links in zip(mine.column("chunk").to_pylist(), mine.column("pairs").to_pylist(), mine.column("links").to_pylist()):
                step, held = unpacked(pairs)
                doc, times = unpacked(links)
                at = np.searchsorted(cells, np.cumsum(step))
                start = np.cumsum(held) - held
                upto = np.cumsum(doc)
                doc = upto - np.repeat((upto - doc)[start], held)  # differences begin anew with each pair
                of, place = np.unique(doc, return_inverse=True)
                n_best, total = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
                np.add.at(n_best, place, times * np.repeat(best[at], held))
                np.add.at(total, place, times * np.repeat(n[at], held))
                chunks.append(chunk)
                sums.append(packed(np.diff(of, prepend=0), n_best, total))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "sums": pa.array(sums, pa.binary())})

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_best, total = np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
        for b in batches:
            for blob in b.column(1).to_pylist():
                step, best, n = unpacked(blob)
                of = np.cumsum(step)
                n_best[of] += best
                total[of] += n
        of = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), key[0].as_py())), pa.array(of, pa.int32()), pa.array(n_best[of]), pa.array(total[of])], ["chunk", "doc", "n_best", "count_sum"])

    parts = left.groupBy("stripe", "split").cogroup(right.groupBy("stripe", "split")).applyInArrow(score, "chunk long, sums binary")
    return parts.groupBy("chunk").applyInArrow(gather, "chunk long, doc int, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of documents, and the counts of pairs (see pair_counts)."""
    rows = written(linked(docs, a_path, b_path, id_col=id_col, text_col=text_col), "links")
    links = rows.where("stripe IS NOT NULL")
    counts = written(counted(links, a_path, b_path), "pair-counts")
    sums = scored(links, counts)
    of = rows.where("stripe IS NULL").drop("stripe", "pairs", "links", "size")
    got = of.join(sums, ["chunk", "doc"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), counts


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
