"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The distinct pieces of a step's texts are laid out as one array of tokens with links to their neighbours. An inverted index from
token pair to positions then replays the merges in rank order over all pieces at once, touching only the neighbours of what it
merged. Encodings are kept for later steps of the worker, up to a bound.

Edge cases: a null text is empty and has no ids; an empty table gives an empty result; rows are independent; other columns are
ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inspectra.llm.common import steps
from inspectra.llm.pretokens import class_table, matched_by_tiktoken, split_pieces

MOST_KEPT = 500_000
LONGEST_KEPT = 48


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.spelled[r] = b
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.kept: dict[bytes, bytes] = {}

    def merge_of(self, a: int, b: int) -> int:
        """The token that a and b make, which is its rank too, or -1."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self.ranks.get(self.spelled[a] + self.spelled[b], -1)
        return got

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        single, merge_of = self.single, self.merge_of
        token = [t for p in pieces for t in (*map(single.__getitem__, p), -1)]  # -1 parts the pieces
        n = len(token)
        right, left = [*range(1, n + 1)], [*range(-1, n - 1)]
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = token[i], token[i + 1]
            if a >= 0 and b >= 0 and (r := merge_of(a, b)) >= 0:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = [*index]
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                a, j = token[i], right[i]
                if a < 0 or j >= n or token[j] < 0 or merge_of(a, token[j]) != rank:
                    continue  # a merge has since taken one of the two
                token[i], token[j] = rank, -2
                right[i] = after = right[j]
                left[after] = i
                lower = False
                before = left[i]
                for x, y in ((before, i), (i, after)):
                    if x >= 0 and token[x] >= 0 and token[y] >= 0 and (r := merge_of(token[x], token[y])) >= 0:
                        if r in index:
                            index[r].append(x)
                        else:
                            index[r] = [x]
                            heapq.heappush(heap, r)
                        lower |= r < rank
                if lower and k + 1 < len(places):  # the new pair comes first, in this piece at least
                    if rank in index:
                        index[rank] += places[k + 1 :]
                    else:
                        index[rank] = places[k + 1 :]
                    heapq.heappush(heap, rank)
                    break
        flat = np.array(token, np.int64)
        flat = flat[flat != -2]
        ends = np.flatnonzero(flat == -1)
        raw = flat.astype("<u4").tobytes()
        begins = np.append(0, ends[:-1] + 1)
        return [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw, begin, end, owner = split_pieces([t or "" for t in texts], class_table(matched_by_tiktoken))
        pieces = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        new = list(set(pieces).difference(self.kept))
        whole = [p for p in new if p in self.ranks]  # a piece that is a token stays one, whether or not merges lead to it
        self.kept.update((p, self.ranks[p].to_bytes(4, "little")) for p in whole)
        rest = [p for p in new if p not in self.ranks]
        self.kept.update(zip(rest, self.replay(rest)))
        ids = [*map(self.kept.__getitem__, pieces)]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        out = [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del self.kept[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def replayer(path: str) -> MergeReplay:
    """One for each Python worker, kept between tasks."""
    with open(path, "rb") as f:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = replayer(path)
        for b in steps(batches):
            ids = of.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_bpe(encoded: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id and the decoded bytes; with digest, also n_tokens and the SHA-256 of ids and of bytes in place of the bytes."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "decoded"]
    hashed = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = replayer(path)
        for b in steps(batches, "ids"):
            ids = b.column(2).to_pylist()
            raw = [of.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), *((b.column(1), hashed(ids), hashed(raw)) if digest else (pa.array(raw, pa.binary()),))], names)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, decoded binary")


def op6_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return decode_bpe(encode_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path, digest=True)
