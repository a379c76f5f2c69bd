"""Token counts by finite-state tokenizer compilation.

Two transducers in a row: pretokens.py splits texts into pieces, and PieceTransducer, compiled from the vocabulary and merges as
its states are met, counts a piece's tokens. Its transitions carry the change in the number of tokens of the prefix read so
far: reading a byte may end a token (+1) or turn the last few into one (-n). So no token is ever written out. Long pieces are cut
into chunks, whose maps from state to state and count compose.

Edge cases: a null text counts as empty (0 tokens); an empty table gives an empty result; rows are independent, so repeated
rows repeat; other columns are ignored; a text of any length is taken whole.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inspectra.llm.common import steps
from inspectra.llm.pretokens import class_table, matched_by_tokenizers, split_pieces

OVER = 512
#: Bytes from which a piece is read in chunks, a chunk's, and those before it that suggest its first state.
LONG, CHUNK, WARM_UP = 2048, 512, 48
#: States and pairs kept; beyond it the compiled transducer starts anew, so a worker's memory is bounded.
MOST_STATES = 200_000
_BIAS, _SHIFT = 96, 7


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceTransducer:
    """Counts BPE tokens byte by byte.

    The encoding of a prefix ends in a token t such that the prefix before t is encoded on its own and its last token u may
    stand before t, that is, merging the bytes of u and t gives u, t again. A state is what the future can depend on: for
    every suffix that begins some token (a node of the vocabulary's trie) the last token before it and the number of tokens
    there relative to now.
    """

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.vocab, self.ranks = vocab, ranks
        self.spelled = {i: b for b, i in vocab.items()}
        self.child, self.token, self.inner = {}, [-1], [False]
        for spelled, i in vocab.items():
            node = 0
            for b in spelled:
                key = node << 8 | b
                self.inner[node] = True
                node = self.child.get(key) or self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i
        self.reset()

    def reset(self) -> None:
        self.states, self.ids, self.fits = [((0, -1, 0),)], {((0, -1, 0),): 0}, {}
        self.next = np.zeros((MOST_STATES + 50_000, 256), np.int32)  # 0: not compiled; memory is taken as rows are touched

    def merged(self, raw: bytes) -> list[int]:
        ids = [self.vocab[raw[i : i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            best = min(((self.ranks.get(p, (1 << 40, 0))), i) for i, p in enumerate(zip(ids, ids[1:])))
            if best[0][0] == 1 << 40:
                break
            ids[best[1] : best[1] + 2] = [best[0][1]]
        return ids

    def fit(self, u: int, t: int) -> bool:
        got = self.fits.get((u, t))
        if got is None:
            want = [t] if u < 0 else [u, t]
            got = self.fits[u, t] = self.merged(b"".join(self.spelled[i] for i in want)) == want
        return got

    def compile(self, state: int, b: int) -> int:
        token, now, later = -1, 0, []
        for node, u, n in self.states[state]:
            to = self.child.get(node << 8 | b)
            if to is None:
                continue
            t = self.token[to]
            if token < 0 <= t and self.fit(u, t):
                token, now = t, n + 1
            if self.inner[to]:
                later.append((to, u, n))
        after = (*((to, u, n - now) for to, u, n in later), (0, token, 0))
        i = self.ids.get(after)
        if i is None:
            i = self.ids[after] = len(self.states)
            self.states.append(after)
            if i >= len(self.next):
                self.next = np.concatenate([self.next, np.zeros_like(self.next[: len(self.next) // 4])])
        self.next[state, b] = i << _SHIFT | now + _BIAS
        return i

    def counts(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece."""
        if len(self.states) > MOST_STATES:
            self.reset()
        data = np.frombuffer(raw, np.uint8)
        long = end - begin > LONG
        if not long.any():
            return self._read(data, begin, end - begin)[1]
        out = np.zeros(len(begin), np.int64)
        out[~long] = self._read(data, begin[~long], (end - begin)[~long])[1]
        out[long] = [self._scan(data, a, z) for a, z in zip(begin[long].tolist(), end[long].tolist())]
        return out

    def _scan(self, data: np.ndarray, begin: int, end: int) -> int:
        """The number of tokens of one long piece, of which all chunks are read at once.

        A chunk's map takes the state before it to the state after it and the tokens in between. It is made for the state that the
        bytes just before the chunk lead to, and again where the chunk before ends in another one; so the maps compose, and their
        counts add up.
        """
        at = np.arange(begin, end, CHUNK)
        length = np.minimum(at + CHUNK, end) - at
        warm = np.minimum(at - begin, WARM_UP)
        before, _ = self._read(data, at - warm, warm)
        after, count = np.full(len(at), -1), np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            after[todo], count[todo] = self._read(data, at[todo], length[todo], before[todo])
            todo = np.flatnonzero(after[:-1] != before[1:]) + 1
            before[todo] = after[todo - 1]
        return int(count.sum())

    def _read(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """State and number of tokens after so many bytes from each place, all read in step."""
        order = np.argsort(-size, kind="stable")  # the longest first: those still being read are a prefix
        at, length = begin[order], size[order]
        state, total = np.zeros(len(at), np.int64) if start is None else start[order], np.zeros(len(at), np.int64)
        falling = -length
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(falling, -k))
            b = data[at[:n] + k]
            while True:
                to = self.next[state[:n], b]
                missing = np.flatnonzero(to == 0)
                if not len(missing):
                    break
                for key in np.unique(state[missing] << 8 | b[missing]).tolist():
                    self.compile(key >> 8, key & 255)
            state[:n] = to >> _SHIFT
            total[:n] += (to & (1 << _SHIFT) - 1) - _BIAS
        ends, out = np.empty_like(state), np.empty_like(total)
        ends[order], out[order] = state, total
        return ends, out


class TokenCounter:
    """Counts of a byte-level BPE tokenizer in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        alphabet = byte_alphabet()
        spell = lambda s: bytes(alphabet[c] for c in s)
        self.specials = [t["content"] for t in form["added_tokens"]]
        vocab = {spell(s): i for s, i in form["model"]["vocab"].items() if s not in self.specials}
        ranks = {}
        for r, pair in enumerate(form["model"]["merges"]):
            a, b = (spell(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            ranks.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.pieces = PieceTransducer(vocab, ranks)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Special strings inside a text count as one token each, the library's default."""
        import re

        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            t = t or ""
            if any(s in t for s in self.specials):
                cut = re.split("|".join(map(re.escape, self.specials)), t)
                out[i] += len(cut) - 1
            else:
                cut = [t]
            parts += cut
            owner += [i] * len(cut)
        raw, begin, end, of = split_pieces(parts, class_table(matched_by_tokenizers))
        np.add.at(out, np.array(owner)[of], self.pieces.counts(raw, begin, end))
        return out


@functools.cache
def counter(path: str) -> TokenCounter:
    """One for each Python worker, kept between tasks."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, over: int = OVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for b in steps(batches):
            texts = b.column(1).to_pylist()
            n = of.count(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > over)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
