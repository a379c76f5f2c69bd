"""Token ids by a word-level BPE of the tokenizers library: each different piece of text is encoded once and kept.

The tokenizer composes characters, lowers case, drops white space and splits what is left by
`'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`. For texts of characters below PLAIN, which are composed and have one
lower-case form each, that is done in numpy over all texts of a step: classes, starts of pieces, a 64-bit hash of each piece,
and a table from hashes to ids. Pieces that aren't in the table, and texts with other characters or special strings, go to the library.

Edge cases: a null text is empty and has no ids but the end id; an empty table gives an empty result; rows are independent, so repeated
rows and doc_ids repeat; other columns are ignored; texts of any length are taken whole, and pieces over LONGEST_KEPT characters
are never kept. Two pieces that a worker keeps share a hash with a chance of about 1e-8.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inspectra.llm.common import steps

PLAIN = 0x250
#: The character below PLAIN whose lower case is two characters.
DOTTED_I = 0x130
LONGEST_KEPT = 48
#: Pieces that go to the library in one call.
AT_ONCE = 100
LETTER, DIGIT, SPACE, OTHER, END = range(5)
_SEED, _BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and hash of every character below PLAIN."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, range(1, PLAIN)))
    kind = np.full(PLAIN, OTHER, np.uint8)
    for pattern, of in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", SPACE)):
        for x, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            kind[[ord(c) for c in x]] = of
    low = np.array([ord(chr(c).lower()) if c != DOTTED_I else c for c in range(PLAIN)], np.uint32)
    return kind, low, _mixed((low.astype(np.uint64) + np.uint64(1)) * np.uint64(_SEED))


class IdTable:
    """Ids of pieces by hash: open addressing, for up to `most` pieces."""

    def __init__(self, most: int, dtype: np.dtype):
        self.most, self.bits = most, max(4, int(2 * most - 1).bit_length())
        self.pool = np.zeros(4 * most, dtype)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.begin, self.n, self.used = np.zeros(self.most + 1, np.int64), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.at[slot], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.keys) - 1)
            key = self.keys[slot]
            same = key == h[todo]
            out[todo[same]] = self.at[slot[same]]
            more = ~same & (key != 0)
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New pieces, all different, with the ids of all in turn."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), self.pool.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[self.n + 1 : self.n + 1 + len(h)] = self.used + np.cumsum(sizes)
        number, slot = np.arange(self.n, self.n + len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        self.n, self.used = self.n + len(h), self.used + len(ids)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several for one slot the last is in
            placed = self.keys[slot] == h
            self.at[slot[placed]] = number[placed]
            h, number, slot = h[~placed], number[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in turn, and how many each has."""
        first = self.begin[numbers]
        n = self.begin[numbers + 1] - first
        return self.pool[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], n


class WordEncoder:
    """Ids as little-endian unsigned 16-bit integers (32-bit for vocabularies over 65,536)."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.piece = Tokenizer.from_file(path)  # for pieces as the normalizer and the splitting make them
        self.piece.normalizer = None
        self.piece.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65_536 else "<u4")
        self.table = IdTable(most, self.dtype)
        self.up = self.down = np.ones(1, np.uint64)

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, each followed by end_id, and how many each text has."""
        texts = [t or "" for t in texts]
        own = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), "<u4")
        own |= set(np.searchsorted(ends, np.flatnonzero((points >= PLAIN) | (points == DOTTED_I))).tolist())
        if not own:
            return self._plain(points, ends, end_id)
        some = [t for i, t in enumerate(texts) if i not in own]
        last = [] if end_id is None else [end_id]
        whole = {i: np.array(self.library.encode(texts[i], add_special_tokens=False).ids + last, self.dtype) for i in sorted(own)}
        ids, n = np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if some:
            ids, n = self._plain(np.frombuffer(("\0".join(some) + "\0").encode("utf-32-le"), "<u4"), np.cumsum([len(t) + 1 for t in some]) - 1, end_id)
        rest = iter(np.split(ids, np.cumsum(n)[:-1]) if some else [])
        parts = [whole[i] if i in own else next(rest) for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _plain(self, points: np.ndarray, ends: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        kinds, lower, hashes = characters()
        kind, low, n = kinds[points], lower[points], len(points)
        kind[ends] = END
        before = np.empty_like(kind)
        before[0], before[1:] = END, kind[:-1]
        start = (kind != before) | (kind == DIGIT) | (kind == END)
        # an apostrophe that no punctuation precedes takes one of these endings along
        quote = np.flatnonzero((low == ord("'")) & (before != OTHER))
        a, b = low[np.minimum(quote + 1, n - 1)], low[np.minimum(quote + 2, n - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[after] |= kind[after] == LETTER
        bounds = np.flatnonzero(start)
        piece = kind[bounds] != SPACE
        begin, size = bounds[piece], np.diff(np.append(bounds, n))[piece]
        closes = kind[begin] == END
        if len(self.up) <= n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[points] * self.up[:n])])
        h = _mixed((sums[begin + size] - sums[begin]) * self.down[begin])
        h[h == 0] = 1
        if self.table.n > self.table.most // 2:
            self.table.clear()
        number = self.table.find(h)
        number[closes] = 0
        long = size > LONGEST_KEPT
        number[long] = 0
        new, first = np.unique(h[number < 0], return_index=True)
        if len(new) > self.table.most - self.table.n:  # one very long text
            self.table = IdTable(max(self.table.most, len(h)), self.dtype)
            return self._plain(points, ends, end_id)
        if len(new):
            first = np.flatnonzero(number < 0)[first]
            self.table.add(new, *self._learn(low, begin[first], size[first]))
            number = np.where(number < 0, self.table.find(h), number)
        ids, count = self.table.gather(number) if self.table.n else (np.zeros(0, self.dtype), np.zeros(len(number), np.int64))
        special = closes | long
        if special.any():
            at = np.flatnonzero(special)
            mine, sizes = self._learn(low, begin[at][~closes[at]], size[at][~closes[at]])
            is_end = closes[at]
            n_new = np.zeros(len(at), np.int64)
            n_new[~is_end], n_new[is_end] = sizes, 0 if end_id is None else 1
            total = count.copy()
            total[at] = n_new
            out = np.zeros(int(total.sum()), self.dtype)
            where = np.repeat(special, total)
            fill = np.zeros(int(n_new.sum()), self.dtype)
            of_end = np.repeat(is_end, n_new)
            fill[of_end], fill[~of_end] = 0 if end_id is None else end_id, mine
            out[where] = fill
            out[~where] = ids[np.repeat(~special, count)]
            ids, count = out, total
        upto = np.cumsum(count)[closes]
        return ids, np.diff(np.append(0, upto))

    def _learn(self, low: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in turn, and how many each has."""
        if not len(begin):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        wide = size + 1
        at = np.repeat(begin - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
        chars = low[np.minimum(at, len(low) - 1)]
        chars[np.cumsum(wide) - 1] = ord("\n")  # white space, which no piece holds
        joined, stops = chars.astype("<u4").tobytes().decode("utf-32-le"), np.cumsum(wide)[AT_ONCE - 1 :: AT_ONCE].tolist()
        ids, sizes = [], []
        for i, j in zip([0, *stops], [*stops, len(joined)]):
            if i < j:
                got = self.piece.encode(joined[i : j - 1], add_special_tokens=False)
                ids.append(np.array(got.ids, self.dtype))
                sizes.append(np.bincount(got.word_ids))
        return np.concatenate(ids), np.concatenate(sizes)


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordEncoder(path)


IDS_SCHEMA = "doc_id long, n_tokens long, ids binary"


def token_ids(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids of every whole text (null: empty), with end_id appended. Repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in steps(batches):
            ids, n = enc.encode(b.column(1).to_pylist(), end_id)
            cuts = np.append(0, np.cumsum(n)) * enc.dtype.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), raw.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, IDS_SCHEMA)
