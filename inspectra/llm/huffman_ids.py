"""Token-ID output: canonical length-limited Huffman codes from global counts, in blocks that decode alone.

A file is a folder: `blocks` holds rows of (part, block, first, n_ids, doc_ids, lengths, checkpoints, bits), where a block is a
run of whole documents in doc_id order, `bits` their ids' codes and `checkpoints` the bit offset of every STRIDE-th id, so a
reader enters a block at many points at once. `codebook` holds (id, code_length), from which the canonical code follows.

Edge cases: a null text is empty and yields its end id alone; an empty table yields an empty file; repeated rows and doc_ids
are kept, ordered by their ids' bytes; null doc_ids sort first; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm.common import pack_bits, partitions, peek_table, scratch, steps, written
from inspectra.llm.word_ids import token_ids

#: Longest codes, but for alphabets that need longer ones.
MAX_BITS = 16
STRIDE = 128
BLOCK_IDS = 32_768
READ_IDS = 1_000_000
BLOCK_SCHEMA = "part int, block int, first long, n_ids long, doc_ids array<long>, lengths array<long>, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits for the symbols with a count (package-merge); 0 for the others."""
    out = np.zeros(len(counts), np.int64)
    symbols = np.flatnonzero(counts)
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    most = max(most, (len(symbols) - 1).bit_length() + 1)
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaf = counts[symbols].astype(np.float64)
    level, leaves = leaf, [np.ones(len(leaf), bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < len(leaf))
    take = 2 * len(leaf) - 2
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        out[symbols[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        of = np.flatnonzero(lengths == n)
        code <<= n - last
        last = n
        codes[of] = code + np.arange(len(of))
        code += len(of)
    return codes


def decode_table(lengths: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each pattern of `most` bits."""
    sym, n = np.zeros(1 << most, np.uint32), np.zeros(1 << most, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    fill = np.repeat(used, 1 << (most - lengths[used]))
    sym[: len(fill)], n[: len(fill)] = fill, lengths[fill]
    return sym, n


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    n = lengths[ids]
    ends = np.cumsum(n)
    at = ends - n
    bits = pack_bits(codes[ids], n, at, (int(ends[-1]) + 7) // 8 if len(ids) else 0)
    return bits.tobytes(), at[::STRIDE].astype("<u4").tobytes()


def decode_blocks(bits: list[bytes], checkpoints: list[bytes], n_ids: list[int], sym: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The ids of several blocks in turn. Every checkpoint is a lane; the lanes step through the table together."""
    size = np.array([len(b) for b in bits], np.int64)
    base = np.cumsum(size) - size
    marks = [np.frombuffer(c, "<u4").astype(np.int64) for c in checkpoints]
    pos = np.concatenate([m + 8 * b for m, b in zip(marks, base)]) if marks else np.zeros(0, np.int64)
    count = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(m))) for m, n in zip(marks, n_ids)]) if marks else pos
    window = peek_table(np.frombuffer(b"".join(bits), np.uint8))
    out = np.zeros((len(pos), STRIDE), np.uint32)
    shift = np.uint64(65 - len(sym).bit_length())
    for k in range(STRIDE):
        code = ((window[pos >> 3] << (pos & 7).astype(np.uint64)) >> shift).astype(np.int64)
        out[:, k] = sym[code]
        pos = np.minimum(pos + width[code], 8 * (len(window) - 1))
    return out[np.arange(STRIDE) < count[:, None]]


def id_counts(ids: DataFrame, dtype: str, vocab: int) -> np.ndarray:
    """Counts of all ids, summed in Spark; at most `vocab` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for b in steps(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=vocab)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(total[has], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(ids: DataFrame, folder: str, dtype: str, vocab: int) -> None:
    """Writes (doc_id, n_tokens, ids) rows as a file in ascending doc_id order. Two passes: counts, then codes."""
    spark = ids.sparkSession
    lengths = code_lengths(id_counts(ids, dtype, vocab))
    codes = canonical_codes(lengths)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, code_length int").coalesce(1).write.parquet(f"{folder}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, held, n_held = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            ns = [len(x) for _, x in held]
            bits, marks = encode_block(np.concatenate([x for _, x in held]), codes, lengths)
            row = {"part": part, "block": block, "first": first, "n_ids": sum(ns), "doc_ids": [d for d, _ in held], "lengths": ns, "checkpoints": marks, "bits": bits}
            return pa.RecordBatch.from_pylist([row], block_arrow)

        block_arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("bits", pa.binary())])
        for b in steps(batches, "ids"):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((doc, np.frombuffer(raw, dtype)))
                n_held += len(held[-1][1])
                if n_held >= BLOCK_IDS:
                    yield flush()
                    block, first, held, n_held = block + 1, first + n_held, [], 0
        if held:
            yield flush()

    # the hash parts rows that share a doc_id by their ids, so that no such group is one task's
    ranged = ids.select("doc_id", "ids").repartitionByRange(partitions(spark), F.col("doc_id"), F.xxhash64("ids"))
    ranged.sortWithinPartitions(F.col("doc_id"), F.xxhash64("ids"), F.col("ids")).mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in the file), n_tokens, ids_crc32 and, if asked for, ids (32-bit) of each document."""
    lengths = np.zeros(0, np.int64)
    book = spark.read.parquet(f"{folder}/codebook").collect()  # the vocabulary's size at most
    if book:
        lengths = np.zeros(max(r["id"] for r in book) + 1, np.int64)
        for r in book:
            lengths[r["id"]] = r["code_length"]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    bases, total = [], 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row for each part of the file
        bases.append((r["part"], total))
        total += r["n"]
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sym, width = decode_table(lengths, max(MAX_BITS, int(lengths.max(initial=0))))
        width = width.astype(np.int64)
        for b in steps(batches, "bits", READ_IDS):
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            ids = decode_blocks(cols["bits"].to_pylist(), cols["checkpoints"].to_pylist(), cols["n_ids"].to_pylist(), sym, width).astype("<u4")
            n = cols["lengths"].flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            inside = np.concatenate([np.cumsum(x) - x for x in (np.array(v, np.int64) for v in cols["lengths"].to_pylist())])
            start = np.repeat(cols["first"].to_numpy(), [len(v) for v in cols["lengths"].to_pylist()]) + inside
            raw = ids.tobytes()
            each = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
            out = [cols["doc_ids"].flatten(), pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(each, pa.binary())] if with_ids else []), [*(f.split()[0] for f in schema.split(", "))])

    read = blocks.join(base, "part").withColumn("first", F.col("first") + F.col("base")).select("doc_ids", "lengths", "first", "n_ids", "checkpoints", "bits")
    return read.mapInArrow(run, schema)


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    vocab = Tokenizer.from_file(path).get_vocab_size()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = written(token_ids(docs, path, end_id=2), "op3-ids")
    folder = scratch(spark, "op3-file")
    write_ids(ids, folder, "<u2" if vocab <= 65_536 else "<u4", vocab)
    return read_ids(spark, folder, with_ids=False)
