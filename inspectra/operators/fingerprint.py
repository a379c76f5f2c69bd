"""Fingerprints: 64-bit similarity hashes of shingles of characters, and documents near one another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectra.functions.normalize import fingerprint_text
from inspectra.functions.steps import cuts
from inspectra.storage import kept

SHINGLE, LEAST_CHARS, THRESHOLD = 4, 50, 0.40
#: Characters hashed at a time; threshold from which bands select; fingerprints up to which one side is sent to all tasks (8 bytes each);
#: comparisons at a time.
STEP_CHARS, BANDED_FROM, SENT, STEP_PAIRS = 100_000, 0.75, 500_000, 1_000_000
#: Fingerprints of a block, about; comparisons of a task, and tasks at most; bands are used where they leave less than this part of all pairs; keys
#: up to which their sizes are sent to all tasks.
BLOCK, TASK_PAIRS, MOST_TASKS, SELECTIVE, SENT_KEYS = 4096, 1 << 26, 4096, 0.5, 100_000
#: Fixed values of the 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: A byte's bits as the eight bytes of a word.
_SPREAD = np.array([sum((v >> b & 1) << 8 * b for b in range(8)) for v in range(256)], "<u8")


def simhash_texts(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """Each different place's shingle votes on every bit of its FNV-1a hash; bits with more ones than zeros are set. Signed 64 bits.

    All texts of a batch at once: no text may be empty. A hash begins at every character of all texts; those that run over a text's end have no vote.
    """
    chars = np.array([len(t) for t in texts], np.int64)
    places = np.maximum(1, chars - shingle + 1)
    joined = "".join(texts)
    points, raw = np.frombuffer(joined.encode("utf-32-le"), "<u4"), np.frombuffer(joined.encode(), np.uint8)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    first, wide, n = raw[at].astype(np.uint64), np.flatnonzero(width > 1), max(0, len(points) - shingle + 1)
    hashes, prime = np.zeros(len(points) + 1, np.uint64), np.uint64(FNV_PRIME)
    h = hashes[:n]
    h[:] = FNV_START
    for j in range(shingle):
        h ^= first[j : n + j]
        h *= prime
        c = wide[(wide >= j) & (wide < n + j)]
        for k in range(1, 4):
            c = c[width[c] > k]
            h[c - j] = (h[c - j] ^ raw[at[c] + k]) * prime
    # stretches of up to 255 places, in which eight counts fit into a word's bytes, and one without a vote behind each text
    text_at, parts = np.cumsum(chars) - chars, -(-places // 255) + 1
    part_at = np.cumsum(parts) - parts
    stretch = np.arange(parts.sum()) - np.repeat(part_at, parts)
    begin = np.repeat(text_at, parts) + np.minimum(255 * stretch, np.repeat(places, parts))
    votes = np.ones(len(begin), bool)
    votes[part_at + parts - 1] = False
    ones = np.empty((len(texts), 8, 8), np.int64)
    for b, byte in enumerate(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T):
        counts = np.add.reduceat(_SPREAD[byte], begin)[votes].view(np.uint8).reshape(-1, 8)
        ones[:, b] = np.add.reduceat(counts.astype(np.int64), part_at - np.arange(len(texts)), axis=0)
    value = np.packbits((2 * ones > places[:, None, None]).reshape(-1, 64), axis=1, bitorder="little").view(np.int64)[:, 0]
    for i in np.flatnonzero(chars < shingle):
        value[i] = _fnv(texts[i].encode())
    return value


def _fnv(data: bytes) -> np.int64:
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return np.uint64(h).view(np.int64)


def simhash_text(text: str, shingle: int = SHINGLE) -> int:
    return int(simhash_texts([text], shingle)[0])


@F.arrow_udf(T.LongType())
def simhash(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        for at, n in cuts((batch,)):
            some = batch.slice(at, n).to_pylist()
            out: list[int | None] = [None] * n
            group, size = [], 0
            for i, t in [*enumerate(some), (n, None)]:
                if group and (i == n or size + len(t or "") > STEP_CHARS):
                    for j, h in zip(group, simhash_texts([some[j] for j in group]).tolist()):
                        out[j] = h
                    group, size = [], 0
                if t:
                    group.append(i)
                    size += len(t)
            yield pa.array(out, pa.int64())


def _long_enough(text: Column) -> Column:
    """A generator of the text that fingerprints see, if it is long enough; of a filter the optimizer would make that text once more."""
    return F.explode(F.filter(F.array(fingerprint_text(F.coalesce(text, F.lit("")))), lambda t: F.length(t) >= LEAST_CHARS))


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fingerprint_id, simhash, text_length and preview of the texts that are long enough."""
    text = docs.select(F.col(id_col).alias("fingerprint_id"), _long_enough(F.col(text_col)).alias("t"), F.substring(text_col, 1, 200).alias("preview"))
    return text.select("fingerprint_id", simhash("t").alias("simhash"), F.length("t").alias("text_length"), "preview")


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids, "fingerprint_id", "left_anti")


def _within(hashes: np.ndarray, bits: int) -> Callable:
    """A UDF of hashes: (i, differing) of the known hashes of which at most so many bits differ; none of a null; blocks of a million comparisons."""
    pairs = pa.list_(pa.struct([("i", pa.int32()), ("differing", pa.int32())]))

    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = max(1, STEP_PAIRS // max(1, len(hashes)))
        for batch in batches:
            x, known = pc.fill_null(batch, 0).to_numpy(zero_copy_only=False).view(np.uint64), batch.is_valid().to_numpy(zero_copy_only=False)
            for k in range(0, len(x), step):
                differing = np.bitwise_count(x[k : k + step, None] ^ hashes)
                row, i = np.nonzero((differing <= bits) & known[k : k + step, None])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(differing)))])
                fields = [pa.array(i.astype(np.int32)), pa.array(differing[row, i].astype(np.int32))]
                yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(pairs.value_type)), pairs)

    return F.arrow_udf(near, "array<struct<i:int,differing:int>>")


def _compared(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """fingerprint_pairs for a right side of at most SENT rows, which goes to every task: each batch is compared with it in blocks."""
    known = right.select("fingerprint_id", "simhash").where("simhash IS NOT NULL").orderBy("fingerprint_id").toPandas()
    hashes, bits = known["simhash"].to_numpy(np.int64).view(np.uint64), int(64 * (1 - threshold) + 1e-9)

    near = _within(hashes, bits)
    # no filter of nulls, which would be computed by the UDF of the hashes once more
    hit = left.select(F.col("fingerprint_id").alias("left_id"), F.explode(near("simhash")).alias("m"))
    numbered = left.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(len(known), dtype=np.int32), "right_id": known["fingerprint_id"]}), f"i int, right_id {right.schema['fingerprint_id'].dataType.simpleString()}")
    return hit.select("left_id", "m.i", (1 - F.col("m.differing") / 64.0).alias("score")).join(F.broadcast(numbered), "i").select("left_id", "right_id", "score")


def band_edges(threshold: float) -> list[int]:
    """Up to 64 * (1 - threshold) bits may differ; cut into one band more than that, some band is equal."""
    bands = min(int(64 * (1 - threshold) + 1e-9) + 1, 64)
    return [64 * i // bands for i in range(bands + 1)]


def band_keys(simhash: Column, edges: list[int]) -> Column:
    """(band, key) of each band."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft(simhash, 64 - z), 64 - z + a).alias("key")) for i, (a, z) in enumerate(zip(edges, edges[1:]))])


def _near_in_blocks(least: float, edges: list[int]) -> Callable:
    """For mapInArrow: the near pairs of two blocks (band, xs, ys), rows of the first in turn. A pair counts in its first equal band only."""
    scores = 1 - np.arange(65) / 64
    bits = int(np.flatnonzero(scores >= least).max(initial=-1))
    masks = [np.uint64((1 << z) - (1 << a)) for a, z in zip(edges, edges[1:])]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, xs, ys in zip(batch["band"].to_pylist(), batch["xs"], batch["ys"]):
                x, y = (rows.values.field("simhash").to_numpy(zero_copy_only=False).view(np.uint64) for rows in (xs, ys))
                left, right = (rows.values.field("id") for rows in (xs, ys))
                step = max(1, STEP_PAIRS // len(y))
                for at in range(0, len(x), step):
                    differing = np.bitwise_count(x[at : at + step, None] ^ y)
                    hit = differing <= bits
                    found = np.flatnonzero(hit)
                    row = np.repeat(np.arange(len(hit)), np.count_nonzero(hit, axis=1))
                    col = found - row * len(y)
                    if band:
                        apart = x[at + row] ^ y[col]
                        first = np.logical_and.reduce([apart & m != 0 for m in masks[:band]])
                        found, row, col = found[first], row[first], col[first]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([left.take(pa.array(at + row)), right.take(pa.array(col)), pa.array(scores[differing.ravel()[found]])], ["left_id", "right_id", "score"])

    return near


def near_pairs(left: DataFrame, right: DataFrame, threshold: float, edges: list[int], banded: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, score) of fingerprints at least so similar; both sides (id, simhash) without nulls, and cheap to read more than once.
    Their sizes are counted when this is called, so of a stream each batch is a side of its own (foreachBatch).

    Rows of equal bands meet in blocks of about BLOCK rows of each side, so no key is one task; tasks hold the blocks' hashes, compare them in steps
    and give pairs as they come. Where bands leave SELECTIVE of all pairs or more (texts in few languages share bits), the blocks are of
    all rows instead, and each pair is met once. `banded`, if given, is right with band and key.
    """
    on, n, m = ["band", "key"], left.count(), right.count()
    in_bands = lambda side: side.select("id", "simhash", F.inline(band_keys(F.col("simhash"), edges)))
    a, b = in_bands(left), in_bands(right) if banded is None else banded
    cuts = lambda rows: F.ceil(F.col(rows) / BLOCK).cast("int")
    sizes = kept(a.groupBy(on).agg(F.count("*").alias("n")).join(b.groupBy(on).agg(F.count("*").alias("m")), on).select(*on, "n", "m", cuts("n").alias("p"), cuts("m").alias("q")), "sizes")
    keys, met = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.col("m").cast("double")), F.lit(0.0))).first()
    if met < SELECTIVE * n * m:
        few = F.broadcast(sizes) if keys <= SENT_KEYS else sizes
        a, b = (side.join(few.select(*on, "p", "q"), on) for side in (a, b))
    else:
        on, met, all_blocks = [], n * m, {"p": F.lit(-(-n // BLOCK)), "q": F.lit(-(-m // BLOCK))}
        a, b = left.withColumns(all_blocks), right.withColumns(all_blocks)

    def blocks(side: DataFrame, rows: str, own: str, other: str) -> DataFrame:
        """Blocks of a key's rows, each once for every block of the other side."""
        cut = side.groupBy(*on, other, F.pmod(F.xxhash64("id", "simhash"), own).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "simhash")).alias(rows))
        return cut.select(*on, F.col("block").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), rows).repartition(tasks, *on, "p", "q")

    tasks = int(min(MOST_TASKS, met // TASK_PAIRS + 1))
    pairs = blocks(a, "xs", "p", "q").hint("merge").join(blocks(b, "ys", "q", "p"), [*on, "p", "q"]).select(F.col("band") if on else F.lit(0).alias("band"), "xs", "ys")
    schema = T.StructType([T.StructField("left_id", left.schema["id"].dataType), T.StructField("right_id", right.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return pairs.mapInArrow(_near_in_blocks(threshold, edges), schema)


def fingerprint_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, score) of fingerprints at least so similar; both sides as build_index gives them.

    Bands join exactly (band_edges, near_pairs). Below BANDED_FROM bands of less than four bits don't select anything; there a right side of
    up to SENT rows is sent to all tasks, and only a larger one is joined in blocks at the cost of all pairs.
    """
    if threshold < BANDED_FROM and right.count() <= SENT:
        return _compared(left, right, threshold)
    a, b = (kept(side.select(F.col("fingerprint_id").alias("id"), "simhash"), "fingerprints").where("simhash IS NOT NULL") for side in (left, right))
    return near_pairs(a, b, threshold, band_edges(threshold))


def scan_fingerprints(components: DataFrame, index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """message_id, component_idx, fingerprint_id and score of bodies, attachments and generic parts like an indexed text.

    Both sides meet by equal bands of bits, exactly (fingerprint_pairs).
    """
    some = components.where(F.col("component_type").isin("body", "attachment", "generic"))
    key = F.struct("message_id", "component_idx")
    seen = some.select(key.alias("fingerprint_id"), _long_enough(F.col("content")).alias("t"))
    near = fingerprint_pairs(seen.select("fingerprint_id", simhash("t").alias("simhash")), index, threshold)
    return near.select("left_id.message_id", "left_id.component_idx", F.col("right_id").alias("fingerprint_id"), "score")
