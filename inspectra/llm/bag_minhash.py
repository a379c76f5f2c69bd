"""Near-duplicate classes of documents: BagMinHash signatures, banding, and verified overlap of the shingle multisets.

A document is the multiset of its runs of SHINGLE words (lower case, split at white space); a shorter text is one shingle.
Every shingle x has a Poisson process in time over the discretised weights 1, 2, ..., built from those of the weight
intervals (0,1], (1,2], (2,4], (4,8], ...; a point's place inside its interval comes from its hash, so an interval covered in part
is split as far as needed. A document with x at weight w sees the points below w. Each point belongs to one of REGISTERS
registers, which keeps its earliest point: two registers agree with the probability of the weighted Jaccard similarity.

Equal word sequences are one vertex. Vertices that share a bucket of a band, directly or through others, are a candidate
family. A family of up to GROUP_DOCS vertices and GROUP_GRAMS shingles goes to one task, which finds the overlap of all its members at once
from an incidence matrix of the shingles that several have, and returns each member's class; so no pair is ever written.
Larger families are verified bucket by bucket: each member first meets one leader; members that have too many shingles of
their own to be similar to anyone leave; what is left of a bucket is dealt into blocks, and each pair of blocks is one task. All ways are
exact: only banding can miss a pair (7e-5 at similarity 0.8).

Edge cases: null texts count as empty, and all empty texts are one class; an empty table gives an empty result; repeated rows
and rows with equal doc_ids share a class; rows with a null doc_id are documents of their own, which take no part in the choice of
class_id, the least doc_id of the class (null if it has none); texts of any length are taken whole; other columns are kept, whatever
their names, if they don't begin with `_near_`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm.common import replaced, steps, table, written

SHINGLE, LEAST_SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Vertices and shingles of a candidate family up to which one task verifies it.
GROUP_DOCS, GROUP_GRAMS = 4096, 2_000_000
#: Columns of the incidence matrix at a time.
COLUMNS = 4096
#: Members of a block, where a bucket of a larger family is dealt into blocks.
BLOCK = 1024
#: Words kept with their hashes in a worker.
MOST_WORDS = 1_000_000
#: t1, t2: hashes of the text as it is; d1, d2: of its words; n: shingles with repetitions.
SIGNATURE_SCHEMA = "doc_id long, t1 long, t2 long, d1 long, d2 long, n long, bands array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Hashes of words, kept up to a bound, and of their runs."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return (text or "").lower().split()

    def multisets(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, hash, count) of every different shingle, by text."""
        if len(self.kept) > MOST_WORDS:
            self.kept.clear()
        kept = self.kept
        for w in set().union(*texts).difference(kept) if texts else ():
            kept[w] = xxhash.xxh64_intdigest(w)
        n = np.array([len(t) for t in texts], np.int64)
        h = np.array([kept[w] for t in texts for w in t], np.uint64)
        of = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        run = np.zeros(len(h), np.uint64)
        for k in range(SHINGLE):
            later = np.zeros(len(h), np.uint64)
            later[: len(h) - k] = h[k:] if k else h
            run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(place + k < n[of], later, np.uint64(k))
            run = mix(run)
        full = (place + SHINGLE <= n[of]) | (place == 0)
        of, run = of[full], run[full]
        order = np.lexsort((run, of))
        of, run = of[order], run[order]
        new = np.ones(len(run), bool)
        new[1:] = (of[1:] != of[:-1]) | (run[1:] != run[:-1])
        at = np.flatnonzero(new)
        return of[at], run[at], np.diff(np.append(at, len(run)))


def signatures(n_texts: int, of: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers (texts x registers, 32 bits each) of multisets with integer weights; 0 throughout for an empty one."""
    out = np.zeros((n_texts, registers), np.uint32)
    mass = np.bincount(of, weight, n_texts)
    todo = np.flatnonzero(mass)
    expected = registers * (np.log(registers) + 3)
    while len(todo):
        until = np.zeros(n_texts)
        until[todo] = expected / mass[todo]
        now = until[of] > 0
        text, x, w = of[now], h[now], weight[now]
        # one process for each weight interval that the shingle reaches into
        level = np.zeros(len(w), np.int64)
        many = np.flatnonzero(w > 1)
        levels = np.ceil(np.log2(w[many])).astype(np.int64)
        more = np.repeat(many, levels)
        level = np.concatenate([level, np.arange(len(more)) - np.repeat(np.cumsum(levels) - levels, levels) + 1])
        text, x, w = np.concatenate([text, text[more]]), np.concatenate([x, x[more]]), np.concatenate([w, w[more]])
        low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
        rate = np.maximum(low, 1)
        state = mix(x + np.uint64(0xA0761D6478BD642F) * (level + 1).astype(np.uint64))
        time = np.zeros(len(x))
        points = []
        while len(state):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
            alive = time <= until[text]
            text, w, low, rate, state, time = text[alive], w[alive], low[alive], rate[alive], state[alive], time[alive]
            bits = mix(state ^ np.uint64(0xD6E8FEB86659FD93))
            seen = low + ((bits >> np.uint64(40)).astype(np.int64) & (rate - 1)) < w
            register = ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            value = mix(state ^ np.uint64(0xE7037ED1A0B428DB)).astype(np.uint32)
            points.append((text[seen] * registers + register[seen], time[seen], value[seen]))
        key, when, value = (np.concatenate(p) for p in zip(*points))
        order = np.argsort(-when, kind="stable")
        filled = np.zeros(n_texts * registers, bool)
        filled[key] = True
        flat = np.zeros(n_texts * registers, np.uint32)
        flat[key[order]] = value[order]  # the earliest point is written last
        done = filled.reshape(n_texts, registers)[todo].all(1)
        out[todo[done]] = flat.reshape(n_texts, registers)[todo[done]]
        todo, expected = todo[~done], expected * 2
    return out


@functools.cache
def shingles() -> Shingles:
    """One for each Python worker, kept between tasks."""
    return Shingles()


def band_keys(registers: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(registers), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + registers[:, k::ROWS])
    return key.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, hashes of the text (null: empty), and the text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The hashes, number of shingles and bands of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shingles()
        for b in steps(batches):
            words = [of.words(t) for t in b.column(3).to_pylist()]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(w)) for w in words), np.int64).reshape(-1, 2)
            sets = of.multisets(words)
            keys = band_keys(signatures(len(words), *sets))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            n = np.bincount(sets[0], sets[2], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(n), bands], ["doc_id", "t1", "t2", "d1", "d2", "n", "bands"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, SIGNATURE_SCHEMA)


def gram_sets(texts: DataFrame) -> DataFrame:
    """family, vertex and grams: sorted 64-bit hashes of (shingle, occurrence), whose set similarity is the multisets'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shingles()
        for b in steps(batches):
            texts = [made.words(t) for t in b.column(2).to_pylist()]
            of, h, n = made.multisets(texts)
            which = np.repeat(np.arange(len(h)), n)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            h, of = mix(h[which] + np.uint64(0x9E3779B97F4A7C15) * nth.astype(np.uint64)), of[which]
            order = np.lexsort((h, of))
            raw = h[order].tobytes()
            cuts = (8 * np.searchsorted(of[order], np.arange(len(texts) + 1))).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([raw[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary())], ["family", "vertex", "grams"])

    return texts.select("family", "vertex", "text").mapInArrow(run, "family long, vertex long, grams binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of every two of the sorted sets."""
    sizes = np.array([len(x) for x in sets])
    gram, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(gram, kind="stable")
    gram, of = gram[order], of[order]
    first = np.ones(len(gram), bool)
    first[1:] = gram[1:] != gram[:-1]
    column = np.cumsum(first) - 1
    column, of = (x[(np.bincount(column) > 1)[column]] for x in (column, of))  # the rest is in one set only
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        i, j = np.searchsorted(column, (low, low + COLUMNS))
        some = np.zeros((len(sets), COLUMNS), np.float32)
        some[of[i:j], column[i:j] - low] = 1
        common += some @ some.T
    np.fill_diagonal(common, sizes)
    return common


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one of its class, the component of sets that are similar enough."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    if m == 2:
        both = np.sort(np.concatenate(sets), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return np.array([0, 0 if common >= LEAST_SIMILARITY * (sizes.sum() - common) else 1])
    common = overlaps(sets)
    near = np.zeros((m, m), bool)
    for i in range(0, m, 256):
        near[i : i + 256] = common[i : i + 256] >= LEAST_SIMILARITY * (sizes[i : i + 256, None] + sizes - common[i : i + 256])
    label = np.full(m, -1)
    for i in range(m):
        if label[i] < 0:
            found = np.zeros(m, bool)
            found[i] = True
            edge = found
            while edge.any():
                edge = near[edge].any(0) & ~found
                found |= edge
            label[found] = i
    return label


def grouped_links(members: DataFrame) -> DataFrame:
    """(v, root) for each vertex of a group (family, vertex, grams) that has an earlier one in its class there."""

    def links(family: list[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint64) for _, x in family]
        return ((family[i][0], family[j][0]) for i, j in enumerate(linked(sets).tolist()) if i != j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, family, found = None, [], []

        def close() -> None:
            if len(family) > 1:
                found.extend(links(family))
            family.clear()

        for b in steps(batches, "grams", 8_000_000):
            for f, v, x in zip(*(c.to_pylist() for c in b.columns)):
                if f != last:
                    close()
                    last = f
                family.append((v, x))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["v", "root"])
            found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["v", "root"])

    return members.select("family", "vertex", "grams").repartition(F.col("family")).sortWithinPartitions("family", "vertex").mapInArrow(run, "v long, root long")


def verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Those pairs (v, root) whose multisets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "x"):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = len(x) // 8, len(y) // 8
                common = 0
                if min(p, q) >= LEAST_SIMILARITY * max(p, q):
                    both = np.sort(np.frombuffer(x + y, np.uint64), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= LEAST_SIMILARITY * (p + q - common) and common > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["v", "root"]).filter(pa.array(keep, pa.bool_()))

    x, y = grams.select(F.col("vertex").alias("v"), F.col("grams").alias("x")), grams.select(F.col("vertex").alias("root"), F.col("grams").alias("y"))
    return pairs.select("v", "root").join(x, "v").join(y, "root").select("v", "root", "x", "y").mapInArrow(run, "v long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (v, root) but the roots, the least vertex of each connected component: edges turn in rounds into stars."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first())
    edges = written(edges.select(F.greatest("v", "root").alias("v"), F.least("v", "root").alias("root")).where("v <> root").distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = both.groupBy("v").agg(F.min("root").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where(F.col("root") > F.col("v")).select(F.col("root").alias("v"), F.col("m").alias("root")).where("v <> root").distinct()
        least = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(least, "v")
        small = small.select("v", F.col("m").alias("root")).union(small.select(F.col("root").alias("v"), F.col("m").alias("root"))).where("v <> root").distinct()
        edges = replaced(edges, written(small, "edges"))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, t1, t2, d1 and d2 of every row, and for every (d1, d2) class (a vertex) and class_id."""
    rows = written(signed(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signatures")
    copies = written(rows.groupBy("d1", "d2").agg(F.min("row").alias("vertex"), F.min("doc_id").alias("least")), "copies")
    first = rows.join(copies.select(F.col("vertex").alias("row")), "row", "left_semi").where("n > 0")
    buckets = written(first.select(F.col("row").alias("vertex"), F.explode("bands").alias("band")), "buckets")
    shared = buckets.groupBy("band").agg(F.min("vertex").alias("m"), F.max("vertex").alias("x")).where("m <> x").select("band", "m")
    families = components(buckets.join(shared, "band").select(F.col("vertex").alias("v"), F.col("m").alias("root")))
    roots = families.select("root").distinct()
    member = written(families.select(F.col("v").alias("vertex"), F.col("root").alias("family")).union(roots.select(F.col("root").alias("vertex"), F.col("root").alias("family"))), "families")
    known = rows.select(F.col("row").alias("vertex"), "doc_id", "t1", "t2", "n").join(member, "vertex")
    large = written(known.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("grams")).where((F.col("docs") > GROUP_DOCS) | (F.col("grams") > GROUP_GRAMS)).select("family"), "large")
    text = _keyed(docs, id_col, text_col)
    at = known.select("family", "vertex", F.col("doc_id").alias("of"), F.col("t1").alias("of1"), F.col("t2").alias("of2"))
    texts = text.join(at, text["doc_id"].eqNullSafe(at["of"]) & (text["t1"] == at["of1"]) & (text["t2"] == at["of2"])).select("family", "vertex", "text")
    if not rows.groupBy("doc_id", "t1", "t2").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["vertex"])
    grams = written(gram_sets(texts), "grams")
    some_large = not large.isEmpty()
    small = grams.join(large, "family", "left_anti") if some_large else grams
    links = written(grouped_links(small), "links")
    # rows of one doc_id with different texts are one document, and so of one class
    of_doc = rows.where("doc_id IS NOT NULL").select("doc_id", "d1", "d2").join(copies, ["d1", "d2"]).groupBy("doc_id").agg(F.min("vertex").alias("root"), F.max("vertex").alias("v")).where("v <> root")
    of_doc = written(of_doc.select("v", "root"), "links")
    if some_large:
        rest = grams.join(large, "family", "left_semi").select("vertex", "grams")
        links = links.union(_large_links(written(buckets.join(shared, "band").join(member.join(large, "family", "left_semi").select("vertex"), "vertex", "left_semi").select("band", "vertex"), "large-buckets"), written(rest, "large-grams")))
    if some_large or not of_doc.isEmpty():
        links = components(links.union(of_doc))
    classes = copies.join(links.select(F.col("v").alias("vertex"), "root"), "vertex", "left").select("d1", "d2", F.coalesce("root", "vertex").alias("class"), "least")
    named = classes.groupBy("class").agg(F.min("least").alias("class_id"))
    return rows.select("doc_id", "t1", "t2", "d1", "d2"), classes.drop("least").join(named, "class")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id, the least doc_id of the class, for every row of docs."""
    rows, classes = _classes(docs, id_col, text_col)
    return rows.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "class_id")


def _large_links(buckets: DataFrame, grams: DataFrame) -> DataFrame:
    """Links (v, root) that join each class of the families in buckets (band, vertex)."""
    crowd = buckets.groupBy("band").agg(F.count("*").alias("size"))
    # each vertex meets one leader, of those that stand in the most crowded buckets the one that it meets most often
    order = buckets.join(crowd, "band").groupBy("vertex").agg(F.sum("size").alias("o"))
    best = buckets.join(order, "vertex").groupBy("band").agg(F.max(F.struct("o", -F.col("vertex"), "vertex")).alias("x")).select("band", F.col("x.vertex").alias("leader"))
    met = buckets.join(best, "band").groupBy("vertex", "leader").count()
    led = written(met.groupBy("vertex").agg(F.max(F.struct("count", -F.col("leader"), "leader")).alias("x")).select("vertex", F.col("x.leader").alias("leader")), "led")
    links = written(verified(led.where("vertex <> leader").select(F.col("vertex").alias("v"), F.col("leader").alias("root")), grams), "links")
    open_ = buckets.join(_hopeful(led, grams), "vertex", "left_semi")
    labelled = open_.join(links.select(F.col("v").alias("vertex"), "root"), "vertex", "left").withColumn("label", F.coalesce("root", "vertex"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("m"), F.max("label").alias("x"), F.count("*").alias("size")).where("m <> x").select("band", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("vertex"), F.col("blocks"))
    dealt = labelled.join(mixed, "band").select("vertex", "band", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    dealt = dealt.select("vertex", F.xxhash64("band", F.least("i", "j"), F.greatest("i", "j")).alias("family"))
    return links.union(grouped_links(written(dealt, "blocks").join(grams, "vertex")))


def _hopeful(led: DataFrame, grams: DataFrame) -> DataFrame:
    """The vertices of led (vertex, leader) that can be similar to another one.

    Similar multisets share LEAST_SIMILARITY of the larger one at least. What of a vertex neither a leader nor what another member
    has besides its own leader holds, can't be shared.
    """

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "x"):
            x, y = ([np.frombuffer(raw, np.int64) for raw in b.column(i).to_pylist()] for i in (1, 2))
            rest = [p if v == leader else np.setdiff1d(p, q, assume_unique=True) for v, leader, p, q in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in x], pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["vertex", "n", "rest"])

    leaders = led.select(F.col("leader").alias("vertex"), "leader").distinct()
    pairs = led.join(leaders.select("vertex"), "vertex", "left_anti").union(leaders)
    x, y = grams.withColumnRenamed("grams", "x"), grams.select(F.col("vertex").alias("leader"), F.col("grams").alias("y"))
    rest = written(pairs.join(x, "vertex").join(y, "leader").select("vertex", "x", "y", "leader").mapInArrow(differ, "vertex long, n long, rest array<long>"), "differences")
    each = rest.select("vertex", F.explode("rest").alias("gram"))
    alone = each.groupBy("gram").agg(F.min("vertex").alias("vertex"), F.count("*").alias("k")).where("k = 1").groupBy("vertex").agg(F.count("*").alias("own"))
    hope = rest.select("vertex", "n").join(alone, "vertex", "left").where(F.col("n") - F.coalesce("own", F.lit(0)) >= LEAST_SIMILARITY * F.col("n") - 1e-6)
    return hope.select("vertex").union(leaders.select("vertex")).distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the least doc_id, and of several with it the one whose text has the least hashes."""
    rows, classes = _classes(docs, id_col, text_col)
    own = rows.join(classes, ["d1", "d2"]).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = written(own.groupBy("class").agg(F.min(F.struct("t1", "t2")).alias("t"), F.first("class_id").alias("_near_id"), F.count("*").alias("_near_rows")).select("_near_id", F.col("t.t1").alias("_near_1"), F.col("t.t2").alias("_near_2"), "_near_rows"), "representatives")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    at = docs.withColumns({"_near_doc": docs[id_col].cast("long"), "_near_t1": F.xxhash64(text), "_near_t2": F.xxhash64(F.lit(7), text)})
    left = at.join(stay, at["_near_doc"].eqNullSafe(stay["_near_id"]) & (at["_near_t1"] == stay["_near_1"]) & (at["_near_t2"] == stay["_near_2"]), "left_semi")
    if not stay.where("_near_rows > 1").isEmpty():
        left = left.dropDuplicates(["_near_doc", "_near_t1", "_near_t2"])
    return left.drop("_near_doc", "_near_t1", "_near_t2")


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
