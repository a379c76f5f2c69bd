"""Exact top-k inner products: a ball tree for each shard of vectors, searched by branch and bound.

Shards of SHARD_ROWS vectors by a hash of the row's number each become one row of an index (vectors in tree order, node centres and
radii). Queries first search the shard they hash to; the k-th score found goes with them, in broadcast blocks of about BLOCK_ROWS, to every
task that reads the index, which is never shuffled again. Nodes are taken by their inner-product upper bound, and each query's k-th score is
shared by SLICE_TREES trees at a time.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id; rows
are numbered, so rows that share an id, or are equal, are candidates of their own and for one another, and each of them that is a query has its own ranking;
a query doesn't meet its own row; vectors meet only vectors of their own length; ties go to the
smaller id; fewer than k candidates give fewer rows; other columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectra.llm.common import table, written

SHARD_ROWS, LEAF_ROWS = 2048, 64
#: Queries of a block, and trees that share k-th scores: what one task holds at most.
BLOCK_ROWS, SLICE_TREES = 4096, 4
INDEX_SCHEMA = "dim int, shard long, ids binary, rows binary, vectors binary, bounds binary, centres binary, radii binary"
FOUND_SCHEMA = "query_row long, query_id long, vec_id long, score long"
#: Integers up to it are exact as doubles.
EXACT = float(1 << 53)


def scaled(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, dim and v = floor(scale * x), as longs, of the usable vectors."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].alias("x"))
    usable = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.size("x").alias("dim"), v.alias("v"))


def numbered(vectors: DataFrame) -> DataFrame:
    """scaled() vectors with the number `row` of each, in a written table, so that the numbers stay."""
    return written(vectors.withColumn("row", F.monotonically_increasing_id()), "ball-vectors")


def build_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and bounds (first, end), centre and radius of every node; node i's children are 2i+1 and 2i+2."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(v) / LEAF_ROWS)))))
    nodes = (1 << (depth + 1)) - 1
    order, x = np.arange(len(v)), v.astype(np.float64)
    bounds, centres, radii = np.zeros((nodes, 2), np.int64), np.zeros((nodes, v.shape[1])), np.zeros(nodes)
    bounds[0] = 0, len(v)
    for i in range(nodes):
        a, b = bounds[i]
        if a == b:
            continue
        of = x[order[a:b]]
        centres[i] = of.mean(0)
        far = np.sqrt(((of - centres[i]) ** 2).sum(1))
        radii[i] = far.max()
        if 2 * i + 1 < nodes:
            pivot = of[far.argmax()]
            other = of[((of - pivot) ** 2).sum(1).argmax()]
            order[a:b] = order[a:b][np.argsort(of @ (other - pivot), kind="stable")]
            bounds[2 * i + 1], bounds[2 * i + 2] = (a, (a + b) // 2), ((a + b) // 2, b)
    return order, bounds, centres, radii


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, kth: np.ndarray, k: int):
        self.rows, self.vectors, self.k = rows, vectors, k
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.scores = np.full((len(rows), k), np.iinfo(np.int64).min)
        self.found = np.full((len(rows), k), np.iinfo(np.int64).max)
        self.least = kth.astype(np.int64)  # a bound known from elsewhere

    def take(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        got = self.vectors[q] @ vectors.T
        got = got if got.dtype == np.int64 else np.rint(got).astype(np.int64)
        own = self.rows[q][:, None] == rows[None]
        worth = (got >= self.least[q][:, None]) & ~own
        some = worth.any(1)
        q, got, worth = q[some], got[some], worth[some]
        if not len(q):
            return
        scores = np.concatenate([self.scores[q], np.where(worth, got, np.iinfo(np.int64).min)], 1)
        found = np.concatenate([self.found[q], np.where(worth, ids[None], np.iinfo(np.int64).max)], 1)
        order = np.lexsort((found, -1 - scores), axis=1)[:, : self.k]  # -1 - x reverses the order and cannot overflow
        self.scores[q], self.found[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
        self.least[q] = np.maximum(self.least[q], self.scores[q][:, -1])


def search(best: Best, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> int:
    """Searches one tree for all queries; the number of (query, leaf) pairs that had to be scored."""
    leaves, q, node = len(radii) // 2, np.arange(len(best.rows)), np.zeros(len(best.rows), np.int64)

    def bound(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        up = np.einsum("ij,ij->i", best.vectors[q].astype(np.float64), centres[node]) + best.norms[q] * radii[node]
        return up + 1e-9 * np.abs(up) + 1e-6

    up = bound(q, node)
    while len(q) and node[0] < leaves:
        keep = up >= best.least[q]
        q, node = np.repeat(q[keep], 2), np.repeat(2 * node[keep] + 1, 2)
        node[1::2] += 1
        up = bound(q, node)
    order = np.lexsort((-up, q))
    q, node, up = q[order], node[order], up[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    scored = 0
    for wave in range(int(rank.max(initial=-1)) + 1):
        of = np.flatnonzero(rank == wave)
        of = of[up[of] >= best.least[q[of]]]
        for leaf in np.unique(node[of]).tolist():
            a, b = bounds[leaf]
            if b > a:
                these = q[of[node[of] == leaf]]
                best.take(these, ids[a:b], rows[a:b], vectors[a:b])
                scored += len(these)
    return scored


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy().astype(np.int64).reshape(n, -1)
    m = float(np.abs(flat).max(initial=0))
    return flat.astype(np.float64) if m * m * flat.shape[1] < EXACT else flat


def index(vectors: DataFrame) -> DataFrame:
    """One row for each shard of numbered() vectors, written to the shared folder."""

    def run(got: pa.Table) -> pa.Table:
        got = got.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        v = np.array(got.column("v").combine_chunks().flatten()).reshape(got.num_rows, -1)
        order, bounds, centres, radii = build_tree(v)
        ids, rows = got.column("vec_id").to_numpy()[order], got.column("row").to_numpy()[order]
        row = [got.column("dim")[0].as_py(), got.column("shard")[0].as_py(), ids.tobytes(), rows.tobytes(), v[order].tobytes(), bounds.tobytes(), centres.tobytes(), radii.tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 6))], [f.split()[0] for f in INDEX_SCHEMA.split(", ")])

    return written(vectors.groupBy("dim", "shard").applyInArrow(run, INDEX_SCHEMA), "ball-trees")


def _searched(trees: list[dict], asked: pa.Table, k: int) -> pa.Table:
    """The k best candidates of each query in all these trees of its length, with at least its known k-th score."""
    out = [pa.array([], pa.int64())] * 4
    if trees and asked.num_rows:
        asked_rows, asked_ids = asked.column("query_row").to_numpy(), asked.column("query_id").to_numpy()
        best = Best(asked_rows, _matrix(asked.column("v"), asked.num_rows), asked.column("kth").to_numpy(), k)
        for row in trees:
            ids = np.frombuffer(row["ids"], np.int64)
            v = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1)
            m = float(max(np.abs(v).max(), np.abs(best.vectors).max()))
            v = v.astype(np.float64) if m * m * v.shape[1] < EXACT else v
            best.vectors = best.vectors if v.dtype == np.float64 else best.vectors.astype(np.int64)
            search(best, ids, np.frombuffer(row["rows"], np.int64), v, np.frombuffer(row["bounds"], np.int64).reshape(-1, 2), np.frombuffer(row["centres"]).reshape(-1, v.shape[1]), np.frombuffer(row["radii"]))
        q, at = np.nonzero(best.found < np.iinfo(np.int64).max)
        out = [pa.array(x) for x in (asked_rows[q], asked_ids[q], best.found[q, at], best.scores[q, at])]
    return pa.table(out, ["query_row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors; vectors as numbered() gives them, queries some of their rows."""
    spark = vectors.sparkSession
    n_queries = queries.count()
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    trees = index(vectors.withColumn("shard", shard))
    parts = max(1, -(-n_queries // (shards * BLOCK_ROWS)))  # of the queries at home in one shard
    part = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(parts)).cast("int").alias("part")
    asked = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "dim", "v", shard.alias("home"), part)

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        return _searched(left.to_pylist(), right, k)

    none = F.lit(-(1 << 63)).cast("long")
    home = trees.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    first = home.groupBy("dim", "shard", "part").cogroup(asked.withColumn("kth", none).groupBy("dim", "home", "part")).applyInArrow(at_home, FOUND_SCHEMA)
    first = written(first, "ball-first")
    known = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_row", "least")
    blocks = max(1, -(-n_queries // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("query_row", F.lit(1)), F.lit(blocks)).alias("block")
    asked = written(asked.join(known, "query_row", "left").select("query_row", "query_id", "dim", "v", F.coalesce("least", none).alias("kth"), block), "ball-queries")
    found = []
    for i in range(blocks):
        sent = spark.sparkContext.broadcast(asked.where(F.col("block") == i).drop("block").toArrow())  # about BLOCK_ROWS rows

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            by_dim = {d: sent.value.filter(pc.equal(sent.value.column("dim"), d)) for d in sent.value.column("dim").unique().to_pylist()}
            held: list[dict] = []
            for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                if held and (len(held) == SLICE_TREES or held[0]["dim"] != row["dim"]):
                    yield from _searched(held, by_dim.get(held[0]["dim"], sent.value.slice(0, 0)), k).to_batches()
                    held = []
                held.append(row)
            if held:
                yield from _searched(held, by_dim.get(held[0]["dim"], sent.value.slice(0, 0)), k).to_batches()

        found.append(written(trees.mapInArrow(run, FOUND_SCHEMA), "ball-found"))
        sent.destroy()
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    all_found = reduce(DataFrame.union, found)
    return all_found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


QUERY_STEP = 50


def op4_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = numbered(scaled(table(spark, sf_dir, "embeddings")))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0), 5)


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
