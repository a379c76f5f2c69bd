"""Helpers shared by the operators: tables, shared scratch folders, batches and bit packing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one step of a Python task takes from an Arrow batch at a time.
STEP_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, one process has a temporary one (tests); a cluster, whose machines can't see each other's folders, has none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="inspectra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, a written table, after the files of old, a written one that nothing reads any more, have gone."""
    jvm, conf = old.sparkSession._jvm, old.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return new


def hash_sample(df: DataFrame, most: int) -> DataFrame:
    """About `most` rows of df (all, if fewer), chosen by a hash of their columns: no task sees more than its own rows."""
    columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    share = min(1.0, most / max(1, df.count()))
    return df if share == 1.0 else df.where(F.xxhash64(*(F.col(f"`{c}`") for c in columns)) < int((2 * share - 1) * 2.0**63))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steps(batches: Iterator[pa.RecordBatch], size_of: str = "text", limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes in column `size_of` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(size_of))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def pack_bits(values: np.ndarray, nbits: np.ndarray, at: np.ndarray, n_bytes: int) -> np.ndarray:
    """The values (up to 25 bits each), most significant bit first, at the bit offsets `at`; the bits don't overlap."""
    byte = at >> 3
    word = values.astype(np.int64) << (32 - nbits - (at & 7))
    out = np.zeros(n_bytes + 4, np.float64)
    for k in range(4):
        part = (word >> (24 - 8 * k)) & 255
        if k < 1 or part.any():
            got = np.bincount(byte, weights=part)
            out[k : k + len(got)] += got
    return out[:n_bytes].astype(np.uint8)


def peek_table(buf: np.ndarray) -> np.ndarray:
    """For each byte offset the 64 bits that begin there, as uint64; zeros follow the end."""
    c = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(np.uint64)
    n = len(buf) + 8
    two = (c[:-1] << np.uint64(8)) | c[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return ((four[:-4] << np.uint64(32)) | four[4:])[:n]
