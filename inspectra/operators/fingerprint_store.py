"""A stored index of fingerprints: bucketed by bands of bits, added to, deleted from and searched by partition, never rebuilt.

For a similarity threshold up to `bits` bits may differ, so of bits + 1 bands one is equal; the index holds each fingerprint once in
every band. Its folders are band, shard (of the band's value) and batch. An addition writes folders of its own batch and can be
repeated; a deletion finds the folders that hold the ids, by the same bands, and rewrites those alone. A search compares blocks of rows of
equal bands, or of all entries where bands don't select (near_pairs). Entries with their texts' lengths and previews lie apart, by shard of the id.

Edge cases: ids are unique: an addition replaces entries of the same id; null ids and fingerprints are left out; of an id that a batch brings
several times one entry stays (the greatest); deleting what isn't there changes nothing; an empty index is an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.operators.fingerprint import band_edges, band_keys, near_pairs
from inspectra.storage import exists, kept, removed

_ENTRY = ("fingerprint_id", "simhash", "text_length", "preview")


@dataclass(frozen=True)
class FingerprintStore:
    """The index in a folder. id_type is that of fingerprint_id."""

    spark: SparkSession
    path: str
    threshold: float = 0.9
    shards: int = 16
    id_type: str = "bigint"

    @property
    def edges(self) -> list[int]:
        return band_edges(self.threshold)

    def _schema(self, part: str) -> str:
        own = f"fingerprint_id {self.id_type}, simhash bigint"
        return f"{own}, text_length int, preview string, shard int, batch bigint" if part == "entries" else f"{own}, key bigint, band int, shard int, batch bigint"

    def _read(self, part: str) -> DataFrame:
        path = f"{self.path}/{part}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self._schema(part))
        return self.spark.read.schema(self._schema(part)).option("basePath", path).parquet(path)

    def _keys(self, simhash: Column) -> Column:
        """(band, key, shard) of each band."""
        shard = lambda key: F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int").alias("shard")
        return F.transform(band_keys(simhash, self.edges), lambda k: F.struct(k["band"].alias("band"), k["key"].alias("key"), shard(k["key"])))

    def _banded(self, rows: DataFrame) -> DataFrame:
        return rows.select("fingerprint_id", "simhash", F.explode(self._keys(F.col("simhash"))).alias("k")).select("fingerprint_id", "simhash", "k.key", "k.band", "k.shard")

    def _put(self, part: str, rows: DataFrame) -> None:
        by = ["shard", "batch"] if part == "entries" else ["band", "shard", "batch"]
        spread = rows.repartition(*by)  # one file for each folder
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{part}")

    def load(self) -> DataFrame:
        """All entries, as build_index gives them."""
        return self._read("entries").select(*_ENTRY)

    def add(self, entries: DataFrame, batch: int) -> None:
        """Entries as build_index gives them. A batch that was interrupted can be added again under its number."""
        rows = entries.where("fingerprint_id IS NOT NULL AND simhash IS NOT NULL")
        rows = rows.groupBy(F.col("fingerprint_id").cast(self.id_type).alias("fingerprint_id")).agg(F.max(F.struct("simhash", F.col("text_length").cast("int").alias("text_length"), "preview")).alias("e")).select("fingerprint_id", "e.*")
        rows = kept(rows, "fingerprints")
        self.remove(rows.select("fingerprint_id"))
        self._put("entries", rows.select(*_ENTRY, self._id_shard(), F.lit(batch).cast("bigint").alias("batch")))
        self._put("bands", self._banded(rows).withColumn("batch", F.lit(batch).cast("bigint")))

    def _id_shard(self) -> Column:
        return F.pmod(F.xxhash64("fingerprint_id"), F.lit(self.shards)).cast("int").alias("shard")

    def remove(self, ids: DataFrame) -> None:
        """Deletes the entries of these ids (column fingerprint_id). The bands go first: an interrupted deletion can be repeated."""
        gone = ids.select(F.col("fingerprint_id").cast(self.id_type).alias("fingerprint_id")).distinct()
        shards = gone.select("*", self._id_shard())
        hit = kept(self._read("entries").join(shards, ["fingerprint_id", "shard"]), "gone")
        keys = kept(self._banded(hit).join(hit.select("fingerprint_id", "batch"), "fingerprint_id"), "gone-bands")
        self._rewrite("bands", keys.select("band", "shard", "batch").distinct(), keys.select("fingerprint_id", "band", "shard", "batch"))
        self._rewrite("entries", hit.select("shard", "batch").distinct(), hit.select("fingerprint_id", "shard", "batch"))

    def _rewrite(self, part: str, folders: DataFrame, gone: DataFrame) -> None:
        """Rewrites these folders without the rows that have gone. The driver sees names of folders, of which there are bands * shards * batches at most."""
        names = [tuple(r) for r in folders.collect()]
        if not names:
            return
        by = folders.columns
        paths = ["/".join(f"{c}={v}" for c, v in zip(by, n)) for n in names]
        there = [f"{self.path}/{part}/{p}" for p in paths if exists(self.spark, f"{self.path}/{part}/{p}")]
        if not there:
            return
        rows = self.spark.read.schema(self._schema(part)).option("basePath", f"{self.path}/{part}").parquet(*there)
        left = kept(rows.join(gone, [*by, "fingerprint_id"], "left_anti").select(*rows.columns), "left")
        filled = {"/".join(f"{c}={v}" for c, v in zip(by, r)) for r in left.select(*by).distinct().collect()}
        self._put(part, left)
        for p in there:
            if p.removeprefix(f"{self.path}/{part}/") not in filled:
                removed(self.spark, p)

    def search(self, seen: DataFrame, threshold: float | None = None) -> DataFrame:
        """(seen_id, fingerprint_id, score) of all entries at least so similar to the rows of `seen` (fingerprint_id, simhash)."""
        least = self.threshold if threshold is None else threshold
        if least < self.threshold:
            raise ValueError(f"this index is exact from {self.threshold} on")
        some = kept(seen.where("simhash IS NOT NULL").select(F.col("fingerprint_id").alias("id"), "simhash"), "seen")
        stored = lambda part, *more: self._read(part).select(F.col("fingerprint_id").alias("id"), "simhash", *more)
        return near_pairs(some, stored("entries"), least, self.edges, stored("bands", "band", "key")).select(F.col("left_id").alias("seen_id"), F.col("right_id").alias("fingerprint_id"), "score")
