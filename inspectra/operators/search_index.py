"""Substring search by an inverted index of trigrams, in place of scans of whole tables.

Every row's texts are cut into their different trigrams (in lower case, as ILIKE compares); a posting holds a trigram, the row's key and its
texts, so that what a trigram finds is verified where it is read. Postings lie in folders by a hash of the trigram, sorted by it, and a
table of counts says how many rows have it. A search reads the counts of its trigrams, then the postings of the rarest one, and
keeps the rows that the whole pattern matches: the same rows as a scan.

The price is space: a row is stored once for each of its trigrams, which suits names and titles, not documents.

Edge cases: % and _ stand for anything, a backslash before them for themselves; patterns without three neighbouring characters
have no trigram and scan the rows; null texts match nothing; texts of under three characters are found by such scans only, as no
pattern with a trigram matches them; a batch can be added again under its number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectra.storage import exists

GRAM, BUCKETS = 3, 64


def literal_runs(pattern: str) -> list[str]:
    """The runs of characters of an ILIKE pattern that stand for themselves."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c in "%_":
            runs.append(run)
            run = ""
        else:
            i += c == "\\"
            run += pattern[i : i + 1]
        i += 1
    return [r for r in [*runs, run] if r]


def _grams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """The index of some text columns of a table, in a folder."""

    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]

    def add(self, rows: DataFrame, batch: int) -> None:
        """Rows (key and text columns) whose keys no other batch has."""
        some = rows.select(self.key, *(F.col(c).cast("string").alias(c) for c in self.columns), F.lit(batch).alias("batch"))
        put = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")
        put(some, "rows", "batch")
        mine = lambda name, df: self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").where(F.col("batch") == batch).withColumn("batch", F.lit(batch))
        some = mine("rows", some)  # as written, not made again
        grams = F.array_distinct(F.flatten(F.array(*(F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in self.columns))))
        postings = some.select("*", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
        # rebalanced: a bucket with a trigram that most rows have is split over several tasks, and nothing is sampled before
        put(postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", self.key), "postings", "bucket", "batch")
        # of the postings as written, where a trigram's rows are neighbours, not of all trigrams made again
        put(mine("postings", postings).groupBy("bucket", "gram").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch)), "counts", "bucket", "batch")

    def _at(self, name: str, grams: list[str]) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df.where(reduce(lambda a, b: a | b, [F.col("bucket") == _bucket(F.lit(g)) for g in grams]) & F.col("gram").isin(*grams))

    def grams_of(self, pattern: str) -> list[str]:
        low = self.spark.range(1).select(F.lower(F.lit(pattern))).first()[0] if not pattern.isascii() else pattern.lower()
        return sorted({r[i : i + GRAM] for r in literal_runs(low) for i in range(len(r) - GRAM + 1)})

    def find(self, words: str) -> DataFrame:
        """The rows of which a text holds the words (an ILIKE pattern that may begin and end anywhere)."""
        wanted = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{words}%"), F.lit(False)) for c in self.columns])
        if not exists(self.spark, f"{self.path}/rows"):
            raise ValueError(f"no index in {self.path}")
        grams = self.grams_of(words)
        if not grams:
            return self.spark.read.parquet(f"{self.path}/rows").drop("batch").where(wanted)
        counts = {r["gram"]: r["n"] for r in self._at("counts", grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rarest = min(grams, key=lambda g: (counts.get(g, 0), g))
        return self._at("postings", [rarest]).where(wanted).select(self.key, *self.columns)


def global_search(indexes: dict[str, SearchIndex], words: str, most: int = 10) -> DataFrame:
    """(kind, id, title, subtitle) of up to `most` hits of each index, whose first two columns are titles and subtitles."""
    parts = []
    for kind, index in indexes.items():
        hit = index.find(words).orderBy(index.key).limit(most)
        parts.append(hit.select(F.lit(kind).alias("kind"), F.col(index.key).cast(T.StringType()).alias("id"), F.col(index.columns[0]).alias("title"), F.col(index.columns[1]).alias("subtitle")))
    return reduce(DataFrame.unionByName, parts)
