"""Deep pages of long lists: rows laid out in sorted ranges whose counts say where a page lies.

A list is dealt into ranges of its order once (the key breaks ties, so no value is too frequent for a range), sorted within them and
written by range with the number of rows and the first row of each. Page n is then read from the one range, or the few, that
the running counts name; nothing before it is sorted or read. A reader that has a page's last row continues after it.

Edge cases: nulls come last in either direction; pages beyond the end are empty; an empty list has no pages but the first; keys must be
unique and not null; numbers and sizes of pages begin at 1.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PagedList:
    """A list in a folder, in the order of a column, then the key."""

    spark: SparkSession
    path: str
    sort_by: str
    key: str
    descending: bool = True

    def _order(self) -> list[Column]:
        c = F.col(self.sort_by)
        return [c.desc_nulls_last() if self.descending else c.asc_nulls_last(), F.col(self.key).asc()]

    def write(self, rows: DataFrame, ranges: int = 200) -> None:
        dealt = rows.repartitionByRange(ranges, *self._order()).sortWithinPartitions(*self._order())
        dealt.withColumn("range", F.spark_partition_id()).write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/rows")
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/empty")  # the columns, also of a list without rows
        self._rows().groupBy("range").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts")

    def _rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/empty").schema.add("range", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def counts(self) -> list[tuple[int, int]]:
        """(range, number of rows) in order: as many as there are ranges, whatever the list's length."""
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.path}/counts").collect())

    def total(self) -> int:
        return sum(n for _, n in self.counts())

    def _within(self, ranges: list[int]) -> DataFrame:
        return self._rows().where(F.col("range").isin(*ranges)).drop("range") if ranges else self._rows().limit(0).drop("range")

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """One page, from the ranges that hold it."""
        if number < 1 or size < 1:
            raise ValueError("numbers and sizes of pages begin at 1")
        counts, first = self.counts(), (number - 1) * size
        ends = list(accumulate(n for _, n in counts))
        a, z = bisect.bisect_right(ends, first), bisect.bisect_left(ends, first + size)
        before = ends[a - 1] if a else 0
        return self._within([r for r, _ in counts[a : z + 1]]).orderBy(*self._order()).offset(first - before).limit(size)

    def after(self, last: Row, size: int = 20) -> DataFrame:
        """The rows that follow a row of the list, from its range and, where that ends, the next ones."""
        value, key = last[self.sort_by], last[self.key]
        here = F.col(self.sort_by).eqNullSafe(F.lit(value)) & (F.col(self.key) > F.lit(key))
        if value is None:
            later = here
        else:
            beyond = F.col(self.sort_by) < F.lit(value) if self.descending else F.col(self.sort_by) > F.lit(value)
            later = here | F.coalesce(beyond, F.lit(False)) | F.col(self.sort_by).isNull()
        found = self._rows().where(F.col(self.sort_by).eqNullSafe(F.lit(value)) & (F.col(self.key) == F.lit(key))).select("range").first()
        if found is None:
            raise ValueError("the row isn't in the list")
        ranges, left = [], size
        for r, n in self.counts():
            if r >= found["range"] and left > 0:
                ranges.append(r)
                left -= n if r > found["range"] else 0
        return self._within(ranges).where(later).orderBy(*self._order()).limit(size)
