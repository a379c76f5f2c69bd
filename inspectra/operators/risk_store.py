"""Risk scores kept up to date: decayed sums for each user and day, appended as incidents come and multiplied forward when they are read.

An incident's weight decays by a constant factor for every day, so what a day's incidents weigh at the day's end can be summed once, and
counts at any later day as that sum times the factor's power. An increment holds, for each user and day of its incidents, that sum, the
undecayed one, counts and first and last times. Increments of all batches merge by adding, so the scores of any reference
day come from the few rows of users and days, not from incidents.

Edge cases: reference days begin at midnight, other times raise; incidents after the reference day's beginning count in full, as in
the full computation; a batch can be added again under its number; users without a name are unknown; null times are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.operators.reports import DECAY, graded, weight
from inspectra.schema import SEVERITIES
from inspectra.storage import removed

_COUNTS = ("n_incidents", *(f"n_{s}" for s in SEVERITIES))


def increments(incidents: DataFrame) -> DataFrame:
    """user, day, decayed (to the day's end), full, counts, oldest and latest."""
    day = F.to_date("created_at")
    end = F.date_add(day, 1).cast("timestamp_ntz")
    age = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6 / 86400
    user = F.when(F.col("user") != "", F.col("user")).otherwise("unknown")
    w = weight(F.col("severity"))
    counts = [F.count("*").alias("n_incidents"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES)]
    some = incidents.where("created_at IS NOT NULL")
    return some.groupBy(user.alias("user"), day.alias("day")).agg(F.sum(w * F.pow(F.lit(DECAY), age)).alias("decayed"), F.sum(w).cast("double").alias("full"), *counts, F.min("created_at").alias("oldest"), F.max("created_at").alias("latest"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user", "day").agg(F.sum("decayed").alias("decayed"), F.sum("full").alias("full"), *(F.sum(c).alias(c) for c in _COUNTS), F.min("oldest").alias("oldest"), F.max("latest").alias("latest"))


@dataclass(frozen=True)
class RiskStore:
    """Increments in a folder, by batch and month; the months before a reference's lookback aren't read."""

    spark: SparkSession
    path: str

    def _put(self, rows: DataFrame, batch: int, replace: bool) -> None:
        month = F.date_trunc("month", F.col("day").cast("timestamp_ntz")).cast("date")
        if replace:
            removed(self.spark, f"{self.path}/batch={batch}")
        rows.withColumns({"month": month, "batch": F.lit(batch)}).write.mode("append").partitionBy("batch", "month").parquet(self.path)

    def add(self, incidents: DataFrame, batch: int) -> None:
        """Incidents that no other batch has; a batch that was added before is replaced."""
        self._put(increments(incidents), batch, True)

    def compact(self, batches: list[int], into: int) -> None:
        """Merges batches that get no more rows into a new one of another number."""
        if into in batches:
            raise ValueError("the merged batch needs a number of its own")
        rows = self.spark.read.parquet(self.path).where(F.col("batch").isin(*batches))
        self._put(_merged(rows), into, True)
        for b in batches:
            removed(self.spark, f"{self.path}/batch={b}")

    def scores(self, reference: str, lookback_days: int = 90) -> DataFrame:
        """What reports.risk gives for the reference day."""
        at = datetime.fromisoformat(reference)
        if (at.hour, at.minute, at.second, at.microsecond) != (0, 0, 0, 0):
            raise ValueError("a reference day begins at midnight")
        now = F.lit(at.date())
        first = F.date_sub(now, lookback_days)
        rows = self.spark.read.parquet(self.path).where((F.col("day") >= first) & (F.col("month") >= F.trunc(first, "month")))
        forward = F.when(F.col("day") >= now, F.col("full")).otherwise(F.col("decayed") * F.pow(F.lit(DECAY), F.datediff(now, F.date_add("day", 1))))
        sums = rows.groupBy("user").agg(F.sum(forward).alias("raw"), *(F.sum(c).alias(c) for c in _COUNTS), F.min("oldest").alias("oldest"), F.max("latest").alias("latest"))
        return graded(sums)
