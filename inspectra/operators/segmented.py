"""Values carried along long histories, with no task for a whole key.

Rows are dealt by ranges of (key, order), so that a key with many rows spreads over several segments and one segment holds about as many
rows as any other. Within a segment the last value before each row is a window's; each segment's own last value is one row, and a
second window over those few rows carries it into the segments that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inspectra.storage import kept


def last_before(rows: DataFrame, key: str, order: list[str], fields: list[str], segments: int | None = None) -> DataFrame:
    """rows with before_<field>: the key's last value of the field, nulls left out, that comes before the row; null if there is none.

    Rows of a key that are equal in `order` come in any order, so let it end in something unique. A null key is a key.
    """
    n = segments or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(n, key, *order).withColumn("_segment", F.spark_partition_id()), "segments")
    inside = Window.partitionBy("_segment", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *(F.last(f, ignorenulls=True).over(inside).alias(f"_local_{f}") for f in fields))
    ends = dealt.groupBy("_segment", key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f"_end_{f}") for f in fields))
    # a row for each segment that a key reaches into
    across = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_segment", F.col(key).alias("_key"), *(F.last(f"_end_{f}", ignorenulls=True).over(across).alias(f"_carried_{f}") for f in fields))
    both = local.withColumnRenamed("_segment", "_s").join(carried, (F.col("_s") == F.col("_segment")) & F.col(key).eqNullSafe(F.col("_key")))
    return both.select(*rows.columns, *(F.coalesce(f"_local_{f}", f"_carried_{f}").alias(f"before_{f}") for f in fields))
