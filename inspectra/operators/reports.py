"""Reports over incidents: summaries, trends, risk, pages and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.schema import SEVERITIES
from inspectra.storage import kept

SUMMARY_FIELDS = ("severity", "policy_name", "channel", "status", "source_type", "user")
#: Weights of severities in a user's risk, their decay for each day, and the raw score that counts as 100.
WEIGHTS = {"critical": 15, "high": 10, "medium": 5, "low": 2, "info": 1}
DECAY, FULL_SCORE = 0.95, 50.0
SORTABLE = ("created_at", "severity", "status", "policy_name", "channel", "user", "match_count", "id")


def between(incidents: DataFrame, start: str, end: str) -> DataFrame:
    return incidents.where(F.col("created_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def details(incidents: DataFrame, end: str, start: str | None = None, days: int = 30) -> DataFrame:
    """The incidents of a period, newest first; without a start it is the `days` before its end."""
    begin = F.lit(start).cast("timestamp_ntz") if start else F.lit(end).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    return incidents.where((F.col("created_at") >= begin) & (F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))).orderBy(F.desc("created_at"), "id")


def _share(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(n / total * 100, 1)).otherwise(0.0)


def summary(incidents: DataFrame, fields: tuple[str, ...] = SUMMARY_FIELDS) -> DataFrame:
    """(field, value, n, percentage) of all fields in one pass; null and empty values are unknown."""
    known = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string")).otherwise("unknown")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), known(f).alias("value")) for f in fields])
    counts = incidents.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("field"))  # over the few rows of groups, not of incidents
    return counts.select("field", "value", "n", _share(F.col("n"), total).alias("percentage"))


def delta(now: Column, before: Column) -> Column:
    return F.when(before > 0, F.bround((now - before) / before * 100, 1)).when(now > 0, 100.0).otherwise(0.0)


def trend(incidents: DataFrame, start: str, end: str, previous: tuple[str, str] | None = None) -> DataFrame:
    """(metric, current, previous, delta, delta_percent): the total and each severity, against the period just before.

    Without an explicit previous period it ends a second before the start and is as long.
    """
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    before_end = at(previous[1]) if previous else at(start) - F.expr("interval 1 second")
    before_start = at(previous[0]) if previous else before_end - (at(end) - at(start))
    now, before = F.col("created_at").between(at(start), at(end)), F.col("created_at").between(before_start, before_end)
    metric = F.explode(F.array(F.lit("total"), F.coalesce("severity", F.lit("unknown"))))
    rows = incidents.where(now | before).select(metric.alias("metric"), now.alias("is_now"), before.alias("is_before"))
    counts = rows.groupBy("metric").agg(F.count_if("is_now").alias("current"), F.count_if("is_before").alias("previous"))
    return counts.select("metric", "current", "previous", (F.col("current") - F.col("previous")).alias("delta"), delta(F.col("current"), F.col("previous")).alias("delta_percent"))


def weight(severity: Column) -> Column:
    out = F.lit(1)
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("info")


def risk(incidents: DataFrame, reference: str, lookback_days: int = 90) -> DataFrame:
    """Users by the sum of their incidents' weights, each less by DECAY for every day of age. Raw scores to four places."""
    now = F.lit(reference).cast("timestamp_ntz")
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    some = incidents.where(F.col("created_at") >= now - F.expr(f"interval {int(lookback_days)} days"))
    score = weight(F.col("severity")) * F.pow(F.lit(DECAY), F.greatest(F.lit(0.0), seconds / 86400))
    user = F.when(F.col("user") != "", F.col("user")).otherwise("unknown")
    by_severity = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    out = some.groupBy(user.alias("user")).agg(F.sum(score).alias("raw"), F.count("*").alias("n_incidents"), *by_severity, F.min("created_at").alias("oldest"), F.max("created_at").alias("latest"))
    return graded(out)


def graded(sums: DataFrame) -> DataFrame:
    """Users with their raw sums, as scores from 0 to 100 and levels."""
    scaled = F.least(F.lit(100), F.bround(F.col("raw") / FULL_SCORE * 100, 0).cast("int"))
    out = sums.withColumn("normalized", F.when(F.col("raw") > 0, F.greatest(F.lit(1), scaled)).otherwise(0))
    return out.select("user", F.round("raw", 4).alias("raw_score"), "normalized", risk_level(F.col("normalized")).alias("level"), "n_incidents", *[f"n_{s}" for s in SEVERITIES], "oldest", "latest")


def top(df: DataFrame, by: str, n: int = 5, key: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(by), *([key] if key else [])).limit(n)


def filtered(incidents: DataFrame, severity: str | None = None, status: str | None = None, channel: str | None = None, policy: str | None = None, search: str | None = None) -> DataFrame:
    """Equality of severity, status and channel; policy and search are parts of names, in which % and _ stand for anything."""
    out = incidents
    for name, value in (("severity", severity), ("status", status), ("channel", channel)):
        out = out.where(F.col(name) == value) if value else out
    out = out.where(F.col("policy_name").ilike(f"%{policy}%")) if policy else out
    return out.where(F.col("policy_name").ilike(f"%{search}%") | F.col("file_name").ilike(f"%{search}%") | F.col("user").ilike(f"%{search}%")) if search else out


def page(df: DataFrame, number: int = 1, size: int = 20, sort_by: str = "created_at", descending: bool = True, key: str = "id", newest: str = "created_at") -> DataFrame:
    """One page in a stable order, of any list; columns that can't be sorted by give way to `newest`."""
    column = F.col(sort_by if sort_by in (*SORTABLE, newest) and sort_by in df.columns else newest)
    return df.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col(key)).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 20) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def global_search(tables: dict[str, tuple[DataFrame, str, str, str]], words: str, most: int = 10) -> DataFrame:
    """(kind, id, title, subtitle) of up to `most` hits of each table, given as (rows, id, title and subtitle columns)."""
    parts = []
    for kind, (df, key, title, subtitle) in tables.items():
        hit = df.where(F.col(title).ilike(f"%{words}%") | F.col(subtitle).ilike(f"%{words}%"))
        parts.append(hit.orderBy(key).limit(most).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(title).cast("string").alias("title"), F.col(subtitle).cast("string").alias("subtitle")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def status_counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """The total and the number of each value, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and row_count of each table."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def rates(events: DataFrame, by: str, minutes: int = 5, ts: str = "ts") -> DataFrame:
    """Events a second in windows of so many minutes."""
    w = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n", (F.col("n") / (60.0 * minutes)).alias("per_second"))


def latency_quantiles(events: DataFrame, by: str, value: str, q: float = 0.95) -> DataFrame:
    """by, the exact quantile of the values that aren't null (between neighbours in proportion; null if there are none), and n of all rows.

    Values are dealt by ranges of (group, value), so that a large group is several segments; the segments' running counts, a row for
    each, say in which the wanted places lie, and only those segments are numbered.
    """
    n_ranges = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").withColumn("_salt", F.monotonically_increasing_id())
    dealt = kept(rows.repartitionByRange(n_ranges, "_by", "_v", "_salt").withColumn("_segment", F.spark_partition_id()), "quantiles")
    counts = dealt.groupBy("_by", "_segment").agg(F.count("*").alias("m"))
    before = Window.partitionBy("_by").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("*", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), (F.lit(q) * (F.sum("m").over(Window.partitionBy("_by")) - 1)).alias("at"))
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("m"))
    wanted = placed.where(holds(F.floor("at")) | holds(F.ceil("at")))
    nth = F.row_number().over(Window.partitionBy("_by", "_segment").orderBy("_v", "_salt")) - 1
    wanted = wanted.select(F.col("_by").alias("_g"), F.col("_segment").alias("_s"), "before", "at")  # two segments of each group at most
    seen = dealt.join(wanted, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_segment") == F.col("_s")))
    ranked = seen.withColumn("rank", F.col("before") + nth)
    low, high = F.max(F.when(F.col("rank") == F.floor("at"), F.col("_v"))), F.max(F.when(F.col("rank") == F.ceil("at"), F.col("_v")))
    ends = ranked.groupBy("_by").agg(low.alias("low"), high.alias("high"), F.max("at").alias("at"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    found = ends.select("_by", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("quantile"))
    return events.groupBy(by).agg(F.count("*").alias("n")).join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "quantile", "n")
