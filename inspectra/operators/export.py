"""Incidents as lines and objects that other systems read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers of severities and actions in CEF lines.
CEF_SEVERITY = {"critical": 10, "high": 8, "medium": 5, "low": 3, "info": 1}
CEF_SIGNATURE = {"block": 100, "notify": 200, "log": 300, "quarantine": 400, "user_cancel": 500}
VENDOR, PRODUCT = "Inspectra", "Inspectra"
DETAIL_COLUMNS = ("id", "policy_name", "severity", "status", "channel", "source_type", "user", "file_name", "match_count", "action_taken", "created_at")


def _lookup(c: Column, values: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def cef_escape(c: Column) -> Column:
    steps = (("\\", "\\\\"), ("|", "\\|"), ("=", "\\="), ("\n", "\\n"), ("\r", "\\r"))
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), steps, c)


def cef_line(vendor: str = VENDOR, product: str = PRODUCT, title: str = "DLP") -> Column:
    """A CEF line of an incident's columns; fields that are null or empty are left out where they may be."""
    pair = lambda k, c: F.concat(F.lit(f"{k}="), cef_escape(c.cast("string")))
    maybe = lambda k, c: F.when(c.cast("string") != "", pair(k, c))
    col = F.col
    millis = F.unix_millis(col("created_at").cast("timestamp"))
    parts = [pair("act", col("action_taken")), pair("cat", col("channel")), pair("cs1", col("policy_name")), F.lit("cs1Label=PolicyName"), pair("cs2", col("source_type")), F.lit("cs2Label=SourceType"), pair("cn1", col("match_count")), F.lit("cn1Label=MatchCount"), pair("sev", col("severity")), pair("outcome", col("status")), maybe("suser", col("user")), maybe("fname", col("file_name")), maybe("rt", millis)]
    name = cef_escape(F.concat(F.lit(f"{title} "), col("action_taken"), F.lit(": "), col("policy_name")))
    head = [F.lit(f"CEF:0|{vendor}|{product}|1.0"), _lookup(col("action_taken"), CEF_SIGNATURE, 999).cast("string"), name, _lookup(col("severity"), CEF_SEVERITY, 1).cast("string")]
    return F.concat_ws("|", *head, F.concat_ws(" ", *parts))


def syslog_priority(severity: Column, facility: int = 13) -> Column:
    return F.lit(facility * 8) + F.least(F.lit(7), F.greatest(F.lit(0), F.lit(7) - _lookup(severity, CEF_SEVERITY, 1)))


def at_least(severity: Column, least: str) -> Column:
    """Severities from `least` up; unknown ones pass."""
    order = list(reversed(CEF_SEVERITY))
    return ~severity.isin(*order[: order.index(least)]) | severity.isNull()


def cef_lines(incidents: DataFrame, least: str = "info") -> DataFrame:
    return incidents.where(at_least(F.col("severity"), least)).select("id", syslog_priority(F.col("severity")).alias("priority"), cef_line().alias("line"))


def ecs_event(event_type: str = "dlp:policy_violation", vendor: str = VENDOR, product: str = PRODUCT) -> Column:
    """An event object in the Elastic Common Schema; user and file only where known."""
    col, lit = F.col, F.lit
    grade = F.coalesce(F.array_position(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), col("severity")).cast("int"), F.lit(0)) - 1
    optional = lambda c: F.when(col(c) != "", F.struct(col(c).alias("name")))
    return F.struct(
        F.date_format(col("created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("@timestamp"),
        lit(event_type).alias("event_type"),
        F.struct(lit("alert").alias("kind"), F.array(lit("intrusion_detection")).alias("category"), F.array(lit("info")).alias("type"), col("action_taken").alias("action"), F.greatest(grade, lit(0)).alias("severity"), F.when(col("action_taken") == "block", "success").otherwise("unknown").alias("outcome"), lit("dlp.incidents").alias("dataset")).alias("event"),
        F.struct(col("source_type").alias("type")).alias("source"),
        F.struct(F.struct(col("policy_name").alias("name")).alias("policy"), col("severity").alias("classification"), "channel", col("action_taken").alias("action"), "match_count", col("id").cast("string").alias("incident_id")).alias("dlp"),
        F.struct(lit(vendor).alias("vendor"), lit(product).alias("product"), lit("dlp").alias("type")).alias("observer"),
        optional("user").alias("user"),
        optional("file_name").alias("file"),
    )


def ecs_events(incidents: DataFrame) -> DataFrame:
    return incidents.select("id", F.to_json(ecs_event()).alias("event"))


def detail(incidents: DataFrame) -> DataFrame:
    """The columns of a detail report as text, null as nothing."""
    return incidents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DETAIL_COLUMNS])


def write_detail_csv(incidents: DataFrame, path: str, bom: bool = True) -> None:
    """A detail report; with bom every file begins with a byte order mark, as spreadsheets want it."""
    first = DETAIL_COLUMNS[0]
    detail(incidents).withColumnRenamed(first, ("\ufeff" if bom else "") + first).write.option("header", True).option("quoteAll", False).csv(path)


#: Times in JSON to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(**_TIMES).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_jsonl has written; lines that aren't JSON are left out, fields that the schema doesn't name too."""
    rows = spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").options(**_TIMES).json(path)
    return rows.where("_broken IS NULL").drop("_broken")


def trend_lines(trend: DataFrame) -> DataFrame:
    """Rows of a trend report: the metric in title case, changes with their sign."""
    sign = lambda c, form: F.format_string(form, F.col(c))
    return trend.select(F.initcap(F.replace("metric", F.lit("_"), F.lit(" "))).alias("metric"), "current", "previous", sign("delta", "%+d").alias("delta"), sign("delta_percent", "%+.1f%%").alias("delta_percent"))


def summary_lines(summary: DataFrame, start: str, end: str) -> DataFrame:
    """Lines of a summary report, in order: an overview, then a section for each field with values by count."""
    total = summary.where(F.col("field") == "severity").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    head = total.select(F.lit("").alias("field"), F.lit(-1).cast("long").alias("rank"), F.explode(F.array(F.lit("Summary report"), F.lit(f"Period,{start},{end}"), F.concat(F.lit("Total,"), F.col("n").cast("string")))).alias("line"))
    titles = summary.select("field").distinct().select("field", F.lit(0).cast("long").alias("rank"), F.initcap(F.replace("field", F.lit("_"), F.lit(" "))).alias("line"))
    quoted = F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"'))
    rows = summary.select("field", (1 - F.col("n") + (1 << 62)).alias("rank"), F.concat_ws(",", quoted, F.col("n").cast("string"), F.col("percentage").cast("string")).alias("line"))
    return head.unionByName(titles).unionByName(rows).orderBy("field", "rank", "line").select("line")


def status_events(agents: DataFrame, vendor: str = VENDOR, product: str = PRODUCT) -> DataFrame:
    """Event objects of agents (agent, hostname, status, ts)."""
    lit = F.lit
    event = F.struct(lit("agent_status").alias("event_type"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("@timestamp"), F.struct(lit("event").alias("kind"), F.array(lit("host")).alias("category"), lit("agent_heartbeat").alias("action"), lit("dlp.agents").alias("dataset")).alias("event"), F.struct(F.col("agent").alias("id"), "hostname").alias("agent"), F.struct(lit(vendor).alias("vendor"), lit(product).alias("product"), lit("dlp").alias("type")).alias("observer"), F.struct(F.col("status").alias("agent_status")).alias("dlp"))
    return agents.select("agent", F.to_json(event).alias("event"))


def write_by_month(incidents: DataFrame, path: str, ts: str = "created_at") -> None:
    """Incidents in folders of a year and month, which readers of a period prune; ranges of time, so that a month may take several tasks."""
    incidents.withColumns({"year": F.year(ts), "month": F.month(ts)}).repartitionByRange(ts).write.partitionBy("year", "month").mode("append").parquet(path)
