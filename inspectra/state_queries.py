"""Registered queries over stored state: lists, notifications, audit rows, nested policies, endpoint policies and incidents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.operators import incidents, lists, reports, scan
from inspectra.plans import endpoint as E
from inspectra.plans.catalog import BY_NAME, TEMPLATES
from inspectra.queries import _CELLS, _CHECK_SQL, _EDGE, _INCIDENTS, ORACLE_SQL, _conversation_matches, _quote, conversation_messages, derived, query, table

_AGENTS = "(SELECT event_id AS id, ['online', 'offline', 'stale'][event_id % 3 + 1] AS status, 'g' || event_id % 4 AS group_id, 'Host' || user_id AS hostname FROM events)"


def _pick(n, *values: str):  # noqa: ANN001, ANN202
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _numbered(prefix: str, n):  # noqa: ANN001, ANN202
    return F.concat(F.lit(prefix), n.cast("string"))


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), _pick(e, "online", "offline", "stale").alias("status"), _numbered("g", e % 4).alias("group_id"), _numbered("Host", F.col("user_id")).alias("hostname"))


@query(f"SELECT * FROM {_AGENTS} WHERE status = 'offline' AND group_id = 'g1' AND hostname ILIKE '%host1%'")
def list_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    return lists.listed("agents", _agents(spark, sf_dir), status="offline", group_id="g1", hostname="host1")


@query(f"SELECT id, hostname FROM {_AGENTS} WHERE status = 'online' ORDER BY id LIMIT 20 OFFSET 40")
def page_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the third page of a list, which is the feature."""
    return reports.page(lists.listed("agents", _agents(spark, sf_dir), status="online", group_id=""), 3, 20, "id", descending=False, newest="id").select("id", "hostname")


@query("SELECT event_id AS id, ['policy', 'incident'][event_id % 2 + 1] AS resource_type, event_type || '.Updated' AS action FROM events WHERE event_id % 2 = 1 AND event_type ILIKE '%c%'")
def list_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("id"), _pick(e, "policy", "incident").alias("resource_type"), F.concat("event_type", F.lit(".Updated")).alias("action"))
    return lists.listed("audit", rows.where(F.col("action").ilike("%c%.upd%")), resource_type="incident", action="UPDATED")


def _dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("id"), F.col("event_type").alias("operation_type"), (e % 4 == 3).alias("is_permanent"), (e % 7 == 0).alias("is_dismissed"))
    return lists.dismissed(rows, table(spark, sf_dir, "events").where("event_id % 10 = 0").select(e.alias("id")))


@query("SELECT event_id AS id, event_type AS operation_type FROM events WHERE event_id % 7 > 0 AND event_id % 10 > 0 AND event_type = 'click'")
def list_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dismissed ones are left out."""
    return lists.listed("dead_letters", _dead_letters(spark, sf_dir), operation_type="click").select("id", "operation_type")


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 7 > 0 AND event_id % 10 > 0 AND event_id % 4 < 3) AS pending, count(*) FILTER (event_id % 7 > 0 AND event_id % 10 > 0 AND event_id % 4 = 3) AS permanent FROM events")
def dead_letter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return lists.dead_letter_stats(_dead_letters(spark, sf_dir))


_NOTES = """n AS (SELECT e.user_id, event_id AS id, ts AS created_at, event_id % 5 = 0 OR coalesce(ts <= last, false) AS is_read FROM events e
    LEFT JOIN (SELECT user_id, max(ts) AS last FROM events WHERE event_id % 97 = 0 GROUP BY user_id) a ON e.user_id = a.user_id WHERE event_id % 7 > 0)"""


def _notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, e = table(spark, sf_dir, "events"), F.col("event_id")
    made = events.select("user_id", e.alias("id"), F.col("ts").alias("created_at"))
    mark = lambda kind, n: events.where(e % n == 0).select("user_id", F.col("ts").alias("at"), F.lit(kind).alias("kind"), e.alias("id"))
    return lists.notification_state(made, mark("read", 5).unionByName(mark("delete", 7)).unionByName(mark("read_all", 97)))


@query(f"WITH {_NOTES} SELECT user_id, id, is_read FROM n")
def notification_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications after reading and deleting."""
    return _notifications(spark, sf_dir).select("user_id", "id", "is_read")


@query(f"WITH {_NOTES} SELECT user_id, id, created_at FROM n WHERE NOT is_read AND user_id = 3")
def list_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15."""
    return lists.listed("unread", _notifications(spark, sf_dir), user_id=3).select("user_id", "id", "created_at")


@query(f"WITH {_NOTES} SELECT user_id, count(*) FILTER (NOT is_read) AS unread FROM n GROUP BY user_id")
def unread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return lists.unread_counts(_notifications(spark, sf_dir))


@query("SELECT c_custkey AS user_id, 'system' AS type, 'Maintenance' AS title, TIMESTAMP '2024-01-31 00:00:00' AS created_at, false AS is_read FROM customer WHERE c_custkey % 3 > 0")
def broadcast_notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for every active user."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3 > 0).alias("is_active"))
    return lists.broadcast_notification(users, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), type="system", title="Maintenance")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS agent_id, 'Scan ' || o_orderpriority AS name FROM orders WHERE o_orderstatus = 'O' AND 'Scan ' || o_orderpriority ILIKE '%scan 1%'")
def list_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("agent_id"), F.concat(F.lit("Scan "), "o_orderpriority").alias("name"))
    return lists.listed("scans", rows, status="O", agent_id=None, name="scan 1")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 5 > 0 AND p_name ILIKE '%RE%'")
def list_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5 > 0).alias("is_active"))
    return lists.listed("dictionaries", rows, name="re").select("id", "name")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 4 > 0 AND n_regionkey = 1 AND n_name ILIKE '%a%'")
def list_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """no templates, by status and name."""
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(n.alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("status"), (n % 4 == 0).alias("is_template"))
    return lists.listed("policies", rows, status=1, name="A").select("id", "name")


@query(
    """WITH c AS (SELECT o_custkey AS parent_id, string_agg(o_orderstatus, '+' ORDER BY o_orderkey) AS conditions FROM orders GROUP BY 1),
    r AS (SELECT c_nationkey AS id, string_agg(c_custkey || ':' || coalesce(conditions, ''), ',' ORDER BY c_custkey) AS exceptions FROM customer LEFT JOIN c ON c_custkey = parent_id GROUP BY 1),
    s AS (SELECT s_nationkey AS id, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS responses FROM supplier GROUP BY 1)
    SELECT n_nationkey AS id, coalesce(exceptions, '') AS exceptions, coalesce(responses, '') AS responses FROM nation LEFT JOIN r ON n_nationkey = r.id LEFT JOIN s ON n_nationkey = s.id"""
)
def nested_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with their exceptions, these with their conditions, and with their responses."""
    policies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    exceptions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("policy_id"))
    conditions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("kind"))
    responses = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("policy_id"))
    out = lists.with_parts(lists.with_parts(policies, exceptions, "exceptions", conditions), responses, "responses")
    kinds = lambda x: F.coalesce(F.array_join(F.transform(x["conditions"], lambda c: c["kind"]), "+"), F.lit(""))
    said = F.transform("exceptions", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), kinds(x)))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return out.select("id", joined(said).alias("exceptions"), joined(F.transform("responses", lambda x: x["id"].cast("string"))).alias("responses"))


@query(
    f"""WITH {_INCIDENTS}, l AS (SELECT "user", id, created_at, status, lag(status) OVER (PARTITION BY "user" ORDER BY id) AS old FROM i WHERE "user" IS NOT NULL)
    SELECT 'system' AS actor_id, 'incident.updated' AS action, 'incident' AS resource_type, "user" AS resource_id, '[{{"field":"status","old_value":"' || old || '","new_value":"' || status || '"}}]' AS changes, id AS created_at FROM l WHERE old <> status"""
)
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for every change."""
    changes = incidents.history(derived(spark, sf_dir).where("user IS NOT NULL").select("user", "id", "status"), "user", "id", ["status"])
    return lists.audit_rows(changes, "incident", F.lit("system"), "user", "id")


# ---- endpoints


@query(
    f"""WITH {_CELLS}, b AS (SELECT *, n_of - s_of AS b_of, conv_id % 3 = 0 AS typed FROM c),
    p AS (SELECT message_id, 'words' AS policy_name, n_the >= 2 AND n_token = 0 AS r1, b_of >= 1 AS r2, n_the + b_of + n_token AS n, s_the AS gone, conv_id % 5 = 0 AS spared FROM b),
    q AS (SELECT *, n - gone AS left_ FROM p)
    SELECT message_id, policy_name, CASE WHEN left_ >= 8 THEN 'critical' WHEN left_ >= 3 THEN 'high' ELSE 'low' END AS severity, concat_ws(',', CASE WHEN r1 THEN 'r1' END, CASE WHEN r2 THEN 'r2' END) AS matched_rules, CAST(left_ AS BIGINT) AS match_count
    FROM q WHERE (r1 OR r2) AND NOT spared AND left_ > 0
    UNION ALL SELECT message_id, 'types', 'medium', 'pdf', CAST(1 AS BIGINT) FROM b WHERE typed"""
)
def endpoint_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, every condition's matches, unconditional exceptions, file types."""
    W, C = E.Where, E.EndpointCondition
    matches = _conversation_matches(spark, sf_dir).where("analyzer_name IN ('the', 'of', 'token')")
    messages = conversation_messages(spark, sf_dir).select("message_id", F.when(F.col("message_id").cast("int") % 3 == 0, "PDF").otherwise("Text").alias("file_type"))
    rules = (("r1", (C(W("the"), least=2), C(W(label="w:token"), "not_matches"))), ("r2", (C(W("of", component="body"), "count_gte", 1),)))
    fifth = E.EndpointException("fifth", when=lambda: F.col("message_id").cast("int") % 5 == 0)
    first = E.EndpointException("first", entire=False, where=W("the", component="subject"))
    policies = [E.EndpointPolicy("words", rules, "low", ((3, "high"), (8, "critical")), (fifth, first)), E.EndpointPolicy("types", (("pdf", (C(W("file_type", "PDF"), of_file_type=True),)),))]
    out = E.evaluate_endpoint(messages, matches, policies)
    return out.withColumn("matched_rules", F.array_join("matched_rules", ","))


@query("""SELECT CAST(doc_id AS VARCHAR) AS message_id, len(regexp_extract_all(text, 'tion')) AS n FROM documents WHERE len(regexp_extract_all(text, 'tion')) > 0""")
def endpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files on an endpoint."""
    d = F.col("doc_id").cast("string")
    files = table(spark, sf_dir, "documents").select(d.alias("message_id"), F.concat(d, F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content_bytes"))
    _, found = E.inspect_endpoint(files, scan.regex_probes({"tion": "tion"}))
    return found.groupBy("message_id").agg(F.count("*").alias("n"))


_SOURCES = "e AS (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'C:\\dir\\f' ELSE '/home/f' END || event_id || '.txt' AS path FROM events)"


@query(
    f"""WITH {_SOURCES} SELECT CAST(event_id AS VARCHAR) AS message_id, 'upload' AS kind, 'browser_upload' AS channel, 'f' || event_id || '.txt' AS file_name, event_type || ' (PID ' || event_id || ')' AS "user", 'block' AS action_taken FROM e WHERE event_id % 4 = 0
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'clipboard', 'clipboard', 'clipboard', '', 'clipboard_block' FROM e WHERE event_id % 4 = 1
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'discover', 'discover', 'f' || event_id || '.txt', NULL, CASE WHEN event_id % 3 = 0 THEN 'quarantine' ELSE 'block' END FROM e WHERE event_id % 4 = 2
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'volume', CASE event_id % 3 WHEN 0 THEN 'usb' WHEN 1 THEN 'network_share' ELSE 'endpoint' END, 'f' || event_id || '.txt', NULL, 'block' FROM e WHERE event_id % 4 = 3"""
)
def endpoint_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of uploads, the clipboard, discover scans and volumes."""
    e = F.col("event_id")
    path = F.concat(F.when(e % 2 == 0, "C:\\dir\\f").otherwise("/home/f"), e.cast("string"), F.lit(".txt"))
    source = table(spark, sf_dir, "events").select(e.cast("string").alias("message_id"), path.alias("path"), F.col("event_type").alias("browser"), e.alias("pid"), F.lit("block").alias("action"), (e % 3 == 0).alias("quarantine"), _pick(e, "removable", "network", "fixed").alias("volume"), (e % 4).alias("k"))
    violations = source.select("message_id", F.lit("p").alias("policy_name"), F.lit("high").alias("severity"), F.lit(1).alias("match_count"))
    one = F.lit("x")
    matches = source.select("message_id", F.lit(0).alias("component_idx"), F.lit(0).alias("start_offset"), one.alias("analyzer_name"), one.alias("rule_name"), one.alias("matched_text"))
    parts = [incidents.endpoint_incidents(violations, matches, source.where(f"k = {k}").drop("k"), kind).select("message_id", F.lit(kind).alias("kind"), "channel", "file_name", "user", "action_taken") for k, kind in enumerate(("upload", "clipboard", "discover", "volume"))]
    return scan.all_matches(*parts)


@query(
    """SELECT doc_id AS id, CASE WHEN k IN (0, 1) AND n > 0 AND NOT late THEN 'block' WHEN k IN (0, 1) AND late THEN 'log' ELSE 'allow' END AS verdict, CASE WHEN k IN (0, 1) THEN '' ELSE 'No content provided' END AS message
    FROM (SELECT doc_id, CASE WHEN length(text) > 0 THEN doc_id % 3 ELSE 2 END AS k, doc_id % 7 = 0 AS late, len(regexp_extract_all(text, 'tion')) AS n FROM documents)"""
)
def ttd_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content, else an excerpt, else nothing."""
    d, raw = F.col("doc_id"), F.encode("text", "UTF-8")
    content, excerpt = F.when(d % 3 == 0, raw), F.when(d % 3 == 1, raw)
    n = F.regexp_count(incidents.ttd_content(content, excerpt), F.lit("tion"))
    out = table(spark, sf_dir, "documents").select(d.alias("id"), incidents.ttd_decision(content, excerpt, n, d % 7 == 0, F.lit(None).cast("string")).alias("v"))
    return out.select("id", "v.verdict", "v.message")


# ---- the SQL of all templates, made from the templates


def _condition_sql(c: dict) -> str:
    config, kind = c["config"], c["condition_type"]
    if kind == "data_identifier":
        i = BY_NAME[config["identifier_name"]]
        return " + ".join(f"len(list_filter(regexp_extract_all(text, {_quote(p)}), lambda m: coalesce({_CHECK_SQL[i.validator]}, false)))" for p in i.patterns)
    if kind == "keyword":
        doubled, flags = f"regexp_replace(text, '({_EDGE})', '\\1\\1', 'g')", "" if config["case_sensitive"] else "(?i)"
        return " + ".join(f"len(regexp_extract_all({doubled}, '{flags}(?:^|{_EDGE}){re.sub(r'(\W)', r'\1\1', w)}(?:{_EDGE}|$)'))" for w in config["keywords"])
    return " + ".join(f"len(regexp_extract_all(text, {_quote(p)}))" for p in config["patterns"]) if kind == "regex" else "0"


def _templates_sql() -> str:
    parts = []
    for name, t in TEMPLATES.items():
        rules = [[(f"({_condition_sql(c)})", c["config"].get("min_matches", 1)) for c in r["conditions"]] for r in t["rules"]]
        n = " + ".join("CASE WHEN " + " AND ".join(f"{x} >= {k}" for x, k in r) + " THEN " + " + ".join(x for x, _ in r) + " ELSE 0 END" for r in rules)
        parts.append(f"SELECT CAST(doc_id AS VARCHAR) AS message_id, '{name}' AS policy_name, '{t['severity']}' AS severity, CAST({n} AS BIGINT) AS match_count FROM documents")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE match_count > 0"


ORACLE_SQL["policy_templates"] = _templates_sql()
