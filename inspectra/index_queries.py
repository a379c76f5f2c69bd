"""Registered queries over indexes, archives, stored state and composed streams."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.operators import export, fingerprint, multiscan, reports, responses
from inspectra.operators.fingerprint_store import FingerprintStore
from inspectra.operators.lifecycle import cascade, fold_states
from inspectra.operators.paging import PagedList
from inspectra.operators.risk_store import RiskStore
from inspectra.operators.search_index import SearchIndex, global_search
from inspectra.plans.policy import Condition, Group, serialized, stored_rows
from inspectra.plans.trees import And, Leaf, Not, Or, TreePolicy, evaluate_trees
from inspectra.queries import _CELLS, _DOCS, _INCIDENTS, ORACLE_SQL, REFERENCE, _conversation_matches, _pattern_sql, conversation_messages, derived, documents, query, table
from inspectra.sources import archives
from inspectra.storage import kept, scratch
from inspectra.streaming import flows

#: 500 patterns made by a rule: two syllables of the invented prose and an ending.
_FIRST = "th he in er an re on at en nd ti es or te of ed is it al ar st nt to ha ou".split()
_SECOND = "er in re on at en nd es ea sh wh ou ti th ha st nt le or ly".split()
MANY_PATTERNS = {f"{a}-{b}": rf"\b{a}{b}(?:ing|tion|ble)(?:ed|s)?\b" for a in _FIRST for b in _SECOND}


@query(
    rf"""WITH p AS (SELECT a || '-' || b AS rule_name, '\b' || a || b || '(?:ing|tion|ble)(?:ed|s)?\b' AS p FROM (SELECT unnest({_FIRST}) AS a), (SELECT unnest({_SECOND}) AS b))
    SELECT CAST(doc_id AS VARCHAR) AS message_id, rule_name, unnest(regexp_extract_all(text, p)) AS matched_text FROM documents, p"""
)
def multi_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 patterns at once; only those whose literals a text holds are tried on it."""
    return multiscan.scan_many(documents(spark, sf_dir), MANY_PATTERNS).select("message_id", "rule_name", "matched_text")


def _packed(texts: pd.DataFrame) -> pd.DataFrame:
    """An archive of a few documents: some as they are, some in a compressed tar in it, the rest in an archive in an archive in it."""

    def zipped(members: list[tuple[str, bytes]]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members:
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED, 1)
        return out.getvalue()

    kinds: list[list[tuple[str, bytes]]] = [[], [], []]
    for i, t in sorted(zip(texts["doc_id"].tolist(), texts["text"].tolist())):
        kinds[i % 3].append((f"doc{i}.txt", (t or "").encode()))
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz", compresslevel=1) as t:
        for name, data in kinds[1]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    inner = [("more.tgz", tar.getvalue()), ("deep.zip", zipped([("deeper.zip", zipped(kinds[2]))]))]
    return pd.DataFrame({"path": [f"/in/a{texts['bundle'].iloc[0]}.zip"], "content": [zipped(kinds[0] + inner)]})


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id // 20 AS b FROM documents)
    SELECT '/in/a' || b || '.zip' AS root, 'a' || b || '.zip/' || ['', 'more.tgz/more.tar/', 'deep.zip/deeper.zip/'][doc_id % 3 + 1] || 'doc' || doc_id || '.txt' AS entry, strlen(text) AS n_bytes, sha256(text) AS sha FROM d"""
)
def archives_unfolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into nested archives of twenty each, and unfolded level by level."""
    bundles = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 20).cast("long").alias("bundle"))
    files = bundles.groupBy("bundle").applyInPandas(_packed, "path string, content binary")
    got = archives.unfold(files).where("error IS NULL")
    return got.select("root", "entry", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id // 20 AS b FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY b, doc_id % 3 ORDER BY doc_id) AS nth FROM d)
    SELECT '/in/a' || b || '.zip' AS root, count(*) AS n_files, sum(strlen(text)) AS n_bytes FROM n WHERE doc_id % 3 = 0 AND nth <= 3 GROUP BY b"""
)
def archives_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same archives what comes before the limit of three files."""
    bundles = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 20).cast("long").alias("bundle"))
    files = bundles.groupBy("bundle").applyInPandas(_packed, "path string, content binary")
    got = archives.unfold(files, archives.Limits(files=3)).where("error IS NULL")
    return got.groupBy("root").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).alias("n_bytes"))


def _requests(docs: DataFrame) -> DataFrame:
    """Documents as uploads to seven hosts, two in three by POST."""
    i = F.col("doc_id")
    method = F.element_at(F.array(F.lit("POST"), F.lit("GET"), F.lit("put")), (i % 3 + 1).cast("int"))
    return docs.select(i.alias("request_id"), method.alias("method"), F.concat(F.lit("https://h"), (i % 7).cast("string"), F.lit(".example.com/up")).alias("url"), F.lit("gateway").alias("client_ip"), F.lit("text/plain").alias("content_type"), F.col("text").cast("binary").alias("body"))


@query(
    f"""WITH {_DOCS}, h AS ({_pattern_sql('d', True)}), n AS (SELECT CAST(key AS BIGINT) AS doc_id, count(*) AS n FROM h GROUP BY key)
    SELECT CAST(doc_id AS VARCHAR) AS message_id, 'https://h' || doc_id % 7 || '.example.com/up' AS url, n AS match_count, least(n, 10) AS n_shown, CASE WHEN n >= 2 THEN 'block' ELSE 'allow' END AS action_taken
    FROM n WHERE doc_id % 3 <> 1 AND doc_id % 7 <> 3"""
)
def monitored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of uploads through the whole flow into a sink that takes each batch once."""
    schema = table(spark, sf_dir, "documents").schema
    # as a pattern, since a stream takes a folder or a pattern, and the table may be one file
    stream = _requests(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parque[t]"))
    sink = scratch(spark, "incidents")
    flows.start_monitor(stream, lambda rows: flows.http_flow(rows, ["h3.example.com"], block_at=2, prevent=True), sink, scratch(spark, "offsets"), once=True).awaitTermination()
    got = flows.read_sink(spark, sink)
    return got.select("message_id", got["about"]["url"].alias("url"), "match_count", F.size(F.from_json("matches", "array<struct<rule_name:string>>")).cast("long").alias("n_shown"), "action_taken")


def _fnv_sql(h: str, c: str) -> str:
    """The hash h after the UTF-8 bytes of the code point c (below 65,536)."""
    step = lambda x, byte: f"((xor({x}, CAST({byte} AS UHUGEINT)) * {fingerprint.FNV_PRIME}) % 18446744073709551616)"
    two = step(step(h, f"(192 + ({c} >> 6))"), f"(128 + ({c} & 63))")
    three = step(step(step(h, f"(224 + ({c} >> 12))"), f"(128 + (({c} >> 6) & 63))"), f"(128 + ({c} & 63))")
    return f"(CASE WHEN {c} < 128 THEN {step(h, c)} WHEN {c} < 2048 THEN {two} ELSE {three} END)"


def simhash_sql(source: str) -> str:
    """CTEs that end in f (id, b: one array of 64 bits) for the texts of `source` (id, text) that are long enough for a fingerprint."""
    steps, h = [], f"CAST({fingerprint.FNV_START} AS UHUGEINT)"
    for k in range(4):
        steps.append(f"h{k} AS (SELECT id, c1, c2, c3, c4, {_fnv_sql('h' if k else h, f'c{k + 1}')} AS h FROM {f'h{k - 1}' if k else 's'})")
    return rf"""t AS (SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS t FROM {source}),
    u AS (SELECT id, list_transform(string_split(t, ''), lambda x: ord(x)) AS c FROM t WHERE length(t) >= {fingerprint.LEAST_CHARS}),
    p AS (SELECT id, c, unnest(range(1, len(c) - 2)) AS i FROM u),
    s AS (SELECT id, c[i] AS c1, c[i + 1] AS c2, c[i + 2] AS c3, c[i + 3] AS c4 FROM p),
    {', '.join(steps)},
    w AS (SELECT id, CAST(h % 4294967296 AS BIGINT) AS lo, CAST(h // 4294967296 AS BIGINT) AS hi FROM h3),
    f AS (SELECT id, [{', '.join(f'CAST(2 * sum(({"lo" if b < 32 else "hi"} >> {b % 32}) & 1) > count(*) AS INT)' for b in range(64))}] AS b FROM w GROUP BY id)"""


def _near_sql(left: str, right: str, threshold: float) -> str:
    differing = "len(list_filter(range(1, 65), lambda k: x.b[k] <> y.b[k]))"
    return f"SELECT * FROM (SELECT x.id AS left_id, y.id AS right_id, 1 - {differing} / 64.0 AS score FROM {left} x, {right} y) WHERE score >= {threshold}"


@query(f"WITH {simhash_sql('(SELECT doc_id AS id, text FROM documents)')}, q AS (SELECT * FROM f WHERE id % 5 = 0), k AS (SELECT * FROM f WHERE id % 5 > 0) SELECT left_id AS seen_id, right_id AS fingerprint_id, CAST(score AS DOUBLE) AS score FROM ({_near_sql('q', 'k', 0.9)})")
def fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of all documents, added in two batches, a fifth deleted, and searched by that fifth."""
    docs = kept(fingerprint.build_index(table(spark, sf_dir, "documents"), "doc_id", "text"), "fingerprints")
    store = FingerprintStore(spark, scratch(spark, "fingerprint-index"), 0.9, shards=4)
    for k in range(2):
        store.add(docs.where(F.col("fingerprint_id") % 2 == k), k)
    seen = docs.where(F.col("fingerprint_id") % 5 == 0)
    store.remove(seen.select("fingerprint_id"))
    return store.search(seen)


ORACLE_SQL["fingerprint_near"] = (
    f"WITH {simhash_sql('(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)')}, q AS (SELECT * FROM f WHERE id >= 0), k AS (SELECT * FROM f WHERE id < 0) "
    f"SELECT left_id, -1 - right_id AS right_id, CAST(score AS DOUBLE) AS score FROM ({_near_sql('q', 'k', fingerprint.THRESHOLD)})"
)


_SEARCHED = "policy_name ILIKE '%{0}%' OR file_name ILIKE '%{0}%' OR \"user\" ILIKE '%{0}%'"


def _incident_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    index = SearchIndex(spark, scratch(spark, "incident-search"), "id", ("policy_name", "file_name", "user"))
    index.add(derived(spark, sf_dir), 0)
    return index


@query(
    f"""WITH {_INCIDENTS}, a AS (SELECT 'incident' AS kind, CAST(id AS VARCHAR) AS id, policy_name AS title, file_name AS subtitle FROM i WHERE {_SEARCHED.format('er%012')} ORDER BY i.id LIMIT 10),
    b AS (SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_mktsegment AS subtitle FROM customer WHERE c_name ILIKE '%er%012%' OR c_mktsegment ILIKE '%er%012%' ORDER BY c_custkey LIMIT 10)
    SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 by trigram indexes: at most ten hits of each kind, which is the feature."""
    customers = SearchIndex(spark, scratch(spark, "customer-search"), "c_custkey", ("c_name", "c_mktsegment"))
    customers.add(table(spark, sf_dir, "customer"), 0)
    return global_search({"incident": _incident_index(spark, sf_dir), "customer": customers}, "er%012")


@query(f"WITH {_INCIDENTS} SELECT id, policy_name, file_name, \"user\" FROM i WHERE {_SEARCHED.format('er1_')}")
def find_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 by the trigram index: all incidents of which a name holds the words."""
    return _incident_index(spark, sf_dir).find("er1_")


@query(f"WITH {_INCIDENTS}, n AS (SELECT count(*) // 20 AS pages FROM i), r AS (SELECT id, match_count, created_at, row_number() OVER (ORDER BY match_count DESC, id) - 1 AS nth FROM i) SELECT id, match_count, created_at FROM r, n WHERE nth >= (pages - 3) * 20 AND nth < (pages - 1) * 20")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page near the end of all incidents by match count, and the page after it by its last row."""
    pages = PagedList(spark, scratch(spark, "incident-list"), "match_count", "id")
    pages.write(derived(spark, sf_dir), 64)
    one = pages.page(pages.total() // 20 - 2)
    return one.unionByName(pages.after(one.tail(1)[0])).select("id", "match_count", "created_at")


@query(ORACLE_SQL["risk_scores"])
def risk_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6-A8 from increments of three batches, two of which are merged, for the reference day of the full computation."""
    store, rows = RiskStore(spark, scratch(spark, "risk")), derived(spark, sf_dir)
    for k in range(3):
        store.add(rows.where(F.col("id") % 3 == k), k)
    store.compact([0, 1], 3)
    return store.scores(REFERENCE)


@query(
    """WITH RECURSIVE n AS (SELECT event_id AS id, CASE WHEN event_id >= 3 THEN event_id // 3 END AS parent_id FROM events),
    d AS (SELECT id FROM n WHERE id % 97 = 5 UNION SELECT n.id FROM n JOIN d ON n.parent_id = d.id)
    SELECT n.id, n.parent_id, d.id IS NOT NULL AS deleted FROM n LEFT JOIN d ON n.id = d.id"""
)
def cascade_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: a tree of all events, of which some nodes are deleted with all below them."""
    e = F.col("event_id")
    nodes = table(spark, sf_dir, "events").select(e.alias("id"), F.when(e >= 3, F.floor(e / 3)).cast("bigint").alias("parent_id"))
    return cascade(nodes, nodes.where("id % 97 = 5").select("id"))


_SCAN_EVENTS = {"view": "trigger", "purchase": "trigger", "click": "complete", "error": "fail", "signup": "cancel"}


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SCAN_EVENTS.items())} END AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, '' AS event, '' AS before, 'pending' AS after FROM e
        UNION ALL SELECT e.user_id, e.event_id, e.n, e.event, r.after, CASE WHEN e.event = 'trigger' AND r.after <> 'running' THEN 'running' WHEN e.event = 'complete' AND r.after = 'running' THEN 'completed' WHEN e.event = 'fail' AND r.after = 'running' THEN 'failed'
            WHEN e.event = 'cancel' AND r.after IN ('pending', 'running') THEN 'cancelled' ELSE r.after END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, event_id, event, before, after, before <> after AS allowed FROM r WHERE n > 0"""
)
def scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: every user's events as the log of a scan, folded by the table of transitions; those that its state forbids are reported."""
    event = F.col("event_type")
    meaning = F.lit(None).cast("string")
    for name, means in _SCAN_EVENTS.items():
        meaning = F.when(event == name, means).otherwise(meaning)
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", meaning.alias("event"))
    return fold_states(log, "user_id", ["ts", "event_id"], "event").drop("ts")


_THE, _OF, _TOKEN = Leaf(Condition("the")), Leaf(Condition("of")), Leaf(Condition("token"))
_OFTEN, _TWICE, _SUBJECT = Leaf(Condition("the", "count_gte", 3)), Leaf(Condition("of", "count_gte", 2)), Leaf(Condition("of", components=("subject",)))
_TREES = [
    TreePolicy("sent", And((_THE, Or((_TWICE, Not(_TOKEN))), Leaf(Group(("Example.com",), mode="domain")))), tiers=((5, "high"),), ejected=((_SUBJECT, ("subject",)),)),
    TreePolicy("either", Or((And((_OFTEN, Not(_OF))), And((_TOKEN, Not(Leaf(Group(("u1@example.com",), "sender"))))))), "low", spared=And((_SUBJECT, Not(_OFTEN)))),
    TreePolicy("people", Not(Or((_THE, Leaf(Group(("u2@example.com",), "sender"))))), "info"),
]


@query(
    f"""WITH {_CELLS},
    p AS (SELECT *, n_the - CASE WHEN s_of > 0 THEN s_the ELSE 0 END + CASE WHEN n_of >= 2 THEN n_of - CASE WHEN s_of > 0 THEN s_of ELSE 0 END ELSE 0 END AS n1, CASE WHEN n_the >= 3 THEN n_the ELSE 0 END + n_token AS n2 FROM c)
    SELECT message_id, 'sent' AS policy_name, CASE WHEN n1 >= 5 THEN 'high' ELSE 'medium' END AS severity, CAST(n1 AS BIGINT) AS match_count FROM p WHERE n_the > 0 AND (n_of >= 2 OR n_token = 0) AND conv_id % 3 = 0 AND n1 > 0
    UNION ALL SELECT message_id, 'either', 'low', CAST(n2 AS BIGINT) FROM p WHERE ((n_the >= 3 AND n_of = 0) OR (n_token > 0 AND conv_id % 4 <> 1)) AND NOT (s_of > 0 AND n_the < 3) AND n2 > 0
    UNION ALL SELECT message_id, 'people', 'info', 0 FROM p WHERE n_the = 0 AND conv_id % 4 <> 2"""
)
def policy_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees over detections and groups, compiled together."""
    return evaluate_trees(conversation_messages(spark, sf_dir), _conversation_matches(spark, sf_dir), _TREES).drop("triggered")


_COMMAND_SQL = """SELECT event_id AS command_id, event_id // 4 AS incident_id, ts AS made_at, ['add_note', 'set_status', 'send_email', 'escalate', 'erase'][event_id % 5 + 1] AS action, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type || ' ' END AS content,
    ['new', 'resolved', 'odd', 'dismissed'][event_id % 4 + 1] AS status, CASE WHEN event_id % 3 > 0 THEN 'u' || user_id || '@example.com' END AS recipient, CASE WHEN event_id % 2 = 0 THEN event_type END AS reason FROM events"""


@query(
    f"""WITH {_INCIDENTS}, c AS ({_COMMAND_SQL}),
    d AS (SELECT c.*, i.status AS first, i.id IS NOT NULL AS there FROM c LEFT JOIN (SELECT * FROM i WHERE id % 13 > 0) i ON c.incident_id = i.id),
    f AS (SELECT *, CASE WHEN action = 'erase' THEN 'Unknown action ''erase''. Valid actions: add_note, escalate, send_email, set_status' WHEN NOT there THEN 'Incident not found' WHEN action = 'add_note' AND trim(content) = '' THEN 'Note content is required (params.content)'
        WHEN action = 'set_status' AND status = 'odd' THEN 'Invalid status ''odd''. Valid: dismissed, escalated, in_progress, new, resolved' WHEN action = 'send_email' AND recipient IS NULL THEN 'Recipient email is required (params.recipient)' END AS fails FROM d),
    n AS (SELECT *, CASE WHEN fails IS NULL AND action = 'set_status' THEN status WHEN fails IS NULL AND action = 'escalate' THEN 'escalated' END AS new_status FROM f),
    o AS (SELECT *, coalesce(last_value(new_status IGNORE NULLS) OVER (PARTITION BY incident_id ORDER BY made_at, command_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first) AS old FROM n)
    SELECT command_id, fails IS NULL AS success, coalesce(fails, CASE action WHEN 'add_note' THEN 'Note added: ' || trim(content) WHEN 'set_status' THEN 'Status changed from ' || old || ' to ' || new_status WHEN 'send_email' THEN 'Email notification queued for ' || recipient
        ELSE 'Incident escalated: ' || coalesce(reason, 'Escalated via smart response') END) AS detail FROM o"""
)
def smart_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a command on an incident, checked and folded."""
    e = F.col("event_id")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    commands = table(spark, sf_dir, "events").select(
        e.alias("command_id"), F.floor(e / 4).cast("bigint").alias("incident_id"), F.col("ts").alias("at"), pick(e, "add_note", "set_status", "send_email", "escalate", "erase").alias("action"),
        F.when(e % 7 == 0, "  ").otherwise(F.concat("event_type", F.lit(" "))).alias("content"), pick(e, "new", "resolved", "odd", "dismissed").alias("status"),
        F.when(e % 3 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com"))).alias("recipient"), F.lit(None).cast("string").alias("subject"), F.when(e % 2 == 0, F.col("event_type")).alias("reason"),
    )
    return responses.outcomes(commands, derived(spark, sf_dir).where("id % 13 > 0")).select("command_id", "success", "detail")


@query(f"WITH {_INCIDENTS} SELECT id, severity, \"user\", match_count, created_at FROM i WHERE created_at >= TIMESTAMP '{REFERENCE}' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '{REFERENCE}'")
def report_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty days, newest first, of incidents that were written as JSON lines and read back."""
    path = scratch(spark, "incident-log")
    export.write_jsonl(derived(spark, sf_dir), path)
    rows = export.read_jsonl(spark, path, "id long, severity string, user string, match_count int, created_at timestamp_ntz")
    return reports.details(rows, REFERENCE)


@query(
    """WITH c AS (SELECT o_custkey AS rule_id, list({condition_type: o_orderstatus, component: 'body', config_json: '{"n":' || o_orderkey || '}'} ORDER BY o_orderstatus, '{"n":' || o_orderkey || '}') AS conditions FROM orders GROUP BY 1),
    r AS (SELECT c_nationkey AS policy_id, list({rule_id: CAST(c_custkey AS VARCHAR), name: c_name, conditions: coalesce(conditions, [])} ORDER BY c_custkey) AS rules FROM customer LEFT JOIN c ON c_custkey = rule_id GROUP BY 1)
    SELECT CAST(n_nationkey AS VARCHAR) AS policy_id, CAST(to_json({policy_id: CAST(n_nationkey AS VARCHAR), name: n_name, description: '', severity: ['high', 'medium', 'low'][n_nationkey % 3 + 1], status: 'active', detection_rules: coalesce(rules, [])}) AS VARCHAR) AS definition
    FROM nation LEFT JOIN r ON n_nationkey = policy_id WHERE n_nationkey % 4 > 0"""
)
def policies_serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies in force with their rules and conditions as JSON text; an unknown severity is medium."""
    n = F.col("n_nationkey")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    policies = table(spark, sf_dir, "nation").select(n.alias("id"), F.col("n_name").alias("name"), F.when(n % 4 > 0, "active").otherwise("draft").alias("status"), pick("high", "odd", "low").alias("severity"), F.lit(False).alias("is_template"), F.lit(1).alias("version"))
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("policy_id"), F.col("c_name").alias("name"))
    config = F.concat(F.lit('{"n":'), F.col("o_orderkey").cast("string"), F.lit("}"))
    conditions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rule_id"), F.col("o_orderstatus").alias("condition_type"), F.lit("body").alias("component"), config.alias("config"))
    return serialized(stored_rows(policies, rules, conditions))


@query("SELECT 'incidents' AS table_name, count(*) AS row_count FROM events UNION ALL SELECT 'incidents_archive', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00' UNION ALL SELECT 'documents', count(*) FROM documents")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table."""
    rows = derived(spark, sf_dir)
    return reports.table_stats({"incidents": rows, "incidents_archive": rows.where("created_at < TIMESTAMP_NTZ '2024-01-16 00:00:00'"), "documents": table(spark, sf_dir, "documents")})
