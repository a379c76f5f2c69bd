"""Registered queries over the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.functions import normalize
from inspectra.functions.validators import VALIDATORS
from inspectra.operators import export, filetype, fingerprint, incidents, reports, scan
from inspectra.plans import policy as P
from inspectra.plans.catalog import IDENTIFIERS, TEMPLATES
from inspectra.schema import SEVERITIES
from inspectra.sources import files, messages
from inspectra.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL if there is any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of one body."""
    return messages.text_messages(table(spark, sf_dir, "documents"), "doc_id", "text")


def conversation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.conversations(table(spark, sf_dir, "conversations"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sender and two recipients for each conversation, by rule."""
    c = F.col("conv_id")
    address = lambda n, host: F.concat(F.lit("u"), n.cast("string"), F.lit(f"@{host}"))
    to = F.array(address(c % 7, "partner.example.org"), F.when(c % 3 == 0, address(c % 5, "mail.example.com")).otherwise(address(c % 5, "example.net")))
    return table(spark, sf_dir, "conversations").select(c).distinct().select(c.cast("string").alias("message_id"), address(c % 4, "example.com").alias("sender"), to.alias("recipients"))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.derived_incidents(table(spark, sf_dir, "events"))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- scans

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
#: Validators in SQL, over the matched text m.
_CHECK_SQL = {
    "luhn": "length(regexp_replace(m, '[\\s-]', '', 'g')) >= 13 AND list_sum(list_transform(range(length(m)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse(m), i + 1, 1) AS INT) ELSE (2 * CAST(substr(reverse(m), i + 1, 1) AS INT)) // 10 + (2 * CAST(substr(reverse(m), i + 1, 1) AS INT)) % 10 END)) % 10 = 0",
    "ssn_area": f"CAST(substr({_DIGITS}, 1, 3) AS INT) NOT IN (0, 666) AND CAST(substr({_DIGITS}, 1, 3) AS INT) < 900 AND substr({_DIGITS}, 4, 2) <> '00' AND substr({_DIGITS}, 6, 4) <> '0000'",
    "phone_format": f"CAST(substr({_DIGITS}, 1, 3) AS INT) >= 200 AND CAST(substr({_DIGITS}, 4, 3) AS INT) >= 200",
    "email_domain": "len(string_split(split_part(m, '@', 2), '.')) >= 2 AND length(string_split(split_part(m, '@', 2), '.')[-1]) BETWEEN 2 AND 63",
    "iban_mod97": "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 AS BIGINT))), lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97) = 1",
    "ipv4_range": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS INT) > 255)) = 0 AND len(list_filter(string_split(m, '.'), lambda p: CAST(p AS INT) <> 0)) > 0 AND len(list_filter(string_split(m, '.'), lambda p: CAST(p AS INT) <> 255)) > 0",
    "date_calendar": "year(coalesce(try_strptime(m, '%m/%d/%Y'), try_strptime(m, '%Y-%m-%d'), try_strptime(m, '%m-%d-%Y'))) BETWEEN 1900 AND 2100",
    "aba_checksum": "(3 * CAST(m[1] AS INT) + 7 * CAST(m[2] AS INT) + CAST(m[3] AS INT) + 3 * CAST(m[4] AS INT) + 7 * CAST(m[5] AS INT) + CAST(m[6] AS INT) + 3 * CAST(m[7] AS INT) + 7 * CAST(m[8] AS INT) + CAST(m[9] AS INT)) % 10 = 0",
}


def _pattern_sql(source: str, checked: bool) -> str:
    """(key, rule_name, m) of all identifiers' matches in `source` (key, text)."""
    parts = []
    for i in IDENTIFIERS:
        for p in i.patterns:
            hit = f"SELECT key, {_quote(i.name)} AS rule_name, unnest(regexp_extract_all(text, {_quote(p)})) AS m FROM {source}"
            parts.append(f"SELECT * FROM ({hit}) WHERE {_CHECK_SQL[i.validator]}" if checked else hit)
    return " UNION ALL ".join(parts)


_DOCS = "d AS (SELECT CAST(doc_id AS VARCHAR) AS key, text FROM documents)"


@query(f"WITH {_DOCS} SELECT key AS message_id, rule_name, m AS matched_text FROM ({_pattern_sql('d', False)})")
def scan_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the identifiers' patterns match, before any check."""
    probes = [scan.Probe("regex", p.rule, p.pattern, needs=p.needs) for p in scan.identifier_probes()]
    return scan.run_probes(documents(spark, sf_dir), probes).select("message_id", "rule_name", "matched_text")


@query(f"WITH {_DOCS} SELECT key AS message_id, rule_name, m AS matched_text FROM ({_pattern_sql('d', True)})")
def scan_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked identifiers of all documents, in one pass."""
    return scan.scan_identifiers(documents(spark, sf_dir)).select("message_id", "rule_name", "matched_text")


@query(f"WITH {_DOCS}, h AS ({_pattern_sql('d', True)}) SELECT rule_name, count(*) AS n_matches, count(DISTINCT key) AS n_messages FROM h GROUP BY rule_name")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return scan.match_counts(scan.scan_identifiers(documents(spark, sf_dir)), "rule_name")


@query(f"WITH {_DOCS}, h AS ({_pattern_sql('d', True)}) SELECT source, lang, rule_name, count(*) AS n FROM h JOIN documents x ON h.key = CAST(x.doc_id AS VARCHAR) GROUP BY ALL")
def match_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = messages.explode_parts(docs, F.col("doc_id"), F.array(messages.part("body", F.col("text"))), F.col("source"), F.col("lang"))

    def named(p: scan.Probe):  # noqa: ANN202
        return F.transform(F.filter(scan.spans(F.col("content"), p.pattern, p.needs(F.col("content"))), lambda s: p.check(s["text"])), lambda s: F.lit(p.rule))

    hits = F.concat(*map(named, scan.identifier_probes()))
    return parts.select("source", "lang", F.explode(hits).alias("rule_name")).groupBy("source", "lang", "rule_name").agg(F.count("*").alias("n"))


WORDS = ("the", "Est", "token", "password", "are being", "von")
_EDGE = "[^\\p{L}\\p{N}_]"


def _keyword_sql(words: tuple[str, ...], flags: str) -> str:
    # no look-around in RE2: runs of word characters (and of what stands between them) are compared as tokens
    parts = [f"SELECT CAST(doc_id AS VARCHAR) AS message_id, {_quote(w)} AS word, len(regexp_extract_all(regexp_replace(text, '({_EDGE})', '\\1\\1', 'g'), '{flags}(?:^|{_EDGE}){w.replace(' ', '  ')}(?:{_EDGE}|$)')) AS n FROM documents" for w in words]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


def _keywords(spark: SparkSession, sf_dir: str, case_sensitive: bool) -> DataFrame:
    found = scan.scan_keywords(documents(spark, sf_dir), "w", WORDS, case_sensitive)
    return found.groupBy("message_id", F.substring_index("rule_name", ":", -1).alias("word")).agg(F.count("*").alias("n"))


@query(_keyword_sql(WORDS, "(?i)"))
def keywords_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words, whatever their case."""
    return _keywords(spark, sf_dir, False)


@query(_keyword_sql(WORDS, ""))
def keywords_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keywords(spark, sf_dir, True)


@query(
    """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS message_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
    p AS (SELECT message_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM t),
    a AS (SELECT * FROM p WHERE x = 'the'), b AS (SELECT * FROM p WHERE x = 'of')
    SELECT a.message_id, count(*) AS n_pairs FROM a JOIN b ON a.message_id = b.message_id AND abs(a.i - b.i) - 1 <= 3 GROUP BY a.message_id"""
)
def proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two words with at most three tokens between them."""
    found = scan.scan_proximity(documents(spark, sf_dir), "the~of", "the", "of", 3)
    return found.groupBy("message_id").agg(F.count("*").alias("n_pairs"))


_SYLLABLES = ("tion", "ing", "ent", "ver", "und", "que", "con", "les", "der", "ich", "per", "pro", "str", "ght", "sch", "ung", "ado", "ria", "ment", "ous")


@query("SELECT message_id, rule_name, n FROM (" + " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) AS message_id, 'd:{w}' AS rule_name, len(regexp_extract_all(lower(text), '{w}')) AS n FROM documents" for w in _SYLLABLES) + ") WHERE n > 0")
def keywords_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary as one automaton."""
    found = scan.scan_large_dictionary(documents(spark, sf_dir), "d", _SYLLABLES, False, False)
    return found.groupBy("message_id", "rule_name").agg(F.count("*").cast("int").alias("n"))


_MATRIX = [
    ("luhn", "4532015112830366", True), ("luhn", "4532015112830367", False), ("luhn", "4111-1111 1111 1111", True), ("luhn", "411111111111", False), ("luhn", "", False), ("luhn", "4111x11111111111", False),
    ("ssn_area", "123-45-6789", True), ("ssn_area", "666-45-6789", False), ("ssn_area", "900-45-6789", False), ("ssn_area", "000-45-6789", False), ("ssn_area", "123-00-6789", False), ("ssn_area", "123-45-0000", False), ("ssn_area", "12-45", False),
    ("phone_format", "(212) 555-0123", True), ("phone_format", "1-212-555-0123", True), ("phone_format", "123-456-7890", False), ("phone_format", "212-155-0123", False), ("phone_format", "2125550", False),
    ("email_domain", "a@example.com", True), ("email_domain", "a@b@example.org", True), ("email_domain", "@example.com", False), ("email_domain", "a@example", False), ("email_domain", "a@example.c", False), ("email_domain", "none", False),
    ("iban_mod97", "GB82WEST12345698765432", True), ("iban_mod97", "GB82 WEST 1234 5698 7654 32", True), ("iban_mod97", "GB82WEST12345698765433", False), ("iban_mod97", "DE89370400440532013000", True), ("iban_mod97", "XX", False),
    ("passport_format", "A12345678", True), ("passport_format", "12345678", True), ("passport_format", "AB1234567", False), ("passport_format", "1234567", False), ("passport_format", "", False),
    ("drivers_license_format", "D1234567", True), ("drivers_license_format", "0000000", False), ("drivers_license_format", "  ", False), ("drivers_license_format", "ABC", True), ("drivers_license_format", "A0", False),
    ("ipv4_range", "192.168.001.1", True), ("ipv4_range", "256.1.1.1", False), ("ipv4_range", "0.0.0.0", False), ("ipv4_range", "255.255.255.255", False), ("ipv4_range", "1.2.3", False),
    ("date_calendar", "02/29/2024", True), ("date_calendar", "02/29/2023", False), ("date_calendar", "2024-12-31", True), ("date_calendar", "12-31-1999", True), ("date_calendar", "12/31/1899", False), ("date_calendar", "nothing", False),
    ("aba_checksum", "021000021", True), ("aba_checksum", "021000022", False), ("aba_checksum", "02100002", False), ("aba_checksum", "", False), ("aba_checksum", "011401533", True),
]


#: Inputs made from event_id (e), as both SQL dialects have them but for the name of the text type (T).
_MADE = {
    "luhn": "lpad(CAST(4000000000000000 + e * 999983 AS T), 16, '0')",
    "ssn_area": "lpad(CAST(e * 37 % 1000 AS T), 3, '0') || '-' || lpad(CAST(e % 100 AS T), 2, '0') || '-' || lpad(CAST(e * 13 % 10000 AS T), 4, '0')",
    "phone_format": "lpad(CAST(e * 7 % 1000 AS T), 3, '0') || lpad(CAST(e * 11 % 1000 AS T), 3, '0') || lpad(CAST(e % 10000 AS T), 4, '0')",
    "email_domain": "'u' || CAST(e AS T) || '@' || CASE e % 4 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example' WHEN 2 THEN 'example.c' ELSE 'mail.example.org' END",
    "iban_mod97": "'GB' || lpad(CAST(e % 100 AS T), 2, '0') || 'WEST' || lpad(CAST(e * 104729 AS T), 14, '0')",
    "passport_format": "CASE e % 3 WHEN 0 THEN 'A' WHEN 1 THEN '' ELSE 'AB' END || lpad(CAST(e AS T), 8, '0')",
    "drivers_license_format": "CASE e % 3 WHEN 0 THEN 'D' || lpad(CAST(e AS T), 7, '0') WHEN 1 THEN lpad(CAST(e % 2 AS T), 7, '0') ELSE 'A' END",
    "ipv4_range": "CAST(e % 300 AS T) || '.' || CAST(e * 3 % 260 AS T) || '.' || CAST(e % 7 AS T) || '.' || CAST(e % 256 AS T)",
    "date_calendar": "lpad(CAST(e % 14 AS T), 2, '0') || '/' || lpad(CAST(e % 33 AS T), 2, '0') || '/' || CAST(1890 + e % 230 AS T)",
    "aba_checksum": "lpad(CAST(e * 1000003 % 1000000000 AS T), 9, '0')",
}
_MORE_CHECK_SQL = _CHECK_SQL | {"passport_format": "regexp_matches(trim(m), '^[A-Za-z]?[0-9]{8,9}$')", "drivers_license_format": f"trim(m) <> '' AND ({_DIGITS} = '' OR regexp_matches({_DIGITS}, '[1-9]'))"}


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"({_quote(v)}, {_quote(x)}, {str(ok).lower()})" for v, x, ok in _MATRIX) + ") AS t(validator, input, valid)"
    + "".join(f" UNION ALL SELECT '{v}', m, coalesce({_MORE_CHECK_SQL[v]}, false) FROM (SELECT {made.replace(' AS T)', ' AS VARCHAR)')} AS m FROM (SELECT event_id AS e FROM events))" for v, made in _MADE.items())
)
def validators_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V10 on given inputs, and on one of each kind made from every event."""
    given = spark.createDataFrame([(v, x) for v, x, _ in _MATRIX], "validator string, input string")
    made = F.explode(F.array(*(F.struct(F.lit(v).alias("validator"), F.expr(x.replace(" AS T)", " AS STRING)")).alias("input")) for v, x in _MADE.items())))
    rows = given.unionByName(table(spark, sf_dir, "events").select(F.col("event_id").alias("e")).select(made.alias("r")).select("r.*"))
    checks = F.coalesce(*[F.when(F.col("validator") == n, f(F.col("input"))) for n, f in VALIDATORS.items()])
    return rows.select("validator", "input", checks.alias("valid"))


# ---- policies over conversations: words and identifiers are analyzers

_ANALYZERS = {"the": "the", "of": "of", "token": "token"}


def _conversation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = [p for a, w in _ANALYZERS.items() for p in scan.keyword_probes("w", [w], analyzer=a)]
    return scan.run_probes(conversation_parts(spark, sf_dir), probes + scan.identifier_probes())


def _counted(word: str, where: str = "true") -> str:
    return f"coalesce(sum(len(regexp_extract_all(regexp_replace(text, '({_EDGE})', '\\1\\1', 'g'), '(?i)(?:^|{_EDGE}){word}(?:{_EDGE}|$)'))) FILTER ({where}), 0)"


_CELLS = f"""c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS message_id, {_counted('the')} AS n_the, {_counted('of')} AS n_of, {_counted('token')} AS n_token,
    {_counted('the', "role = 'system'")} AS s_the, {_counted('of', "role = 'system'")} AS s_of, {_counted('the', "role <> 'system'")} AS b_the FROM conversations GROUP BY conv_id)"""


def _decided(spark: SparkSession, sf_dir: str, *policies: P.Policy) -> DataFrame:
    out = P.evaluate(conversation_messages(spark, sf_dir), _conversation_matches(spark, sf_dir), list(policies))
    return out.select("message_id", "policy_name", "severity", F.array_join("matched_rules", ",").alias("matched_rules"), "match_count", F.array_join("exceptions_applied", ",").alias("exceptions"))


def _one(name: str, *conditions: P.Condition) -> tuple[P.Rule, ...]:
    return (P.Rule(name, conditions),)


@query(f"WITH {_CELLS} SELECT message_id, 'and' AS policy_name, 'medium' AS severity, 'r' AS matched_rules, CAST(n_the + n_of AS BIGINT) AS match_count, '' AS exceptions FROM c WHERE n_the > 0 AND n_of >= 2")
def policy_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conditions of a rule."""
    return _decided(spark, sf_dir, P.Policy("and", _one("r", P.Condition("the"), P.Condition("of", "count_gte", 2))))


@query(
    f"""WITH {_CELLS}, r AS (SELECT *, n_the >= 3 AS r1, n_of > 0 AND n_token <= 1 AS r2 FROM c),
    m AS (SELECT *, (CASE WHEN r1 OR false THEN n_the ELSE 0 END) + (CASE WHEN r2 THEN n_of + n_token ELSE 0 END) AS n FROM r WHERE r1 OR r2)
    SELECT message_id, 'or' AS policy_name, CASE WHEN n >= 10 THEN 'critical' WHEN n >= 5 THEN 'high' ELSE 'low' END AS severity,
    concat_ws(',', CASE WHEN r1 THEN 'r1' END, CASE WHEN r2 THEN 'r2' END) AS matched_rules, CAST(n AS BIGINT) AS match_count, '' AS exceptions FROM m WHERE n > 0"""
)
def policy_or_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any rule, matches of the true ones, severity by their number."""
    rules = (P.Rule("r1", (P.Condition("the", "count_gte", 3),)), P.Rule("r2", (P.Condition("of"), P.Condition("token", "count_lte", 1))))
    return _decided(spark, sf_dir, P.Policy("or", rules, "low", ((5, "high"), (10, "critical"))))


@query(f"WITH {_CELLS} SELECT message_id, 'not' AS policy_name, 'medium' AS severity, 'r' AS matched_rules, CAST(n_the AS BIGINT) AS match_count, '' AS exceptions FROM c WHERE n_the > 0 AND n_token = 0 AND s_of = 0")
def policy_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = (P.Condition("the"), P.Condition("token", "not_matches"), P.Condition("token", "count_lte", 0, ("subject",)))
    out = P.Policy("not", _one("r", *conditions), exceptions=(P.Exception_("system", when=lambda: P._count(F.col("cells"), lambda c: (c["analyzer"] == "of") & (c["component"] == "subject")) > 0),))
    return _decided(spark, sf_dir, out)


@query(f"WITH {_CELLS} SELECT message_id, 'groups' AS policy_name, 'medium' AS severity, 'r' AS matched_rules, CAST(n_the AS BIGINT) AS match_count, '' AS exceptions FROM c WHERE n_the > 0 AND conv_id % 3 = 0 AND conv_id % 4 <> 1")
def policy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients by domain; a sender's exception for the whole message."""
    spared = P.Exception_("boss", groups=(P.Group(("u1@EXAMPLE.com",), "sender"),))
    return _decided(spark, sf_dir, P.Policy("groups", _one("r", P.Condition("the")), groups=(P.Group(("Example.com",), mode="domain"),), exceptions=(spared,)))


@query(
    f"""WITH {_CELLS}, m AS (SELECT *, n_the - s_the + n_of AS after_first FROM c WHERE n_the > 0 OR n_of > 0),
    k AS (SELECT *, CASE WHEN n_the > 0 THEN n_the - s_the ELSE 0 END + CASE WHEN n_of > 0 AND conv_id % 3 <> 0 THEN n_of ELSE 0 END AS n FROM m)
    SELECT message_id, 'mco' AS policy_name, 'medium' AS severity, concat_ws(',', CASE WHEN n_the > 0 THEN 'r1' END, CASE WHEN n_of > 0 THEN 'r2' END) AS matched_rules, CAST(n AS BIGINT) AS match_count,
    concat_ws(',', CASE WHEN s_the > 0 THEN 'subject' END, CASE WHEN n_of > 0 AND conv_id % 3 = 0 THEN 'of' END) AS exceptions FROM k WHERE n > 0"""
)
def policy_component_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of some components and analyzers are left out, one exception after the other."""
    rules = (P.Rule("r1", (P.Condition("the"),)), P.Rule("r2", (P.Condition("of"),)))
    first = P.Exception_("subject", False, when=lambda: F.lit(True), analyzers=("the",), components=("subject",))
    second = P.Exception_("of", False, groups=(P.Group(("^u[0-9]@mail",), mode="regex"),), analyzers=("of",))
    return _decided(spark, sf_dir, P.Policy("mco", rules, exceptions=(first, second)))


@query(
    f"""WITH {_CELLS}, v AS (SELECT message_id, 1 AS place, 'a' AS policy_name, CASE WHEN n_the >= 5 THEN 'high' ELSE 'low' END AS severity FROM c WHERE n_the > 0
    UNION ALL SELECT message_id, 2, 'b', 'high' FROM c WHERE n_of >= 3 UNION ALL SELECT message_id, 3, 'c', 'info' FROM c WHERE n_of > 0),
    o AS (SELECT *, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) AS grade FROM v)
    SELECT message_id, string_agg(policy_name, ',' ORDER BY place) AS triggered, arg_max(severity, grade) AS highest_severity, arg_max(policy_name, 10 * grade - place) AS worst_policy FROM o GROUP BY message_id"""
)
def policy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several policies at once; the highest severity and the worst policy."""
    policies = [P.Policy("a", _one("r", P.Condition("the")), "low", ((5, "high"),)), P.Policy("b", _one("r", P.Condition("of", "count_gte", 3)), "high"), P.Policy("c", _one("r", P.Condition("of")), "info"), P.Policy("off", _one("r", P.Condition("the")), enabled=False)]
    found = P.evaluate(conversation_messages(spark, sf_dir), _conversation_matches(spark, sf_dir), policies)
    return P.message_verdicts(found, ["a", "b", "c"]).withColumn("triggered", F.array_join("triggered_policies", ",")).drop("triggered_policies")


@query(
    f"""WITH {_DOCS}, h AS (SELECT key, count(*) AS n FROM ({_pattern_sql('d', True)}) WHERE rule_name = 'Credit Card Number' GROUP BY key)
    SELECT key AS message_id, 'pci_dss' AS policy_name, CASE WHEN n >= 3 THEN 'high' WHEN n >= 1 THEN 'medium' END AS severity, n AS match_count FROM h"""
)
def policy_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents with checked card numbers, under a stored policy with tiers."""
    stored = {"pci_dss": TEMPLATES["pci_dss"] | {"severity_thresholds": [{"threshold": 1, "severity": "medium"}, {"threshold": 3, "severity": "high"}]}}
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("message_id"))
    return P.evaluate_stored(docs, documents(spark, sf_dir), stored).select("message_id", "policy_name", "severity", "match_count")


@query()
def policy_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six templates over all documents in one scan; against a plain model in the tests."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("message_id"))
    return P.evaluate_stored(docs, documents(spark, sf_dir), TEMPLATES).select("message_id", "policy_name", "severity", "match_count")


# ---- incidents and reports

_INCIDENTS = """i AS (SELECT event_id AS id, 'Policy ' || (user_id % 6) AS policy_name,
    ['info', 'low', 'low', 'medium', 'medium', 'medium', 'high', 'high', 'critical', 'odd'][event_id % 10 + 1] AS severity,
    ['new', 'in_progress', 'resolved', 'dismissed', 'escalated'][event_id % 5 + 1] AS status,
    ['email', 'usb', 'http_upload', 'clipboard', 'network_share'][length(event_type) % 5 + 1] AS channel,
    ['endpoint', 'network', 'discover'][event_id % 3 + 1] AS source_type,
    CASE WHEN user_id % 17 <> 0 THEN 'user' || user_id END AS "user", CASE WHEN event_id % 3 <> 0 THEN 'file' || event_id || '.docx' END AS file_name,
    ['log', 'block', 'notify', 'quarantine'][event_id % 4 + 1] AS action_taken, CAST(1 + event_id % 20 AS INT) AS match_count, ts AS created_at FROM events)"""
START, END, REFERENCE = "2024-01-16 00:00:00", "2024-01-30 23:59:59", "2024-01-31 00:00:00"
_FIELDS = ("severity", "policy_name", "channel", "status", "source_type", "user")


@query(f"WITH {_INCIDENTS} SELECT * FROM i")
def incidents_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir)


@query(
    f"WITH {_INCIDENTS}, c AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(nullif(\"{f}\", ''), 'unknown') AS value FROM i WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'" for f in _FIELDS)
    + ") SELECT field, value, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY field) * 100, 1) AS percentage FROM c GROUP BY field, value"
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six groupings in one pass."""
    return reports.summary(reports.between(derived(spark, sf_dir), START, END))


@query(
    f"""WITH {_INCIDENTS}, p AS (SELECT *, created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AS is_now,
    created_at BETWEEN TIMESTAMP '{START}' - INTERVAL 1 SECOND - (TIMESTAMP '{END}' - TIMESTAMP '{START}') AND TIMESTAMP '{START}' - INTERVAL 1 SECOND AS is_before FROM i),
    m AS (SELECT 'total' AS metric, is_now, is_before FROM p WHERE is_now OR is_before UNION ALL SELECT severity, is_now, is_before FROM p WHERE is_now OR is_before),
    c AS (SELECT metric, count(*) FILTER (is_now) AS "current", count(*) FILTER (is_before) AS previous FROM m GROUP BY metric)
    SELECT metric, "current", previous, "current" - previous AS delta, CASE WHEN previous > 0 THEN round_even(("current" - previous) / previous * 100, 1) WHEN "current" > 0 THEN 100.0 ELSE 0.0 END AS delta_percent FROM c"""
)
def report_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: two periods in one scan."""
    return reports.trend(derived(spark, sf_dir), START, END)


_WEIGHT = "CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 1 END"
_RISK = f"""{_INCIDENTS}, s AS (SELECT coalesce(nullif("user", ''), 'unknown') AS "user", sum({_WEIGHT} * pow(0.95, greatest(0, (epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(created_at)) / 1e6 / 86400))) AS raw,
    count(*) AS n_incidents, {', '.join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in SEVERITIES)}, min(created_at) AS oldest, max(created_at) AS latest
    FROM i WHERE created_at >= TIMESTAMP '{REFERENCE}' - INTERVAL 90 DAY GROUP BY 1),
    z AS (SELECT *, CASE WHEN raw > 0 THEN greatest(1, least(100, CAST(round_even(raw / 50 * 100, 0) AS INT))) ELSE 0 END AS normalized FROM s)"""
_LEVEL = "CASE WHEN normalized >= 80 THEN 'critical' WHEN normalized >= 60 THEN 'high' WHEN normalized >= 40 THEN 'medium' WHEN normalized >= 20 THEN 'low' ELSE 'info' END"


@query(f'WITH {_RISK} SELECT "user", round(raw, 4) AS raw_score, CAST(normalized AS INT) AS normalized, {_LEVEL} AS level, n_incidents, {", ".join(f"n_{s}" for s in SEVERITIES)}, oldest, latest FROM z')
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A7, A8."""
    return reports.risk(derived(spark, sf_dir), REFERENCE)


@query(f'WITH {_RISK} SELECT "user", round(raw, 4) AS raw_score FROM z ORDER BY round(raw, 4) DESC, "user" LIMIT 5')
def risk_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return reports.top(reports.risk(derived(spark, sf_dir), REFERENCE), "raw_score", 5, "user").select("user", "raw_score")


@query(f"""WITH {_INCIDENTS} SELECT * FROM i WHERE severity = 'low' AND status = 'in_progress' AND policy_name ILIKE '%icy 1%' AND (policy_name ILIKE '%file%' OR file_name ILIKE '%file%' OR "user" ILIKE '%file%') ORDER BY match_count DESC, id LIMIT 20 OFFSET 20""")
def incidents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a filtered list."""
    return reports.page(reports.filtered(derived(spark, sf_dir), "low", "in_progress", None, "icy 1", "file"), 2, 20, "match_count")


@query(f"WITH {_INCIDENTS} SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS pages FROM i WHERE severity = 'high'")
def incidents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_count(reports.filtered(derived(spark, sf_dir), "high"))


@query(
    f"""WITH {_INCIDENTS}, a AS (SELECT 'incident' AS kind, CAST(id AS VARCHAR) AS id, policy_name AS title, file_name AS subtitle FROM i WHERE policy_name ILIKE '%12%' OR file_name ILIKE '%12%' ORDER BY i.id LIMIT 10),
    b AS (SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_mktsegment AS subtitle FROM customer WHERE c_name ILIKE '%12%' OR c_mktsegment ILIKE '%12%' ORDER BY c_custkey LIMIT 10)
    SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten hits of each kind, which is the feature."""
    return reports.global_search({"incident": (derived(spark, sf_dir), "id", "policy_name", "file_name"), "customer": (table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_mktsegment")}, "12")


@query(f"WITH {_INCIDENTS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in ("new", "in_progress", "resolved", "dismissed", "escalated")) + " FROM i")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several counts in one pass."""
    return reports.status_counts(derived(spark, sf_dir), "status", ("new", "in_progress", "resolved", "dismissed", "escalated"))


@query(f"WITH {_INCIDENTS} SELECT channel, severity, action_taken, count(*) AS n FROM i GROUP BY ALL")
def incident_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return derived(spark, sf_dir).groupBy("channel", "severity", "action_taken").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, count(*) / 300.0::DOUBLE AS per_second FROM events GROUP BY ALL")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    return reports.rates(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS quantile, count(*) AS n FROM events GROUP BY event_type")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latency_quantiles(table(spark, sf_dir, "events"), "event_type", "value").withColumn("quantile", F.round("quantile", 6))


# ---- verdicts, exports, state


@query(f"""WITH {_INCIDENTS} SELECT id, CASE WHEN match_count >= 10 THEN 'block' ELSE 'allow' END AS http, CASE WHEN match_count >= 15 THEN 'block' WHEN match_count >= 5 THEN 'redirect' ELSE 'log' END AS smtp,
    CASE WHEN action_taken IN ('block', 'user_cancel') THEN 'block' ELSE 'allow' END AS endpoint, CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 0 THEN 'block' ELSE 'log' END WHEN match_count > 3 THEN 'block' ELSE 'allow' END AS ttd FROM i""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, R2, R4, R5."""
    n, i = F.col("match_count"), F.col("id")
    ttd = incidents.ttd_verdict(n - 3, i % 7 == 0, F.when(i % 2 == 0, "block"))
    return derived(spark, sf_dir).select("id", incidents.http_verdict(n, 10).alias("http"), incidents.smtp_verdict(n, 15, 5, "redirect").alias("smtp"), incidents.endpoint_verdict(F.col("action_taken")).alias("endpoint"), ttd.alias("ttd"))


_CEF = """'CEF:0|Inspectra|Inspectra|1.0|' || CASE action_taken WHEN 'block' THEN 100 WHEN 'notify' THEN 200 WHEN 'log' THEN 300 WHEN 'quarantine' THEN 400 ELSE 999 END || '|DLP ' || action_taken || ': ' || policy_name || '|'
    || CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 WHEN 'low' THEN 3 ELSE 1 END || '|act=' || action_taken || ' cat=' || channel || ' cs1=' || policy_name || ' cs1Label=PolicyName cs2=' || source_type
    || ' cs2Label=SourceType cn1=' || match_count || ' cn1Label=MatchCount sev=' || severity || ' outcome=' || status || coalesce(' suser=' || "user", '') || coalesce(' fname=' || file_name, '') || ' rt=' || CAST(floor(epoch_us(created_at) / 1000) AS BIGINT)"""


@query(f"WITH {_INCIDENTS} SELECT id, CAST(104 + greatest(0, 7 - CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 WHEN 'low' THEN 3 ELSE 1 END) AS INT) AS priority, {_CEF} AS line FROM i WHERE severity NOT IN ('info', 'low')")
def cef_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, E6, F7."""
    return export.cef_lines(derived(spark, sf_dir), "medium")


@query(
    f"""WITH {_INCIDENTS} SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", CAST(greatest(0, coalesce(list_position(['info', 'low', 'medium', 'high', 'critical'], severity), 0) - 1) AS INT) AS severity,
    CASE WHEN action_taken = 'block' THEN 'success' ELSE 'unknown' END AS outcome, "user" AS user_name, file_name, policy_name, match_count FROM i"""
)
def ecs_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7, as columns."""
    e = derived(spark, sf_dir).select("id", export.ecs_event().alias("e"))
    return e.select("id", F.col("e.@timestamp").alias("timestamp"), "e.event.severity", "e.event.outcome", F.col("e.user.name").alias("user_name"), F.col("e.file.name").alias("file_name"), F.col("e.dlp.policy.name").alias("policy_name"), "e.dlp.match_count")


@query(f"WITH {_INCIDENTS}, o AS (SELECT * FROM i WHERE created_at < TIMESTAMP '{START}') SELECT 'archive' AS side, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o WHERE id % 4 <> 0 UNION ALL SELECT 'active', count(*), CAST(sum(id) AS BIGINT) FROM i WHERE created_at >= TIMESTAMP '{START}'")
def archive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth incident is archived already."""
    rows = derived(spark, sf_dir)
    put, keep = incidents.archive(rows, rows.where("id % 4 = 0"), START)
    side = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("side"), "n", "ids")
    return side(put, "archive").unionByName(side(keep, "active"))


@query(f"WITH {_INCIDENTS} SELECT \"user\", max(id) AS id, arg_max(status, id) AS status FROM i WHERE \"user\" IS NOT NULL GROUP BY \"user\"")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key."""
    rows = derived(spark, sf_dir).where("user IS NOT NULL").select("user", "id", "status")
    return incidents.latest(rows.withColumn("at", F.col("id")), "user", "at").select("user", "id", "status")


@query(
    f"""WITH {_INCIDENTS}, l AS (SELECT "user", id, status, lag(status) OVER (PARTITION BY "user" ORDER BY id) AS old_value FROM i WHERE "user" IS NOT NULL)
    SELECT "user", id, 'status' AS field, old_value, status AS new_value FROM l WHERE old_value IS NOT NULL AND old_value <> status"""
)
def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every change."""
    return incidents.history(derived(spark, sf_dir).where("user IS NOT NULL").select("user", "id", "status"), "user", "id", ["status"])


_PAIRED = f"""{_INCIDENTS}, a AS (SELECT * FROM i WHERE id % 2 = 0 AND "user" IS NOT NULL), b AS (SELECT * FROM i WHERE id % 2 = 1 AND "user" IS NOT NULL)"""


@query(f"""WITH {_PAIRED} SELECT a.id AS incident_id, b.id AS other_id, a."user" FROM a JOIN b ON a."user" = b."user" AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 1800000000""")
def correlate_30min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time-range join."""
    rows = derived(spark, sf_dir)
    return incidents.correlate(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).select("incident_id", "other_id", "user")


@query(f"""WITH {_PAIRED} SELECT b.id AS event_id, b."user", max_by(a.id, (a.created_at, a.id)) AS last_incident FROM b LEFT JOIN a ON a."user" = b."user" AND a.created_at <= b.created_at GROUP BY ALL""")
def previously_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An as-of join."""
    rows = derived(spark, sf_dir)
    return incidents.previously_flagged(rows.where("id % 2 = 1"), rows.where("id % 2 = 0")).select("event_id", "user", "last_incident")



@query(f"WITH {_INCIDENTS}, q AS (SELECT sha256(concat_ws('|', policy_name, coalesce(file_name, ''), coalesce(\"user\", ''), CAST(match_count AS VARCHAR), channel)) AS hash, min(id) AS id, count(*) AS n FROM i GROUP BY 1) SELECT hash, id, n FROM q")
def dedup_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued incidents by their hash."""
    key = monitor.queue_hash(("policy_name", "file_name", "user", "match_count", "channel"))
    return derived(spark, sf_dir).groupBy(key.alias("hash")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(f"WITH {_INCIDENTS}, k AS (SELECT id FROM i ORDER BY created_at DESC, id DESC LIMIT 100) SELECT id FROM i WHERE id NOT IN (SELECT id FROM k)")
def evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a queue of a hundred lets go."""
    queue = derived(spark, sf_dir).select("id", F.col("id").alias("hash"), F.col("created_at").alias("queued_at"))
    return monitor.evicted(queue, 100).select("id")


@query()
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: a token bucket for each user; against a plain fold in the tests."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return monitor.rate_limit(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("caller"), F.col("event_id").alias("request_id"), at.alias("at")), 1)


# ---- more of stored state


@query(f"""WITH {_INCIDENTS}, n AS (SELECT id - id % 3 AS incident_id, created_at, 'note ' || id AS note FROM i WHERE id % 3 > 0),
    c AS (SELECT incident_id, string_agg(note, ',' ORDER BY created_at, note) AS notes FROM n GROUP BY 1) SELECT i.id, coalesce(c.notes, '') AS notes FROM i LEFT JOIN c ON i.id = c.incident_id""")
def incident_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of incidents, oldest first."""
    rows = derived(spark, sf_dir)
    notes = rows.where("id % 3 > 0").select((F.col("id") - F.col("id") % 3).alias("incident_id"), "created_at", F.concat(F.lit("note "), F.col("id").cast("string")).alias("note"))
    return incidents.with_notes(rows.select("id"), notes).select("id", F.array_join("notes", ",").alias("notes"))


@query("""SELECT 'host' || user_id AS agent, max(ts) AS last_seen, arg_max(event_id % 5, ts) AS version, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch_us(max(ts)) / 1000000) AS BIGINT) AS age_seconds,
    CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch_us(max(ts)) / 1000000) <= 86400 THEN 'online' ELSE 'stale' END AS status FROM events GROUP BY user_id""")
def agent_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent's last heartbeat."""
    beats = table(spark, sf_dir, "events").select(F.concat(F.lit("host"), "user_id").alias("agent"), "ts", (F.col("event_id") % 5).alias("version"))
    return monitor.agents(beats, REFERENCE, 1440)


@query("""SELECT event_id AS id, CAST(CASE WHEN event_id % 4 < 3 AND event_id % 7 > 0 AND event_id % 2 = 0 THEN event_id % 4 + 1 ELSE event_id % 4 END AS INT) AS retry_count,
    event_id % 4 = 3 OR (event_id % 7 > 0 AND event_id % 2 = 0 AND event_id % 4 + 1 >= 3) AS is_permanent FROM events""")
def dead_letter_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retry of every open entry."""
    e = F.col("event_id")
    queue = table(spark, sf_dir, "events").select(e.alias("id"), (e % 4).cast("int").alias("retry_count"), (e % 4 == 3).alias("is_permanent"), (e % 7 == 0).alias("is_dismissed"))
    return incidents.dead_letters(queue, F.col("id") % 2 == 0).select("id", "retry_count", "is_permanent")


@query(f"""WITH {_INCIDENTS}, v AS (SELECT id, policy_name AS subject, CASE WHEN match_count >= 15 THEN 'block' WHEN match_count >= 5 THEN 'redirect' ELSE 'modify' END AS verdict, coalesce("user", 'nobody') AS "to" FROM i)
    SELECT id, verdict, CASE WHEN verdict = 'modify' THEN '[FLAGGED] ' || subject ELSE subject END AS out_subject, CASE verdict WHEN 'redirect' THEN 'quarantine@example.com' WHEN 'block' THEN '' ELSE "to" END AS out_recipients, CAST(CASE WHEN verdict = 'block' THEN 550 ELSE 250 END AS INT) AS reply FROM v""")
def mail_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verdicts do to mails."""
    n = F.col("match_count")
    mails = derived(spark, sf_dir).select("id", F.col("policy_name").alias("subject"), "match_count", F.array(F.coalesce("user", F.lit("nobody"))).alias("recipients"), F.when(n >= 15, "block").when(n >= 5, "redirect").otherwise("modify").alias("verdict"))
    return incidents.smtp_effects(mails).select("id", "verdict", "out_subject", F.coalesce(F.array_join("out_recipients", ","), F.lit("")).alias("out_recipients"), "reply")


@query("""SELECT event_id AS id, CASE WHEN event_type IN ('low', 'high') THEN event_type ELSE 'medium' END AS severity, CASE event_id % 3 WHEN 0 THEN 'email' ELSE 'usb' END AS channel, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS file_size,
    CASE WHEN event_id % 2 = 0 THEN 'f' END AS file_name FROM events""")
def agent_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of agents as incident columns."""
    e = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(e.alias("id"), F.upper("event_type").alias("severity"), F.when(e % 3 == 0, "EMAIL").otherwise("elsewhere").alias("channel"), (e % 5).alias("file_size"), F.when(e % 2 == 0, "f").otherwise("").alias("file_name"))
    return incidents.normalize_report(raw)


@query("SELECT doc_id AS path, n_chars AS length FROM documents WHERE doc_id % 3 = 0 OR n_chars % 2 = 1")
def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the cache doesn't know as they are."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seen = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("length"), now.alias("modificationTime"))
    cache = seen.where("path % 3 > 0").withColumn("length", F.col("length") + F.when(F.col("length") % 2 == 1, 1).otherwise(0))
    return files.changed(seen, cache).select("path", "length")


_FILES = """f AS (SELECT 'p' || page_id || '.html' AS filename, html AS t, 'HTML' AS type_name, 'document' AS category FROM pages UNION ALL SELECT 'd' || doc_id || '.txt', text, 'Plain Text', 'document' FROM documents WHERE length(text) > 0
    UNION ALL SELECT 'c' || conv_id || '_' || turn || '.py', text, 'Python Script', 'script' FROM conversations WHERE length(text) > 0)"""


@query(f"WITH {_FILES} SELECT filename, type_name, 'docs' AS rule_name FROM f WHERE category = 'document' UNION ALL SELECT filename, type_name, 'small' FROM f WHERE strlen(t) <= 300 UNION ALL SELECT filename, type_name, 'scripts' FROM f WHERE filename LIKE 'c%.py'")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of pages, documents and conversations under three rules."""
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    texts = lambda t, column, *parts: table(spark, sf_dir, t).where(F.length(column) > 0).select(name(*parts).alias("filename"), F.encode(column, "UTF-8").alias("content_bytes"))
    rows = texts("pages", "html", "p", F.col("page_id"), ".html").unionByName(texts("documents", "text", "d", F.col("doc_id"), ".txt")).unionByName(texts("conversations", "text", "c", F.col("conv_id"), "_", F.col("turn"), ".py"))
    rules = [filetype.FileRule("docs", categories=("document",)), filetype.FileRule("small", max_size=300), filetype.FileRule("scripts", extensions=("py",), globs=("c*.py",)), filetype.FileRule("nothing")]
    return filetype.scan_file_types(rows, rules).select("filename", "file_info.type_name", "rule_name")


# ---- texts


@query()
def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of web pages."""
    return files.pages_text(table(spark, sf_dir, "pages"))


@query("SELECT page_id, url LIKE 'http%' AS is_web, coalesce(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) IN ('example.com') OR regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) LIKE '%.example.com', false) AS allowed FROM pages")
def allowed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").startswith("http").alias("is_web"), messages.allowed_host(F.col("url"), ["example.com"]).alias("allowed"))


@query()
def normalized_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded variants of pages' text."""
    parts = messages.text_messages(table(spark, sf_dir, "pages"), "page_id", "html")
    return normalize.with_variants(parts).select("message_id", "component_type", "normalized", F.length("content").alias("n_chars"))


@query()
def fingerprint_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like a benchmark text, by the default threshold."""
    index = fingerprint.build_index(table(spark, sf_dir, "benchmark"), "item_id", "text")
    docs = fingerprint.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return fingerprint.fingerprint_pairs(docs, index, fingerprint.THRESHOLD)



@query("SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events")
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM s GROUP BY user_id, n"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, by the function that streams use too."""
    out = monitor.user_sessions(table(spark, sf_dir, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.window_counts(table(spark, sf_dir, "events"), "event_type")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers in documents under a policy, by severity."""
    return policy_cards(spark, sf_dir).groupBy("policy_name", "severity").agg(F.count("*").alias("n_messages"), F.sum("match_count").alias("n_matches"))
