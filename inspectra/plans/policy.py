"""Policies as column expressions: all policies are decided in one pass over the match counts of each message."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.functions.patterns import java
from inspectra.operators.filetype import file_type_matches
from inspectra.operators.scan import Probe, all_matches, identifier_probes, keyword_probes, run_probes
from inspectra.plans.catalog import BY_NAME
from inspectra.schema import SEVERITIES

OPERATORS = ("matches", "not_matches", "count_gte", "count_lte")


@dataclass(frozen=True)
class Condition:
    analyzer: str
    op: str = "matches"
    value: int = 1
    components: tuple[str, ...] = ()  # none: all

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator: {self.op}")


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...]


@dataclass(frozen=True)
class Group:
    """Senders or recipients: exact addresses, domains (and those below them), or regular expressions."""

    members: tuple[str, ...]
    field: str = "recipients"
    mode: str = "exact"


@dataclass(frozen=True)
class Exception_:
    """An exception for the whole message, or for the matches of some analyzers in some components (all, if none are named)."""

    name: str
    entire: bool = True
    groups: tuple[Group, ...] = ()
    when: Callable[[], Column] | None = None  # over message columns and `cells`; goes before groups
    analyzers: tuple[str, ...] = ()
    components: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]
    severity: str = "medium"
    tiers: tuple[tuple[int, str], ...] = ()  # (least matches, severity)
    groups: tuple[Group, ...] = ()
    exceptions: tuple[Exception_, ...] = ()
    enabled: bool = True


@dataclass
class Policies:
    """A registry by name."""

    all: dict[str, Policy] = field(default_factory=dict)

    def add(self, policy: Policy) -> None:
        if policy.name in self.all:
            raise ValueError(f"policy {policy.name} is there already")
        self.all[policy.name] = policy

    def remove(self, name: str) -> None:
        del self.all[name]

    def evaluate(self, messages: DataFrame, matches: DataFrame, triggered_only: bool = True) -> DataFrame:
        return evaluate(messages, matches, list(self.all.values()), triggered_only)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def in_group(group: Group) -> Column:
    def member(value: Column) -> Column:
        low = F.lower(value)
        tests = []
        for m in group.members:
            if group.mode == "exact":
                tests.append(low == m.lower())
            elif group.mode == "domain":
                domain = F.regexp_extract(low, "(?s)^[^@]*@(.*)$", 1)
                tests.append(F.when(low.contains("@"), (domain == m.lower()) | domain.endswith("." + m.lower())).otherwise(low == m.lower()))
            else:
                tests.append(value.rlike(f"(?iu){java(m)}"))
        return _any(tests)

    if group.field == "recipients":
        return F.coalesce(F.exists("recipients", member), F.lit(False))
    return F.coalesce(member(F.coalesce(F.col(group.field).cast("string"), F.lit(""))), F.lit(False))


def _count(cells: Column, keep: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.filter(cells, keep), F.lit(0).cast("long"), lambda a, c: a + c["n"])


def holds(c: Condition) -> Column:
    def mine(cell: Column) -> Column:
        test = cell["analyzer"] == c.analyzer
        return test & cell["component"].isin(*c.components) if c.components else test

    n = _count(F.col("cells"), mine)
    return {"matches": n > 0, "not_matches": n == 0, "count_gte": n >= c.value, "count_lte": n <= c.value}[c.op]


def _texts(values: list[Column]) -> Column:
    return F.array(*values).cast("array<string>")


def _covered(e: Exception_) -> Callable[[Column], Column]:
    def test(cell: Column) -> Column:
        return _all(([cell["analyzer"].isin(*e.analyzers)] if e.analyzers else []) + ([cell["component"].isin(*e.components)] if e.components else []))

    return test


def _not(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda cell: ~test(cell)


def decide(policy: Policy) -> Column:
    """(policy_name, triggered, severity, matched_rules, match_count, exceptions_applied) from a message's cells and columns."""
    rules = [(r, _all([holds(c) for c in r.conditions]) if r.conditions else F.lit(False)) for r in policy.rules]
    detected = _any([ok for _, ok in rules])
    named = F.filter(_texts([F.when(ok, r.name) for r, ok in rules]), lambda x: x.isNotNull())
    # analyzers of conditions that hold in rules that hold
    own = F.filter(_texts([F.when(ok & holds(c), c.analyzer) for r, ok in rules for c in r.conditions]), lambda x: x.isNotNull())
    concerned = _any([in_group(g) for g in policy.groups]) if policy.groups else F.lit(True)
    applies = {e.name: F.coalesce(e.when() if e.when else _any([in_group(g) for g in e.groups]), F.lit(False)) for e in policy.exceptions}
    whole = [e for e in policy.exceptions if e.entire]
    spared = F.coalesce(*[F.when(applies[e.name], e.name) for e in whole], F.lit(None).cast("string")) if whole else F.lit(None).cast("string")
    left, done = F.filter("cells", lambda c: F.array_contains(own, c["analyzer"])), []
    for e in policy.exceptions:
        if e.entire:
            continue

        covered = _covered(e)
        done.append(F.when(applies[e.name] & F.exists(left, covered), e.name))
        left = F.when(applies[e.name], F.filter(left, _not(covered))).otherwise(left)
    n = _count(left, lambda c: F.lit(True))
    open_ = detected & concerned & spared.isNull()
    triggered = open_ & (n > 0)
    severity = F.lit(policy.severity)
    for least, name in sorted(policy.tiers):
        severity = F.when(n >= least, name).otherwise(severity)
    used = F.when(spared.isNotNull(), F.array(spared)).otherwise(F.filter(_texts(done), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(policy.name).alias("policy_name"),
        triggered.alias("triggered"),
        F.when(triggered, severity).otherwise(F.lit(policy.severity)).alias("severity"),
        F.when(detected, named).otherwise(none).alias("matched_rules"),
        F.when(open_, n).otherwise(F.lit(0)).cast("long").alias("match_count"),
        F.when(detected & concerned, used).otherwise(none).alias("exceptions_applied"),
    )


def _decided(policy: Policy) -> Column:
    """decide, or a violation that isn't triggered with what went wrong, so that one policy's fault leaves the others."""
    try:
        return decide(policy).withField("error", F.lit(None).cast("string"))
    except Exception as e:
        none = F.array().cast("array<string>")
        return F.struct(F.lit(policy.name).alias("policy_name"), F.lit(False).alias("triggered"), F.lit(policy.severity).alias("severity"), none.alias("matched_rules"), F.lit(0).cast("long").alias("match_count"), none.alias("exceptions_applied"), F.lit(f"{type(e).__name__}: {e}").alias("error"))


def message_cells(matches: DataFrame) -> DataFrame:
    """message_id and cells: the numbers of matches by analyzer and component type."""
    counts = matches.groupBy("message_id", "analyzer_name", "component_type").agg(F.count("*").alias("n"))
    return counts.groupBy("message_id").agg(F.collect_list(F.struct(F.col("analyzer_name").alias("analyzer"), F.col("component_type").alias("component"), "n")).alias("cells"))


def evaluate(messages: DataFrame, matches: DataFrame, policies: list[Policy], triggered_only: bool = True) -> DataFrame:
    """A row for each message and enabled policy. messages: message_id and, for groups, sender and recipients.

    A policy that can't be planned gives rows that aren't triggered and say why in `error`.
    """
    active = [p for p in policies if p.enabled]
    joined = messages.join(message_cells(matches), "message_id", "inner" if triggered_only else "left")
    joined = joined.withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<analyzer:string,component:string,n:bigint>>")))
    if not active:
        return joined.select("message_id", *(F.lit(None).cast(t).alias(n) for n, t in (("policy_name", "string"), ("triggered", "boolean"), ("severity", "string"), ("matched_rules", "array<string>"), ("match_count", "long"), ("exceptions_applied", "array<string>"), ("error", "string")))).limit(0)
    rows = joined.select("message_id", F.explode(F.array(*map(_decided, active))).alias("v")).select("message_id", "v.*")
    return rows.where("triggered") if triggered_only else rows


def ordinal(severity: Column) -> Column:
    """0 for info to 4 for critical; -1 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)).cast("int") - 1


def message_verdicts(violations: DataFrame, order: list[str]) -> DataFrame:
    """Per message: whether something triggered, which policies in their order, the highest severity, and the worst policy (the first of equals)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("policy_name")).cast("int")
    hit = violations.where("triggered").withColumn("place", place).withColumn("grade", ordinal(F.col("severity")))
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "policy_name"))), lambda x: x["policy_name"])
    return hit.groupBy("message_id").agg(names.alias("triggered_policies"), F.max_by("severity", "grade").alias("highest_severity"), F.max_by("policy_name", F.struct("grade", -F.col("place"))).alias("worst_policy"))


def from_stored(name: str, stored: dict) -> tuple[Policy, list[Probe], dict[str, list[str]]]:
    """A stored policy as a Policy, the probes of its conditions and, by analyzer, the file types that it looks for.

    Every stored condition is an analyzer of its own, named by the policy, the rule's and its own number.
    """
    rules, probes, types = [], [], {}
    for i, r in enumerate(stored["rules"]):
        conditions = []
        for j, c in enumerate(r["conditions"]):
            key, config, kind = f"{name}/{i}/{j}", c["config"], c["condition_type"]
            if kind == "data_identifier":
                probes += identifier_probes([BY_NAME[config["identifier_name"]]], key)
            elif kind == "keyword":
                probes += keyword_probes(r["name"], config["keywords"], config.get("case_sensitive", False), True, key)
            elif kind == "regex":
                probes += [Probe(key, p, java(p)) for p in config["patterns"]]
            elif kind == "file_type":
                types[key] = config["types"]
            else:
                raise ValueError(f"unknown condition type: {kind}")
            where = () if c.get("component", "generic") == "generic" else (c["component"],)
            conditions.append(Condition(key, "count_gte", config.get("min_matches", 1), where))
        rules.append(Rule(r["name"], tuple(conditions)))
    tiers = tuple((t["threshold"], t["severity"]) for t in stored.get("severity_thresholds", ()))
    return Policy(name, tuple(rules), stored.get("severity", "medium"), tiers), probes, types


def evaluate_stored(messages: DataFrame, components: DataFrame, stored: dict[str, dict], triggered_only: bool = True) -> DataFrame:
    """Scans components once for all conditions of all stored policies, then decides them."""
    compiled = [from_stored(n, s) for n, s in stored.items()]
    probes = [p for _, ps, _ in compiled for p in ps]
    found = [run_probes(components, probes)] if probes else []
    found += [file_type_matches(components, key, types) for _, _, t in compiled for key, types in t.items()]
    return evaluate(messages, all_matches(*found), [p for p, _, _ in compiled], triggered_only)


def stored_rows(policies: DataFrame, rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """Policies (id, name, status, severity, is_template, version), their rules (id, policy_id, name) and conditions (rule_id, condition_type,
    component, config) as one row with nested rules for each policy that is in force: the newest version, active, no template."""
    newest = policies.groupBy("id").agg(F.max_by(F.struct(*[c for c in policies.columns if c != "id"]), "version").alias("p")).select("id", "p.*")
    inner = conditions.groupBy("rule_id").agg(F.collect_list(F.struct("condition_type", "component", "config")).alias("conditions"))
    of = rules.withColumnRenamed("id", "rule_id").join(inner, "rule_id", "left")
    nested = of.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "name", "conditions"))).alias("rules"))
    return newest.where("status = 'active' AND NOT is_template").join(nested.withColumnRenamed("policy_id", "id"), "id", "left").withColumn("severity", F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("medium"))


def serialized(rows: DataFrame) -> DataFrame:
    """policy_id and definition: the nested rows of stored_rows as JSON text, as agents get them.

    Rules come by id, conditions by type, component and configuration, which is text in the text ({} if there is none); a missing description is empty.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    condition = lambda c: F.struct(c["condition_type"].alias("condition_type"), c["component"].alias("component"), F.coalesce(c["config"], F.lit("{}")).alias("config_json"))
    none = F.array().cast("array<struct<condition_type:string,component:string,config_json:string>>")
    conditions = lambda r: F.coalesce(F.array_sort(F.transform(r["conditions"], condition)), none)
    rules = F.transform("rules", lambda r: F.struct(text(r["rule_id"]).alias("rule_id"), text(r["name"]).alias("name"), conditions(r).alias("conditions")))
    described = text(F.col("description")) if "description" in rows.columns else F.lit("")
    empty = F.array().cast("array<struct<rule_id:string,name:string,conditions:array<struct<condition_type:string,component:string,config_json:string>>>>")
    parts = F.struct(text(F.col("id")).alias("policy_id"), text(F.col("name")).alias("name"), described.alias("description"), "severity", "status", F.coalesce(rules, empty).alias("detection_rules"))
    return rows.select(text(F.col("id")).alias("policy_id"), F.to_json(parts).alias("definition"))


def edited(stored: dict, **changes: object) -> dict:
    """A stored policy with what is not None changed; the original stays as it is."""
    import copy

    return copy.deepcopy(stored) | {k: v for k, v in changes.items() if v is not None}
