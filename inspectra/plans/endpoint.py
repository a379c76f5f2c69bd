"""Policies as endpoints read them: labels count, unconditional exceptions apply, and there are no groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.operators.filetype import EXTENSIONS, extension, file_info
from inspectra.operators.scan import Probe, run_probes
from inspectra.plans.policy import OPERATORS

CELLS = "array<struct<analyzer:string,label:string,component:string,n:bigint>>"
MOST = (1 << 31) - 1
#: Bytes of a file that an endpoint reads.
READ_BYTES = 50 * 1024 * 1024
#: Endings of names whose content is text.
PLAIN = (".txt", ".csv", ".eml", ".rtf", *(e for e, (kind, _) in EXTENSIONS.items() if kind == "script"))


@dataclass(frozen=True)
class Where:
    """A choice of matches; what is empty chooses all."""

    analyzer: str = ""
    label: str = ""
    component: str = ""

    def holds(self, cell: Column) -> Column:
        tests = [cell[n] == v for n, v in (("analyzer", self.analyzer), ("label", self.label), ("component", self.component)) if v]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def misses(self, cell: Column) -> Column:
        return ~self.holds(cell)


@dataclass(frozen=True)
class EndpointCondition:
    where: Where = Where()
    op: str = "matches"
    least: int = 1
    most: int = MOST
    of_file_type: bool = False

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator: {self.op}")


@dataclass(frozen=True)
class EndpointException:
    """Takes the whole message out, or those of its matches that `where` chooses. `when`: over message columns and `cells`; none: always."""

    name: str
    entire: bool = True
    when: Callable[[], Column] | None = None
    where: Where = Where()

    def applies(self) -> Column:
        return F.lit(True) if self.when is None else F.coalesce(self.when(), F.lit(False))


@dataclass(frozen=True)
class EndpointPolicy:
    name: str
    rules: tuple[tuple[str, tuple[EndpointCondition, ...]], ...]
    severity: str = "medium"
    tiers: tuple[tuple[int, str], ...] = ()
    exceptions: tuple[EndpointException, ...] = ()


def _sum(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"])


def counted(c: EndpointCondition) -> Column:
    n = _sum(F.filter("cells", c.where.holds))
    if c.of_file_type and c.where.label:  # the file's own type stands for one match where no match does
        same = F.col("file_type") == c.where.label
        n = F.when(same, F.greatest(n, F.lit(1))).otherwise(0)
    return n


def holds(c: EndpointCondition) -> Column:
    n = counted(c)
    return {"matches": n >= c.least, "not_matches": n == 0, "count_gte": n >= c.least, "count_lte": n <= c.most}[c.op]


def relevant(policy: EndpointPolicy) -> Column:
    """The cells that any condition of any rule chooses; for file-type conditions, without any, the file's type."""
    conditions = [c for _, cs in policy.rules for c in cs]
    chosen = F.filter("cells", lambda cell: reduce(lambda a, b: a | b, (c.where.holds(cell) for c in conditions), F.lit(False)))
    if any(not c.where.analyzer and not c.where.label for c in conditions):
        chosen = F.when(F.size(chosen) > 0, chosen).otherwise(F.col("cells"))
    of_type = [c for c in conditions if c.of_file_type]
    if of_type:
        known = F.coalesce(F.col("file_type"), F.lit("")) != ""
        n = sum((F.when(known & ((F.col("file_type") == c.where.label) if c.where.label else F.lit(True)), 1).otherwise(0) for c in of_type), F.lit(0)).cast("long")
        made = F.filter(F.array(F.struct(F.lit("file_type").alias("analyzer"), F.col("file_type").alias("label"), F.lit("").alias("component"), n.alias("n"))), lambda x: x["n"] > 0)
        chosen = F.when(F.size(chosen) > 0, chosen).otherwise(made.cast(CELLS))
    return chosen


def decide(policy: EndpointPolicy) -> Column:
    rules = [(name, reduce(lambda a, b: a & b, map(holds, cs)) if cs else F.lit(False)) for name, cs in policy.rules]
    matched = F.filter(F.array(*[F.when(ok, F.lit(n)) for n, ok in rules]).cast("array<string>"), lambda x: x.isNotNull())
    spared = reduce(lambda a, b: a | b, (e.applies() for e in policy.exceptions if e.entire), F.lit(False))
    left = relevant(policy)
    for e in policy.exceptions:
        if not e.entire:
            left = F.when(e.applies(), F.filter(left, e.where.misses)).otherwise(left)
    n = _sum(left)
    severity = F.lit(policy.severity)
    for least, name in sorted(policy.tiers):
        severity = F.when(n >= least, name).otherwise(severity)
    triggered = (F.size(matched) > 0) & ~spared & (n > 0)
    return F.struct(F.lit(policy.name).alias("policy_name"), triggered.alias("triggered"), severity.alias("severity"), matched.alias("matched_rules"), n.alias("match_count"))


def evaluate_endpoint(messages: DataFrame, matches: DataFrame, policies: list[EndpointPolicy]) -> DataFrame:
    """The policies that trigger. messages: message_id, file_type and what exceptions look at; one pass over the counts of matches."""
    counts = matches.groupBy("message_id", "analyzer_name", "rule_name", "component_type").agg(F.count("*").alias("n"))
    cell = F.struct(F.col("analyzer_name").alias("analyzer"), F.col("rule_name").alias("label"), F.col("component_type").alias("component"), "n")
    own = counts.groupBy("message_id").agg(F.collect_list(cell).alias("cells"))
    joined = messages.join(own, "message_id", "left").withColumn("cells", F.coalesce("cells", F.array().cast(CELLS)))
    rows = joined.select("message_id", F.explode(F.array(*map(decide, policies))).alias("v"))
    return rows.where("v.triggered").select("message_id", "v.policy_name", "v.severity", "v.matched_rules", "v.match_count")


def endpoint_text(content: Column, name: Column) -> Column:
    """The text that an endpoint sees in a file's first READ_BYTES: all of a text, the printable runs of four characters or more of others."""
    head = F.substring(content, 1, READ_BYTES)
    plain = F.coalesce(extension(name).isin(*PLAIN), F.lit(False)) | (F.substring(content, 1, 2) == F.lit(b"#!"))
    runs = F.array_join(F.regexp_extract_all(F.decode(head, "ISO-8859-1"), F.lit(r"[\x20-\x7e\t]{4,}"), F.lit(0)), "\n")
    return F.when(plain, F.decode(head, "UTF-8")).otherwise(runs)


def inspect_endpoint(files: DataFrame, probes: list[Probe]) -> tuple[DataFrame, DataFrame]:
    """(messages with file_type, matches) of files (message_id, filename, content_bytes): every text is one body."""
    typed = files.select("message_id", "filename", file_info(F.col("content_bytes"), F.col("filename"))["type_name"].alias("file_type"))
    body = F.lit("body")
    parts = files.where(F.octet_length("content_bytes") > 0).select("message_id", F.lit(0).alias("component_idx"), body.alias("component_type"), body.alias("component_name"), endpoint_text(F.col("content_bytes"), F.col("filename")).alias("content"))
    return typed.select("message_id", "filename", "file_type"), run_probes(parts, probes)
