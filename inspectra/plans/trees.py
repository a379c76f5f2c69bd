"""The intended policy model: trees of AND, OR and NOT over detections and groups, compiled together into shared columns.

A tree's leaves are conditions on a message's match counts and groups of its people. Compiling pushes NOT down to the leaves, flattens
and orders the parts of AND and OR, drops repeated ones, and decides what a part and its opposite settle; equal parts of all policies are
then one node. Leaves are one projection over the messages' cells, each level of nodes is one more, and every node is computed once
for a message, whatever number of policies has it.

A policy is met where its tree holds and no exception for the whole message does. Component exceptions that hold take
their components' matches away; what is left of the conditions that a true tree asks for is counted, and decides severity. A policy with
conditions but no match left isn't met; one of groups and NOTs alone is met without matches.

Edge cases: AND of nothing holds, OR of nothing doesn't; a message without matches has counts of 0; null people are in no group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.plans.policy import Condition, Group, holds, in_group, message_cells


@dataclass(frozen=True)
class Leaf:
    of: Condition | Group


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class And:
    parts: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Or:
    parts: tuple[Node, ...] = ()


Node = Leaf | Not | And | Or


@dataclass(frozen=True)
class TreePolicy:
    name: str
    tree: Node
    severity: str = "medium"
    tiers: tuple[tuple[int, str], ...] = ()  # (least matches, severity)
    spared: Node = Or()  # the whole message is left alone where it holds
    ejected: tuple[tuple[Node, tuple[str, ...]], ...] = ()  # (where it holds, components whose matches don't count)
    enabled: bool = True


def normal(node: Node, negated: bool = False) -> Node:
    """The node (or its opposite) with NOT at leaves only, without nested, repeated or settled parts, in one order."""
    if isinstance(node, Not):
        return normal(node.of, not negated)
    if isinstance(node, Leaf):
        return Not(node) if negated else node
    kind: type = And if isinstance(node, And) != negated else Or
    other = Or if kind is And else And
    parts: set[Node] = set()
    for p in (normal(p, negated) for p in node.parts):
        if isinstance(p, kind):
            parts |= set(p.parts)
        elif p == other():  # settles the whole: false in an AND, true in an OR
            return other()
        else:
            parts.add(p)
    if any(Not(p) in parts for p in parts if isinstance(p, Leaf)):
        return other()
    # a part that another one contains says nothing more: x OR (x AND y) is x
    inside = lambda p: set(p.parts) if isinstance(p, other) else {p}
    parts = {p for p in parts if not any(q != p and inside(q) < inside(p) for q in parts)}
    return next(iter(parts)) if len(parts) == 1 else kind(tuple(sorted(parts, key=repr)))


def leaves(node: Node) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    else:
        for p in (node.of,) if isinstance(node, Not) else node.parts:
            yield from leaves(p)


def asked(node: Node) -> list[Condition]:
    """The conditions that a normal tree asks for, not those that it forbids."""
    if isinstance(node, Not):
        return []
    return [node.of] * isinstance(node.of, Condition) if isinstance(node, Leaf) else [c for p in node.parts for c in asked(p)]


@dataclass
class Compiled:
    """Numbered nodes of all trees; a node's number is above those of its parts."""

    numbers: dict[Node, int] = field(default_factory=dict)
    level: dict[Node, int] = field(default_factory=dict)

    def add(self, node: Node) -> Node:
        if node not in self.numbers:
            parts = () if isinstance(node, Leaf) else (node.of,) if isinstance(node, Not) else node.parts
            for p in parts:
                self.add(p)
            self.level[node] = 0 if isinstance(node, Leaf) else 1 + max((self.level[p] for p in parts), default=0)
            self.numbers[node] = len(self.numbers)
        return node

    def column(self, node: Node) -> Column:
        return F.col(f"_n{self.numbers[node]}")

    def _made(self, node: Node) -> Column:
        if isinstance(node, Leaf):
            return F.coalesce(holds(node.of) if isinstance(node.of, Condition) else in_group(node.of), F.lit(False))
        if isinstance(node, Not):
            return ~self.column(node.of)
        join, start = ((lambda a, b: a & b), True) if isinstance(node, And) else ((lambda a, b: a | b), False)
        return reduce(join, map(self.column, node.parts), F.lit(start))

    def computed(self, messages: DataFrame) -> DataFrame:
        """messages with a column for each node, level by level."""
        for depth in range(max(self.level.values(), default=-1) + 1):
            messages = messages.withColumns({f"_n{self.numbers[n]}": self._made(n) for n, d in self.level.items() if d == depth})
        return messages


def _left(policy: TreePolicy, tree: Node, compiled: Compiled) -> Column:
    """Matches of the conditions that the tree asks for and that hold, outside of ejected components."""
    conditions = sorted(set(asked(tree)), key=repr)
    if not conditions:
        return F.lit(0).cast("long")

    def mine(cell: Column) -> Column:
        of = [compiled.column(Leaf(c)) & (cell["analyzer"] == c.analyzer) & (cell["component"].isin(*c.components) if c.components else F.lit(True)) for c in conditions]
        gone = [compiled.column(normal(where)) & cell["component"].isin(*names) for where, names in policy.ejected]
        return reduce(lambda a, b: a | b, of) & ~reduce(lambda a, b: a | b, gone, F.lit(False))

    return F.aggregate(F.filter("cells", mine), F.lit(0).cast("long"), lambda a, c: a + c["n"])


def compile_policies(policies: list[TreePolicy]) -> Compiled:
    compiled = Compiled()
    for p in policies:
        for node in (p.tree, p.spared, *(where for where, _ in p.ejected)):
            compiled.add(normal(node))
        for c in asked(normal(p.tree)):
            compiled.add(Leaf(c))
    return compiled


def evaluate_trees(messages: DataFrame, matches: DataFrame, policies: list[TreePolicy], triggered_only: bool = True) -> DataFrame:
    """message_id, policy_name, triggered, severity and match_count. messages: message_id and, for groups, sender and recipients."""
    active = [p for p in policies if p.enabled]
    compiled = compile_policies(active)
    cells = messages.join(message_cells(matches), "message_id", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<analyzer:string,component:string,n:bigint>>")))

    def verdict(p: TreePolicy) -> Column:
        tree = normal(p.tree)
        n = _left(p, tree, compiled)
        met = compiled.column(tree) & ~compiled.column(normal(p.spared)) & ((n > 0) if asked(tree) else F.lit(True))
        severity = F.lit(p.severity)
        for least, name in sorted(p.tiers):
            severity = F.when(n >= least, name).otherwise(severity)
        return F.struct(F.lit(p.name).alias("policy_name"), met.alias("triggered"), F.when(met, severity).otherwise(F.lit(p.severity)).alias("severity"), F.when(met, n).otherwise(F.lit(0)).cast("long").alias("match_count"))

    if not active:
        return messages.sparkSession.createDataFrame([], "message_id string, policy_name string, triggered boolean, severity string, match_count long")
    rows = compiled.computed(cells).select("message_id", F.explode(F.array(*map(verdict, active))).alias("v")).select("message_id", "v.*")
    return rows.where("triggered") if triggered_only else rows
