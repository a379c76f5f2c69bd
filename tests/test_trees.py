"""Compiled policy trees against a recursive evaluation."""

import random

from inspectra.plans.policy import Condition, Group
from inspectra.plans.trees import And, Leaf, Not, Or, TreePolicy, asked, compile_policies, evaluate_trees, normal

ANALYZERS, COMPONENTS = "xyz", ("subject", "body")
LEAVES = [
    *(Leaf(Condition(a, op, v, c)) for a in ANALYZERS for op, v in (("matches", 1), ("count_gte", 3), ("count_lte", 1)) for c in ((), ("body",))),
    Leaf(Group(("a@x.com",), "sender")), Leaf(Group(("x.com",), mode="domain")),
]


def some(rng, depth):
    kind = rng.choice(["leaf", "and", "or", "not"]) if depth else "leaf"
    if kind == "leaf":
        return rng.choice(LEAVES)
    return Not(some(rng, depth - 1)) if kind == "not" else {"and": And, "or": Or}[kind](tuple(some(rng, depth - 1) for _ in range(rng.randint(0, 3))))


def value(node, m):
    if isinstance(node, Not):
        return not value(node.of, m)
    if isinstance(node, And):
        return all(value(p, m) for p in node.parts)
    if isinstance(node, Or):
        return any(value(p, m) for p in node.parts)
    if isinstance(node.of, Group):
        people = [m["sender"]] if node.of.field == "sender" else m["recipients"] or []
        return any(p is not None and (p.lower() == x if node.of.mode == "exact" else p.lower().endswith("@" + x)) for p in people for x in node.of.members)
    c = node.of
    n = sum(k for (a, w), k in m["cells"].items() if a == c.analyzer and (not c.components or w in c.components))
    return {"matches": n > 0, "count_gte": n >= c.value, "count_lte": n <= c.value}[c.op]


def messages_of(rng, n):
    people = ["a@x.com", "b@x.com", "c@y.com", None]
    return [{"sender": rng.choice(people), "recipients": rng.choice([None, rng.sample(people, 2)]), "cells": {(a, c): rng.choice([0, 0, 1, 2, 4]) for a in ANALYZERS for c in COMPONENTS}} for _ in range(n)]


def test_normal_form_means_the_same():
    rng = random.Random(21)
    seen = messages_of(rng, 40)
    for _ in range(400):
        tree = some(rng, 4)
        form = normal(tree)
        assert [value(form, m) for m in seen] == [value(tree, m) for m in seen]
        assert normal(form) == form
        assert normal(Not(Not(tree))) == form

    def nots(node):
        return isinstance(node.of, Leaf) if isinstance(node, Not) else all(map(nots, getattr(node, "parts", ())))

    assert all(nots(normal(some(rng, 4))) for _ in range(100))


def test_laws():
    x, y, z = LEAVES[:3]
    assert normal(And((x, Or((y, Not(And((Not(x), z)))))))) == normal(And((Or((Or((x, Not(z))), y)), x)))
    assert normal(And((x, Not(x)))) == Or() and normal(Or((x, Not(x)))) == And()
    assert normal(Or((x, And((x, y))))) == x and normal(And((x, x))) == x
    assert asked(normal(And((x, Not(y))))) == [x.of]


def test_equal_parts_are_shared():
    x, y, z = LEAVES[:3]
    part = Or((x, y))
    policies = [TreePolicy(f"p{i}", And((part, (z, Not(z), LEAVES[5], LEAVES[-1])[i]))) for i in range(4)]
    compiled = compile_policies([*policies, TreePolicy("q", Or((y, x)))])
    assert sum(isinstance(n, Or) and bool(n.parts) for n in compiled.numbers) == 1


def test_against_a_recursive_evaluation(spark):
    rng = random.Random(22)
    seen = messages_of(rng, 60)
    policies = [TreePolicy(f"p{i}", some(rng, 3), "low", ((3, "high"), (6, "critical")), some(rng, 1) if i % 3 == 0 else Or(), ((some(rng, 1), ("body",)), (some(rng, 1), ("subject",))) if i % 2 else ()) for i in range(25)]
    policies.append(TreePolicy("off", And(), enabled=False))
    messages = spark.createDataFrame([(str(i), m["sender"], m["recipients"]) for i, m in enumerate(seen)], "message_id string, sender string, recipients array<string>")
    matches = spark.createDataFrame([(str(i), a, c) for i, m in enumerate(seen) for (a, c), n in m["cells"].items() for _ in range(n)], "message_id string, analyzer_name string, component_type string")
    want = []
    for i, m in enumerate(seen):
        for p in policies[:-1]:
            conditions, gone = asked(normal(p.tree)), [w for where, w in p.ejected if value(where, m)]
            held = [c for c in conditions if value(Leaf(c), m)]
            n = sum(k for (a, w), k in m["cells"].items() if any(a == c.analyzer and (not c.components or w in c.components) for c in held) and not any(w in g for g in gone))
            met = value(p.tree, m) and not value(p.spared, m) and (n > 0 or not conditions)
            grade = "low" if not met or n < 3 else "high" if n < 6 else "critical"
            want.append((str(i), p.name, met, grade, n if met else 0))
    got = sorted(map(tuple, evaluate_trees(messages, matches, policies, False).collect()))
    assert got == sorted(want)
    assert any(w[2] for w in want) and not all(w[2] for w in want)
    assert sorted(map(tuple, evaluate_trees(messages, matches, policies).collect())) == sorted(w for w in want if w[2])
    assert evaluate_trees(messages, matches, []).count() == 0
    assert evaluate_trees(messages.limit(0), matches, policies).count() == 0
