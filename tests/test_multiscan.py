"""Required literals, the index of their grams, and the scan with candidates against the scan without."""

import random
import re

import pytest

from inspectra.functions.patterns import java
from inspectra.operators.multiscan import LiteralIndex, fold, required_literals, scan_many
from inspectra.operators.scan import scan_regex
from inspectra.plans.catalog import IDENTIFIERS, SECRET_PATTERNS

WANT = {
    "abc": {"abc"},
    "Ab[cd]e": {"abce", "abde"},
    r"\bfoo(?:bar|baz)\d+": {"foobar", "foobaz"},
    "(?:alpha|be)x*": {"alpha", "be"},
    "a*": None,
    "x?yz+": {"xyz", "yz"},
    r"\d{3}-\d{2}": {"-"},
    r"[^a]key": {"key"},
    "(?i)mark": {"mar"},
    "(?i)kiss": None,
    r"\p{L}abc": None,
    "[[:alpha:]]abc": None,
    "abc|": None,
    "(?:abc)?def": {"abcdef", "def"},
    "(?:ab){2,}": {"abab"},
    r"foo.bar_baz": {"bar_baz"},
    "(": None,
}


@pytest.mark.parametrize("pattern", WANT)
def test_required_literals(pattern):
    want = WANT[pattern]
    assert required_literals(pattern) == (None if want is None else frozenset(want))


def test_every_match_holds_a_literal():
    rng = random.Random(5)
    atoms = ["a", "b", "[ab]", "c?", "(?:ab|c)", "d+", "(?:da|ad){2}", ".", "[^b]", r"\b", "(?i:a)", "e{1,3}", "(?:|b)"]
    for _ in range(600):
        pattern = "".join(rng.choices(atoms, k=rng.randint(1, 6)))
        need = required_literals(pattern)
        for _ in range(40 if need else 0):
            text = "".join(rng.choices("abcdeABCDE ", k=rng.randint(1, 12)))
            for m in re.finditer(pattern, text):
                assert any(x in fold(m[0]) for x in need), (pattern, m[0], need)


def test_index_finds_just_the_literals():
    rng = random.Random(6)
    patterns = ["".join(rng.choices("abAB", k=rng.randint(2, 6))) for _ in range(80)] + ["-", r"\d", "é1é", "[0-9]x", "\U0001f600b"]
    index = LiteralIndex(patterns)
    texts = ["", *("".join(rng.choices("abAB -1é9x\0\U0001f600", k=rng.randint(0, 60))) for _ in range(200))]
    for text, got in zip(texts, index.candidates(texts)):
        assert got == [i for i, p in enumerate(patterns) if (n := required_literals(p)) is None or any(x in fold(text) for x in n)]


def parts(spark, texts):
    rows = [("m", i, "body" if i % 2 else "subject", "b", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "message_id string, component_idx int, component_type string, component_name string, content string")


def test_same_rows_as_without_candidates(spark):
    patterns = {i.name: i.patterns[0] for i in IDENTIFIERS} | {f"secret {i}": p for i, p in enumerate(SECRET_PATTERNS)} | {"any": r"[a-z]{2}\d", "word": r"\bfour\b", "mixed": "(?i)ÉTÉ"}
    texts = [None, "", "4111111111111111 and 123-45-6789", "api_key = 'abcdefghijklmnopqrstuvwxyz'", "x@example.com four fouré ab1 Été", "password: 'longenough'", "b" * 100_000 + "ab1", "-----BEGIN PRIVATE KEY-----", "four four"]
    for types in (None, ["body"]):
        assert sorted(scan_many(parts(spark, texts), patterns, types).collect()) == sorted(scan_regex(parts(spark, texts), patterns, types).collect())


def test_pieces_hold_the_same_matches():
    rng = random.Random(7)
    atoms = ["a", "b", "ab", "[ab]", "c?", "(?:ab|c)", "(?:da|ad){2}", ".", "[^b]", r"\b", "e{1,3}", "^", "$"]
    for _ in range(400):
        pattern = "".join(rng.choices(atoms, k=rng.randint(1, 6)))
        if re.search(pattern, "") or re.search(pattern, "zz") and re.search(pattern, "zz")[0] == "":
            continue
        texts = ["".join(rng.choices("abcde \n", k=rng.randint(0, 60))) for _ in range(10)]
        for t, pieces in zip(texts, LiteralIndex([pattern]).pieces(texts)):
            got = sorted((a + m.start(), m[0]) for _, a, z in pieces for m in re.finditer(pattern, t if z < 0 else t[a:z]) if m[0])
            assert got == sorted((m.start(), m[0]) for m in re.finditer(pattern, t) if m[0]), (pattern, t)


def test_no_texts(spark):
    assert scan_many(parts(spark, []), {"a": "abc"}).collect() == []


def test_few_patterns_run(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    patterns = [rf"\bvendor{i:03}[_-]?(?:key|token)\s*[:=]\s*[A-Za-z0-9]{{8,}}" for i in range(500)]
    found = LiteralIndex(patterns).candidates(texts)
    assert sum(map(len, found)) == 0
    assert all(required_literals(p) for p in patterns)
    assert [re.compile(java(p)) for p in patterns[:3]]
