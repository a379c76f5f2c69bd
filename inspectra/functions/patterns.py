"""Patterns written for RE2, as Java understands them, and the places of their matches without a UDF."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
#: A boundary between ASCII word characters and others, as RE2's \b; Java's looks at Unicode letters too.
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
SPACES = r"\t\n\f\r "
#: Letters, digits and the underscore of all scripts.
UNICODE_WORD = r"[\p{L}\p{N}_]"
SPANS = "array<struct<start:int,end:int,text:string>>"


def _begins_with_word(pattern: str) -> bool:
    """Whether every match begins with an ASCII word character, as far as is easily seen."""
    if pattern.startswith("(?:"):
        depth, parts, last, i = 0, [], 3, 3
        while i < len(pattern) and depth >= 0:
            c = pattern[i]
            depth += (c == "(") - (c == ")")
            if (c == "|" and depth == 0) or depth < 0:
                parts.append(pattern[last:i])
                last = i + 1
            i += 2 if c == "\\" else 1
        return not re.match(r"[?*]|\{0", pattern[i:]) and all(map(_begins_with_word, parts))
    atom = re.match(r"\\d|\[(?:[A-Za-z]-[A-Za-z]|\d-\d|[A-Za-z0-9])+\]|[A-Za-z0-9]", pattern)
    return bool(atom) and not re.match(r"[?*|]|\{0", pattern[atom.end() :])


def java(pattern: str) -> str:
    """The pattern with \\b, \\B and \\s replaced by what RE2 means by them."""
    if pattern.startswith(r"\b") and _begins_with_word(pattern[2:]):
        return f"(?<!{_WORD})" + java(pattern[2:])  # half of BOUNDARY, which is tried at every character
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\" and len(two) == 2:
            swap = {r"\s": SPACES if inside else f"[{SPACES}]", r"\S": f"[^{SPACES}]", r"\b": BOUNDARY, r"\B": NO_BOUNDARY}
            out.append(two if inside and two != r"\s" else swap.get(two, two))
            i += 2
            continue
        if two[0] == "[" and not inside:
            inside = True
        elif two[0] == "]" and inside and out[-1] not in ("[", "^"):
            inside = False
        out.append(two[0])
        i += 1
    return "".join(out)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once: a lambda's body computes all that isn't its variable anew for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """op over an array's integers up to each place, the place itself left out. op is associative and zero neutral.

    There are as many blocks as a block has values, so that no array grows one by one for long.
    """
    none, start = F.array().cast("array<int>"), F.lit(zero)

    def fold(x: Column, first: Column) -> Column:
        add = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(x, F.struct(first.alias("at"), none.alias("all")), add, lambda acc: acc["all"])

    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), width)).otherwise(none)
        return F.transform(starts, lambda i: F.slice(v, i, width))

    def joined(b: Column) -> Column:
        totals = F.transform(b, lambda x: F.aggregate(x, start, op))
        return F.flatten(F.transform(F.arrays_zip(b.alias("b"), fold(totals, start).alias("at")), lambda z: fold(z["b"], z["at"])))

    return let(let(values, blocks), joined)


def running_sums(values: Column) -> Column:
    return running(values, 0, lambda a, v: a + v)


def spans(text: Column, pattern: str | Column, needs: Column | None = None) -> Column:
    """(start, end, text) of each non-overlapping match of a Java pattern (or of each row's own) that matches no empty text; code points, end exclusive.

    needs: a cheap test that each text with a match passes.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = let(found, lambda f: F.arrays_zip(F.slice(gaps, 1, F.size(f)).alias("gap"), f.alias("text")))
    def placed(m: Column, at: Column) -> Column:
        start = at + m["gap"]
        return F.struct(start.alias("start"), (start + F.length(m["text"])).alias("end"), m["text"].alias("text"))

    # a cheap test first: most texts match nothing
    hit = F.rlike(text, pattern)
    some = hit if needs is None else needs & hit
    return F.when(some, let(both, lambda b: F.zip_with(b, running_sums(F.transform(b, lambda m: m["gap"] + F.length(m["text"]))), placed))).otherwise(F.array().cast(SPANS))


def literal(words: str) -> str:
    """The pattern that matches just these characters."""
    return re.sub(r"([\\.\[\]{}()*+?^$|/&~#\-])", r"\\\1", words)


def keyword(words: str, whole_word: bool = True, case_sensitive: bool = False) -> str:
    body = literal(words)
    if whole_word:
        body = f"(?<!{UNICODE_WORD}){body}(?!{UNICODE_WORD})"
    return body if case_sensitive else f"(?iu){body}"


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole name, in lower case."""
    out, i = [], 0
    pattern = pattern.lower()
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(literal(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
