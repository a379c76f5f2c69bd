"""Scans with hundreds of patterns: an index of the literals that patterns ask for picks each text's candidates, and only those run.

From each pattern come literals of which every match holds one (`required_literals`). A literal is found by one of its grams of up to
five characters: an index from grams to literals is looked up for all characters of a batch at once, what it finds is compared with the whole literal, and
the patterns of the literals that are there are the text's candidates. Patterns without such a literal are every text's candidates.
The candidates are rows then, and Spark's own regular expressions find the matches; where a pattern's matches are of bounded length, they
see only the text around its literals. So a text costs one pass, and what it costs beyond that grows with the places that
may match, not with the number of patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import product
from re import _constants as C  # the standard library's parser of regular expressions, whose syntax holds RE2's common part
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectra.functions.patterns import java, spans
from inspectra.functions.steps import in_steps
from inspectra.operators.scan import targeted
from inspectra.schema import MATCH_COLUMNS

#: Literals of one pattern at most, and their length; characters of a class that is spelled out.
MOST_LITERALS, MOST_LENGTH, MOST_CLASS = 32, 24, 10
GRAM = 5
#: Patterns whose matches may be longer are tried on whole texts; characters beside a match that anchors may look at.
MOST_WIDTH, BESIDE = 500, 2
#: What Python's parser reads in another way than RE2 and Java do.
UNLIKE = re.compile(r"\[\[:|\\[QEpPhHRXGCzZkKvVNu]|&&|\(\?[a-zA-Z]*[xU]|\[[^\]]*\[")
#: Between texts: no character.
_STOP = 0x110000
_MULTIPLIER = np.int64(0x5851F42D4C957F2D)


def _best(*choices: frozenset[str] | None) -> frozenset[str] | None:
    """The most telling set of literals: the longest least one, then the fewest."""
    some = [c for c in choices if c and all(c)]
    return max(some, key=lambda c: (min(min(map(len, c)), GRAM), -len(c), sorted(c)), default=None)


class _Literals:
    """Of a parsed pattern, for each part: the texts it matches (exact; None if many), and literals of which each match holds one."""

    def __init__(self, ignore_case: bool):
        self.ignore_case = ignore_case

    def char(self, code: int) -> str | None:
        c = chr(code)
        # letters that other letters than their ASCII partners match without regard to case
        if self.ignore_case and (c.lower() in "iks" or not c.isascii()):
            return None
        return fold(c)

    def sequence(self, parts: Iterable) -> tuple[frozenset[str] | None, frozenset[str] | None]:
        run, needs, whole = frozenset([""]), [], True
        for op, of in (x for p in parts for x in self.split(*p)):
            exact, need = self.part(op, of)
            tells = min(map(len, run)) >= 3 and exact is not None and len(exact) > 3  # a class would only multiply what is long enough
            joined = frozenset(a + b for a, b in product(run, exact)) if exact is not None and not tells and len(run) * len(exact) <= MOST_LITERALS else None
            if joined is not None and max(map(len, joined)) <= MOST_LENGTH:
                run = joined
                continue
            needs += [run, need if exact is None else exact]
            run, whole = exact if exact is not None and max(map(len, exact)) <= MOST_LENGTH else frozenset([""]), False
        return (run, _best(run)) if whole else (None, _best(run, *needs))

    @staticmethod
    def split(op, of) -> list[tuple]:  # noqa: ANN001
        """A repetition as its least times and the rest."""
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and 0 < of[0] < of[1]:
            return [(op, (of[0], of[0], of[2])), (op, (0, of[1] - of[0] if of[1] is not C.MAXREPEAT else of[1], of[2]))]
        return [(op, of)]

    def part(self, op, of) -> tuple[frozenset[str] | None, frozenset[str] | None]:  # noqa: ANN001
        none = (None, None)
        if op is C.LITERAL:
            c = self.char(of)
            return none if c is None else (frozenset([c]), frozenset([c]))
        if op is C.IN:
            codes: list[int] = []
            for kind, x in of:
                codes += [x] if kind is C.LITERAL else range(x[0], min(x[1], x[0] + 64) + 1) if kind is C.RANGE else range(48, 58) if x is C.CATEGORY_DIGIT else range(99)
                if kind in (C.NEGATE,) or len(codes) > 2 * MOST_CLASS:
                    return none
            chars = [self.char(x) for x in codes]
            return none if None in chars or len(set(chars)) > MOST_CLASS else (frozenset(chars), frozenset(chars))
        if op is C.BRANCH:
            each = [self.sequence(x) for x in of[1]]
            exact = frozenset().union(*(e for e, _ in each)) if all(e is not None for e, _ in each) else None
            needs = [n if e is None else _best(e) for e, n in each]
            need = frozenset().union(*needs) if all(needs) else None
            small = lambda s: s if s and len(s) <= MOST_LITERALS else None
            return small(exact), small(need)
        if op is C.SUBPATTERN:
            return none if of[1] or of[2] else self.sequence(of[3])
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            return frozenset([""]), None
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = of
            exact, need = self.sequence(inner)
            if least == 0:
                return (exact | {""} if most == 1 and exact is not None else None), None
            if exact is not None and len(exact) ** least <= MOST_LITERALS and least <= MOST_LENGTH:
                all_of = frozenset(map("".join, product(exact, repeat=least)))
                return (all_of if most == least else None), _best(all_of)
            return None, need
        return none


def fold(text: str) -> str:
    """ASCII letters in lower case."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def required_literals(pattern: str) -> frozenset[str] | None:
    """Folded literals of which each match of a pattern (as RE2 has it) holds one; None if there are none that tell anything."""
    if UNLIKE.search(pattern):
        return None
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    exact, need = _Literals(bool(parsed.state.flags & re.IGNORECASE or re.search(r"\(\?[a-z]*i", pattern))).sequence(parsed)
    found = _best(exact, need)
    return None if found is None or any(len(x) < 2 and x.isalpha() for x in found) else found


def greatest_width(pattern: str) -> int:
    """Characters of a match at most; -1 if they aren't bounded by MOST_WIDTH, or if the pattern looks around."""
    width = int(_parser.parse(pattern).getwidth()[1])
    return width if width <= MOST_WIDTH and not re.search(r"\(\?[=!<]", pattern) else -1


class LiteralIndex:
    """From grams to literals to patterns."""

    def __init__(self, patterns: list[str]):
        needed = [required_literals(p) for p in patterns]
        self.width = np.array([-1 if n is None else greatest_width(p) for p, n in zip(patterns, needed)], np.int64)
        self.always = np.array([i for i, n in enumerate(needed) if n is None], np.int64)
        asked: dict[str, list[int]] = {}
        for i, n in enumerate(needed):
            for x in n or ():
                asked.setdefault(x, []).append(i)
        self.literals = sorted(asked)
        owners = [asked[x] for x in self.literals]
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owners = np.array([i for o in owners for i in o], np.int64)
        self.size = np.array(list(map(len, self.literals)), np.int64)
        self.points = np.full((len(self.literals), max(self.size, default=0)), -1, np.int64)
        for row, x in zip(self.points, self.literals):
            row[: len(x)] = list(map(ord, x))
        # of a literal's grams the one that the fewest others hold
        grams = [[x[k : k + GRAM] for k in range(max(1, len(x) - GRAM + 1))] for x in self.literals]
        shared: dict[str, int] = {}
        for g in {(x, y) for x, gs in zip(self.literals, grams) for y in gs}:
            shared[g[1]] = shared.get(g[1], 0) + 1
        self.offset = np.array([min(range(len(gs)), key=lambda k: (shared[gs[k]], k)) for gs in grams], np.int64)
        self.by_gram: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, GRAM + 1):
            mine = np.flatnonzero(np.minimum(self.size, GRAM) == n)
            if len(mine):
                codes = self._codes(np.stack([self.points[mine, self.offset[mine] + k] for k in range(n)]))
                order = np.argsort(codes, kind="stable")
                keys, first = np.unique(codes[order], return_index=True)
                seen = np.zeros(1 << 20, bool)
                seen[self._short(keys)] = True
                self.by_gram[n] = (seen, keys, np.append(first, len(mine)), mine[order])

    @staticmethod
    def _codes(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1], np.int64)
        for c in columns:
            out = out * _MULTIPLIER + c  # a hash: what it finds is compared with the literal
        return out

    @staticmethod
    def _short(codes: np.ndarray) -> np.ndarray:
        return (codes ^ codes >> 17 ^ codes >> 37) & 0xFFFFF

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, place in the text) of the literals in all texts."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        points = np.full(ends[-1] + self.points.shape[1], _STOP, np.int64)
        points[: ends[-1]] = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        points[ends - 1] = _STOP
        points = np.where((points >= 65) & (points <= 90), points + 32, points)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for n, (seen, keys, first, literals) in self.by_gram.items():
            codes = points[: ends[-1]]
            for k in range(1, n):
                codes = codes * _MULTIPLIER + points[k : k + ends[-1]]
            at = np.flatnonzero(seen[self._short(codes)])
            slot = np.searchsorted(keys, codes[at])
            same = keys[np.minimum(slot, len(keys) - 1)] == codes[at]
            at, slot = at[same], slot[same]
            many = first[slot + 1] - first[slot]
            row = np.repeat(np.arange(len(at)), many)
            literal = literals[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[slot][row]]
            begin = at[row] - self.offset[literal]
            good = begin >= 0
            begin, literal = begin[good], literal[good]
            for k in range(int(self.size[literal].max(initial=0))):
                fits = (self.size[literal] <= k) | (points[np.minimum(begin + k, len(points) - 1)] == self.points[literal, k])
                begin, literal = begin[fits], literal[fits]
            text = np.searchsorted(ends, begin, "right")
            begin = begin - np.concatenate([[0], ends[:-1]])[text]
            many = self.owner_at[literal + 1] - self.owner_at[literal]
            owner = self.owners[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.owner_at[literal], many)]
            for out, x in zip(found, (np.repeat(text, many), owner, np.repeat(begin, many))):
                out.append(x)
        return tuple(map(np.concatenate, found))

    def pieces(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text (pattern, start, end) of all parts in which matches may lie, each match in one; end -1: the whole text."""
        text, pattern, at = self.places(texts)
        width = self.width[pattern]
        start = np.where(width < 0, 0, np.maximum(0, at - width - BESIDE))
        end = np.where(width < 0, -1, np.minimum(np.array(list(map(len, texts)))[text], at + width + BESIDE))
        order = np.lexsort((start, pattern, text))
        text, pattern, start, end = text[order], pattern[order], start[order], end[order]
        # parts that touch are one; ends ascend with starts
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (pattern[1:] != pattern[:-1]) | ((start[1:] > end[:-1]) & (end[:-1] >= 0))
        first = np.flatnonzero(new)
        out: list[list[tuple[int, int, int]]] = [[(int(i), 0, -1) for i in self.always] for _ in texts]
        for t, p, a, z in zip(text[first].tolist(), pattern[first].tolist(), start[first].tolist(), end[np.append(first[1:], len(new)) - 1].tolist()) if len(first) else ():
            out[t].append((p, a, z))
        return out

    def candidates(self, texts: list[str]) -> list[list[int]]:
        """The numbers of the patterns that each text may match, ascending."""
        return [sorted({p for p, _, _ in x}) for x in self.pieces(texts)]


def pieces_of(patterns: list[str]) -> Callable:
    """A UDF of texts: what the patterns are to be tried on, as (pattern, at, text; null for the whole)."""

    def start() -> Callable[[list], list]:
        index = LiteralIndex(patterns)

        def pieces(column: list[str | None]) -> list[list[dict]]:
            texts = [t or "" for t in column]
            return [[{"pattern": p, "at": a, "text": None if z < 0 else t[a:z]} for p, a, z in x] for t, x in zip(texts, index.pieces(texts))]

        return pieces

    return in_steps(T.ArrayType(T.StructType().add("pattern", "integer").add("at", "integer").add("text", "string")), start)


def scan_many(components: DataFrame, patterns: dict[str, str], types: Iterable[str] | None = None, analyzer: str = "regex") -> DataFrame:
    """Matches of all patterns (by name, as RE2 has them; they match no empty text), as run_probes gives them."""
    some = targeted(components, types).where(F.coalesce(F.col("content"), F.lit("")) != "")
    named = some.sparkSession.createDataFrame([(i, n, java(p)) for i, (n, p) in enumerate(patterns.items())], "_pattern int, rule_name string, _regex string")
    key = ("message_id", "component_idx", "component_type", "component_name")
    # inside the generator: of a column of its own the optimizer would make a filter that calls the UDF once more
    tried = some.select(*key, "content", F.explode(pieces_of(list(patterns.values()))("content")).alias("p"))
    tried = tried.select(*key, F.coalesce("p.text", "content").alias("_text"), "p.at", F.col("p.pattern").alias("_pattern"))
    # a table of patterns, not of data
    hits = tried.join(F.broadcast(named), "_pattern").select(*key, "rule_name", "at", F.explode(spans(F.col("_text"), F.col("_regex"))).alias("s"))
    found = hits.select(*key, F.lit(analyzer).alias("analyzer_name"), "rule_name", F.col("s.text").alias("matched_text"), (F.col("at") + F.col("s.start")).alias("start_offset"), (F.col("at") + F.col("s.end")).alias("end_offset"), F.lit(1.0).alias("confidence"))
    return found.select(*MATCH_COLUMNS)
