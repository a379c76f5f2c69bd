"""Scans: regular expressions, identifiers, keywords and proximity over components, all patterns in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectra.functions.patterns import java, keyword, spans
from inspectra.functions.steps import in_steps
from inspectra.functions.validators import validator
from inspectra.plans.catalog import IDENTIFIERS, Identifier
from inspectra.schema import MATCH_COLUMNS, MATCHES

WORD_TOKENS = r"[\p{L}\p{N}_]+"
#: Letters that a pattern without regard to case takes for ASCII letters, or the other way round, and lower case doesn't.
ODD = "[\u017f\u0130\u0131]"


def targeted(components: DataFrame, types: Iterable[str] | None) -> DataFrame:
    """Components of these types, and generic ones always; all if none are named."""
    return components if types is None else components.where(F.col("component_type").isin(*types, "generic"))


@dataclass(frozen=True)
class Probe:
    """One pattern of a fused scan."""

    analyzer: str
    rule: str
    pattern: str  # as Java has it
    confidence: float = 1.0
    check: Callable[[Column], Column] | None = None
    needs: Callable[[Column], Column] | None = None  # a cheap test that every text with a match passes
    word: str | None = None  # in lower case: what each text with a match holds in lower case, or it holds one of ODD


def run_probes(components: DataFrame, probes: list[Probe], types: Iterable[str] | None = None) -> DataFrame:
    """Matches of all probes: each text is read once, and texts that match nothing give no row."""
    text = F.col("content")

    def hits_of(p: Probe) -> Column:
        needs = None if p.needs is None else p.needs(text)
        if p.word is not None:
            may = F.col("_lower").contains(p.word) | F.col("_odd")
            needs = may if needs is None else needs & may
        found = spans(text, p.pattern, needs)
        found = found if p.check is None else F.filter(found, lambda s: p.check(s["text"]))
        name = (F.lit(p.analyzer).alias("analyzer_name"), F.lit(p.rule).alias("rule_name"))
        return F.transform(found, lambda s: F.struct(*name, s["text"].alias("matched_text"), s["start"].alias("start_offset"), s["end"].alias("end_offset"), F.lit(float(p.confidence)).alias("confidence")))

    hits = [hits_of(p) for p in probes]
    some = targeted(components, types).where(F.col("content").isNotNull() & (F.col("content") != ""))
    if any(p.word is not None for p in probes):
        # columns of their own, so that a text is put in lower case once and not for each word
        some = some.withColumns({"_lower": F.lower(text), "_odd": text.rlike(ODD)})
    rows = some.select("message_id", "component_idx", "component_type", "component_name", F.explode(F.concat(*hits) if len(hits) > 1 else hits[0]).alias("hit"))
    return rows.select("message_id", "component_idx", "component_type", "component_name", "hit.*").select(*MATCH_COLUMNS)


def regex_probes(patterns: dict[str, str], analyzer: str = "regex") -> list[Probe]:
    return [Probe(analyzer, name, java(p)) for name, p in patterns.items()]


def identifier_probes(identifiers: Iterable[Identifier] = IDENTIFIERS, analyzer: str = "data_identifier", custom: dict[str, Callable[[Column], Column]] | None = None) -> list[Probe]:
    """Every pattern of every identifier; one that two patterns match is reported twice."""
    holds = lambda n: (lambda text: text.rlike(n)) if n else None
    return [Probe(analyzer, i.name, java(p), i.confidence, validator(i.validator, custom) if i.validator else None, holds(i.needs)) for i in identifiers for p in i.patterns]


def keyword_probes(dictionary: str, words: Iterable[str], case_sensitive: bool = False, whole_word: bool = True, analyzer: str = "keyword") -> list[Probe]:
    """One probe for each word; hits of different words may overlap. Words that are equal but for case count once, the last."""
    kept = {w if case_sensitive else w.lower(): w for w in words if w}

    def probe(w: str) -> Probe:
        pattern = keyword(w, whole_word, case_sensitive)
        if case_sensitive:
            return Probe(analyzer, f"{dictionary}:{w}", pattern, needs=lambda text: text.contains(w))
        return Probe(analyzer, f"{dictionary}:{w}", pattern, word=w.lower() if w.isascii() else None)

    return [probe(w) for w in kept.values()]


def scan_regex(components: DataFrame, patterns: dict[str, str], types: Iterable[str] | None = None) -> DataFrame:
    return run_probes(components, regex_probes(patterns), types)


def scan_identifiers(components: DataFrame, identifiers: Iterable[Identifier] = IDENTIFIERS, types: Iterable[str] | None = None) -> DataFrame:
    return run_probes(components, identifier_probes(identifiers), types)


def scan_keywords(components: DataFrame, dictionary: str, words: Iterable[str], case_sensitive: bool = False, whole_word: bool = True, types: Iterable[str] | None = None) -> DataFrame:
    return run_probes(components, keyword_probes(dictionary, words, case_sensitive, whole_word), types)


def _folded(text: str) -> str:
    """Lower case, character by character where it would change the text's length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def scan_large_dictionary(components: DataFrame, dictionary: str, words: Iterable[str | tuple[str, bool, bool]], case_sensitive: bool = False, whole_word: bool = True) -> DataFrame:
    """Keywords by one automaton for each task, for dictionaries of hundreds of words and for hits of one word that overlap.

    A word may bring its own (word, case_sensitive, whole_word); of words that are equal but for case the last counts.
    """
    asked = [(w, case_sensitive, whole_word) if isinstance(w, str) else w for w in words]
    kept = {_folded(w): (w, cased, whole) for w, cased, whole in asked if w}
    fields = T.StructType().add("rule_name", "string").add("matched_text", "string").add("start_offset", "integer").add("end_offset", "integer")

    def start() -> Callable[[list], list]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for low, entry in kept.items():
            machine.add_word(low, entry)
        if kept:
            machine.make_automaton()
        is_word = lambda c: c.isalnum() or c == "_"

        def find(text: str | None) -> list[dict]:
            out, low = [], _folded(text or "")
            for last, (w, cased, whole) in machine.iter(low) if low and kept else ():
                a, z = last - len(w) + 1, last + 1
                inside = whole and ((a and is_word(low[a - 1])) or (z < len(low) and is_word(low[z])))
                if not inside and (not cased or text[a:z] == w):
                    out.append({"rule_name": f"{dictionary}:{w}", "matched_text": text[a:z], "start_offset": a, "end_offset": z})
            return out

        return lambda texts: list(map(find, texts))

    hits = in_steps(T.ArrayType(fields), start)
    rows = components.select("message_id", "component_idx", "component_type", "component_name", F.explode(hits("content")).alias("hit"))
    return rows.select("message_id", "component_idx", "component_type", "component_name", F.lit("keyword").alias("analyzer_name"), "hit.*", F.lit(1.0).alias("confidence")).select(*MATCH_COLUMNS)


def scan_proximity(components: DataFrame, rule: str, first: str, second: str, most_between: int, case_sensitive: bool = False) -> DataFrame:
    """Pairs of the two words with at most so many tokens between them, in either order; the match reaches from one to the other.

    The tokens of the two words join on the component and on neighbouring windows of positions, so that pairs far apart never meet.
    Texts without both words give no token, others those two only.
    """
    want = (first, second) if case_sensitive else (first.lower(), second.lower())
    folded = (lambda c: c) if case_sensitive else F.lower
    some = components.where(folded(F.col("content")).contains(want[0]) & folded(F.col("content")).contains(want[1]))
    numbered = F.transform(spans(F.col("content"), WORD_TOKENS), lambda s, i: F.struct(i.alias("i"), s.alias("t")))
    said_now = F.filter(numbered, lambda x: folded(x["t"]["text"]).isin(*want))
    tokens = some.select("message_id", "component_idx", "component_type", "component_name", "content", F.explode(said_now).alias("x")).select("message_id", "component_idx", "component_type", "component_name", "content", "x.i", "x.t")
    said = folded(F.col("t.text"))
    key, width = ["message_id", "component_idx"], most_between + 1
    window = F.floor(F.col("i") / width)
    a = tokens.where(said == want[0]).select("*", F.explode(F.array(window - 1, window, window + 1)).alias("w")).drop("content")
    b = tokens.where(said == want[1]).select(*key, F.col("i").alias("j"), F.col("t").alias("u"), window.alias("w"), "content")
    near = a.join(b, [*key, "w"]).where((F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) - 1 <= most_between))
    start, end = F.least("t.start", "u.start"), F.greatest("t.end", "u.end")
    hit = near.select(*key, "component_type", "component_name", F.lit("keyword").alias("analyzer_name"), F.lit(rule).alias("rule_name"), F.substring("content", start + 1, end - start).alias("matched_text"), start.alias("start_offset"), end.alias("end_offset"), F.lit(1.0).alias("confidence"))
    return hit.select(*MATCH_COLUMNS)


def all_matches(*scans: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, scans)


class Engine:
    """Named analyzers (functions of components) that run in the order in which they were added."""

    def __init__(self) -> None:
        self.analyzers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, analyzer: Callable[[DataFrame], DataFrame]) -> Engine:
        if name in self.analyzers:
            raise ValueError(f"analyzer {name} is there already")
        if not callable(analyzer):
            raise TypeError("an analyzer is a function of components")
        self.analyzers[name] = analyzer
        return self

    def detect(self, components: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """Matches of all analyzers, and what those said that couldn't be planned."""
        found, errors = [], {}
        for name, analyzer in self.analyzers.items():
            try:
                found.append(analyzer(components))
            except Exception as e:  # one analyzer's failure leaves the others' matches
                errors[name] = f"{type(e).__name__}: {e}"
        return all_matches(*found) if found else components.sparkSession.createDataFrame([], MATCHES), errors


def match_counts(matches: DataFrame, *by: str) -> DataFrame:
    return matches.groupBy(*(by or ("analyzer_name", "rule_name", "component_type"))).agg(F.count("*").alias("n_matches"), F.countDistinct("message_id").alias("n_messages"))
