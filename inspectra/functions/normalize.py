"""Decoded variants of texts: percent escapes, HTML entities, embedded base64; and the text that fingerprints see."""

from __future__ import annotations

import base64
import html
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectra.functions.steps import each_in_steps

MOST_PASSES = 5
_BASE64 = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
LEAST_PRINTABLE = 0.8


def _decode_run(m: re.Match[str]) -> str:
    run = m[0]
    try:
        plain = base64.b64decode(run, validate=True).decode("utf-8")
    except ValueError:
        return run
    good = sum(c.isprintable() or c in "\t\r\n" for c in plain)
    return plain if plain and good >= LEAST_PRINTABLE * len(plain) else run


def decode_once(text: str) -> str:
    """One pass: percent escapes (a plus stays), entities, base64 runs of 32 characters or more that hold readable text."""
    return _BASE64.sub(_decode_run, html.unescape(unquote(text, errors="replace")))


def variant_list(text: str | None) -> list[str]:
    """The text and what up to MOST_PASSES passes make of it, each once."""
    out = [] if text is None else [text]
    while text is not None and len(out) <= MOST_PASSES:
        text = decode_once(text)
        if text in out:
            break
        out.append(text)
    return out


variants = each_in_steps(T.ArrayType(T.StringType()), variant_list)


def with_variants(components: DataFrame) -> DataFrame:
    """Components, and one more of the same type for each decoded variant of a body, an attachment or a subject."""
    decoded = components.where(F.col("component_type").isin("body", "attachment", "subject"))
    # inside the generator: of a column of its own the optimizer would make a filter that calls the UDF once more
    more = decoded.select("*", F.posexplode(variants("content")).alias("n", "decoded")).where("n > 0").withColumn("content", F.col("decoded"))
    return components.withColumn("normalized", F.lit(False)).unionByName(more.drop("n", "decoded").withColumn("normalized", F.lit(True)))


#: What fingerprints see as blanks; most characters of most texts, which the patterns tell at once.
_BLANK, _PLAIN = r"\s\x{85}\p{Z}\x1c-\x1f", "abcdefghijklmnopqrstuvwxyz0123456789_ "


def fingerprint_text(text: Column) -> Column:
    """Lower case, only letters, digits, underscores and single blanks."""
    kept = F.regexp_replace(F.lower(text), rf"[[^{_PLAIN}]&&[^\p{{L}}\p{{N}}_{_BLANK}]]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, rf"[[^{_PLAIN}]&&[{_BLANK}]]", " "), "  +", " "))
