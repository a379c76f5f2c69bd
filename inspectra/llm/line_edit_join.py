"""Line dedup by a segment-partition edit join: a line goes if an earlier line is equal or within a few edits.

Lines of LEAST_CHARS or more take part: only empty ones always stay. Lines under EDIT_CHARS go for equal lines only, as one edit
makes another word of them. Of equal lines the first in the first document stays, documents being ordered by doc_id and the hash of
their text. Of two different near lines that one goes which comes later by (its first document, hash, text), whether or
not the earlier one goes too. Near are lines within k edits, k by the shorter one's length: one for every CHARS_PER_EDIT
characters, 1 at least and `most` (MOST) at most.

Equal lines meet by their hashes alone, so that no text is shuffled for them.

Pairs within one edit: threshold 1 gives two segments. One edit leaves one of them as it is, so each line is indexed by (length, segment number,
segment), and probed with its own segments and those of a line shorter by one. A key that more than HOT lines share is split
again: what lies outside the segment holds the edit, so its halves are the next two segments. When that rest is at most
LEAST_REST characters, the remaining groups go by what is left when any one character is taken out: lines of one such group are
within one edit of each other, so the earliest stands for it. All groups thus stay bounded or cost as much as they have rows.
Candidates are verified by Spark's banded edit distance (a bit-parallel one would need Python).

Pairs within k > 1 edits (lines of 2 * CHARS_PER_EDIT characters or more): a layout belongs to a range of lengths and has k + 1 cells of the
range's least length / (k + 1) characters, the first half of them counted from the line's start, the others from its end. The shorter line's
length gives the layout; a line that may be the longer one of another range has that layout too. Of k edits there are, for one cell, none in
it and at most i in the i cells before it and k - i after, so that its text is found in the other line at a place moved by at most as
many. What stands at each such place would be 41 keys for 9 cells; a key is therefore what begins at the place's first space, and places with the same
one give one row (about 1.7 a cell). Lines without spaces give all. First one shuffle of keys and hashes finds the keys that two lines
share; only those and their lines' texts are kept. Keys that a sample of documents shows often are dealt to SALTS groups and taken to be
shared. Pairs must also agree in how often 16 letters and all others occur in the first three eighths and the last five, and in the first five and the
last three: each edit changes either sum by two at most. Texts are compared without what both begin and end with, as Spark's
`levenshtein` takes time by the square of the length. In hot groups all
members first meet LEADERS early ones; only those that still have no earlier near line meet all that come before them. This is exact; few rows come of a
group whose lines are not near each other, but its comparisons grow with its square.

Edge cases: a null text has no lines and stays null; an empty table gives an empty result; rows with equal doc_ids and different
texts are different documents; null doc_ids come first; repeated rows get the same result; a text of any length and number of lines is taken
whole; other columns are kept, whatever their names, if they don't begin with `_line_`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectra.functions.patterns import let
from inspectra.llm.common import replaced, table, written

LEAST_CHARS, EDIT_CHARS, LEAST_REST, HOT = 1, 10, 8, 32
CHARS_PER_EDIT, MOST, LEADERS = 32, 8, 3
#: Characters in which a cell's first space is looked for, and the least length of a key.
SPACE_WITHIN, LEAST_KEY = 12, 16
#: Documents in which keys are counted beforehand, how many of them make a key a frequent one, and the groups it is dealt to.
SAMPLE_DOCS, FREQUENT, SALTS = 5_000, 16, 64
#: Letters whose numbers near lines have nearly in common.
LETTERS = "eatinsrohdlugwb "
#: Of a line's first three eighths, first five, last three and last five: codes of its letters' numbers, and how many other characters there are.
CODES, OTHERS = [f"f{i}" for i in range(4)], [f"o{i}" for i in range(4)]
#: Hashes of candidate lines up to which they are broadcast (8 MB).
BROADCAST = 1_000_000
OWN = ("_line_h", "_line_g")


def _h(line: Column) -> Column:
    return F.xxhash64(line)


def _g(line: Column) -> Column:
    return F.xxhash64(F.lit(7), line)


def _doc(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.struct(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("t"))


def _each_line(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """doc, line and h of the lines, `least` characters long or more, of every text."""
    lines = docs.select(_doc(docs, id_col, text_col).alias("doc"), F.explode(F.split(docs[text_col].cast("string"), "\n", -1)).alias("line")).where(F.length("line") >= least)
    return lines.withColumn("h", _h(F.col("line")))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """line, doc (the first that has it) and h, written to the shared folder."""
    return written(lines.groupBy("line").agg(F.min("doc").alias("doc")).withColumn("h", _h(F.col("line"))), "lines")


def _entries(lines: DataFrame) -> DataFrame:
    """more 0: the line as indexed, 1: as the longer of two lines. The rest (start, n) is n + more characters long."""
    kinds = F.array(*(F.struct(F.lit(m).alias("more"), (F.length("line") - m).alias("n")) for m in (0, 1)))
    return lines.select("line", "doc", "h", F.explode(kinds).alias("k")).select("line", "doc", "h", "k.more", F.lit(1).alias("start"), "k.n", F.xxhash64("k.n").alias("key"))


def _split(entries: DataFrame) -> DataFrame:
    """Each entry twice: its rest's first half as a segment and its second half as one."""
    half = F.floor(F.col("n") / 2).cast("int")
    last = F.col("start") + half + F.col("more")
    first = F.struct(F.xxhash64("key", F.lit(0), F.substring("line", F.col("start"), half)).alias("key"), (F.col("start") + half).alias("start"), (F.col("n") - half).alias("n"))
    second = F.struct(F.xxhash64("key", F.lit(1), F.substring("line", last, F.col("n") - half)).alias("key"), F.col("start"), half.alias("n"))
    return entries.select("line", "doc", "h", "more", F.explode(F.array(first, second)).alias("k")).select("line", "doc", "h", "more", "k.start", "k.n", "k.key")


def _pairs(entries: DataFrame) -> DataFrame:
    """Hashes of lines with a key in common, of equal length or with the longer one on the right."""
    a = entries.where("more = 0").select("key", F.col("h").alias("a"))
    b = entries.select("key", "more", F.col("h").alias("b"))
    return a.join(b, "key").where("(more = 1 AND a <> b) OR a < b").select("a", "b")


def _last_pairs(entries: DataFrame) -> DataFrame:
    """Pairs among entries whose rest is short, by the rest without any one of its characters."""
    size = F.col("n") + F.col("more")
    rest = F.substring("line", F.col("start"), size)
    # the kind of group goes into its key: a character replaced at place i (1 ..), or one that only the longer line has (0)
    without = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.when(F.col("more") == 0, i).otherwise(0).alias("i"), F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, size - i)).alias("w")))
    whole = F.when(F.col("more") == 0, F.array(F.struct(F.lit(0).alias("i"), rest.alias("w"))))
    variants = F.concat(F.when(size > 0, without).otherwise(F.array().cast("array<struct<i:int,w:string>>")), F.coalesce(whole, F.array().cast("array<struct<i:int,w:string>>")))
    e = entries.select("key", "more", "doc", "h", F.explode(variants).alias("v")).select(F.xxhash64("key", "v.i", "v.w").alias("key"), "v.i", "more", "doc", "h")
    one = e.where("more = 0").groupBy("key").agg(F.min(F.struct("doc", "h")).alias("first"), F.max(F.struct("doc", "h")).alias("last")).select("key", F.col("first.h").alias("a"), F.col("last.h").alias("z"))
    met = e.join(one, "key")
    # a group of i = 0 has one indexed line; the longer ones may all come before or after it. Both ends meet everyone
    return met.select("a", F.col("h").alias("b")).union(met.select(F.col("z").alias("a"), F.col("h").alias("b"))).where("a <> b")


def near_pairs(lines: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the lines' hashes, each once."""
    entries, found, level = _split(_entries(lines)), [], 1
    while True:
        bare = entries.select("key", "more", "n", "doc", "h")
        hot = written(bare.where("more = 0 AND n > 0").groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot-keys")
        if hot.isEmpty():
            found.append(_pairs(bare))
            break
        found.append(_pairs(bare.join(hot, "key", "left_anti")))
        # the keys choose lines first, so that no text moves more than once
        some, level = lines.join(bare.join(hot, "key", "left_semi").select("h").distinct(), "h", "left_semi"), level + 1
        more = written(reduce(lambda e, _: _split(e), range(level - 1), _entries(some)).join(hot, "key", "left_semi"), "hot-lines")
        found.append(_last_pairs(more.where(F.col("n") <= LEAST_REST)))
        entries = _split(more.where(F.col("n") > LEAST_REST))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return reduce(DataFrame.union, found).select(low.alias("a"), high.alias("b")).distinct()


def edits(n: Column, most: int = MOST) -> Column:
    """The most edits between near lines of which the shorter one has n characters."""
    return F.least(F.greatest(F.floor(n / CHARS_PER_EDIT).cast("int"), F.lit(1)), F.lit(most))


def _least_length(n: Column, most: int) -> Column:
    """The least length of the range n is in: CHARS_PER_EDIT characters wide while k grows, then a fourth to an eighth of n."""
    border = CHARS_PER_EDIT * most
    wide = F.greatest(F.lit(border), n - n % F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 3))
    return F.when(n < border, n - n % CHARS_PER_EDIT).otherwise(wide)


def _letters(part: Column) -> Column:
    """code, how often each of LETTERS occurs, modulo 8, in 4 bits of which as many differ as two numbers do (four at most), and other, the characters left."""
    table = sum(code << 4 * n for n, code in enumerate((0, 1, 3, 7, 15, 14, 12, 8)))
    bits = lambda n: F.call_function("shiftright", F.lit(table), n.bitwiseAND(7) * 4).bitwiseAND(15)
    # a letter's number is known one step later, by what taking it out has left
    more = lambda s: F.shiftleft(s["code"], 4).bitwiseOR(bits(s["n"] - F.octet_length(s["rest"])))
    start = F.struct(part.alias("rest"), F.octet_length(part).alias("n"), F.lit(0).cast("long").alias("code"))
    step = lambda s, c: F.struct(F.replace(s["rest"], c, F.lit("")).alias("rest"), F.octet_length(s["rest"]).alias("n"), more(s).alias("code"))
    return F.aggregate(F.array(*map(F.lit, LETTERS)), start, step, lambda s: F.struct(more(s).alias("code"), F.length(s["rest"]).alias("other")))


def _laid(lines: DataFrame, most: int) -> DataFrame:
    """doc, h, line and n (its length) of lines, once for each layout: c (its least length), k and mine (whether it is that of the line's own length)."""
    own = lines.select("doc", "h", "line", F.length("line").alias("n")).select("*", _least_length(F.col("n"), most).alias("c"))
    own = own.select("*", _least_length(F.col("c") - 1, most).alias("before"))
    near = (F.col("c") > 2 * CHARS_PER_EDIT) & (F.col("n") - F.col("c") < edits(F.col("before"), most))
    of = lambda c, mine: F.struct(F.col(c).alias("c"), F.lit(mine).alias("mine"))
    laid = own.select("doc", "h", "line", "n", F.explode(F.when(near, F.array(of("c", True), of("before", False))).otherwise(F.array(of("c", True)))).alias("of"))
    return laid.select("doc", "h", "line", "n", "of.c", "of.mine", edits(F.col("of.c"), most).alias("k"))


def _long_keys(laid: DataFrame, most: int) -> DataFrame:
    """key, doc, h, mine and indexed: of two lines that meet by a key one is indexed by it."""
    cells = laid.select("doc", "h", "line", "n", "c", "mine", "k", F.expr("c div (k + 1)").cast("int").alias("size"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    cells = cells.select("*", F.least(F.col("i"), F.col("k") - F.col("i")).alias("m"), F.greatest(F.lit(LEAST_KEY), F.col("size") - SPACE_WITHIN).alias("q"))
    at = F.when(F.col("i") * 2 <= F.col("k"), F.col("i") * F.col("size")).otherwise(F.col("n") - (F.col("k") - F.col("i") + 1) * F.col("size"))
    cells = cells.select("doc", "h", "c", "mine", "i", "m", "q", (F.col("size") - F.col("q")).alias("g"), F.substring("line", at - F.col("m") + 1, F.col("size") + 2 * F.col("m")).alias("z"))
    # where the key of a place in z begins (from 0): never before that of an earlier place
    begins = lambda place: place + F.greatest(F.call_function("locate", F.lit(" "), F.substring("z", place + 1, F.col("g"))) - 1, F.lit(0))
    places = range(2 * (most // 2) + 1)
    cells = cells.select("*", begins(F.col("m")).alias("mid"), *(F.when(F.col("m") * 2 >= p, begins(F.lit(p))).alias(f"b{p}") for p in places))
    new = [F.col("b0"), *(F.when(F.col(f"b{p}") != F.col(f"b{p - 1}"), F.col(f"b{p}")) for p in places[1:])]
    cells = cells.select("doc", "h", "c", "mine", "i", "q", "z", "mid", F.explode(F.array(*new)).alias("b")).where("b IS NOT NULL")
    key = F.xxhash64("c", "i", F.substring("z", F.col("b") + 1, F.col("q")))
    return cells.select(key.alias("key"), "doc", "h", "mine", (F.col("mine") & (F.col("b") == F.col("mid"))).alias("indexed"))


def _long_entries(laid: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key, h, mine, indexed), each once, with doc, n (the length), k, CODES and OTHERS of their lines."""
    e = F.expr("c div 8").cast("int")
    parts = [F.left("line", e * 3), F.left("line", e * 5), F.right("line", e * 3), F.right("line", e * 5)]
    known = laid.select("doc", "h", "n", "mine", "k", *(_letters(x).alias(f"l{i}") for i, x in enumerate(parts)))
    known = known.select("doc", "h", "n", "mine", "k", *(F.col(f"l{i}.code").alias(c) for i, c in enumerate(CODES)), *(F.col(f"l{i}.other").alias(c) for i, c in enumerate(OTHERS)))
    return keys.groupBy("key", "h", "mine").agg(F.max("indexed").alias("indexed")).join(known, ["h", "mine"])


def _alike(other: str) -> str:
    """Whether lengths and letters let a line be near the one whose columns begin with `other`: if not, it isn't."""
    differ = lambda i, j: " + ".join(f"bit_count(f{x} ^ {other}f{x}) + abs(o{x} - {other}o{x})" for x in (i, j))
    return f"abs(n - {other}n) <= k AND {differ(0, 3)} <= 2 * k AND {differ(1, 2)} <= 2 * k"


def _distance(a: Column, b: Column, most: int) -> Column:
    """Edits between two different texts, -1 if more than `most`; what both begin and end with is left out first."""
    powers = F.array(*(F.lit(1 << i) for i in range(20, -1, -1)))
    same = lambda s, n: F.left(s["a"], n) == F.left(s["b"], n)
    after = lambda x, n: F.substring(x, n + 1, F.lit(2**31 - 1))
    cut = lambda both: F.aggregate(powers, both, lambda s, n: F.when(same(s, n), F.struct(after(s["a"], n).alias("a"), after(s["b"], n).alias("b"))).otherwise(s))
    turned = let(cut(F.struct(a.alias("a"), b.alias("b"))), lambda s: F.struct(F.reverse(s["a"]).alias("a"), F.reverse(s["b"]).alias("b")))
    return let(cut(turned), lambda s: F.levenshtein(s["a"], s["b"], most))


def _verified(lines: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """Keys (_line_h, _line_g) of the later lines of those pairs (a, b) that are near."""
    pairs = written(pairs, "line-pairs").hint("merge")  # the same plan at every size
    both = written(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "line-ends")
    some = written(lines.join(F.broadcast(both) if both.count() <= BROADCAST else both.hint("merge"), "h", "left_semi"), "near-lines")
    side = lambda c: some.select(F.col("h").alias(c), F.struct("doc", "h", "line").alias(f"{c}_at"))
    within = F.pmod(_distance(F.col("a_at.line"), F.col("b_at.line"), most), F.lit(1 << 20))  # named once, as it is computed where it is named: -1 becomes large
    near = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a_at") != F.col("b_at")) & (within <= edits(F.least(F.length("a_at.line"), F.length("b_at.line")), most)))
    later = near.select(F.greatest("a_at", "b_at").alias("x"))
    return later.select(_h(F.col("x.line")).alias("_line_h"), _g(F.col("x.line")).alias("_line_g")).distinct()


def _long_covered(lines: DataFrame, most: int, keys: DataFrame | None = None) -> DataFrame:
    """The same for lines within two edits or more; keys: those that two of them share, if known (key, h, mine, indexed)."""
    laid, at = _laid(lines.where(F.length("line") >= 2 * CHARS_PER_EDIT), most), F.struct("doc", "h")
    if keys is None:
        keys = _long_keys(laid, most)
        keys = keys.join(keys.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
    entries = written(_long_entries(laid, keys), "long-entries")
    hot = written(entries.groupBy("key").count().where(F.col("count") > HOT).select("key"), "long-keys")
    covered, rows = [], entries.withColumn("hots", F.lit(None).cast("array<bigint>")).withColumn("owns", F.col("hots"))
    if not hot.isEmpty():
        open_ = written(entries.join(hot, "key", "left_semi"), "long-hot")
        # the hot keys of a line, and those it is indexed by: two lines meet by the least one they share
        marks = written(open_.groupBy("h", "mine").agg(F.collect_list("key").alias("hots"), F.collect_list(F.when(F.col("indexed"), F.col("key"))).alias("owns")), "long-marks")
        rows = rows.join(hot, "key", "left_anti").unionByName(entries.join(hot, "key", "left_semi").join(marks, ["h", "mine"]))
        for _ in range(LEADERS):
            met = open_.join(open_.groupBy("key").agg(F.min(F.struct("doc", "h", "n", *CODES, *OTHERS)).alias("first")), "key").where(at > F.struct("first.doc", "first.h"))
            covered.append(written(_verified(lines, met.where(_alike("first.")).select(F.col("first.h").alias("a"), F.col("h").alias("b")).distinct(), most), "long-covered"))
            open_ = replaced(open_, written(met.drop("first").join(covered[-1].select(F.col("_line_h").alias("h")), "h", "left_anti"), "long-hot"))
    x = rows
    for c in covered:
        x = x.join(c.select(F.col("_line_h").alias("h")), "h", "left_anti")
    x = x.select("key", F.col("indexed").alias("x_indexed"), "n", "k", *CODES, *OTHERS, "hots", "owns", F.struct("doc", "h").alias("x"))
    y = rows.select("key", F.col("indexed").alias("y_indexed"), *(F.col(c).alias(f"y_{c}") for c in ("n", *CODES, *OTHERS, "hots", "owns")), at.alias("y"))
    once = "hots IS NULL OR key = array_min(array_union(array_intersect(hots, y_owns), array_intersect(owns, y_hots)))"
    met = x.join(y, "key").where(f"(x_indexed OR y_indexed) AND y < x AND {_alike('y_')} AND ({once})")
    pairs = met.select(F.col("y.h").alias("a"), F.col("x.h").alias("b")).distinct()
    return reduce(DataFrame.union, covered, _verified(lines, pairs, most))


def covered_lines(lines: DataFrame, most: int = MOST) -> DataFrame:
    """Keys (_line_h, _line_g) of the lines (line, doc, h) that have an earlier near line; `most` bounds the edits of the longest lines."""
    lines = lines.where(F.length("line") >= EDIT_CHARS)
    one = _verified(lines, near_pairs(lines), most)
    return one if most < 2 else one.union(_long_covered(lines, most)).distinct()


def _candidates(each: DataFrame, share: float, most: int) -> DataFrame:
    """key, h, mine and indexed of the lines within reach of more than one edit that share the key with another line; share: of the documents, for the sample."""
    keys = lambda d: _long_keys(_laid(d.where(F.length("line") >= 2 * CHARS_PER_EDIT), most), most)
    sample = each.where(F.xxhash64(F.lit(11), "doc").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30)))
    often = written(keys(sample).groupBy("key").count().where(F.col("count") >= FREQUENT).select("key"), "often")  # few: so many documents hold so many keys
    salt = F.when(F.col("often"), 1 + F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0).cast("int")
    tag = F.shiftleft(salt, 2).bitwiseOR(F.col("mine").cast("int") * 2).bitwiseOR(F.col("indexed").cast("int"))  # one small column, as there are many rows
    dealt = keys(each).join(F.broadcast(often.withColumn("often", F.lit(True))), "key", "left").select("key", tag.alias("tag"), "h")
    group = Window.partitionBy("key", F.shiftright("tag", 2))
    met = dealt.select("key", "h", "tag", F.min("h").over(group).alias("a"), F.max("h").over(group).alias("z"), F.max(F.col("tag").bitwiseAND(1)).over(group).alias("most"))
    return written(met.where("tag >= 4 OR a <> z AND most = 1").select("key", "h", F.expr("(tag & 2) <> 0").alias("mine"), F.expr("(tag & 1) <> 0").alias("indexed")).distinct(), "candidates")


def _near_covered(each: DataFrame, share: float, most: int) -> DataFrame:
    """covered_lines of each (doc, line, h), of which only those are gathered that may be near another one."""
    border = 2 * CHARS_PER_EDIT
    short = each.where((F.length("line") >= EDIT_CHARS) & (F.length("line") <= border if most > 1 else F.lit(True)))
    short = distinct_lines(short)
    one = _verified(short, near_pairs(short), 1)
    if most < 2:
        return one
    keys = _candidates(each, share, most)
    some = written(keys.select("h").distinct(), "candidate-lines")
    some = F.broadcast(some) if some.count() <= BROADCAST else some
    return one.union(_long_covered(distinct_lines(each.where(F.length("line") >= border).join(some, "h", "left_semi")), most, keys)).distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """_line_doc and _line_kept, the hashes (h, g) of the lines that stay in it, for each document that keeps a line."""
    # texts are split once; the steps that follow read the columns they need
    each = written(_each_line(docs, id_col, text_col, LEAST_CHARS).withColumn("g", _g(F.col("line"))), "each-line")
    first = each.groupBy(F.col("h").alias("_line_h"), F.col("g").alias("_line_g")).agg(F.min("doc").alias("_line_doc"))
    stay = first.join(_near_covered(each, min(1.0, SAMPLE_DOCS / max(docs.count(), 1)), most), list(OWN), "left_anti")
    return stay.groupBy("_line_doc").agg(F.collect_list(F.struct(*OWN)).alias("_line_kept"))


def _left(text: Column, kept: Column) -> Column:
    """The text's empty lines and the first of each line in `kept`, by one sort: a line stays if it follows the entry of its hashes."""
    place = lambda h, g, i, line: F.struct(h.alias("h"), g.alias("g"), i.alias("i"), line.alias("line"))
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: place(_h(x), _g(x), i, x))
    known = F.transform(kept, lambda k: place(k["_line_h"], k["_line_g"], F.lit(-1), F.lit("")))

    def first_ones(s: Column) -> Column:
        before = F.slice(F.concat(F.array(place(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0), F.lit(""))), s), F.lit(1), F.size(s))
        both = F.zip_with(s, before, lambda x, y: F.struct(x.alias("x"), ((x["i"] >= 0) & ((F.length(x["line"]) < LEAST_CHARS) | ((y["i"] < 0) & (y["h"] == x["h"]) & (y["g"] == x["g"])))).alias("stays")))
        return F.transform(F.filter(both, lambda z: z["stays"]), lambda z: F.struct(z["x"]["i"].alias("i"), z["x"]["line"].alias("line")))

    return F.array_join(F.transform(F.sort_array(let(F.sort_array(F.concat(lines, known)), first_ones)), lambda z: z["line"]), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """docs without the lines that go; texts whose lines all stay are as they were."""
    kept = kept_lines(docs, id_col, text_col, most)
    left = docs.withColumn("_line_doc", _doc(docs, id_col, text_col)).join(kept, "_line_doc", "left")
    has = F.coalesce("_line_kept", F.array().cast("array<struct<_line_h:bigint,_line_g:bigint>>"))
    return left.withColumn(text_col, _left(F.col(text_col).cast("string"), has)).drop("_line_doc", "_line_kept")


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept and kept_sha256 (of the kept lines' hashes in order of h) of each document."""
    docs = table(spark, sf_dir, "documents")
    kept = kept_lines(docs)
    lines = F.split("text", "\n", -1)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(F.filter(lines, lambda x: F.length(x) < LEAST_CHARS)), F.lit(0)).alias("short"), _doc(docs, "doc_id", "text").alias("_line_doc"))
    listed = F.array_join(F.transform(F.sort_array("_line_kept"), lambda x: x["_line_h"].cast("string")), ",")
    n_long = F.coalesce(F.size("_line_kept"), F.lit(0))
    return counted.join(kept, "_line_doc", "left").select("doc_id", "n_lines", (F.col("short") + n_long).cast("long").alias("n_kept"), F.sha2(F.coalesce(listed, F.lit("")), 256).alias("kept_sha256"))
