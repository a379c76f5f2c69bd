"""Lifecycles: deletions that cascade through trees of any depth, and states folded by a table of transitions.

Cascade: every node points at its parent; a round looks up what the parent knows and then points at the parent's own pointer, so a chain of n
nodes takes log2(n) rounds, each a join by unique keys. Nodes that hang on a deleted one are deleted.

Fold: an event's meaning is the map from each state to the next; maps compose, so a key's log is cut into segments of bounded length, each
segment is one map, the maps of a key's segments compose to the states in which they start, and prefix maps give the state before each
event. A key with most of the rows spreads over tasks. Maps are packed in one integer, three bits for each state.

Edge cases: a parent that isn't there ends a chain; a null parent too; nodes in a ring are deleted if one of them is; unknown events and
events that a state doesn't allow leave the state and are reported; events at one time come in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.functions.patterns import running
from inspectra.storage import kept

#: The states of a scan, and from which states which event leads where.
SCAN_STATES = ("pending", "running", "completed", "failed", "cancelled")
SCAN_TRANSITIONS = {
    "trigger": {"pending": "running", "completed": "running", "failed": "running", "cancelled": "running"},
    "complete": {"running": "completed"},
    "fail": {"running": "failed"},
    "cancel": {"pending": "cancelled", "running": "cancelled"},
}
MOST_STATES = 8
#: Rows of one key that a task folds at a time, about.
SEGMENT_ROWS = 20_000


def cascade(nodes: DataFrame, deleted: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """nodes with `deleted`: whether the node or one above it is among the keys of `deleted`."""
    gone = deleted.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    state = kept(nodes.select(key, F.col(parent).alias("_up")).join(gone, key, "left").select(key, "_up", F.coalesce("_gone", F.lit(False)).alias("_gone")), "cascade")
    for _ in range(max(1, state.count().bit_length() + 1)):
        above = state.select(F.col(key).alias("_up"), F.col("_up").alias("_next"), F.col("_gone").alias("_above"))
        state = kept(state.join(above, "_up", "left").select(key, F.when(~(F.col("_gone") | F.coalesce("_above", F.lit(False))), F.col("_next")).alias("_up"), (F.col("_gone") | F.coalesce("_above", F.lit(False))).alias("_gone")), "cascade")
        if state.where("_up IS NOT NULL").isEmpty():
            break
    return nodes.join(state.select(key, F.col("_gone").alias("deleted")), key)


def _packed(states: tuple[str, ...], to: dict[str, str]) -> int:
    return sum(states.index(to.get(s, s)) << 3 * i for i, s in enumerate(states))


def _apply(packed: Column, state: Column) -> Column:
    return F.call_function("shiftrightunsigned", packed, 3 * state).bitwiseAND(7)


def fold_states(log: DataFrame, key: str, order: list[str], event: str, start: str = "pending", states: tuple[str, ...] = SCAN_STATES, transitions: dict[str, dict[str, str]] | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """log with `before`, `after` and `allowed` for each event of a key in its order, which must tell the key's rows apart."""
    transitions = SCAN_TRANSITIONS if transitions is None else transitions
    if len(states) > MOST_STATES:
        raise ValueError(f"at most {MOST_STATES} states")
    identity = _packed(states, {})
    meaning = F.lit(identity)
    for name, to in transitions.items():
        meaning = F.when(F.col(event) == name, _packed(states, to)).otherwise(meaning)
    n = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), log.count() // segment_rows + 1)
    dealt = kept(log.repartitionByRange(n, key, *order).withColumns({"_segment": F.spark_partition_id(), "_map": meaning.cast("int")}), "states")

    def compose(first: Column, then: Column) -> Column:
        parts = [F.call_function("shiftleft", _apply(then, _apply(first, F.lit(i))), F.lit(3 * i)) for i in range(len(states))]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return out

    rows = F.array_sort(F.collect_list(F.struct(*order, F.col("_map"), F.struct(*log.columns).alias("_row"))))
    segments = dealt.groupBy("_segment", F.col(key).alias("_key")).agg(rows.alias("_rows"))
    segments = segments.withColumn("_prefix", running(F.transform("_rows", lambda r: r["_map"]), identity, compose))
    last = F.element_at("_rows", -1)["_map"]
    segments = kept(segments.withColumn("_whole", compose(F.element_at("_prefix", -1), last)), "segments")
    # a number for each segment that a key reaches into
    maps = segments.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_segment", "_whole"))).alias("_maps"))
    upto = maps.select("_key", F.explode(F.arrays_zip("_maps", running(F.transform("_maps", lambda m: m["_whole"]), identity, compose).alias("p"))).alias("m"))
    starts = upto.select(F.col("m._maps._segment").alias("_s"), F.col("_key").alias("_k"), _apply(F.col("m.p"), F.lit(states.index(start))).alias("_begin"))
    both = segments.join(starts, (F.col("_segment") == F.col("_s")) & F.col("_key").eqNullSafe(F.col("_k")))
    each = both.select("_begin", F.explode(F.arrays_zip("_rows", F.col("_prefix").alias("p"))).alias("z"))
    before = _apply(F.col("z.p"), F.col("_begin"))
    named = lambda c: F.element_at(F.array(*map(F.lit, states)), c + 1)
    allowed = F.lit(False)
    for name, to in transitions.items():
        allowed = allowed | ((F.col(event) == name) & F.col("before").isin(*to))
    out = each.select("z._rows._row.*", named(before).alias("before"), named(_apply(F.col("z._rows._map"), before)).alias("after"))
    return out.withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def current_states(folded: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, state, and how many events were allowed and not."""
    return folded.groupBy(key).agg(F.max_by("after", F.struct(*order)).alias("state"), F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_refused"))
