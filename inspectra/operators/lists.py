"""Lists of agents, audit rows, dead letters, notifications, scans and dictionaries, and the folds behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For every list the columns compared for equality, those searched for a part, and what always holds.
LISTS: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "agents": (("status", "group_id"), ("hostname",), "true"),
    "audit": (("resource_type",), ("action",), "true"),
    "dead_letters": (("operation_type",), (), "NOT is_dismissed"),
    "notifications": (("user_id",), (), "true"),
    "unread": (("user_id",), (), "NOT is_read"),
    "scans": (("status", "agent_id"), ("name",), "true"),
    "dictionaries": ((), ("name",), "is_active"),
    "policies": (("status",), ("name",), "NOT is_template"),
}


def listed(kind: str, rows: DataFrame, **asked: object) -> DataFrame:
    """The rows of a list; what is asked with None or '' doesn't filter. Searches ignore case."""
    equal, parts, always = LISTS[kind]
    if unknown := set(asked) - set(equal) - set(parts):
        raise ValueError(f"{kind} can't be filtered by {', '.join(sorted(unknown))}")
    out = rows.where(always)
    for name, value in asked.items():
        if value not in (None, ""):
            out = out.where(F.col(name) == value if name in equal else F.col(name).ilike(f"%{value}%"))
    return out


def dead_letter_stats(rows: DataFrame) -> DataFrame:
    """total, pending (neither permanent nor dismissed) and permanent (not dismissed)."""
    open_ = ~F.col("is_dismissed")
    return rows.agg(F.count("*").alias("total"), F.count_if(open_ & ~F.col("is_permanent")).alias("pending"), F.count_if(open_ & F.col("is_permanent")).alias("permanent"))


def dismissed(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows with is_dismissed set for the given ids."""
    marks = ids.select(key).distinct().withColumn("_dismiss", F.lit(True))
    return rows.join(marks, key, "left").withColumn("is_dismissed", F.col("is_dismissed") | F.coalesce("_dismiss", F.lit(False))).drop("_dismiss")


def broadcast_notification(users: DataFrame, at: Column, **fields: str) -> DataFrame:
    """One unread notification for every active user."""
    return users.where("is_active").select(F.col("id").alias("user_id"), *[F.lit(v).alias(k) for k, v in fields.items()], at.alias("created_at"), F.lit(False).alias("is_read"))


def notification_state(made: DataFrame, marks: DataFrame) -> DataFrame:
    """Notifications (id, user_id, created_at, ...) after the marks (user_id, at, kind, id): read one, read_all or delete one.

    A mark counts for its own user's notifications; read_all for those made before it.
    """
    one = marks.where("kind IN ('read', 'delete')").groupBy("user_id", "id").agg(F.bool_or(F.col("kind") == "read").alias("_read"), F.bool_or(F.col("kind") == "delete").alias("_deleted"))
    every = marks.where("kind = 'read_all'").groupBy("user_id").agg(F.max("at").alias("_all"))
    out = made.join(one, ["user_id", "id"], "left").join(every, "user_id", "left")
    read = F.coalesce("_read", F.lit(False)) | F.coalesce(F.col("created_at") <= F.col("_all"), F.lit(False))
    return out.where(~F.coalesce("_deleted", F.lit(False))).withColumn("is_read", read).drop("_read", "_deleted", "_all")


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


def audit_rows(history: DataFrame, resource: str, actor: Column, key: str, ts: str) -> DataFrame:
    """Audit entries of a history of changes (key, ts, field, old_value, new_value): one for each change of a resource, with what changed."""
    change = F.struct("field", "old_value", "new_value")
    rows = history.groupBy(key, ts, actor.alias("actor_id")).agg(F.to_json(F.array_sort(F.collect_list(change))).alias("changes"))
    return rows.select(F.col("actor_id"), F.lit(f"{resource}.updated").alias("action"), F.lit(resource).alias("resource_type"), F.col(key).cast("string").alias("resource_id"), "changes", F.col(ts).alias("created_at"))


def with_parts(policies: DataFrame, parts: DataFrame, name: str, inner: DataFrame | None = None, inner_name: str = "conditions") -> DataFrame:
    """policies (id) with an array column of their parts (id, policy_id, ...): rules, exceptions or responses; these with their own parts
    (parent_id, position, ...) in order, none as an empty array."""
    if inner is not None:
        fields = [c for c in inner.columns if c not in ("parent_id", "position")]
        own = inner.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias(inner_name))
        parts = parts.join(own, "id", "left")
    of = [c for c in parts.columns if c not in ("id", "policy_id")]
    nested = parts.groupBy(F.col("policy_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", *of))).alias(name))
    return policies.join(nested, "id", "left")


def with_part(stored: dict, kind: str, part: dict) -> dict:
    """A stored policy with one more rule or exception; its version is one more, and the original stays as it is."""
    return stored | {kind: [*stored.get(kind, ()), part], "version": stored.get("version", 1) + 1}


def without_part(stored: dict, kind: str, name: str) -> dict:
    """A stored policy without the rules or exceptions of a name; KeyError if there is none."""
    left = [p for p in stored.get(kind, ()) if p["name"] != name]
    if len(left) == len(stored.get(kind, ())):
        raise KeyError(name)
    return stored | {kind: left, "version": stored.get("version", 1) + 1}
