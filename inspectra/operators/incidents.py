"""Incidents: rows from violations, verdicts, the fold of commands into state, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectra.operators.segmented import last_before
from inspectra.schema import STATUSES


def incidents_from(violations: DataFrame, matches: DataFrame, channel: str, action: Column | None = None) -> DataFrame:
    """One incident for each triggered violation, with at most ten matches of up to 100 characters as JSON."""
    part = F.struct("analyzer_name", "rule_name", F.substring("matched_text", 1, 100).alias("text"))
    shown = matches.withColumn("nth", F.row_number().over(Window.partitionBy("message_id").orderBy("component_idx", "start_offset", "rule_name"))).where("nth <= 10")
    shown = shown.groupBy("message_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("nth", part.alias("m")))), lambda x: x["m"])).alias("matched_content"))
    hit = violations.where("triggered").join(shown, "message_id", "left")
    return hit.select(F.sha2(F.concat_ws("|", "message_id", "policy_name"), 256).alias("id"), "message_id", "policy_name", "severity", F.lit("new").alias("status"), F.lit(channel).alias("channel"), F.col("match_count").cast("int").alias("match_count"), "matched_content", (F.lit("log") if action is None else action).alias("action_taken"))


def derived_incidents(events: DataFrame) -> DataFrame:
    """Incidents made from the events table by rule, for reports over given data."""
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    user = F.when(u % 17 != 0, F.concat(F.lit("user"), u.cast("string")))
    file_name = F.when(e % 3 != 0, F.concat(F.lit("file"), e.cast("string"), F.lit(".docx")))
    return events.select(
        e.alias("id"),
        F.concat(F.lit("Policy "), (u % 6).cast("string")).alias("policy_name"),
        pick(e % 10, "info", "low", "low", "medium", "medium", "medium", "high", "high", "critical", "odd").alias("severity"),
        pick(e % 5, *STATUSES).alias("status"),
        pick(F.length("event_type").cast("long"), "email", "usb", "http_upload", "clipboard", "network_share").alias("channel"),
        pick(e % 3, "endpoint", "network", "discover").alias("source_type"),
        user.alias("user"),
        file_name.alias("file_name"),
        pick(e % 4, "log", "block", "notify", "quarantine").alias("action_taken"),
        (F.lit(1) + e % 20).cast("int").alias("match_count"),
        F.col("ts").alias("created_at"),
    )


def http_verdict(n: Column, block_at: int = 1) -> Column:
    return F.when((n > 0) & (n >= block_at), "block").otherwise("allow")


def smtp_verdict(n: Column, block_at: int = 5, modify_at: int = 1, action: str = "modify") -> Column:
    return F.when(n <= 0, "pass").when(n >= block_at, "block").when(n >= modify_at, action).otherwise("log")


def smtp_effects(mails: DataFrame, verdict: str = "verdict", subject: str = "subject", recipients: str = "recipients", prefix: str = "[FLAGGED] ", quarantine: str = "quarantine@example.com") -> DataFrame:
    """What a verdict does to a mail: its new subject, headers, recipients and reply."""
    v, marked = F.col(verdict), F.col(verdict).isin("modify", "redirect")
    heads = F.create_map(F.lit("X-Inspection"), F.lit("flagged"), F.lit("X-Inspection-Verdict"), v, F.lit("X-Inspection-Matches"), F.col("match_count").cast("string"))
    return mails.select("*", F.when(v == "modify", F.concat(F.lit(prefix), subject)).otherwise(F.col(subject)).alias("out_subject"), F.when(marked, heads).alias("out_headers"), F.when(v == "redirect", F.array(F.lit(quarantine))).when(v != "block", F.col(recipients)).alias("out_recipients"), F.when(v == "block", 550).otherwise(250).alias("reply"))


def endpoint_verdict(action: Column) -> Column:
    return F.when(action.isin("block", "user_cancel"), "block").otherwise("allow")


def ttd_verdict(n: Column, timed_out: Column, fallback: Column) -> Column:
    """Any match blocks; what timed out goes by the policy's fallback (log, if none)."""
    return F.when(timed_out, F.coalesce(fallback, F.lit("log"))).when(n > 0, "block").otherwise("allow")


def normalize_report(reports: DataFrame) -> DataFrame:
    """Agents' reports as incident columns: unknown severities are medium, unknown channels usb, empty texts and sizes null."""
    known = lambda c, values, other: F.when(F.lower(c).isin(*values), F.lower(c)).otherwise(other)
    channels = ("usb", "network_share", "clipboard", "browser_upload", "email", "http_upload", "print")
    empty = [c for c, t in reports.dtypes if t == "string" and c not in ("severity", "channel")]
    out = reports.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in empty})
    return out.withColumns({"severity": known(F.col("severity"), ("info", "low", "medium", "high", "critical"), "medium"), "channel": known(F.col("channel"), channels, "usb"), "file_size": F.when(F.col("file_size") > 0, F.col("file_size"))})


def latest(log: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row of each key: agents by host, policies by id, any state that later rows replace."""
    columns = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(ts)).alias("s")).select(key, "s.*")


def fold_updates(log: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """State from partial updates: of every field the last value that is not null."""
    return log.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(ts))).alias(f) for f in fields], F.max(ts).alias("updated_at"))


def history(log: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """A row (key, ts, field, old_value, new_value) for every change of a field; nulls in the log change nothing."""
    before = last_before(log.select(key, ts, *fields).withColumn("_any", F.lit(1)), key, [ts], [*fields, "_any"])
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"before_{f}").cast("string").alias("old_value"), F.col(f).cast("string").alias("new_value")) for f in fields]
    out = before.where("before__any IS NOT NULL").select(key, ts, F.explode(F.array(*rows)).alias("c")).select(key, ts, "c.*")
    return out.where("new_value IS NOT NULL AND NOT new_value <=> old_value")


def archive(active: DataFrame, archived: DataFrame, older_than: str, ts: str = "created_at", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(what is to be appended to the archive, what stays active)."""
    old = F.col(ts) < F.lit(older_than).cast("timestamp_ntz")
    return active.where(old).join(archived.select(key), key, "left_anti"), active.where(~old)


def dead_letters(queue: DataFrame, failed: Column, most: int = 3) -> DataFrame:
    """A retry of every open entry: those that fail count one more and are permanent at `most`."""
    open_ = ~F.col("is_permanent") & ~F.col("is_dismissed")
    n = F.when(open_ & failed, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    return queue.withColumn("retry_count", n).withColumn("is_permanent", F.col("is_permanent") | (open_ & failed & (F.col("retry_count") >= most)))


def correlate(incidents: DataFrame, others: DataFrame, minutes: int = 30) -> DataFrame:
    """Pairs of incidents and other products' alerts of one user within so many minutes.

    Both sides join on windows of that length, the right side's in its neighbours too: no join over a user's whole history.
    """
    step = minutes * 60
    slot = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / step)
    a = incidents.select(F.col("id").alias("incident_id"), "user", F.col("created_at").alias("incident_at"), slot("created_at").alias("slot"))
    b = others.select(F.col("id").alias("other_id"), "user", F.col("created_at").alias("other_at"), F.explode(F.array(slot("created_at") - 1, slot("created_at"), slot("created_at") + 1)).alias("slot"))
    gap = F.abs(F.unix_micros(F.col("incident_at").cast("timestamp")) - F.unix_micros(F.col("other_at").cast("timestamp")))
    return a.join(b, ["user", "slot"]).where(gap <= step * 1_000_000).select("incident_id", "other_id", "user", "incident_at", "other_at")


def previously_flagged(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Each event with its user's last incident before it or at its time (an as-of join by sorting, not by pairs; long histories spread over tasks)."""
    none = lambda t: F.lit(None).cast(t)
    a = incidents.select("user", F.col("created_at").alias("at"), F.lit(0).alias("side"), F.col("id").cast("bigint").alias("incident_id"), none("bigint").alias("event_id"))
    b = events.select("user", F.col("created_at").alias("at"), F.lit(1).alias("side"), none("bigint").alias("incident_id"), F.col("id").cast("bigint").alias("event_id"))
    seen = last_before(a.unionByName(b).where(F.col("user").isNotNull()), "user", ["at", "side", "incident_id", "event_id"], ["incident_id"])
    return seen.where("side = 1").select("event_id", "user", "at", F.col("before_incident_id").alias("last_incident"))


def with_notes(incidents: DataFrame, notes: DataFrame, key: str = "id") -> DataFrame:
    """Incidents with their notes (incident_id, created_at, note), oldest first, as an array; none as an empty one."""
    own = notes.groupBy(F.col("incident_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("created_at", "note"))).alias("notes"))
    return incidents.join(own, key, "left").withColumn("notes", F.coalesce(F.transform("notes", lambda n: n["note"]), F.array().cast("array<string>")))


def assigned_or_open(assigned: DataFrame, unassigned: DataFrame, key: str = "id") -> DataFrame:
    """Both sets of rows, each id once."""
    return assigned.unionByName(unassigned).dropDuplicates([key])


def shown_matches(matches: DataFrame, most: int = 10) -> DataFrame:
    """message_id and matched_content: the first `most` matches as JSON objects of type, label and text."""
    at = F.struct("component_idx", "start_offset", "analyzer_name", "rule_name", F.substring("matched_text", 1, 100).alias("text"))
    first = F.slice(F.array_sort(F.collect_list(at)), 1, most)
    parts = matches.groupBy("message_id", F.pmod(F.xxhash64("component_idx", "start_offset", "rule_name"), F.lit(64)).alias("part")).agg(first.alias("m"))  # so no message's matches meet in one task
    json = F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, most), lambda m: F.struct(m["analyzer_name"].alias("type"), m["rule_name"].alias("label"), m["text"].alias("text")))
    return parts.groupBy("message_id").agg(F.to_json(json).alias("matched_content"))


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def volume_channel(volume: Column) -> Column:
    return F.when(volume == "removable", "usb").when(volume == "network", "network_share").otherwise("endpoint")


def endpoint_incidents(violations: DataFrame, matches: DataFrame, source: DataFrame, kind: str) -> DataFrame:
    """Incidents of an endpoint's clipboard, browser uploads, discover scans or volumes.

    source: message_id and action; for uploads path, browser and pid, for discover scans and volumes path and, for volumes, volume.
    Clipboard actions are marked as such; a discovered file in violation is put into quarantine if quarantine is set.
    """
    hit = violations.join(source, "message_id").join(shown_matches(matches), "message_id", "left")
    none, action = F.lit(None).cast("string"), F.col("action")
    if kind == "clipboard":
        file_name, channel, user, action = F.lit("clipboard"), F.lit("clipboard"), F.lit(""), F.concat(F.lit("clipboard_"), action)
    elif kind == "upload":
        file_name, channel, user = base_name(F.col("path")), F.lit("browser_upload"), F.format_string("%s (PID %d)", "browser", "pid")
    elif kind == "discover":
        file_name, channel, user, action = base_name(F.col("path")), F.lit("discover"), none, F.when(F.col("quarantine"), "quarantine").otherwise(action)
    else:
        file_name, channel, user = base_name(F.col("path")), volume_channel(F.col("volume")), none
    return hit.select("message_id", "policy_name", "severity", channel.alias("channel"), F.lit("endpoint").alias("source_type"), file_name.alias("file_name"), user.alias("user"), F.col("match_count").cast("int").alias("match_count"), "matched_content", action.alias("action_taken"))


def ttd_content(content: Column, excerpt: Column) -> Column:
    """The text that a request for a decision brings: its content, else its excerpt (UTF-8, what isn't as U+FFFD), else null."""
    some = lambda c: F.when(F.octet_length(c) > 0, F.decode(c, "UTF-8"))
    return F.coalesce(some(content), some(excerpt))


def ttd_decision(content: Column, excerpt: Column, n: Column, timed_out: Column, fallback: Column) -> Column:
    """(verdict, message): requests without content are allowed."""
    empty = ttd_content(content, excerpt).isNull()
    verdict = F.when(empty, "allow").otherwise(ttd_verdict(n, timed_out, fallback))
    return F.struct(verdict.alias("verdict"), F.when(empty, "No content provided").otherwise("").alias("message"))
