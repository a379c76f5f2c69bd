"""Responses to incidents: commands that add notes, set states, notify and escalate, checked and folded in their order.

Every command gets an outcome, whether it is carried out and a sentence that says what came of it; states and notes follow from the
commands that are. A command's old state is the last one that a command before it has set, by segments of the log, so that an incident
with most of the commands is no task of its own.

Edge cases: texts are stripped; commands on incidents that aren't there, of unknown actions or without what they need change nothing; commands at one
time come in the order of their ids, which must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.operators.segmented import last_before
from inspectra.schema import STATUSES

#: Actions and the sentences of their outcomes.
ACTIONS = ("add_note", "escalate", "send_email", "set_status")
SUBJECT, REASON = "DLP Incident Notification", "Escalated via smart response"
MOST_SHOWN = 80


def _stripped(c: str) -> Column:
    return F.coalesce(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""), F.lit(""))


def outcomes(commands: DataFrame, incidents: DataFrame) -> DataFrame:
    """command_id, incident_id, at, action, success, detail, new_status and note of commands (command_id, incident_id, at, action, content, status, recipient, subject, reason)."""
    have = incidents.select(F.col("id").alias("incident_id"), F.col("status").alias("_first"), F.lit(True).alias("_there"))
    content, status, recipient = _stripped("content"), _stripped("status"), _stripped("recipient")
    reason, subject = F.when(F.col("reason").isNull(), REASON).otherwise(_stripped("reason")), F.coalesce("subject", F.lit(SUBJECT))
    action, there = F.col("action"), F.coalesce("_there", F.lit(False))
    fails = (
        F.when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), F.concat(F.lit("Unknown action '"), F.coalesce(action, F.lit("")), F.lit(f"'. Valid actions: {', '.join(ACTIONS)}")))
        .when(~there, "Incident not found")
        .when((action == "add_note") & (content == ""), "Note content is required (params.content)")
        .when((action == "set_status") & ~status.isin(*STATUSES), F.concat(F.lit("Invalid status '"), status, F.lit(f"'. Valid: {', '.join(sorted(STATUSES))}")))
        .when((action == "send_email") & (recipient == ""), "Recipient email is required (params.recipient)")
    )
    rows = commands.join(have, "incident_id", "left").withColumn("_fails", fails)
    done = F.col("_fails").isNull()
    note = F.when(action == "add_note", content).when(action == "send_email", F.concat(F.lit("[Smart Response] Email notification sent to "), recipient, F.lit(" — Subject: "), subject)).when(action == "escalate", F.concat(F.lit("[Escalated] "), reason))
    rows = rows.withColumns({"new_status": F.when(done & (action == "set_status"), status).when(done & (action == "escalate"), "escalated"), "note": F.when(done, note)})
    seen = last_before(rows, "incident_id", ["at", "command_id"], ["new_status"])
    old = F.coalesce("before_new_status", "_first")
    shown = F.concat(F.lit("Note added: "), F.substring(content, 1, MOST_SHOWN), F.when(F.length(content) > MOST_SHOWN, "...").otherwise(""))
    said = F.when(action == "add_note", shown).when(action == "set_status", F.concat(F.lit("Status changed from "), old, F.lit(" to "), F.col("new_status"))).when(action == "send_email", F.concat(F.lit("Email notification queued for "), recipient)).otherwise(F.concat(F.lit("Incident escalated: "), reason))
    return seen.select("command_id", "incident_id", "at", "action", F.col("_fails").isNull().alias("success"), F.coalesce("_fails", said).alias("detail"), "new_status", "note")


def responded(incidents: DataFrame, done: DataFrame) -> DataFrame:
    """incidents with the states that the outcomes lead to, and the number of notes they add."""
    order = F.struct("at", "command_id")
    last = done.groupBy(F.col("incident_id").alias("id")).agg(F.max_by("new_status", F.when(F.col("new_status").isNotNull(), order)).alias("_status"), F.count("note").alias("n_notes"))
    out = incidents.join(last, "id", "left")
    return out.withColumns({"status": F.coalesce("_status", "status"), "n_notes": F.coalesce("n_notes", F.lit(0))}).drop("_status")
