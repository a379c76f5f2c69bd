"""Responses to incidents, logs read back, periods of details, and mails whose attachments are files."""

import email.message
import io
import json
import zipfile

from inspectra.operators import export, reports, responses
from inspectra.plans.policy import serialized
from inspectra.sources.archives import mail_components

COMMANDS = "command_id long, incident_id long, at int, action string, content string, status string, recipient string, subject string, reason string"


def test_outcomes_and_states(spark):
    rows = [
        (1, 7, 1, "add_note", "  " + "n" * 90 + " ", None, None, None, None), (2, 7, 2, "set_status", None, " resolved ", None, None, None), (3, 7, 2, "escalate", None, None, None, None, None), (4, 7, 3, "set_status", None, "odd", None, None, None),
        (5, 7, 4, "send_email", None, None, "a@b.c", "S", None), (6, 7, 5, "send_email", None, None, " ", None, None), (7, 99, 1, "add_note", "x", None, None, None, None), (8, 7, 9, "drop", None, None, None, None, None), (9, 7, 9, None, None, None, None, None, None),
        (10, 8, 1, "set_status", None, "dismissed", None, None, None), (11, None, 1, "add_note", "x", None, None, None, None), (12, 7, 6, "add_note", "\t\n", None, None, None, None),
    ]
    incidents = spark.createDataFrame([(7, "new"), (8, "new"), (9, "new")], "id long, status string")
    done = responses.outcomes(spark.createDataFrame(rows, COMMANDS), incidents).cache()
    said = {r.command_id: (r.success, r.detail) for r in done.collect()}
    assert said[1] == (True, "Note added: " + "n" * 80 + "...")
    assert said[2] == (True, "Status changed from new to resolved") and said[3] == (True, "Incident escalated: Escalated via smart response")
    assert said[4] == (False, "Invalid status 'odd'. Valid: dismissed, escalated, in_progress, new, resolved")
    assert said[5] == (True, "Email notification queued for a@b.c") and said[6][0] is False and said[12][0] is False
    assert said[7] == (False, "Incident not found") == said[11] and said[8][1].startswith("Unknown action 'drop'") and said[9][1].startswith("Unknown action ''")
    notes = {r.command_id: r.note for r in done.collect() if r.note}
    assert notes == {1: "n" * 90, 3: "[Escalated] Escalated via smart response", 5: "[Smart Response] Email notification sent to a@b.c — Subject: S"}
    got = {r.id: (r.status, r.n_notes) for r in responses.responded(incidents, done).collect()}
    assert got == {7: ("escalated", 3), 8: ("dismissed", 0), 9: ("new", 0)}
    assert responses.outcomes(spark.createDataFrame([], COMMANDS), incidents).count() == 0


def test_logs_and_periods(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-31 00:00:00"), (3, "2024-02-01 00:00:01"), (4, None)], "id long, t string").selectExpr("id", "CAST(t AS timestamp_ntz) AS created_at")
    path = f"file://{tmp_path}/log"
    export.write_jsonl(rows, path)
    export.write_jsonl(rows.where("id = 1"), path)
    (tmp_path / "log" / "part-broken.json").write_text("not json\n")
    back = export.read_jsonl(spark, path, "id long, created_at timestamp_ntz")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.unionByName(rows.where("id = 1")).collect()))
    assert [r.id for r in reports.details(rows, "2024-02-01 00:00:00").collect()] == [2]
    assert [r.id for r in reports.details(rows, "2024-02-02 00:00:00", "2024-01-01 00:00:00").collect()] == [3, 2, 1]


def test_attachments_are_inspected_as_files(spark):
    def zipped(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
        return out.getvalue()

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>in the document</w:t></w:r></w:p></w:body></w:document>'})
    m = email.message.EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@example.com", "b@example.org", "s"
    m.set_content("the body")
    m.add_attachment(zipped({"d.docx": docx, "t.txt": "in the archive", "n.zip": zipped({"deep.txt": "deeper"})}), maintype="application", subtype="zip", filename="files.zip")
    m.add_attachment(b"plain text", maintype="application", subtype="octet-stream", filename="p.txt")
    mails = spark.createDataFrame([(1, bytearray(m.as_bytes())), (2, None), (3, bytearray(b"Subject: only\r\n\r\n"))], "mail_id long, raw binary")
    got = [(r.component_type, r.component_name, r.content.strip()) for r in mail_components(mails).where("message_id = '1'").orderBy("component_idx").collect()]
    assert got[1:] == [
        ("subject", "subject", "s"), ("body", "body", "the body"), ("attachment", "files.zip/d.docx", "in the document"), ("attachment", "files.zip/t.txt", "in the archive"), ("attachment", "files.zip/n.zip/deep.txt", "deeper"), ("attachment", "p.txt", "plain text"),
    ]
    assert mail_components(mails.where("mail_id = 2")).count() == 0


def test_policies_as_text(spark):
    rule = "struct<rule_id:long,name:string,conditions:array<struct<condition_type:string,component:string,config:string>>>"
    rows = [(1, "a", "high", "active", [(7, "r", [("regex", "body", '{"p": "x\\"y"}'), ("keyword", "body", None)]), (8, None, None)]), (2, None, "medium", "active", None)]
    got = {r.policy_id: json.loads(r.definition) for r in serialized(spark.createDataFrame(rows, f"id long, name string, severity string, status string, rules array<{rule}>")).collect()}
    conditions = [{"condition_type": "keyword", "component": "body", "config_json": "{}"}, {"condition_type": "regex", "component": "body", "config_json": '{"p": "x\\"y"}'}]
    head = {"description": "", "status": "active"}
    assert got == {
        "1": head | {"policy_id": "1", "name": "a", "severity": "high", "detection_rules": [{"rule_id": "7", "name": "r", "conditions": conditions}, {"rule_id": "8", "name": "", "conditions": []}]},
        "2": head | {"policy_id": "2", "name": "", "severity": "medium", "detection_rules": []},
    }
