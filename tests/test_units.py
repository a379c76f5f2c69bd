"""Patterns, scans, policies, files and exports on small inputs with known answers."""

import bz2
import gzip
import io
import json
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from inspectra.functions import normalize, patterns
from inspectra.functions.validators import validator
from inspectra.operators import export, filetype, fingerprint, incidents, reports, scan
from inspectra.plans import policy as P
from inspectra.plans.catalog import TEMPLATES
from inspectra.sources import files, messages

CARDS = ["4532015112830366", "5425233430109903", "374245455400126", "6011514433546201", "4916338506082832"]


def parts(spark, rows):
    return spark.createDataFrame([(str(i), 0, "body", "body", t) for i, t in enumerate(rows)], "message_id string, component_idx int, component_type string, component_name string, content string")


def test_spans(spark):
    texts = ["", None, "aXbXX", "X😀X中X", "none", "XX" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(patterns.spans(F.col("t"), "X+").alias("s")).collect()
    want = [[(m.start(), m.end(), m[0]) for m in re.finditer("X+", t or "")] for t in texts]
    assert [[tuple(s) for s in r["s"]] for r in got] == want


def test_boundaries(spark):
    texts = ["é4111111111111111", "x4111111111111111x", "4111111111111111_", "(4111111111111111)", "中4111111111111111中", "😀4111111111111111"]
    got = scan.scan_identifiers(parts(spark, texts)).where("rule_name = 'Credit Card Number'").collect()
    assert sorted((r["message_id"], r["start_offset"], r["end_offset"]) for r in got) == [("0", 1, 17), ("3", 1, 17), ("4", 1, 17), ("5", 1, 17)]


def test_identifier_quirks(spark):
    texts = ["call (743) 555-3824", "Social: 987-65-4321", "Routing number 021000021", "123-456-7890", "mail a@b.co."]
    got = {(r["message_id"], r["rule_name"], r["matched_text"]) for r in scan.scan_identifiers(parts(spark, texts)).collect()}
    assert ("0", "US Phone Number", "743) 555-3824") in got and ("2", "ABA Routing Number", "021000021") in got and ("4", "Email Address", "a@b.co") in got
    assert not {m for m in got if m[0] in ("1", "3")}
    with pytest.raises(ValueError):
        validator("no such")


def test_keywords(spark):
    texts = ["Confidential: CONFIDENTIALITÉ secret_x secret", "top  secret top secret", "aaaa"]
    got = scan.scan_keywords(parts(spark, texts), "d", ["confidential", "secret", "top secret", "Secret"])
    found = sorted((r["message_id"], r["matched_text"]) for r in got.collect())
    assert found == [("0", "Confidential"), ("0", "secret"), ("1", "secret"), ("1", "secret"), ("1", "top secret")]
    assert scan.scan_large_dictionary(parts(spark, texts), "d", ["aa"], whole_word=False).count() == 3
    large = scan.scan_large_dictionary(parts(spark, texts), "d", ["confidential", "secret", "top secret"]).collect()
    assert sorted((r["message_id"], r["matched_text"]) for r in large) == found


def test_proximity(spark):
    texts = ["merger of the two", "merger one two three four secret", "secret merger", "merger merger", "Merger x SECRET"]
    near = scan.scan_proximity(parts(spark, texts), "r", "merger", "secret", 3).collect()
    assert sorted((r["message_id"], r["matched_text"]) for r in near) == [("2", "secret merger"), ("4", "Merger x SECRET")]
    assert scan.scan_proximity(parts(spark, texts), "r", "merger", "secret", 4).count() == 3
    assert scan.scan_proximity(parts(spark, texts), "r", "merger", "merger", 0).count() == 2


def test_engine(spark):
    engine = scan.Engine().add("ids", scan.scan_identifiers)
    with pytest.raises(ValueError):
        engine.add("ids", scan.scan_identifiers)
    with pytest.raises(TypeError):
        engine.add("x", "not a function")
    engine.add("broken", lambda c: c.select("no such column"))
    found, errors = engine.detect(parts(spark, [CARDS[0]]))
    assert found.count() == 1 and "broken" in errors


def decide(spark, policy, cells, sender="a@x.org", to=("b@sub.example.com",)):
    rows = [("m", i, kind, kind, name, "r", "t", 0, 1, 1.0) for i, (name, kind) in enumerate(cells)]
    from inspectra.schema import MATCHES

    messages_ = spark.createDataFrame([("m", sender, list(to))], "message_id string, sender string, recipients array<string>")
    (row,) = P.evaluate(messages_, spark.createDataFrame(rows, MATCHES), [policy], False).collect()
    return row["triggered"], row["severity"], row["match_count"], row["matched_rules"], row["exceptions_applied"]


def test_policies(spark):
    rule = (P.Rule("r", (P.Condition("card"),)),)
    tiers = ((1, "low"), (3, "medium"), (5, "high"), (20, "critical"))
    for n, severity in ((1, "low"), (3, "medium"), (5, "high"), (6, "high"), (20, "critical")):
        assert decide(spark, P.Policy("p", rule, "info", tiers), [("card", "body")] * n)[:3] == (True, severity, n)
    assert decide(spark, P.Policy("p", rule, "info", ((2, "low"),)), [("card", "body")])[1] == "info"
    assert not decide(spark, P.Policy("p", (P.Rule("r", ()),)), [("card", "body")])[0]
    assert not decide(spark, P.Policy("p", (P.Rule("r", (P.Condition("other", "not_matches"),)),)), [("card", "body")])[0]
    where = P.Policy("p", (P.Rule("r", (P.Condition("card", components=("subject",)),)),))
    assert not decide(spark, where, [("card", "body")])[0] and decide(spark, where, [("card", "subject"), ("card", "body")])[2] == 2
    every = P.Exception_("all", False, when=lambda: F.lit(True))
    assert decide(spark, P.Policy("p", rule, exceptions=(every,)), [("card", "body")]) == (False, "medium", 0, ["r"], ["all"])
    whole = P.Exception_("whole", groups=(P.Group(("example.com",), mode="domain"),))
    assert decide(spark, P.Policy("p", rule, exceptions=(every, whole)), [("card", "body")])[4] == ["whole"]
    never = P.Exception_("never")
    assert decide(spark, P.Policy("p", rule, exceptions=(never,)), [("card", "body")])[0]
    assert not decide(spark, P.Policy("p", rule, groups=(P.Group(("other.com",), mode="domain"),)), [("card", "body")])[0]
    assert decide(spark, P.Policy("p", rule, groups=(P.Group(("^B@",), mode="regex"),)), [("card", "body")])[0]
    registry = P.Policies()
    registry.add(P.Policy("p", rule))
    with pytest.raises(ValueError):
        registry.add(P.Policy("p", rule))
    with pytest.raises(KeyError):
        registry.remove("q")
    with pytest.raises(ValueError):
        P.Condition("card", "equals")


def test_templates(spark):
    texts = ["card 4532015112830366", "patient with SSN 123-45-6789", "IBAN GB82WEST12345698765432", "name and 02/03/1980", "merger and 10-K", "api_key = 'abcdefghij0123456789'", "TOP SECRET", "top secret", "-----BEGIN RSA PRIVATE KEY-----", "merger"]
    rows = parts(spark, texts).union(spark.createDataFrame([("file", 0, "attachment", "main.py", "x = 1")], "a string, b int, c string, d string, e string"))
    ids = rows.select("message_id").distinct()
    got = sorted((r["message_id"], r["policy_name"]) for r in P.evaluate_stored(ids, rows, TEMPLATES).collect())
    assert got == [("0", "pci_dss"), ("1", "hipaa"), ("2", "gdpr"), ("3", "gdpr"), ("4", "sox"), ("5", "source_code"), ("6", "confidential"), ("8", "source_code"), ("file", "source_code")]


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives():
    nested = zipped({"a.txt": "inner text", "../up.txt": "no", "dir/con.txt": "no", "b.zip": zipped({"c.txt": "deeper"})})
    got = {p["component_name"]: p["content"] for p in files.extract(nested, "x.zip")}
    assert got == {"a.txt": "inner text", "b.zip": "deeper"} or set(got.values()) == {"inner text", "deeper"}
    deep = b"last"
    for i in range(5):
        deep = zipped({f"l{i}.zip" if i else "t.txt": deep})
    assert any("safety limit" in p["content"] for p in files.extract(deep, "d.zip"))
    assert any("safety limit" in p["content"] for p in files.extract(zipped({f"{i}.txt": "x" for i in range(501)}), "m.zip"))
    assert any("safety limit" in p["content"] for p in files.extract(zipped({"big.txt": b"0" * 20_000_000}), "r.zip"))
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 4
        t.addfile(info, io.BytesIO(b"tar!"))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    assert [p["content"] for p in files.extract(out.getvalue(), "x.tgz")] == ["tar!"]
    assert files.extract(gzip.compress(b"plain"), "x.txt.gz")[0]["content"] == "plain"
    assert files.extract(bz2.compress(b"plain"), "x.txt.bz2")[0]["content"] == "plain"
    assert "failed" in files.extract(b"PK\x03\x04 broken", "x.docx")[0]["content"]
    assert files.extract(None, "x") == [] and files.extract(b"", "x") == []


def test_office_and_encodings():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    document = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert [p["content"] for p in files.extract(zipped({"word/document.xml": document}), "x.docx")] == ["one\ntwo", "a | b"]
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>'
    book = zipped({"xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>head</t></si></sst>', "xl/worksheets/sheet1.xml": sheet})
    assert files.extract(book, "x.xlsx")[0]["content"] == "head | 5"
    for raw in ("é plain".encode(), "﻿é plain".encode(), "é plain".encode("utf-16"), "é plain".encode("utf-16-le"), "é plain".encode("latin-1")):
        assert files.decode_text(raw) == "é plain"
    assert files.html_to_text("<p>a<b>b</b></p><script>x()</script><p>c &amp; d</p>") == "ab\nc & d"
    assert not files.looks_like_text(b"") and not files.looks_like_text(bytes(range(32)) * 10) and files.looks_like_text(b"text")


def test_file_walk(spark, tmp_path):
    for name, data in (("a.txt", b"card 4532015112830366"), ("skip/b.txt", b"x"), ("c.bin", b"\0\1"), ("d.txt", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.walk(spark, f"file://{tmp_path}", ("txt",), (f"file:{tmp_path}/skip",))
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.txt"]
    assert files.changed(found, found).count() == 0 and files.changed(found, found.limit(0)).count() == 1
    assert scan.scan_identifiers(files.file_components(found)).count() == 1


def test_file_types(spark):
    rows = [("a.pdf", b"%PDF-1.7"), ("b.docx", b"PK\x03\x04xx"), ("c.zip", b"PK\x03\x04xx"), ("d.py", b"import os"), ("e", b"\x89PNG\r\n\x1a\n"), ("f.csv", None), ("g", b"\0\1\2"), (None, None)]
    df = spark.createDataFrame(rows, "filename string, content_bytes binary")
    got = {r["filename"]: r["i"]["type_name"] for r in df.select("filename", filetype.file_info(F.col("content_bytes"), F.col("filename")).alias("i")).collect()}
    assert got == {"a.pdf": "PDF", "b.docx": "Microsoft Word (DOCX)", "c.zip": "ZIP", "d.py": "Python Script", "e": "PNG Image", "f.csv": "CSV", "g": "Unknown", None: "Unknown"}
    rules = [filetype.FileRule("docs", categories=("document",), min_size=1), filetype.FileRule("py", globs=("*.PY",)), filetype.FileRule("none")]
    assert sorted((r["filename"], r["rule_name"]) for r in filetype.scan_file_types(df, rules).collect()) == [("a.pdf", "docs"), ("b.docx", "docs"), ("d.py", "py")]


def test_messages(spark):
    body = b'--X\r\nContent-Disposition: form-data; name="f"; filename="a.txt"\r\n\r\nfile text\r\n--X\r\nContent-Disposition: form-data; name="g"\r\n\r\nfield text\r\n--X--\r\n'
    rows = [(1, "POST", "http://h/", "1.2.3.4", "multipart/form-data; boundary=X", body), (2, "GET", "http://h/", "1.2.3.4", None, b"x"), (3, "put", "http://h/", "1.2.3.4", "text/plain", b"whole")]
    got = messages.http_messages(spark.createDataFrame(rows, "request_id long, method string, url string, client_ip string, content_type string, body binary")).collect()
    assert sorted((r["message_id"], r["component_type"], r["content"]) for r in got if r["component_type"] != "envelope") == [("1", "attachment", "file text"), ("1", "body", "field text"), ("3", "body", "whole")]
    mail = b"From: a@x.org\r\nTo: b@y.org\r\nSubject: hello\r\nContent-Type: multipart/mixed; boundary=Q\r\n\r\n--Q\r\nContent-Type: text/plain\r\n\r\nplain\r\n--Q\r\nContent-Type: text/html\r\n\r\n<b>html</b>\r\n--Q\r\nContent-Disposition: attachment; filename=f.txt\r\n\r\nattached\r\n--Q--\r\n"
    got = messages.smtp_messages(spark.createDataFrame([(1, mail), (2, None)], "mail_id long, raw binary")).orderBy("component_idx").collect()
    assert [r["component_type"] for r in got] == ["envelope", "subject", "body", "body", "attachment"] and got[1]["content"] == "hello"
    hosts = spark.createDataFrame([("https://Sub.Example.com/x",), ("https://example.com.evil.org",), ("nonsense",), (None,)], "u string")
    assert [r[0] for r in hosts.select(messages.allowed_host(F.col("u"), ["example.com"])).collect()] == [True, False, False, False]


def test_variants():
    assert normalize.variant_list("hello+world") == ["hello+world"]
    assert "123-45-6789" in normalize.variant_list("123%252D45%252D6789")
    import base64

    assert "card 4532015112830366 is here in base64" in normalize.variant_list(base64.b64encode(b"card 4532015112830366 is here in base64").decode())
    assert len(normalize.variant_list("%2525252525252541")) <= 6 and normalize.variant_list(None) == []


def slow_simhash(text):
    votes = [0] * 64
    grams = [text[i : i + 4] for i in range(max(1, len(text) - 3))]
    for g in grams:
        h = fingerprint.FNV_START
        for b in g.encode():
            h = (h ^ b) * fingerprint.FNV_PRIME % (1 << 64)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def test_fingerprints(spark):
    texts = ["the quick brown fox jumps over the lazy dog and runs away again", "naïve 中文 text 😀 with more than fifty characters in it, surely so", "The Quick brown fox jumps over the lazy dog, and runs away again!!", "short"]
    index = fingerprint.build_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()
    assert [r["fingerprint_id"] for r in index] == [0, 1, 2]
    assert all(fingerprint.simhash_text(t) & (1 << 64) - 1 == slow_simhash(t) for t in texts[:2])
    df = spark.createDataFrame(index)
    for threshold in (0.4, 0.8, 0.95):
        got = {(r["left_id"], r["right_id"]): r["score"] for r in fingerprint.fingerprint_pairs(df, df, threshold).collect()}
        want = {(a["fingerprint_id"], b["fingerprint_id"]): 1 - bin((a["simhash"] ^ b["simhash"]) & (1 << 64) - 1).count("1") / 64 for a in index for b in index}
        assert got == {k: v for k, v in want.items() if v >= threshold}
    assert got[0, 2] == 1.0


def test_reports(spark):
    rows = [("high", "2026-03-20 12:00:00", "u1")] * 1 + [("critical", "2026-03-01 12:00:00", ""), ("low", "2026-03-19 00:00:00", None)]
    df = spark.createDataFrame(rows, "severity string, t string, user string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    risk = {r["user"]: r for r in reports.risk(df, "2026-03-20 12:00:00").collect()}
    assert (risk["u1"]["raw_score"], risk["u1"]["normalized"], risk["u1"]["level"]) == (10.0, 20, "low") and risk["unknown"]["n_incidents"] == 2
    trend = {r["metric"]: (r["current"], r["previous"], r["delta_percent"]) for r in reports.trend(df, "2026-03-18 00:00:00", "2026-03-20 23:59:59").collect()}
    assert trend["total"] == (2, 0, 100.0)
    share = {r["value"]: r["percentage"] for r in reports.summary(df, ("user",)).collect()}
    assert share == {"u1": 33.3, "unknown": 66.7}


def test_exports(spark):
    row = [(7, "a|b=c\\d\n", "high", "new", "email", "endpoint", None, "f.txt", "block", 3, "2026-03-20 12:00:00")]
    df = spark.createDataFrame(row, "id long, policy_name string, severity string, status string, channel string, source_type string, user string, file_name string, action_taken string, match_count int, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    (line,) = export.cef_lines(df).collect()
    assert line["priority"] == 104 and line["line"].startswith("CEF:0|Inspectra|Inspectra|1.0|100|DLP block: a\\|b\\=c\\\\d\\n|8|act=block") and "suser" not in line["line"]
    event = json.loads(export.ecs_events(df).first()["event"])
    assert event["event"]["severity"] == 3 and "user" not in event and event["file"]["name"] == "f.txt" and event["event"]["outcome"] == "success"
    assert export.cef_lines(df, "critical").count() == 0
    mails = spark.createDataFrame([("m", "hi", ["a@b.c"], v, 3) for v in ("pass", "modify", "redirect", "block")], "id string, subject string, recipients array<string>, verdict string, match_count int")
    got = {r["verdict"]: r for r in incidents.smtp_effects(mails).collect()}
    assert got["modify"]["out_subject"] == "[FLAGGED] hi" and got["redirect"]["out_recipients"] == ["quarantine@example.com"] and got["block"]["reply"] == 550 and got["pass"]["out_headers"] is None


def test_state(spark):
    log = spark.createDataFrame([("a", 1, "new", None), ("a", 2, None, "x"), ("a", 3, "done", None), ("a", 4, "done", None), ("b", 1, "new", "y")], "id string, ts int, status string, note string")
    state = {r["id"]: (r["status"], r["note"], r["updated_at"]) for r in incidents.fold_updates(log, "id", "ts", ["status", "note"]).collect()}
    assert state == {"a": ("done", "x", 4), "b": ("new", "y", 1)}
    assert sorted((r["id"], r["field"], r["old_value"], r["new_value"]) for r in incidents.history(log, "id", "ts", ["status", "note"]).collect()) == [("a", "note", None, "x"), ("a", "status", "new", "done")]
    queue = spark.createDataFrame([(1, 2, False, False), (2, 0, False, True), (3, 0, False, False)], "id int, retry_count int, is_permanent boolean, is_dismissed boolean")
    got = {r["id"]: (r["retry_count"], r["is_permanent"]) for r in incidents.dead_letters(queue, F.lit(True)).collect()}
    assert got == {1: (3, True), 2: (0, False), 3: (1, False)}


def test_endpoint_dialect(spark):
    from inspectra.functions.validators import ENDPOINT_VALIDATORS

    cases = [
        ("luhn", CARDS[0], True), ("luhn", "0" * 20, False), ("phone_format", "212-155-0123", True), ("phone_format", "212-055-0123", False), ("phone_format", "112-555-0123", False),
        ("email_domain", " a@b.co ", True), ("email_domain", "a@b@c.co", False), ("email_domain", "a@-b.co", False), ("email_domain", "a@b.c", False), ("email_domain", "x" * 65 + "@b.co", False),
        ("passport_format", "A12345678", True), ("passport_format", "123456789", False), ("drivers_license_format", "D1234567", True), ("drivers_license_format", "D12345", False),
        ("ipv4_range", "1.2.3.4", True), ("ipv4_range", "1.2.3.04", False), ("date_calendar", "01/31/2020", True), ("date_calendar", "2020-01-31", False), ("date_calendar", "01/31/2026", False),
    ]
    rows = spark.createDataFrame([(v, x) for v, x, _ in cases], "v string, x string")
    got = rows.select(F.coalesce(*[F.when(F.col("v") == n, f(F.col("x"))) for n, f in ENDPOINT_VALIDATORS.items()])).collect()
    assert [r[0] for r in got] == [ok for *_, ok in cases]


def test_stored_policies_and_lines(spark, tmp_path):
    policies = spark.createDataFrame([(1, "a", "draft", "high", False, 1), (1, "a", "active", "odd", False, 2), (2, "t", "active", "low", True, 1), (3, "s", "suspended", "low", False, 1)], "id int, name string, status string, severity string, is_template boolean, version int")
    rules = spark.createDataFrame([(10, 1, "r")], "id int, policy_id int, name string")
    conditions = spark.createDataFrame([(10, "regex", "generic", "{}"), (10, "keyword", "body", "{}")], "rule_id int, condition_type string, component string, config string")
    (row,) = P.stored_rows(policies, rules, conditions).collect()
    assert (row["id"], row["severity"], len(row["rules"][0]["conditions"])) == (1, "medium", 2)
    assert P.edited(TEMPLATES["sox"], severity="low", rules=None)["severity"] == "low" and TEMPLATES["sox"]["severity"] == "medium"
    summary = spark.createDataFrame([("severity", "high", 3, 75.0), ("severity", "low", 1, 25.0), ("user", 'a"b', 4, 100.0)], "field string, value string, n long, percentage double")
    lines = [r["line"] for r in export.summary_lines(summary, "2026-01-01", "2026-01-31").collect()]
    assert set(lines[:3]) == {"Summary report", "Period,2026-01-01,2026-01-31", "Total,4"} and lines[3:] == ["Severity", '"high",3,75.0', '"low",1,25.0', "User", '"a""b",4,100.0']
    rows = spark.createDataFrame([(1, "2026-01-05 00:00:00"), (2, "2026-02-05 00:00:00")], "id int, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    export.write_by_month(rows, f"file://{tmp_path}/m")
    assert (tmp_path / "m" / "year=2026" / "month=2").is_dir()
    beat = spark.createDataFrame([("a", "h", "online", "2026-01-05 00:00:00")], "agent string, hostname string, status string, ts string")
    assert json.loads(export.status_events(beat).first()["event"])["dlp"]["agent_status"] == "online"


def test_automaton_keeps_places_and_flags(spark):
    rows = parts(spark, ["İ is Secret, SECRET and top secret"])
    hits = lambda *words: sorted((r["matched_text"], r["start_offset"]) for r in scan.scan_large_dictionary(rows, "d", list(words)).collect())
    assert hits("secret") == [("SECRET", 13), ("Secret", 5), ("secret", 28)]
    assert hits("x", ("Secret", True, True)) == [("Secret", 5)]
    assert hits("SECRET", ("secret", True, True)) == [("secret", 28)]
    assert hits(("ecre", False, False)) == [("ECRE", 14), ("ecre", 6), ("ecre", 29)]


def test_policy_parts():
    from inspectra.operators import lists

    stored = {"name": "p", "rules": [{"name": "a"}]}
    more = lists.with_part(stored, "exceptions", {"name": "e"})
    assert more == {"name": "p", "rules": [{"name": "a"}], "exceptions": [{"name": "e"}], "version": 2} and "exceptions" not in stored
    assert lists.without_part(more, "rules", "a")["rules"] == [] and lists.without_part(more, "rules", "a")["version"] == 3
    with pytest.raises(KeyError):
        lists.without_part(stored, "rules", "b")
    with pytest.raises(ValueError):
        lists.listed("agents", type("Rows", (), {"where": lambda self, _: self})(), colour="red")


def test_running_folds(spark):
    from inspectra.functions.patterns import running, running_sums

    for values in ([], [3], [3, 1], [5, 0, 2, 9, 4, 4, 1] * 13):
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, most = df.select(running_sums(F.col("v")), running(F.col("v"), 0, lambda a, b: F.greatest(a, b))).first()
        assert sums == [sum(values[:i]) for i in range(len(values))] and most == [max(values[:i], default=0) for i in range(len(values))]


def test_a_policy_that_fails_leaves_the_others(spark):
    messages_ = spark.createDataFrame([("m", "s@x", ["r@x"])], "message_id string, sender string, recipients array<string>")
    found = spark.createDataFrame([("m", "a", "body")], "message_id string, analyzer_name string, component_type string")

    def broken():
        raise KeyError("no such list")

    bad = P.Policy("bad", (P.Rule("r", (P.Condition("a"),)),), exceptions=(P.Exception_("e", when=broken),))
    good = P.Policy("good", (P.Rule("r", (P.Condition("a"),)),))
    got = {r["policy_name"]: r for r in P.evaluate(messages_, found, [bad, good], triggered_only=False).collect()}
    assert not got["bad"]["triggered"] and "no such list" in got["bad"]["error"] and got["good"]["triggered"] and got["good"]["error"] is None


def test_detail_reports_begin_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([tuple("x" for _ in export.DETAIL_COLUMNS)], ", ".join(f"`{c}` string" for c in export.DETAIL_COLUMNS))
    export.write_detail_csv(df, f"file://{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbf" + export.DETAIL_COLUMNS[0].encode())
