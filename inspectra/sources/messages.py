"""Messages as rows of components: from columns of text, requests, mail and conversations."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Methods of requests that carry content.
BODY_METHODS = ("POST", "PUT", "PATCH")
PARTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("component_type", "component_name", "content")]))


def part(kind: str, content: Column, name: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("component_type"), (F.lit(kind) if name is None else name).alias("component_name"), content.alias("content"))


def explode_parts(df: DataFrame, message_id: Column, parts: Column, *keep: Column) -> DataFrame:
    """One row for each part with content, numbered within its message."""
    full = F.filter(parts, lambda p: p["content"].isNotNull() & (p["content"] != ""))
    rows = df.select(message_id.cast("string").alias("message_id"), *keep, F.posexplode(full).alias("component_idx", "part"))
    kept = [c for c in rows.columns if c not in ("message_id", "component_idx", "part")]
    return rows.select("message_id", "component_idx", "part.component_type", "part.component_name", "part.content", *kept)


def text_messages(df: DataFrame, id_col: str, body_col: str, subject_col: str | None = None, sender_col: str | None = None, recipients_col: str | None = None) -> DataFrame:
    """Envelope (if there is a sender or a recipient), subject and body of each row."""
    sender = F.coalesce(F.col(sender_col), F.lit("")) if sender_col else F.lit("")
    to = F.array_join(recipients_col, ", ") if recipients_col else F.lit("")
    to = F.coalesce(to, F.lit(""))
    envelope = F.when((sender != "") | (to != ""), F.concat(F.lit("From: "), sender, F.lit("\nTo: "), to))
    subject = F.col(subject_col) if subject_col else F.lit(None).cast("string")
    return explode_parts(df, F.col(id_col), F.array(part("envelope", envelope), part("subject", subject), part("body", F.col(body_col))))


def conversations(df: DataFrame) -> DataFrame:
    """A conversation is a message; its turns are components: a system turn the subject, the others bodies."""
    kind = F.when(F.col("role") == "system", "subject").otherwise("body")
    return df.where(F.coalesce(F.col("text"), F.lit("")) != "").select(
        F.col("conv_id").cast("string").alias("message_id"), F.col("turn").cast("int").alias("component_idx"), kind.alias("component_type"), kind.alias("component_name"), F.col("text").alias("content")
    )


def http_messages(requests: DataFrame) -> DataFrame:
    """Envelope and body, or the fields and files of a form, of requests (request_id, method, url, client_ip, content_type, body)."""
    carry = requests.where(F.upper("method").isin(*BODY_METHODS) & (F.octet_length("body") > 0))
    envelope = F.concat(F.lit("URL:"), F.coalesce("url", F.lit("")), F.lit("\nSource-IP:"), F.coalesce("client_ip", F.lit("")), F.lit("\nMethod:"), F.upper("method"))
    return explode_parts(carry, F.col("request_id"), F.concat(F.array(part("envelope", envelope)), form_parts("content_type", "body")))


def _form(kind: str | None, body: bytes) -> list[dict]:
    if kind and kind.lower().startswith("multipart/"):
        message = email.message_from_bytes(b"Content-Type: " + kind.encode("latin-1", "replace") + b"\r\n\r\n" + body, policy=email.policy.HTTP)
        if message.is_multipart():
            out = []
            for p in message.iter_parts():
                name, text = p.get_filename(), (p.get_payload(decode=True) or b"").decode("utf-8", "replace")
                out.append({"component_type": "attachment" if name else "body", "component_name": name or "body", "content": text})
            return out
    return [{"component_type": "body", "component_name": "body", "content": body.decode("utf-8", "replace")}]


@F.pandas_udf(PARTS)
def form_parts(kind: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([_form(k, bytes(b)) for k, b in zip(kind, body)])


def _mail(raw: bytes | None, inner: bool = False) -> list[dict]:
    """Envelope, subject, text and HTML bodies and attachments of a mail; attached mails are opened."""
    if raw is None:
        return []
    message = email.message_from_bytes(bytes(raw), policy=email.policy.default)
    heads = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Reply-To", "Date", "X-Mailer") if message[h]]
    out = [{"component_type": "envelope", "component_name": "envelope", "content": "\n".join(heads)}, {"component_type": "subject", "component_name": "subject", "content": str(message["Subject"] or "")}]
    for p in message.walk():
        if p.is_multipart():
            continue
        data, name = p.get_payload(decode=True) or b"", p.get_filename()
        text = data.decode(p.get_content_charset() or "utf-8", "replace") if _known(p.get_content_charset()) else data.decode("utf-8", "replace")
        if name or p.get_content_disposition() == "attachment":
            out.append({"component_type": "attachment", "component_name": name or "attachment", "content": text})
        elif p.get_content_maintype() == "text":
            out.append({"component_type": "body", "component_name": "body", "content": text})
    return out


def _known(charset: str | None) -> bool:
    try:
        "".encode(charset or "utf-8")
    except LookupError:
        return False
    return True


@F.pandas_udf(PARTS)
def mail_parts(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in raw:
        yield s.map(_mail)


def smtp_messages(mails: DataFrame) -> DataFrame:
    """Components of mails (mail_id, raw)."""
    return explode_parts(mails, F.col("mail_id"), mail_parts("raw"))


def allowed_host(url: Column, domains: list[str]) -> Column:
    """Whether the URL's host is one of the domains or below one."""
    host = F.lower(F.call_function("try_parse_url", url, F.lit("HOST")))
    tests = [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))
