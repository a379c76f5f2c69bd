"""Files as rows: walks with limits and increments, texts out of bytes, office documents, mails and archives."""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectra.functions.steps import each_in_steps
from inspectra.operators.filetype import extension
from inspectra.sources.messages import _mail

MOST_BYTES, MOST_CHARS = 100_000_000, 10_000_000
#: Of archives: levels, bytes in all, files, and how many times larger than the archive its content may be.
MOST_DEPTH, MOST_TOTAL, MOST_FILES, MOST_RATIO = 3, 100_000_000, 500, 1000
TRUNCATED = "\n[TRUNCATED]"
#: Elements whose end is a line's end, and whose text is no text.
BREAKS, HIDDEN = {"p", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr"}, {"script", "style"}
_PARTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("component_type", "component_name", "content")]))
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), excluded: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, modificationTime, length and content of the files below root that are not empty, too large, excluded or of other types."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    keep = F.col("length").between(1, most_bytes)
    if extensions:
        keep = keep & extension(F.col("path")).isin(*(("." + e.lower().lstrip(".")) for e in extensions))
    for prefix in excluded:
        keep = keep & ~F.col("path").startswith(prefix)
    return files.where(keep)


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache (path, length, modificationTime) doesn't know as they are."""
    known = cache.select("path", F.col("length").alias("_length"), F.col("modificationTime").alias("_time"))
    same = (F.col("_length") == F.col("length")) & (F.col("_time") == F.col("modificationTime"))
    return files.join(known, "path", "left").where(~F.coalesce(same, F.lit(False))).drop("_length", "_time")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in HIDDEN
        if tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BREAKS and tag != "br":
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_to_text(page: str | None) -> str | None:
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "".join(parser.out).strip()


html_text = each_in_steps(T.StringType(), html_to_text)


def truncated(text: Column, most: int = MOST_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)


def printable_strings(content: Column, least: int = 6) -> Column:
    """Runs of readable ASCII of so many characters or more, one on a line."""
    return F.array_join(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"[\x20-\x7E\t\r\n]{%d,}" % least), F.lit(0)), "\n")


def archive_kind(content: Column, name: Column) -> Column:
    """zip, gz, bz2, 7z, rar or tar by the first bytes, else by the name; null for no archive."""
    starts = lambda h, at=1: F.hex(F.substring(content, at, len(h) // 2)) == h
    by_magic = F.when(starts("504B0304"), "zip").when(starts("1F8B"), "gz").when(starts("425A68"), "bz2").when(starts("377ABCAF271C"), "7z").when(starts("526172211A07"), "rar").when(starts("7573746172", 258), "tar")
    low = F.lower(name)
    by_name = F.coalesce(*[F.when(low.endswith(e), k) for e, k in ((".zip", "zip"), (".tgz", "gz"), (".gz", "gz"), (".bz2", "bz2"), (".7z", "7z"), (".rar", "rar"), (".tar", "tar"))])
    return F.coalesce(by_magic, by_name)


def safe_member(path: Column) -> Column:
    """Whether a member's path stays inside: not empty or absolute, no step up, no reserved name."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    reserved = F.exists(parts, lambda p: p.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"))
    return F.coalesce((path != "") & ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..") & ~reserved, F.lit(False))


def decode_text(raw: bytes) -> str:
    """By byte order mark, else UTF-8, else UTF-16 where every other byte is zero, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    head = raw[:4096]
    if len(head) >= 4:
        for at, name in ((1, "utf-16-le"), (0, "utf-16-be")):
            if head[at::2].count(0) > 0.7 * len(head[at::2]) and head[1 - at :: 2].count(0) < 0.1 * len(head):
                return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def looks_like_text(raw: bytes) -> bool:
    head = raw[:8192]
    odd = sum(b < 32 and b not in b"\t\n\r\f\b\x1b" for b in head)
    return bool(head) and odd < 0.05 * len(head)


def _docx(z: zipfile.ZipFile) -> list[str]:
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    paragraphs = [text(p) for p in body.findall(f"{_W}p")]
    tables = ["\n".join(" | ".join(text(c) for c in r.findall(f"{_W}tc")) for r in t.findall(f"{_W}tr")) for t in body.findall(f"{_W}tbl")]
    return ["\n".join(p for p in paragraphs if p.strip()), *tables]


def _xlsx(z: zipfile.ZipFile) -> list[str]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
            cells = []
            for c in row.findall(f"{_S}c"):
                v = c.findtext(f"{_S}v")
                cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else shared[int(v)] if c.get("t") == "s" and v else v or "")
            if any(x.strip() for x in cells):
                rows.append(" | ".join(cells))
        out.append("\n".join(rows))
    return out


def _pptx(z: zipfile.ZipFile) -> list[str]:
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    return ["\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p")) for n in names]


class Unsafe(ValueError):
    """An archive that goes beyond a limit."""


def _members(raw: bytes, name: str, budget: dict[str, int]) -> list[tuple[str, bytes]] | None:
    """Files of an archive one level down; None if it is none."""

    def take(path: str, size: int, read) -> tuple[str, bytes] | None:  # noqa: ANN001
        parts = path.replace("\\", "/").split("/")
        if not path or path[0] in "/\\" or re.match("[A-Za-z]:", path) or ".." in parts or any(re.fullmatch(r"(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?", p) for p in parts):
            return None
        budget["files"] += 1
        if budget["files"] > MOST_FILES:
            raise Unsafe(f"more than {MOST_FILES} files")
        data = read()
        budget["bytes"] += len(data)
        if budget["bytes"] > MOST_TOTAL:
            raise Unsafe(f"more than {MOST_TOTAL} bytes")
        if len(data) > MOST_RATIO * max(1, len(raw)):
            raise Unsafe(f"more than {MOST_RATIO} times its size")
        return path, data

    def bounded(stream, path: str) -> bytes:  # noqa: ANN001
        data = stream.read(MOST_TOTAL - budget["bytes"] + 1)
        return data

    if zipfile.is_zipfile(io.BytesIO(raw)) and raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            got = [take(i.filename, i.file_size, lambda i=i: bounded(z.open(i), i.filename)) for i in z.infolist() if not i.is_dir()]
        return [g for g in got if g]
    if len(raw) > 262 and raw[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            got = [take(m.name, m.size, lambda m=m: bounded(t.extractfile(m), m.name)) for m in t if m.isfile()]
        return [g for g in got if g]
    for magic, opener, ends in ((b"\x1f\x8b", gzip.GzipFile, (".gz", ".tgz")), (b"BZh", bz2.BZ2File, (".bz2",))):
        if raw.startswith(magic):
            with opener(io.BytesIO(raw) if opener is bz2.BZ2File else None, **({} if opener is bz2.BZ2File else {"fileobj": io.BytesIO(raw)})) as f:
                inner = next((name[: -len(e)] + (".tar" if e == ".tgz" else "") for e in ends if name.lower().endswith(e)), name + ".out")
                got = take(inner.rsplit("/", 1)[-1] or "content", 0, lambda: bounded(f, inner))
            return [got] if got else []
    return None


def extract(raw: bytes | None, name: str | None, depth: int = 0, budget: dict[str, int] | None = None) -> list[dict]:
    """Components of a file: pages, sheets, slides, a mail's parts, an archive's files; errors are generic components."""
    part = lambda kind, text, of=None: {"component_type": kind, "component_name": of or kind, "content": text if len(text) <= MOST_CHARS else text[:MOST_CHARS] + TRUNCATED}
    if raw is None or not len(raw):
        return []
    raw, name, budget = bytes(raw), name or "", budget if budget is not None else {"files": 0, "bytes": 0}
    if len(raw) > MOST_BYTES:
        return [part("generic", f"[File too large: {len(raw)} bytes]")]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if ext in (".docx", ".xlsx", ".pptx"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return [part("body", t) for t in {".docx": _docx, ".xlsx": _xlsx, ".pptx": _pptx}[ext](z) if t.strip()]
        if ext == ".eml":
            return [p for p in _mail(raw) if p["content"]]
        members = _members(raw, name, budget)
        if members is not None:
            if depth >= MOST_DEPTH:
                raise Unsafe(f"more than {MOST_DEPTH} levels")
            return [p | {"component_name": f"{path}" if p["component_type"] != "generic" else p["component_name"]} for path, data in members for p in extract(data, path, depth + 1, budget)]
        if ext in (".html", ".htm"):
            return [part("attachment" if depth else "body", html_to_text(decode_text(raw)) or "", name)]
        if looks_like_text(raw) or raw[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\0" in raw[:64] and decode_text(raw).isprintable():
            return [part("attachment" if depth else "body", decode_text(raw), name)]
        return [part("attachment", "", name)]
    except Unsafe as e:
        return [part("generic", f"[Archive safety limit: {e}]")]
    except Exception as e:  # a damaged file is a finding, not a failed job
        return [part("generic", f"[Extraction failed: {type(e).__name__}: {e}]")]


extracted = each_in_steps(_PARTS, lambda content, name: extract(content, name))


def file_components(files: DataFrame, content_col: str = "content", path_col: str = "path") -> DataFrame:
    """message_id (the path), component_idx, component_type, component_name and content of files."""
    rows = files.select(F.col(path_col).alias("message_id"), F.posexplode(extracted(F.col(content_col), F.regexp_extract(path_col, r"[^/\\]*$", 0))).alias("component_idx", "p"))
    return rows.select("message_id", "component_idx", "p.component_type", "p.component_name", "p.content")


def pages_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", html_text("html").alias("text"))
