"""File types by content and name."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.functions.patterns import glob, let
from inspectra.schema import MATCH_COLUMNS

# Offset, first bytes in hexadecimal, MIME type, category, name. Earlier rows win.
SIGNATURES = (
    (0, "255044462D", "application/pdf", "document", "PDF"),
    (0, "7B5C727466", "application/rtf", "document", "Rich Text Format (RTF)"),
    (0, "D0CF11E0A1B11AE1", "application/msword", "document", "Microsoft Word (DOC)"),
    (0, "4D5A", "application/x-dosexec", "executable", "Windows Executable (EXE/DLL)"),
    (0, "7F454C46", "application/x-executable", "executable", "Linux Executable (ELF)"),
    (0, "CFFAEDFE", "application/x-mach-binary", "executable", "macOS Executable (Mach-O)"),
    (0, "CAFEBABE", "application/x-java-applet", "executable", "Java Applet"),
    (0, "504B0304", "application/zip", "archive", "ZIP"),
    (0, "504B0506", "application/zip", "archive", "ZIP"),
    (0, "1F8B", "application/gzip", "archive", "GZIP"),
    (0, "425A68", "application/x-bzip2", "archive", "BZIP2"),
    (0, "FD377A585A00", "application/x-xz", "archive", "XZ"),
    (0, "377ABCAF271C", "application/x-7z-compressed", "archive", "7-Zip"),
    (0, "526172211A07", "application/x-rar", "archive", "RAR"),
    (257, "7573746172", "application/x-tar", "archive", "TAR"),
    (0, "FFD8FF", "image/jpeg", "image", "JPEG Image"),
    (0, "89504E470D0A1A0A", "image/png", "image", "PNG Image"),
    (0, "47494638", "image/gif", "image", "GIF Image"),
    (0, "424D", "image/bmp", "image", "BMP Image"),
    (0, "49492A00", "image/tiff", "image", "TIFF Image"),
    (0, "4D4D002A", "image/tiff", "image", "TIFF Image"),
    (8, "57454250", "image/webp", "image", "WebP Image"),
    (0, "00000100", "image/x-icon", "image", "ICO Image"),
    (0, "494433", "audio/mpeg", "media", "MP3 Audio"),
    (0, "FFFB", "audio/mpeg", "media", "MP3 Audio"),
    (8, "57415645", "audio/wav", "media", "WAV Audio"),
    (8, "41564920", "video/x-msvideo", "media", "AVI Video"),
    (0, "4F676753", "audio/ogg", "media", "OGG Audio"),
    (0, "664C6143", "audio/flac", "media", "FLAC Audio"),
    (4, "66747970", "video/mp4", "media", "MP4 Video"),
    (0, "1A45DFA3", "video/x-matroska", "media", "MKV Video"),
    (0, "53514C69746520666F726D61742033", "application/x-sqlite3", "data", "SQLite Database"),
    (0, "2D2D2D2D2D424547494E2043455254", "application/x-x509-ca-cert", "encrypted", "X.509 Certificate"),
    (0, "2D2D2D2D2D424547494E20504750", "application/pgp-encrypted", "encrypted", "PGP Encrypted"),
    (0, "2321", "text/x-shellscript", "script", "Shell Script"),
    (0, "3C3F786D6C", "text/xml", "document", "XML"),
    (0, "3C21444F4354595045", "text/html", "document", "HTML"),
    (0, "3C68746D6C", "text/html", "document", "HTML"),
)
# Types by the name's ending, where the content says nothing or only ZIP.
EXTENSIONS = {
    ".docx": ("document", "Microsoft Word (DOCX)"), ".xlsx": ("document", "Microsoft Excel (XLSX)"), ".pptx": ("document", "Microsoft PowerPoint (PPTX)"),
    ".odt": ("document", "OpenDocument Text (ODT)"), ".ods": ("document", "OpenDocument Spreadsheet (ODS)"), ".odp": ("document", "OpenDocument Presentation (ODP)"),
    ".py": ("script", "Python Script"), ".js": ("script", "JavaScript"), ".ts": ("script", "TypeScript"), ".rb": ("script", "Ruby Script"),
    ".php": ("script", "PHP Script"), ".sh": ("script", "Shell Script"), ".bat": ("script", "Batch Script"), ".ps1": ("script", "PowerShell Script"),
    ".sql": ("data", "SQL"), ".yaml": ("data", "YAML"), ".yml": ("data", "YAML"), ".json": ("data", "JSON"), ".csv": ("document", "CSV"),
    ".md": ("document", "Markdown"), ".eml": ("document", "Email (EML)"),
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/\\.](\.[^./\\]+)$", 1))


def file_info(content: Column, name: Column) -> Column:
    """(mime, category, type_name, extension, size); unknown content goes by the name, then is text or unknown."""
    ext = extension(F.coalesce(name, F.lit("")))
    kind = "struct<mime:string,category:string,type_name:string>"
    row = lambda m, c, t: F.struct(F.lit(m).cast("string").alias("mime"), F.lit(c).alias("category"), F.lit(t).alias("type_name")).cast(kind)
    named = F.coalesce(*[F.when(ext == e, row(None, c, t)) for e, (c, t) in EXTENSIONS.items()])
    magic = F.coalesce(*[F.when(F.hex(F.substring(content, at + 1, len(h) // 2)) == h, row(m, c, t)) for at, h, m, c, t in SIGNATURES])
    text = F.when((F.octet_length(content) > 0) & F.is_valid_utf8(content.cast("string")) & ~F.contains(F.substring(content, 1, 8192), F.lit(b"\0")), row("text/plain", "document", "Plain Text"))

    def chosen(z: Column) -> Column:
        by_name = F.when((z["magic"]["category"] == "archive") & (z["named"]["category"] == "document"), z["named"])
        return F.coalesce(by_name, z["magic"], z["named"], text, row("application/octet-stream", "unknown", "Unknown"))

    whole = lambda x: F.struct(x["mime"].alias("mime"), x["category"].alias("category"), x["type_name"].alias("type_name"), ext.alias("extension"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("size"))
    return let(let(F.struct(magic.alias("magic"), named.alias("named")), chosen), whole)


@dataclass(frozen=True)
class FileRule:
    """All that is given must hold; a rule that gives nothing never does."""

    name: str
    categories: tuple[str, ...] = ()
    mimes: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    min_size: int | None = None
    max_size: int | None = None


def file_rule(rule: FileRule, info: Column, name: Column) -> Column:
    tests = []
    if rule.categories:
        tests.append(info["category"].isin(*rule.categories))
    if rule.mimes:
        tests.append(info["mime"].isin(*rule.mimes))
    if rule.extensions:
        tests.append(info["extension"].isin(*(("." + e.lower().lstrip(".")) for e in rule.extensions)))
    if rule.globs:
        tests.append(reduce(lambda a, b: a | b, (F.lower(name).rlike(glob(g)) for g in rule.globs)))
    if rule.min_size is not None:
        tests.append(info["size"] >= rule.min_size)
    if rule.max_size is not None:
        tests.append(info["size"] <= rule.max_size)
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(False)


def scan_file_types(files: DataFrame, rules: list[FileRule], content_col: str = "content_bytes", name_col: str = "filename") -> DataFrame:
    """A row (columns of files, rule_name, file_info) for each rule that a file meets; files with neither content nor name have none."""
    info = file_info(F.col(content_col), F.col(name_col))
    seen = files.where(F.col(content_col).isNotNull() | F.col(name_col).isNotNull()).withColumn("file_info", info)
    met = F.filter(F.array(*[F.when(file_rule(r, F.col("file_info"), F.col(name_col)), r.name) for r in rules]).cast("array<string>"), lambda x: x.isNotNull())
    return seen.withColumn("rule_name", F.explode(met))


def file_type_matches(components: DataFrame, analyzer: str, extensions: list[str]) -> DataFrame:
    """Attachments whose name has one of the endings, as matches at no place."""
    hit = components.where((F.col("component_type") == "attachment") & extension(F.col("component_name")).isin(*extensions))
    return hit.select("message_id", "component_idx", "component_type", "component_name", F.lit(analyzer).alias("analyzer_name"), extension(F.col("component_name")).alias("rule_name"), F.col("component_name").alias("matched_text"), F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), F.lit(1.0).alias("confidence")).select(*MATCH_COLUMNS)
