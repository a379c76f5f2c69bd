"""Archives unfolded level by level: members are rows that are dealt anew, not the loop of one task.

A level lists the members of the archives found so far, with their sizes as the archive says and their packed bytes cut out, not yet unpacked;
the limits of files, bytes, ratio and depth are checked over all levels known; what is left is dealt by member and unpacked, each in a
task of its own; archives among them are the next level's. So one archive of many members spreads over tasks.

Limits count in the order of a walk that goes into a nested archive before its next neighbour: a member's place is the array of
its numbers from the root down, and files and bytes before it are window sums over a root's places. The first member beyond a
limit ends its root's walk: what comes before it counts, it is an error row, what follows is dropped. Levels that aren't
unfolded yet can only add to the sums, so what a level drops would never have been reached.

Edge cases: null and empty contents are files as they are; so are office documents, by their names; a member that can't be read is an error row, counts with the size its archive says,
and later members of that archive are dropped; an archive that can't be read, 7z and RAR are error rows; paths that leave the archive, links and
devices are error rows and don't count; equal rows need keys of their own.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from email import message_from_bytes, policy
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectra.functions.steps import each_in_steps
from inspectra.sources.files import MOST_DEPTH, MOST_FILES, MOST_RATIO, MOST_TOTAL, archive_kind, extracted, safe_member
from inspectra.sources.messages import mail_parts
from inspectra.storage import kept

_MEMBER = T.StructType().add("name", "string").add("size", "long").add("packed", "long").add("method", "integer").add("crc", "long").add("data", "binary").add("error", "string")
STORED, DEFLATED, BZIP2, LZMA = 0, 8, 12, 14
_READ = 1 << 20


@dataclass(frozen=True)
class Limits:
    depth: int = MOST_DEPTH
    total: int = MOST_TOTAL
    files: int = MOST_FILES
    ratio: float = MOST_RATIO


def _failed(what: str) -> dict:
    return {"name": None, "size": 0, "packed": 0, "method": STORED, "crc": None, "data": None, "error": what}


def _zip_members(raw: bytes, most: int) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for i in z.infolist()[: 4 * most + 4]:
            if i.is_dir():
                continue
            head = raw[i.header_offset : i.header_offset + 30]
            at = i.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
            yield {"name": i.filename, "size": i.file_size, "packed": i.compress_size, "method": -1 if i.flag_bits & 1 else i.compress_type, "crc": i.CRC, "data": raw[at : at + i.compress_size], "error": None}


def _tar_members(raw: bytes, most: int) -> Iterator[dict]:
    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as t:
        for m in t.getmembers():
            if m.isdir():
                continue
            if not m.isreg():
                yield _failed(f"Skipping link or device: {m.name}") | {"name": m.name}
            else:
                yield {"name": m.name, "size": m.size, "packed": 0, "method": STORED, "crc": None, "data": raw[m.offset_data : m.offset_data + m.size], "error": None}


def _stream_member(raw: bytes, name: str, opener, limits: Limits) -> Iterator[dict]:  # noqa: ANN001
    """The one member of a compressed stream; what goes beyond the limits is counted, up to the ratio, and not kept."""
    parts, size, most = [], 0, max(limits.total, int(limits.ratio * len(raw))) + 1
    with opener(io.BytesIO(raw)) as f:
        while size < most and (got := f.read(_READ)):
            size += len(got)
            if size <= limits.total:
                parts.append(got)
    low = name.lower()
    inner = next((name[: -len(e)] + (".tar" if e == ".tgz" else "") for e in (".gz", ".gzip", ".tgz", ".bz2") if low.endswith(e)), name)
    yield {"name": inner or "content", "size": size, "packed": len(raw), "method": STORED, "crc": None, "data": b"".join(parts), "error": None}


def list_members(raw: bytes, name: str, kind: str, limits: Limits) -> list[dict]:
    """The members of one archive, packed, up to the first that is certainly beyond the limits."""
    openers = {"gz": lambda f: gzip.GzipFile(fileobj=f), "bz2": bz2.BZ2File}
    out, files, size = [], 0, 0
    try:
        if kind not in ("zip", "tar", *openers):
            raise ValueError(f"no reader of {kind} archives")
        members = _zip_members(raw, limits.files) if kind == "zip" else _tar_members(raw, limits.files) if kind == "tar" else _stream_member(raw, name, openers[kind], limits)
        for m in members:
            out.append(m)
            files, size = files + (m["error"] is None), size + m["size"]
            if files > limits.files or size > limits.total:
                out[-1] = m | {"data": None}
                break
    except Exception as e:  # a damaged archive is a finding, not a failed job
        out = [_failed(f"Failed to extract {name}: {e}")]
    return out


def unpack(data: bytes, method: int, size: int, crc: int | None) -> bytes:
    """A member's bytes. Raises where they aren't what its archive says."""
    if method == STORED:
        raw = bytes(data)
    elif method == DEFLATED:
        raw = zlib.decompressobj(-15).decompress(data, size + 1)
    elif method == BZIP2:
        raw = bz2.BZ2Decompressor().decompress(data, size + 1)
    elif method == LZMA:
        n = int.from_bytes(data[2:4], "little")  # version, length of the properties, the properties
        bits, words = data[4], int.from_bytes(data[5:9], "little")
        chosen = {"id": lzma.FILTER_LZMA1, "lc": bits % 9, "lp": bits // 9 % 5, "pb": bits // 45, "dict_size": words}
        raw = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[chosen]).decompress(data[4 + n :], size + 1)
    else:
        raise ValueError("encrypted, or packed by an unknown method")
    if len(raw) != size or (crc is not None and zlib.crc32(raw) != crc):
        raise ValueError("damaged")
    return raw


def _unpacked_or_error(data: bytes, method: int, size: int, crc: int | None) -> dict:
    try:
        return {"content": unpack(data, method, size, crc), "error": None}
    except Exception as e:
        return {"content": None, "error": str(e)}


#: Steps go by the sizes that the archives say.
_unpacked = each_in_steps(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]), _unpacked_or_error, expected=2)


def _base(path):  # noqa: ANN001, ANN202
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def _kind(content: Column, entry: Column) -> Column:
    """The kind of archive; office documents, which are ZIP files too, are read as documents."""
    return F.when(~F.lower(entry).rlike(r"\.(docx|xlsx|pptx)$"), archive_kind(content, entry))


def _ends(known: DataFrame, limits: Limits) -> DataFrame:
    """root, end (the place where the root's walk ends) and reason, of the roots that go beyond a limit."""
    before = Window.partitionBy("root").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("error").isNull()
    files = F.coalesce(F.sum(counts.cast("long")).over(before), F.lit(0))
    size = F.coalesce(F.sum(F.when(counts, F.col("size"))).over(before), F.lit(0))
    reason = (
        F.when(~counts, F.lit(None))
        .when((files >= limits.files) & F.col("kind").isin("zip", "tar"), f"more than {limits.files} files")
        .when((F.col("packed") > 0) & (F.col("size") > limits.ratio * F.col("packed")), f"more than {limits.ratio:g} times its size")
        .when(size + F.col("size") > limits.total, f"more than {limits.total} bytes")
        .when(F.size("place") > limits.depth, f"more than {limits.depth} levels")
    )
    seen = known.withColumn("reason", reason).where("reason IS NOT NULL")
    return seen.groupBy("root").agg(F.min("place").alias("end"), F.min_by("reason", "place").alias("reason"))


def unfold(files: DataFrame, limits: Limits | None = None, key_col: str = "path", content_col: str = "content", name_col: str | None = None) -> DataFrame:
    """root, place, entry (the path through the archives), content and error: the files in archives, files that are none, and errors.

    The number of steps is the limit of depth, not the data's.
    """
    limits = limits or Limits()

    members = each_in_steps(T.ArrayType(_MEMBER), lambda content, name, kind: list_members(content, name, kind, limits))
    name = _base(F.col(name_col or key_col).cast("string"))
    rows = files.select(F.col(key_col).alias("root"), F.array().cast("array<int>").alias("place"), name.alias("entry"), F.col(content_col).alias("content"), F.lit(None).cast("string").alias("error"))
    opened = [rows.withColumn("kind", _kind(F.col("content"), F.col("entry")))]
    known = None
    for _ in range(limits.depth + 1):
        inside = opened[-1].where("kind IS NOT NULL AND error IS NULL")
        listed = inside.select("root", "place", "entry", "kind", F.posexplode(members("content", _base(F.col("entry")), "kind")).alias("i", "m"))
        bad = F.when(F.col("m.error").isNull() & F.col("kind").isin("zip", "tar") & ~safe_member(F.col("m.name")), F.concat(F.lit("Path leaves the archive: "), "m.name"))
        entry = F.when(F.col("m.name").isNull(), F.col("entry")).otherwise(F.concat_ws("/", "entry", "m.name"))
        listed = kept(listed.select("root", F.concat("place", F.array("i")).alias("place"), entry.alias("entry"), "kind", "m.size", "m.packed", "m.method", "m.crc", "m.data", F.coalesce("m.error", bad).alias("error")), "listed")
        slim = listed.select("root", "place", "entry", "kind", "size", "packed", "error")
        known = slim if known is None else known.unionByName(slim)
        ends = _ends(known, limits)
        known = kept(known.join(ends, "root", "left").where(F.col("end").isNull() | (F.col("place") <= F.col("end"))).drop("end", "reason"), "members")
        # dealt by member, so that an archive's members are unpacked by many tasks
        open_now = known.where((F.size("place") <= limits.depth) & F.col("error").isNull()).join(ends, "root", "left").where(F.col("end").isNull() | (F.col("place") < F.col("end"))).select("root", "place")
        packed = listed.where("data IS NOT NULL").select("root", "place", "entry", "data", "method", "size", "crc")
        got = packed.join(open_now, ["root", "place"]).repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "place")
        got = got.select("root", "place", "entry", _unpacked("data", "method", "size", "crc").alias("u")).select("root", "place", "entry", "u.content", F.when(F.col("u.error").isNotNull(), F.concat(F.lit("Failed to extract "), "entry", F.lit(": "), "u.error")).alias("error"))
        got = got.withColumn("kind", F.when(F.col("error").isNull(), _kind(F.col("content"), F.col("entry"))))
        got = kept(got, "unpacked")
        parent, last = F.slice("place", 1, F.size("place") - 1), F.element_at("place", -1)
        broken = got.where("error IS NOT NULL").groupBy("root", parent.alias("parent")).agg(F.min(last).alias("last"))
        within = lambda df: df.withColumn("parent", parent).join(broken, ["root", "parent"], "left").where(F.col("last").isNull() | (F.element_at("place", -1) <= F.col("last"))).drop("parent", "last")
        opened.append(within(got))
        known = within(known)
        if opened[-1].where("kind IS NOT NULL").isEmpty():
            break
    ends = _ends(known, limits)
    reached = lambda df: df.join(ends, "root", "left").where(F.col("end").isNull() | (F.col("place") < F.col("end"))).drop("end", "reason")
    none = F.lit(None).cast("binary").alias("content")
    leaves = reached(reduce(DataFrame.unionByName, opened).where("kind IS NULL")).select("root", "place", "entry", "content", "error")
    problems = reached(known.where("error IS NOT NULL")).select("root", "place", "entry", none, "error")
    stopped = known.join(ends.withColumnRenamed("end", "place"), ["root", "place"]).select("root", "place", "entry", none, F.concat(F.lit("Archive safety limit: "), "reason").alias("error"))
    return leaves.unionByName(problems).unionByName(stopped)


def archive_components(files: DataFrame, limits: Limits | None = None, key_col: str = "path", content_col: str = "content") -> DataFrame:
    """message_id (the key), component_idx, component_type, component_name (the path through the archives) and content of files and what archives hold."""
    rows = unfold(files, limits, key_col, content_col)
    wrong = F.array(F.struct(F.lit("generic").alias("component_type"), F.col("entry").alias("component_name"), F.concat(F.lit("["), "error", F.lit("]")).alias("content")))
    nested = F.when(F.size("place") > 0, "attachment")
    found = F.transform(extracted(F.col("content"), _base(F.col("entry"))), lambda p: F.struct(F.when(p["component_type"] == "body", F.coalesce(nested, p["component_type"])).otherwise(p["component_type"]).alias("component_type"), F.when(F.size("place") > 0, F.col("entry")).otherwise(p["component_name"]).alias("component_name"), p["content"].alias("content")))
    parts = rows.select(F.col("root").cast("string").alias("message_id"), "place", F.posexplode(F.when(F.col("error").isNotNull(), wrong).otherwise(found)).alias("i", "p"))
    number = F.row_number().over(Window.partitionBy("message_id").orderBy("place", "i")) - 1
    return parts.select("message_id", number.cast("int").alias("component_idx"), "p.component_type", "p.component_name", "p.content")


def _attachments(mail: bytes | None) -> list[dict]:
    """Names and bytes of a mail's attachments; a mail that is attached is one file."""
    out = []
    for p in message_from_bytes(mail, policy=policy.default).walk() if mail is not None else ():
        name = p.get_filename()
        if not p.is_multipart() and (name or p.get_content_disposition() == "attachment"):
            out.append({"name": name or "attachment", "content": p.get_payload(decode=True) or b""})
    return out


_attached = each_in_steps(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])), _attachments)


def mail_components(mails: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Components of mails (mail_id, raw) whose attachments are inspected as files: office documents are read, archives unfolded."""
    texts = mails.select(F.col("mail_id").cast("string").alias("message_id"), F.posexplode(mail_parts("raw")).alias("n", "p")).where("p.component_type <> 'attachment'")
    own = texts.select("message_id", F.lit(-1).alias("file"), F.array("n").alias("place"), F.lit(0).alias("i"), "p.component_type", "p.component_name", "p.content")
    files = mails.select(F.col("mail_id").cast("string").alias("message_id"), F.posexplode(_attached("raw")).alias("file", "a")).select(F.struct("message_id", "file").alias("key"), F.col("a.name").alias("name"), F.col("a.content").alias("content"))
    rows = unfold(files, limits, "key", "content", "name")
    text = F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit("generic").alias("component_type"), F.col("entry").alias("component_name"), F.concat(F.lit("["), "error", F.lit("]")).alias("content")))).otherwise(
        F.transform(extracted(F.col("content"), _base(F.col("entry"))), lambda p: F.struct(F.when(p["component_type"] == "body", "attachment").otherwise(p["component_type"]).alias("component_type"), F.col("entry").alias("component_name"), p["content"].alias("content")))
    )
    held = rows.select("root.message_id", "root.file", "place", F.posexplode(text).alias("i", "p")).select("message_id", "file", "place", "i", "p.component_type", "p.component_name", "p.content")
    number = F.row_number().over(Window.partitionBy("message_id").orderBy("file", "place", "i")) - 1
    return own.unionByName(held).where("content <> ''").select("message_id", number.cast("int").alias("component_idx"), "component_type", "component_name", "content")
