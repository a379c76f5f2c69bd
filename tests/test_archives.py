"""Archives unfolded by levels against a plain recursion, with limits that bite."""

import bz2
import gzip
import io
import pathlib
import random
import tarfile
import zipfile

import pytest

from inspectra.sources.archives import Limits, archive_components, unfold
from inspectra.storage import shared_dir


def zipped(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def tarred(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


class Stop(Exception):
    pass


def walk(content, name, limits):
    """The same by recursion: (entry, content or error)."""
    out, state = [], {"files": 0, "bytes": 0}

    def go(data, path, depth):
        base = path.rsplit("/", 1)[-1]
        kind = "zip" if data[:4] == b"PK\3\4" or base.endswith(".zip") else "gz" if data[:2] == b"\x1f\x8b" else "bz2" if data[:3] == b"BZh" else "tar" if data[257:262] == b"ustar" else None
        if kind is None:
            out.append((path, data))
            return
        if kind == "zip":
            try:
                members = [(i.filename, i.file_size, i.compress_size) for i in zipfile.ZipFile(io.BytesIO(data)).infolist()]
                read = zipfile.ZipFile(io.BytesIO(data)).read
            except zipfile.BadZipFile:
                out.append((path, "error"))
                return
        elif kind == "tar":
            t = tarfile.open(fileobj=io.BytesIO(data))
            members, read = [(m.name, m.size, 0) for m in t.getmembers()], lambda n: t.extractfile(n).read()
        else:
            whole = (gzip if kind == "gz" else bz2).decompress(data)
            members, read = [(base.rsplit(".", 1)[0], len(whole), len(data))], lambda n: whole
        for n, size, packed in members:
            here = f"{path}/{n}"
            if ".." in n.split("/"):
                out.append((here, "error"))
                continue
            for beyond in (kind in ("zip", "tar") and state["files"] >= limits.files, packed and size > limits.ratio * packed, state["bytes"] + size > limits.total):
                if beyond:
                    out.append((here, "error"))
                    raise Stop
            try:
                got = read(n)
            except Exception:
                state["files"], state["bytes"] = state["files"] + 1, state["bytes"] + size
                out.append((here, "error"))
                return
            state["files"], state["bytes"] = state["files"] + 1, state["bytes"] + size
            if depth + 1 > limits.depth:
                out.append((here, "error"))
                raise Stop
            go(got, here, depth + 1)

    try:
        go(content, name, 0)
    except Stop:
        pass
    return sorted(out, key=repr)


def tree(rng, depth):
    members = []
    for i in range(rng.randint(0, 5)):
        kind = rng.choice(["txt", "txt", "zip", "tar", "gz", "bz2", "up", "junk"]) if depth else "txt"
        text = rng.choice([b"", b"x" * rng.randint(1, 3000), bytes(rng.randbytes(rng.randint(1, 300)))])
        inner = tree(rng, depth - 1) if kind in ("zip", "tar") else []
        members.append({
            "txt": (f"d{i}/f{i}.txt", b"t" + text), "zip": (f"n{i}.zip", zipped(inner) if inner else zipped([("one", b"1")])), "tar": (f"n{i}.tar", tarred(inner or [("one", b"1")])), "gz": (f"g{i}.txt.gz", gzip.compress(text or b"1", mtime=0)),
            "bz2": (f"b{i}.bz2", bz2.compress(text or b"1")), "up": (f"../u{i}.txt", b"up"), "junk": (f"j{i}.zip", b"PK\3\4 damaged"),
        }[kind])
    return members or [("only.txt", b"only")]


def unfolded(spark, archives, limits):
    files = spark.createDataFrame([(f"/in/{n}", bytearray(d)) for n, d in archives], "path string, content binary")
    got = {n: [] for n, _ in archives}
    for r in unfold(files, limits).collect():
        got[r.root.rsplit("/", 1)[-1]].append((r.entry, "error" if r.error else bytes(r.content)))
    return {k: sorted(v, key=repr) for k, v in got.items()}


@pytest.mark.parametrize("limits", [Limits(), Limits(depth=2, total=6000, files=9, ratio=50), Limits(depth=1, total=2500, files=4, ratio=20)])
def test_trees_of_archives(spark, limits):
    rng = random.Random(limits.files)
    archives = [(f"a{i}.zip", zipped(tree(rng, 4))) for i in range(25)]
    archives += [("plain.txt", b"as it is"), ("t.tar", tarred([("a", b"1"), ("b.zip", zipped([("c", b"2")]))])), ("many.zip", zipped([(f"{i}.txt", b"x") for i in range(30)])), ("stored.zip", zipped([("s", b"stored")], zipfile.ZIP_STORED)), ("lz.zip", zipped([("l", b"lzma" * 50)], zipfile.ZIP_LZMA)), ("bz.zip", zipped([("l", b"bzip" * 50)], zipfile.ZIP_BZIP2))]
    broken = bytearray(zipped([("a.txt", b"first"), ("b.txt", bytes(random.Random(1).randbytes(400))), ("c.txt", b"third")]))
    broken[broken.index(b"b.txt") + 100] ^= 255
    archives.append(("broken.zip", bytes(broken)))
    got = unfolded(spark, archives, limits)
    for name, data in archives:
        assert got[name] == walk(data, name, limits), name


def test_default_limits(spark):
    deep = b"last"
    for i in range(5):
        deep = zipped([(f"l{i}.zip" if i else "t.txt", deep)])
    got = unfolded(spark, [("deep.zip", deep), ("many.zip", zipped([(f"{i}", b"x") for i in range(501)])), ("bomb.zip", zipped([("a", b"a"), ("big", b"0" * 20_000_000)])), ("bomb.gz", gzip.compress(b"0" * 20_000_000))], None)
    assert [e for _, e in got["deep.zip"]] == ["error"]
    assert sum(e == b"x" for _, e in got["many.zip"]) == 500 and len(got["many.zip"]) == 501
    assert got["bomb.zip"] == [("bomb.zip/a", b"a"), ("bomb.zip/big", "error")]
    assert [e for _, e in got["bomb.gz"]] == ["error"]


def test_components_and_nothing(spark):
    files = spark.createDataFrame([("/x/a.zip", bytearray(zipped([("in.txt", b"inner"), ("p.html", b"<p>page</p>"), ("../no", b"no")]))), ("/x/b.txt", bytearray(b"plain")), ("/x/none.zip", None), ("/x/empty", bytearray(b""))], "path string, content binary")
    got = sorted(map(tuple, archive_components(files).collect()))
    assert got[:3] == [("/x/a.zip", 0, "attachment", "a.zip/in.txt", "inner"), ("/x/a.zip", 1, "attachment", "a.zip/p.html", "page"), ("/x/a.zip", 2, "generic", "a.zip/../no", "[Path leaves the archive: ../no]")]
    assert got[3] == ("/x/b.txt", 0, "body", "b.txt", "plain") and len(got) <= 5
    assert unfold(files.limit(0)).count() == 0


def test_members_of_one_archive_are_dealt_by_member(spark):
    one = zipped([(f"{i}.txt", bytes([i])) for i in range(200)])
    got = unfold(spark.createDataFrame([("a.zip", bytearray(one))], "path string, content binary"))
    assert got.count() == 200
    newest = max((p for p in pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("unpacked-*")), key=lambda p: p.stat().st_mtime)
    assert len(list(newest.glob("part-*.parquet"))) > 1
