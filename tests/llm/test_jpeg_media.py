"""Progressive JPEG against Java's own reader and writer; payloads against the texts."""

import hashlib
import random
import zlib

import numpy as np

from inspectra.llm import jpeg_codec as C
from inspectra.llm import jpeg_media as M

TEXTS = [None, "", "a", "x" * 63, "x" * 64, "e" * 5000, " " * 3000, "naïve 中文 👩‍👩‍👧 " * 40, "".join(map(chr, range(1, 300))), "the quick brown fox\n" * 900]


def java_pixels(spark, raw):
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    w, h = image.getWidth(), image.getHeight()
    raster, bands = image.getRaster(), min(3, image.getRaster().getNumBands())
    got = np.array([[[raster.getSample(x, y, b) for b in range(bands)] for x in range(w)] for y in range(h)])
    return got if bands == 3 else np.repeat(got, 3, 2)


def java_progressive(spark, pixels, quality):
    """The file that Java writes for grey pixels, or for RGB ones."""
    jvm = spark.sparkContext._jvm
    grey = pixels.ndim == 2
    h, w = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    for y in range(h):
        for x in range(w):
            p = int(pixels[y, x]) * 0x10101 if grey else int.from_bytes(bytes(pixels[y, x].tolist()), "big")
            if grey:
                image.getRaster().setSample(x, y, 0, int(pixels[y, x]))
            else:
                image.setRGB(x, y, p)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


def test_reads_what_java_writes(spark):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:37, :50]
    grey = np.clip(128 + 80 * np.sin(x / 5) + 40 * np.cos(y / 3) + rng.normal(0, 10, x.shape), 0, 255).astype(np.uint8)
    smooth = np.stack([grey, 255 - grey, (x * 5).astype(np.uint8)], 2)
    for pixels in (grey, smooth):
        for quality in (0.3, 0.95):
            raw = java_progressive(spark, pixels, quality)
            assert b"\xff\xc2" in raw
            coefficients, (image,), _ = C.decode([raw])
            got = C.rgb(coefficients, image).astype(int)
            want = java_pixels(spark, raw)
            assert got.shape == want.shape == (37, 50, 3)
            near = np.abs(got - want)
            # Java smooths chroma when it upsamples; grey samples are the same up to rounding
            assert near.max() <= 1 if pixels is grey else near.mean() < 6, (near.max(), near.mean())


def test_java_reads_what_is_written(spark):
    for t in ("hello world, " * 30, "".join(random.Random(1).choice("abc éà\n") for _ in range(4000))):
        (raw,) = M.store([t.encode()])
        coefficients, (image,), _ = C.decode([raw])
        planes = [C.samples(coefficients[c.base : c.base + c.wide * image.mcus[1] * c.v], image.quants[0]) for c in image.components]
        ours, java = C.rgb(coefficients, image).astype(int), java_pixels(spark, raw)
        # luma of equal samples; chroma differs by smoothing only, so compare what doesn't depend on it on the whole
        assert ours.shape == java.shape and len(planes) == 3
        assert np.abs(ours.mean((0, 1)) - java.mean((0, 1))).max() < 6


def test_payloads(spark):
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], b"z")], "doc_id long, text string, media binary")
    media = M.encode_texts(df)
    rows = M.read_payloads(media).collect()
    files = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        f = files[r["doc_id"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(f), hashlib.sha256(f).hexdigest())
    assert rows[0]["feature"] == rows[1]["feature"]
    pixels = {r["doc_id"]: r for r in M.decode_media(media).collect()}
    for r in rows:
        p = pixels[r["doc_id"]]
        assert M.feature(np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"], 3)) == r["feature"]
    assert M.read_payloads(M.encode_texts(df.limit(0))).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert M.decode_media(null).collect()[0]["pixels"] is None


def test_a_file_does_not_depend_on_its_neighbours():
    texts = [(t or "").encode() for t in TEXTS]
    together = M.store(texts)
    assert [M.store([t])[0] for t in texts] == together
    every = C.decode(together)
    for i, f in enumerate(together):
        alone = C.decode([f])
        assert (alone[0] == every[0][every[2][i] : every[2][i + 1]]).all()
        assert M.feature(C.rgb(alone[0], alone[1][0])) == M.feature(C.rgb(every[0][every[2][i] : every[2][i + 1]], every[1][i]))


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = M.op1_progressive_jpeg(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["payload_sha256"] == hashlib.sha256(t + b"\0" * (-len(t) % 64 if t else 64)).hexdigest()
