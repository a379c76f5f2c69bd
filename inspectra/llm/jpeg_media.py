"""Media columns: progressive JPEG files decoded to full-resolution RGB tensors, and texts stored as such files and read back.

A text's bytes are stored in the format's own unit, the coefficient: byte order[r] is the value 0, 1, -1, 2, -2, ... at place r, and the
quantisation is 1, so what scans carry is exact. The payload fills the blocks of Y, then of Cb and Cr, from the first on.

Edge cases: a null text is empty and has 64 zero bytes as payload; an empty table gives an empty result; rows are independent, so
equal texts give equal files; texts of any length are taken whole (one file each); other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inspectra.llm import jpeg_codec
from inspectra.llm.common import steps, table, written

#: Bytes by how often texts have them; all others follow in their own order.
FREQUENT = b" enatirosdhulc\xc3mp.gbv\n\xa9,zyfwqx\xa8k\xb3jT"
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
PAYLOAD_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@functools.cache
def byte_values() -> tuple[np.ndarray, np.ndarray]:
    """The coefficient of each byte, and the byte of each coefficient (by its value + 128)."""
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    value = np.array([(r + 1) // 2 if r % 2 else -(r // 2) for r in range(256)])
    of_byte, of_value = np.zeros(256, np.int16), np.zeros(258, np.uint8)
    of_byte[order] = value
    of_value[value + 128] = order
    return of_byte, of_value


def image_size(payload: int) -> tuple[int, int]:
    """Columns and rows of MCUs, six blocks each, that hold so many bytes."""
    mcus = -(-payload // (6 * 64))
    columns = math.isqrt(mcus - 1) + 1
    return columns, -(-mcus // columns)


def store(texts: list[bytes]) -> list[bytes]:
    """A JPEG file for each text."""
    if not texts:
        return []
    of_byte, _ = byte_values()
    padded = [t + b"\0" * (64 - len(t) % 64 if len(t) % 64 or not t else 0) for t in texts]
    sizes = [image_size(len(p)) for p in padded]
    blocks = np.array([6 * a * b for a, b in sizes])
    base = np.cumsum(blocks) - blocks
    coefficients = np.zeros((int(blocks.sum()), 64), np.int16)
    n = np.array([len(p) // 64 for p in padded])
    at = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    coefficients[at] = of_byte[np.frombuffer(b"".join(padded), np.uint8)].reshape(-1, 64)
    return jpeg_codec.encode(coefficients, sizes)


def restore(coefficients: np.ndarray, payload: int) -> bytes:
    return byte_values()[1][coefficients[: payload // 64].ravel() + 128].tobytes()


def feature(pixels: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and a checksum of the tensor."""
    means = pixels.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (pixels.shape[0] * pixels.shape[1])
    return f"{pixels.shape[0]}x{pixels.shape[1]}:{means[0]}:{means[1]}:{means[2]}:{zlib.crc32(pixels.tobytes()):08x}"


def decode_media(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """doc_id, height, width and pixels (height x width x 3 bytes, RGB) of progressive JPEG files; null for a null file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "media"):
            files = b.column(1).to_pylist()
            coefficients, images, base = jpeg_codec.decode([f for f in files if f is not None])
            got = iter([jpeg_codec.rgb(coefficients[a:z], i) for i, a, z in zip(images, base, base[1:])])
            pixels = [None if f is None else next(got) for f in files]
            out = [pa.array([None if p is None else p.shape[k] for p in pixels], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *out, pa.array([None if p is None else p.tobytes() for p in pixels], pa.binary())], ["doc_id", "height", "width", "pixels"])

    return media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, "doc_id long, height int, width int, pixels binary")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the JPEG file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(store(texts), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, MEDIA_SCHEMA)


def read_payloads(media: DataFrame) -> DataFrame:
    """What stored files hold: digests of payload and file, and the feature of the RGB tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "media"):
            files, n = b.column(2).to_pylist(), b.column(1).to_pylist()
            coefficients, images, base = jpeg_codec.decode(files)
            rows = []
            for f, size, image, a, z in zip(files, n, images, base, base[1:]):
                payload = restore(coefficients[a:z], max(64, -(-size // 64) * 64))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(jpeg_codec.rgb(coefficients[a:z], image))))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            out = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], [f.split()[0] for f in PAYLOAD_SCHEMA.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PAYLOAD_SCHEMA)


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_payloads(written(encode_texts(docs), "op1-media"))
