"""Media columns: texts as lossless WebP images, read back as pixel arrays.

``to_media`` pads each text's UTF-8 bytes with spaces to whole rows and stores
them as an image, long ones as an animation of frames side by side in the
file; ``to_pixels`` decodes stored images to arrays; ``from_media`` decodes
the stored bytes and computes what it reports from the decoded pixels alone.

Defined cases: null text is empty, one row of spaces; a text of any length
that a binary value holds is stored whole; equal texts have equal images; null
media have null pixels; null and repeated ids are passed on; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import lanes, rolling
from .common import larger, small_batches, table, utf8

COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PIXELS = 4 << 20  # samples in one batch of arrays


def feature(pixels: np.ndarray) -> str:
    """Per channel mean and standard deviation, and the mean step along rows, in thousandths."""
    flat = pixels.reshape(-1, 3)
    n, total = len(flat), flat.sum(0, dtype=np.int64)
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    spread = np.sqrt(np.maximum(0, square / n - (total / n) ** 2))
    ramp = np.abs(np.diff(flat.reshape(-1).astype(np.int16))).sum(dtype=np.int64) / max(1, flat.size - 1)
    return ",".join(str(round(float(x) * 1000)) for x in (*(total / n), *spread, ramp))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in larger(batches, lanes.CHUNK):
        texts = utf8(b.column("text"))
        payloads = [x + b" " * (-len(x) % lanes.ROW or (0 if x else lanes.ROW)) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in payloads], pa.int64()), pa.array(lanes.encode(payloads), pa.binary())],
            names=["doc_id", "n_bytes", "payload_bytes", "media"],
        )


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and the image as ``media``."""
    small_batches(docs.sparkSession)
    kind = "doc_id long, n_bytes long, payload_bytes long, media binary"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_encode, kind)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in larger(batches, lanes.CHUNK // 2):
        out: list[list] = [[] for _ in range(5)]
        files = b.column("media").to_pylist()
        for media, n, pixels in zip(files, b.column("payload_bytes").to_pylist(), lanes.decode(files), strict=True):
            payload = memoryview(pixels.reshape(-1))[:n]
            values = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels))
            for column, v in zip(out, values, strict=True):
                column.append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), b.column("payload_bytes"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files = b.column("media").to_pylist()
        images = iter(lanes.decode([f for f in files if f is not None]))
        rows = [next(images) if f is not None else None for f in files]
        for at, to in rolling.chunks([0 if r is None else r.size for r in rows], PIXELS):
            some = rows[at:to]
            size = [0 if r is None else r.size for r in some]
            flat = np.concatenate([np.zeros(0, np.int16), *(r.ravel().astype(np.int16) for r in some if r is not None)])
            missing = np.array([r is None for r in some])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32(), mask=np.append(missing, False)), pa.array(flat))
            dims = [pa.array([None if r is None else r.shape[k] for r in some], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), *dims, lists], names=["doc_id", "height", "width", "pixels"])


def to_pixels(media: DataFrame) -> DataFrame:
    """doc_id, height, width and the red, green and blue samples of ``media`` (any lossless WebP), row by row, as ``pixels``."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_pixels, "doc_id long, height int, width int, pixels array<smallint>")


def from_media(media: DataFrame) -> DataFrame:
    """What is computed from the decoded pixels of each image."""
    return media.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(_decode, COLUMNS)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_media(to_media(table(spark, sf_dir, "documents")))
