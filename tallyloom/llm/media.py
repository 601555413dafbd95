"""Media columns: texts' bytes as lossless WebP images, read back to pixel arrays with features.

A payload is laid out as rows of 64 RGB pixels. One of over 16,384 rows, the format's limit, is
several files in a row, each of which tells its own size. Files of an image of few colours have a palette; all others have
predictors and cross-colour elements by blocks, and green subtracted where that pays.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp, webp_many
from .common import written

WIDTH = 64
UNIT = 3 * WIDTH
#: Size of the colour cache, as a power of two.
CACHE_BITS = 6
#: Rows and bytes that are coded together at most, unless one row has more.
WRITTEN_TOGETHER, READ_TOGETHER = (1000, 5 << 19), (3000, 1 << 22)


def payload(text: str | None) -> bytes:
    """The text in UTF-8, filled up with spaces to a positive multiple of 192 bytes; null is empty."""
    data = (text or "").encode()
    return data + b" " * (UNIT - len(data) if not data else -len(data) % UNIT)


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload as one or more lossless WebP files, which depend on nothing but the payload."""
    images, owner = [], []
    for i, data in enumerate(payloads):
        samples = np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 3)
        parts = [samples[a : a + webp.MAX_SIDE] for a in range(0, len(samples), webp.MAX_SIDE)]
        images += parts
        owner += [i] * len(parts)
    out: list[list[bytes]] = [[] for _ in payloads]
    for i, file in zip(owner, webp_many.encode_many(images, CACHE_BITS), strict=True):
        out[i].append(file)
    return [b"".join(x) for x in out]


def load_many(media: list[bytes]) -> list[np.ndarray]:
    """The pixel arrays (height x 64 x 3) of the files that store_many() made."""
    files, owner = [], []
    for i, data in enumerate(media):
        at = 0
        while at < len(data):
            end = at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
            files.append(data[at:end])
            owner.append(i)
            at = end
    out: list[list[np.ndarray]] = [[] for _ in media]
    for i, samples in zip(owner, webp_many.decode_many(files), strict=True):
        out[i].append(samples)
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def store(data: bytes) -> bytes:
    return store_many([data])[0]


def load(media: bytes) -> np.ndarray:
    return load_many([media])[0]


def feature(samples: np.ndarray) -> str:
    """Integers that describe the samples: sum and number of distinct values of each channel, and the sum of steps between neighbouring samples."""
    flat = samples.reshape(-1, 3)
    sums = flat.sum(axis=0, dtype=np.int64).tolist()
    kinds = [int((np.bincount(flat[:, c], minlength=256) > 0).sum()) for c in range(3)]
    line = samples.reshape(-1).astype(np.int16)
    return ":".join(map(str, [*sums, *kinds, int(np.abs(np.diff(line)).sum(dtype=np.int64))]))


def _pieces(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, and so many bytes in the column."""
    first = total = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if i > first and (i - first == rows or total + n > size):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)


def write(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media) of all documents, written to the shared folder. Repeated rows are stored each; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 1, *WRITTEN_TOGETHER):
                texts = part.column(1).to_pylist()
                media = store_many([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    docs = documents.select(F.col(id_col), F.col(text_col))
    return written(docs.mapInArrow(run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, n_bytes bigint, media binary"), "media")


def read(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of write(): id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256, feature, all from the decoded files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 2, *READ_TOGETHER):
                rows: list[tuple] = []
                files = part.column(2).to_pylist()
                for media, samples in zip(files, load_many(files), strict=True):
                    data = samples.tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[id_col].dataType.simpleString()
    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
