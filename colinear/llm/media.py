"""Media columns: payloads kept as baseline JPEG, read back through the decoder, described by their thumbnails.

Storage is lossless: each byte is the sample of a flat 8x8 block, so the DC-only luminance thumbnail of the stored image
is the payload itself. The padding (bytes 255 up to a positive multiple of 576) makes whole rows of 24 blocks. A payload
too tall for one image of 65,535 pixels a side becomes several images laid end to end.

Null or empty text is a payload of 576 bytes 255; equal texts give equal values; repeated rows give one row each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import jpeg
from .common import bytes_of, id_and_text, mapped, slices, table

SLICE = 1 << 20
STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % jpeg.UNIT or (0 if data else jpeg.UNIT))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and the stored form of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            data = bytes_of(batch.column(1))
            media = jpeg.encode([padded(x) for x in data])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return mapped(id_and_text(docs, id_col, text_col), run, STORED)


def describe(stored: DataFrame) -> DataFrame:
    """Decode the stored bytes alone: dimensions in pixels, the payload's digests and the thumbnail's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE):
            media = bytes_of(batch.column(2))
            rows = []
            for stream, thumbs in zip(media, jpeg.decode(media), strict=True):
                payload = b"".join(x.tobytes() for x in thumbs)
                high, wide = sum(x.shape[0] for x in thumbs), thumbs[0].shape[1]
                whole = thumbs[0] if len(thumbs) == 1 else np.concatenate(thumbs)
                rows.append((len(stream), hashlib.sha256(stream).hexdigest(), wide * 8, high * 8, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), f"{wide * 8}x{high * 8}:{jpeg.average_hash(whole)}"))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return mapped(stored.select("doc_id", "n_bytes", "media"), run, READ)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
