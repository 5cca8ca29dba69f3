"""Media columns: texts as FLAC streams in a binary column, and back (operator 4).

A text's UTF-8 bytes, filled with byte 255 up to a positive multiple of the block size, are 8-bit samples (byte - 128).
pcm_blocks() writes the decoded samples as blocks with the offset of their first sample, so that a reader seeks to a
block without the others; features() measures the decoded samples.

Defined results: a null text is an empty one, of a single block of fill bytes; equal texts give equal streams and
features wherever they stand; equal rows stay; an empty table gives no rows; other columns of the input are ignored. A
damaged stream stops the job.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import flac
from tessella.llm.common import ship, slices, string_buffers

#: Samples of a PCM block: a multiple of the frame's block size.
PCM_BLOCK = 64 * flac.BLOCK


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // flac.BLOCK)) * flac.BLOCK - len(text))


def to_media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes (of the text), media (a FLAC stream)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                offsets, data = string_buffers(part.column("text"))
                raw, ends = data.tobytes(), offsets.tolist()
                media = flac.encode([padded(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary")


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
    for batch in batches:
        for part in slices(batch, "media", 1 << 20):
            streams = part.column("media").to_pylist()
            yield part, streams, flac.decode(streams)


def pcm_blocks(media: DataFrame, *, samples: int = PCM_BLOCK) -> DataFrame:
    """id, block, sample_offset, pcm (unsigned bytes): the samples of each stream in blocks that can be sought."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, payloads in decoded(batches):
            rows = [(i, k // samples, k, p[k : k + samples]) for i, p in zip(part.column("id").to_pylist(), payloads, strict=True) for k in range(0, len(p), samples)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "block", "sample_offset", "pcm"])

    return media.select("id", "media").mapInArrow(run, "id long, block int, sample_offset long, pcm binary")


def feature(payload: bytes) -> str:
    """Integers only: samples, their sum, energy, peak, and zero crossings."""
    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};crossings={crossings}"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of the stored streams, read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    ship(media.sparkSession)
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams, payloads in decoded(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), part.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.array([feature(p) for p in payloads]),
                ],
                names,
            )

    return media.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_flac(spark, sf_dir: str) -> DataFrame:
    return features(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")
