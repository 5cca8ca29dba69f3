"""Token-ID files of byte or bit planes (operator 9).

A file holds the ids of whole documents in order. Blocks of `BLOCK` ids are transposed into planes - plane k has byte k
(or bit k) of every id - and each plane is compressed with zstandard, so that the high planes of small ids shrink to
almost nothing. A chunk index gives each block's place, so a block can be read without the others.

    magic "TPLN" | u8 version | u8 kind (0 byte, 1 bit planes) | u16 0 | u32 block length
    blocks, each: its planes, one after another
    index: zstandard of int64 arrays [n_docs, n_ids, n_blocks, planes] doc_ids, null flags, lengths, plane sizes (blocks x planes)
    u64 offset of the index | u32 crc32 of the index | magic "TPLN"

Defined results: a null text is empty; an empty text has the end id alone; equal doc_ids stay adjacent, a null doc_id
comes first; an empty table gives no file and no row. Texts are never cut; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Stage, shared_dir, ship, slices, string_buffers, tokenizer_path
from tessella.llm.words import library_encoder

MAGIC, BLOCK, WIDTH = b"TPLN", 1 << 16, 4


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, WIDTH)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(WIDTH)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * WIDTH)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.empty((n, WIDTH), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.empty((n, 8 * WIDTH), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class PlaneWriter:
    def __init__(self, out, kind: str = "byte", level: int = 1):
        self.out, self.kind, self.zstd = out, kind, zstandard.ZstdCompressor(level=level)
        self.rest, self.held, self.n_ids = [], 0, 0
        self.doc_ids, self.lengths, self.sizes = [], [], []
        self.at = out.write(MAGIC + struct.pack("<BBHI", 1, kind == "bit", 0, BLOCK)) or 12

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths.append(np.asarray(lengths, np.int64))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK:
            self.flush(False)

    def flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        stop = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for i in range(0, stop, BLOCK):
            part = ids[i : min(i + BLOCK, stop)]
            packed = [self.zstd.compress(x) for x in to_planes(part, self.kind)]
            self.sizes.append([len(x) for x in packed])
            self.out.write(b"".join(packed))
            self.at += sum(map(len, packed))
            self.n_ids += len(part)
        self.rest, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> tuple[int, int]:
        self.flush(True)
        planes = WIDTH if self.kind == "byte" else 8 * WIDTH
        parts = [[len(self.doc_ids), self.n_ids, len(self.sizes), planes], [x or 0 for x in self.doc_ids], [x is None for x in self.doc_ids], *self.lengths, *self.sizes]
        index = self.zstd.compress(b"".join(np.asarray(x, "<i8").tobytes() for x in parts))
        self.out.write(index + struct.pack("<QI", self.at, zlib.crc32(index)) + MAGIC)
        return len(self.doc_ids), self.n_ids


class PlaneReader:
    """Random access to a file: documents() goes through it; ids(start, stop) reads only the blocks that hold them."""

    def __init__(self, file):
        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        at, crc, magic = struct.unpack("<QI4s", self.read(max(0, size - 16), 16).rjust(16, b"\0"))
        head = self.read(0, 12)
        sound = magic == MAGIC and head[:4] == MAGIC and at <= size - 16
        index = self.read(at, size - 16 - at) if sound else b""
        if not sound or zlib.crc32(index) != crc:
            raise ValueError("not a plane file, or its index is damaged")
        self.kind, (self.block,) = "bit" if head[5] else "byte", struct.unpack("<I", head[8:])
        a = np.frombuffer(self.unzip.decompress(index), "<i8")
        n, self.n_ids, blocks, planes = map(int, a[:4])
        self.doc_ids = [None if gone else x for x, gone in zip(a[4 : 4 + n].tolist(), a[4 + n : 4 + 2 * n].tolist(), strict=True)]
        self.lengths = a[4 + 2 * n : 4 + 3 * n]
        self.sizes = a[4 + 3 * n :].reshape(blocks, planes)
        self.places = 12 + np.concatenate([[0], np.cumsum(self.sizes.sum(1))])

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block_ids(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        raw, planes, at = self.read(int(self.places[k]), int(self.sizes[k].sum())), [], 0
        for size in self.sizes[k].tolist():
            planes.append(self.unzip.decompress(raw[at : at + size]))
            at += size
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        first = start // self.block
        got = [self.block_ids(k) for k in range(first, -(-stop // self.block))]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block] if got else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k, at = np.zeros(0, np.uint32), 0, 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            if len(held) - at < n:
                parts, have = [held[at:]], len(held) - at
                while have < n:
                    parts.append(self.block_ids(k))
                    have, k = have + len(parts[-1]), k + 1
                held, at = np.concatenate(parts), 0
            yield doc, held[at : at + n]
            at += n


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The flat ids with the end id after each document, and the lengths."""
    lengths = np.diff(offsets)
    out = np.empty(len(ids) + len(lengths), np.uint32)
    stops = np.cumsum(lengths + 1) - 1
    mask = np.ones(len(out), bool)
    mask[stops] = False
    out[stops], out[mask] = end, ids
    return out, lengths + 1


def write_files(df: DataFrame, tokenizer: str, *, end_id: int = 2, kind: str = "byte", level: int = 1, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Writes plane files in ascending id order under the shared folder; one row per file: file, path, n_docs, n_ids.

    Texts are dealt by ranges of the id before they become ids, so each file is one task's work and a lost task is
    simply done again; a file's name is new at each attempt, and the returned manifest names those of finished tasks.
    """
    spark = df.sparkSession
    ship(spark)
    folder = shared_dir(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        path, encoder, writer = f"{base}/{number:06d}-{uuid.uuid4().hex}.planes", library_encoder(tokenizer, added_tokens), None
        out = None
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    out = files.open_output_stream(path)
                    writer = PlaneWriter(out, kind, level)
                ids, offsets = encoder(*string_buffers(part.column("text")))
                writer.add(part.column("id").to_pylist(), *with_end(ids, offsets, end_id))
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id")
    manifest = Stage(dealt.mapInArrow(write, "file long, path string, n_docs long, n_ids long")).df
    return manifest.withColumn("folder", F.lit(folder))


def read_files(manifest: DataFrame) -> DataFrame:
    """Rows of the files named by a manifest: id, start (ids of all documents before), n_tokens, ids (binary, <u4).

    The running start takes one window over the manifest, which has a row for each file.
    """
    ship(manifest.sparkSession)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                where, _ = fs.FileSystem.from_uri(row["folder"])
                with where.open_input_file(row["path"]) as file:
                    reader, start, held, size = PlaneReader(file), row["before"], [], 0
                    for doc, ids in reader.documents():
                        held.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                        start, size = start + len(ids), size + 4 * len(ids)
                        if size > 4 << 20:
                            yield as_batch(held)
                            held, size = [], 0
                    if held:
                        yield as_batch(held)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"id": pa.array(a, pa.int64()), "start": pa.array(b, pa.int64()), "n_tokens": pa.array(c, pa.int64()), "ids": pa.array(d, pa.binary())})

    return files.repartition(max(1, n), "file").mapInArrow(read, "id long, start long, n_tokens long, ids binary")


def op9_plane_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = read_files(write_files(docs, tokenizer_path("byte_bpe_50k.json"), added_tokens=True))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
