"""Removal of long substrings that an earlier document has, by distributed prefix doubling (operator 6).

A byte goes when a string of LENGTH bytes that covers it also starts in a document with a smaller id. Strings are ranked
by prefix doubling: first by their first half, then by the pair of the ranks of both halves, which covers
the threshold. Spark brings the (rank, document) rows of all positions that are still open together in order of rank's
buckets; a rank that one document alone has is unique, and its positions are dropped before the next round. Ranks are
64-bit fingerprints, so that a rank needs no numbering pass; two different strings share one with a chance of 2**-64.

Not every position takes part in the first sort. The window of LENGTH bytes at a position holds LENGTH / 2 + 1
half-length strings; the leftmost of those with the least fingerprint stands for the window (its anchor), and equal
windows have equal anchors. So windows can only be equal when their anchors' ranks are, and one row per anchor, about
7 of 100 positions, decides which windows stay open. Consecutive windows with the same anchor form a block, ranked as
one string; where a block is in an earlier document, all its windows are. Only windows of blocks that aren't, under
anchors that still matter, are ranked one by one.

Of a rank that many documents share, a task sends the rows of one document to the rank's bucket (tessella.llm.meeting);
what comes together for one document is bounded by its own length.

Defined results: a null or empty text has no bytes and loses none; rows with equal ids don't remove each other's bytes; a
row with a null id is in no order, so it loses nothing and takes nothing; an empty table gives no rows; other columns of
the input are ignored. Whole texts are read, however long. `kept` has the bytes that remain, which can begin or end
inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Stage, others, release, ship, slices, squeezed, string_buffers, unsqueezed
from tessella.llm.meeting import ALL, LATER, SHARED, bucket_bits, meeting
from tessella.llm.shingles import distinct, mixed, size_class
from tessella.llm.words import INVERSE, MULT, powers

LENGTH = 50
POSITION_BITS = 31


TABLE = np.random.default_rng(20240401).integers(0, 1 << 64, 256, np.uint64)


class Ranks:
    """Fingerprints of any substrings of a text."""

    def __init__(self, text: np.ndarray):
        n = size_class(len(text))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(TABLE[text] * powers(n, MULT)[: len(text)], out=self.sums[1:])
        self.back = powers(n, INVERSE)

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        raw = (self.sums[stops] - self.sums[starts]) * self.back[starts]
        return mixed(raw + (stops - starts).astype(np.uint64))

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n] + np.uint64(size))


def half_of(length: int) -> int:
    """Two halves cover a string; those of an odd length overlap by a byte."""
    return -(-length // 2)


def least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys."""
    out, have, step, size = None, 0, keys, 1
    while width:
        if width & 1:
            if out is None:
                out, have = step, size
            else:
                n = len(step) - have
                out = np.minimum(out[:n], step[have : have + n])
                have += size
        width >>= 1
        if width:
            step = np.minimum(step[:-size], step[size:])
            size *= 2
    return out


def blocks(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: its first and last window, the anchor's rank and the block's rank; and the ranks of all half strings."""
    half = half_of(length)
    ranks = Ranks(text)
    halves = ranks.all_of(half)
    low = np.uint64(POSITION_BITS)
    keys = halves >> low << low | np.arange(len(halves), dtype=np.uint64)
    anchor = least_in(keys, length - half + 1) & np.uint64((1 << POSITION_BITS) - 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    return first, last, halves[anchor[first].astype(np.int64)], ranks.of(first, last + length), halves


def window_ranks(halves: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The doubling step: ranks of whole windows from the ranks at offsets 0 and length - half."""
    return mixed(halves[at] * np.uint64(MULT) + halves[at + length - half_of(length)])


def texts_of(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    offsets, data = string_buffers(part.column("text"))
    ends = offsets.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield data[a:b]


def anchor_rows(length: int = LENGTH):
    """rank (of the anchor), block (rank of the block), doc: once for each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            for i, text in zip(np.asarray(part.column("doc")).tolist(), texts_of(part), strict=True):
                if len(text) >= length:
                    _, _, r, b, _ = blocks(text, length)
                    _, at = np.unique(mixed(r) ^ b, return_index=True)
                    yield [r[at].view(np.int64), b[at].view(np.int64), np.full(len(at), i, np.int64)]

    return make


def window_rows(length: int = LENGTH):
    """rank, doc for the windows of the open blocks of documents (squeezed) joined with them (column `open`)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for part in (p for batch in unsqueezed(batches) for p in slices(batch, "text")):
            for i, text, wants in zip(np.asarray(part.column("doc")).tolist(), texts_of(part), lists_of(part.column("open")), strict=True):
                if len(text) >= length:
                    first, last, _, block, halves = blocks(text, length)
                    at = windows_in(first, last, np.isin(block.view(np.int64), wants))
                    rank = distinct(window_ranks(halves, at, length)).view(np.int64)
                    yield [rank, np.full(len(rank), i, np.int64)]

    return make


def table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        yield [np.asarray(c).astype(np.int64) for c in batch.columns]


def as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def windows_in(first: np.ndarray, last: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    size = (last - first + 1)[chosen]
    return np.repeat(first[chosen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def lists_of(column: pa.Array) -> Iterator[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for k in range(len(column)):
        yield np.asarray(column[k].values) if column[k].is_valid else np.zeros(0, np.int64)


def covered_bytes(text: np.ndarray, gone_blocks: np.ndarray, gone_windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Marks the bytes of the blocks and windows that an earlier document has."""
    mark = np.zeros(len(text) + 1, np.int32)
    if len(text) >= length and (len(gone_blocks) or len(gone_windows)):
        first, last, _, block, halves = blocks(text, length)
        whole = np.isin(block.view(np.int64), gone_blocks)
        np.add.at(mark, first[whole], 1)
        np.add.at(mark, last[whole] + length, -1)
        if len(gone_windows):
            at = windows_in(first, last, ~whole)
            at = at[np.isin(window_ranks(halves, at, length).view(np.int64), gone_windows)]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + length, -1)
    return np.cumsum(mark[:-1]) > 0


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """One row per row: struct `_row` with the input's other columns, n_bytes, n_removed, n_spans, kept (binary).

    as_text: kept is a string without the characters that a removal has cut in two, and null where the text is.
    """
    rows, run, schema = removing(df, id_col=id_col, text_col=text_col, length=length, as_text=as_text)
    return rows.mapInArrow(run, schema)


def removing(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> tuple[DataFrame, Callable, str]:
    """What remove_repeats() maps at last, by what, and its schema."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), others(df, text_col).alias("_row"), F.col(f"`{text_col}`").alias("text"))
    docs = rows.where("doc is not null and text is not null").select("doc", "text")
    bits = bucket_bits(docs)
    shared = Stage.made(*meeting(docs, anchor_rows(length), ["rank", "block", "doc"], "rank", bits, want=SHARED))
    release(spark)
    rows_in = shared.df.select("rank", "block", "doc", F.col("later").cast("long").alias("rank_later"))
    ranked = Stage.made(*meeting(rows_in, table_rows, rows_in.columns, "block", bits, want=ALL))
    shared.drop()
    found = ranked.df.select("rank", "block", "doc", F.col("later").alias("gone"), (F.col("rank_later") == 1).alias("later"))
    release(spark)
    blocks_gone = Stage.made(found.where("gone").select("doc", "block"), as_they_are, "doc long, block long").df
    matters = found.where("not gone and later").select("rank").distinct()
    still_open = found.where("not gone").join(matters, "rank", "left_semi").groupBy("doc").agg(F.collect_set("block").alias("open"))
    windows = meeting(squeezed(docs).join(still_open, "doc").select("doc", "text", "open"), window_rows(length), ["rank", "doc"], "rank", bits, want=LATER)
    windows = Stage.made(*windows).df
    ranked.drop()
    del found, matters, still_open
    release(spark)
    none = F.lit(None).cast("long")
    gone = blocks_gone.select("doc", "block", none.alias("window")).unionByName(windows.select("doc", none.alias("block"), F.col("rank").alias("window")))
    gone = gone.groupBy("doc").agg(F.collect_set("block").alias("gone_blocks"), F.collect_list("window").alias("gone_windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unsqueezed(batches):
            for part in slices(batch, "text"):
                size, lost, spans, kept = [], [], [], []
                for text, b, w in zip(texts_of(part), lists_of(part.column("gone_blocks")), lists_of(part.column("gone_windows")), strict=True):
                    out = covered_bytes(text, b, w, length)
                    size.append(len(text))
                    lost.append(int(out.sum()))
                    spans.append(int(np.count_nonzero(out[1:] & ~out[:-1])) + int(len(out) and out[0]))
                    kept.append(text[~out].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("_row"), *(pa.array(x, pa.int64()) for x in (size, lost, spans)), kept_column(part, kept)], ["_row", "n_bytes", "n_removed", "n_spans", "kept"])

    def kept_column(part: pa.RecordBatch, kept: list[bytes]) -> pa.Array:
        if not as_text:
            return pa.array(kept, pa.binary())
        there = part.column("text").is_valid().to_pylist()
        return pa.array([k.decode("utf-8", "ignore") if t else None for k, t in zip(kept, there, strict=True)], pa.string())

    kind = rows.schema["_row"].dataType.simpleString()
    rows = squeezed(rows).join(gone, "doc", "left").select("_row", "text", "gone_blocks", "gone_windows")
    return rows, run, f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"


def op6_prefix_doubling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, remove, _ = removing(docs)

    # the digest stands for the bytes that remain, so they don't leave the task that finds them
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in remove(batches):
            digest = pa.array([hashlib.sha256(kept.as_buffer()).hexdigest() for kept in part.column("kept")], pa.string())
            doc = pc.struct_field(part.column("_row"), "doc_id")
            yield pa.RecordBatch.from_arrays([doc, *part.columns[1:4], digest], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return Stage.made(rows, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").df
