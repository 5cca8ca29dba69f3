"""Sum-of-squares packing of documents into fixed-length token sequences (operator 3).

Documents become ids, then pieces of at most `capacity` ids; the first piece of a longer one takes the remainder, so
all others fill a sequence. Only lengths are needed to place pieces: they are dealt into buckets of a fixed expected
number by a hash, and each bucket is packed on its own, longest pieces first, so the work of a task doesn't grow with
the corpus. A piece goes where the sum over gaps of the squared number of open sequences with that gap becomes
smallest; a new sequence opens only when no open one has room; ties go to the smallest gap.

Defined results: a null or empty text is a document of the separator alone; equal rows are packed as often as they
come; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Stage, ship, slices, string_buffers, tokenizer_path
from tessella.llm.token_store import with_end
from tessella.llm.words import library_encoder

CAPACITY, BUCKET = 2048, 16_384


def pieces(df: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, <u4)."""
    rows, cut, schema = cutting(df, tokenizer, capacity=capacity, separator=separator, id_col=id_col, text_col=text_col, added_tokens=added_tokens)
    return rows.mapInArrow(cut, schema)


def cutting(df: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> tuple[DataFrame, Callable, str]:
    """What pieces() maps, by what, and its schema."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, added_tokens)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encoder(*string_buffers(part.column("text")))
                ids, lengths = with_end(ids, offsets, separator)
                count = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(lengths)), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = lengths - (count - 1) * capacity
                start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
                size = np.where(number == 0, first[doc], capacity)
                raw = ids.astype("<u4").tobytes()
                at = (np.cumsum(lengths) - lengths)[doc] + start
                data = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], ["id", "piece", "start", "length", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows, run, "id long, piece int, start long, length long, ids binary"


def checked_pieces(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """A written table of the pieces with the crc32 of their ids instead of these: id, piece, start, length, ids_crc32.

    The task that cuts pieces also writes the table, so ids don't leave it.
    """
    rows, cut, _ = cutting(df, tokenizer, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches):
            check = pa.array([zlib.crc32(ids.as_buffer()) for ids in part.column("ids")], pa.int64())
            yield part.set_column(part.schema.get_field_index("ids"), "ids_crc32", check)

    return Stage.made(rows, run, "id long, piece int, start long, length long, ids_crc32 long").df


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length, taken in the given order."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap; full ones don't count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        gaps = size + np.flatnonzero(counts[size:])
        if len(gaps):
            change = counts[gaps - size] - counts[gaps]
            if gaps[0] == size:  # becomes full: only the gap's own count falls
                change[0] = -counts[size]
            # both sides of 2 (after - before + 1); a full sequence adds nothing: 1 - 2 before
            change = 2 * change + 2
            if gaps[0] == size:
                change[0] -= 1
            gap = int(gaps[int(np.argmin(change))])
            bin_ = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, bin_, made = capacity, made, made + 1
        sequence[k], offset[k] = bin_, capacity - gap
        rest = gap - size
        if rest:
            open_bins[rest].append(bin_)
            counts[rest] += 1
    return sequence, offset


def place(rows: DataFrame, *, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """Adds sequence_id and offset to rows with id, piece and length. rows is read twice: pass a written table."""
    ship(rows.sparkSession)
    buckets = max(1, -(-rows.count() // bucket))
    names = rows.columns

    def pack(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("length", "descending"), ("id", "ascending"), ("piece", "ascending")]))
        sequence, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        number = group["bucket"][0].as_py() << 32 | sequence
        return group.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    # a row's place in the table is hashed too, so that rows with equal or null ids don't share a bucket
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(pack, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (binary, <u4), and its pieces in order as docs, piece_numbers and
    offsets. placed has the ids of pieces(); a sequence has at most `capacity` ids, so no group is larger."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "id", "piece", "length", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    last = F.get("parts", F.size("parts") - 1)
    return parts.select(
        "sequence_id", (last["offset"] + last["length"]).alias("n_tokens"), ids.alias("ids"),
        F.col("parts.id").alias("docs"), F.col("parts.piece").alias("piece_numbers"), F.col("parts.offset").alias("offsets"),
    )


def op3_sum_of_squares(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the ids' checksum stands for them from here on; the operator itself keeps them
    return place(checked_pieces(docs, tokenizer_path("byte_bpe_50k.json"), added_tokens=True)).withColumnRenamed("id", "doc_id")
