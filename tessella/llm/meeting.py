"""Rows of longs that meet under a 64-bit key, shuffled as packed blocks instead of one by one.

A task gathers FLUSH rows and sorts them by key. Where several documents have a key among them, the rows of all but the
smallest document are decided already: an earlier document has the key. They are spread over all buckets, so a key that a
third of all rows have sends only one document's rows of each FLUSH to its own bucket. The other rows go to the bucket
that their key's highest bits name. A task then reads one bucket at a time.

Results don't depend on the order of rows, on FLUSH or on the number of buckets.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shingles import mixed

#: Rows that a task packs together, and bytes of text for each bucket.
FLUSH, BUCKET_BYTES = 1 << 17, 2 << 20
#: Which rows come out.
ALL, SHARED, LATER = 0, 1, 2
ALONE, FIRST, DECIDED = 0, 1, 2


def bucket_bits(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets as a power of two: one for each shuffle partition at least, and more where texts are many."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, size // BUCKET_BYTES, 2).bit_length()


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start; keys aren't empty."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def block(columns: list[np.ndarray], doc: int, state: np.ndarray) -> bytes:
    """Columns one after another; documents as short differences from the smallest."""
    least = int(columns[doc].min())
    apart = columns[doc].view(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(apart.max()) < 1 << 8 * w)
    parts = [struct.pack("<IBq", len(state), width, least), state.tobytes()]
    parts += [apart.astype(f"<u{width}").tobytes() if i == doc else c.tobytes() for i, c in enumerate(columns)]
    return b"".join(parts)


def unblock(raw: bytes, columns: int, doc: int) -> tuple[list[np.ndarray], np.ndarray]:
    n, width, least = struct.unpack_from("<IBq", raw)
    at = struct.calcsize("<IBq")
    state, out = np.frombuffer(raw, np.uint8, n, at), []
    at += n
    for i in range(columns):
        size = width if i == doc else 8
        values = np.frombuffer(raw, f"<u{size}", n, at)
        out.append((values.astype(np.uint64) + np.uint64(least & 0xFFFFFFFFFFFFFFFF)).view(np.int64) if i == doc else values.view(np.int64))
        at += n * size
    return out, state


def packed(columns: list[np.ndarray], key: int, doc: int, bits: int) -> pa.RecordBatch:
    order = np.argsort(columns[key].view(np.uint64))
    columns = [c[order] for c in columns]
    keys, docs = columns[key], columns[doc]
    starts = runs(keys)
    sizes = np.diff(np.append(starts, len(keys)))
    low = np.minimum.reduceat(docs, starts)
    several = np.maximum.reduceat(docs, starts) > low
    late = docs > np.repeat(low, sizes)
    state = np.repeat(several, sizes).astype(np.uint8)
    bucket, data = [], []
    # rows with open questions are sorted by bucket already
    part, mark = [c[~late] for c in columns], state[~late]
    where = (part[key].view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)
    cuts = np.append(runs(where), len(where))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        bucket.append(int(where[a]))
        data.append(block([c[a:b] for c in part], doc, mark[a:b]))
    part = [c[late] for c in columns]
    n, step = len(part[doc]), 512
    for a in range(0, n, step):
        some = [c[a : a + step] for c in part]
        bucket.append(int(mixed(some[key][:1].view(np.uint64) ^ some[doc][:1].view(np.uint64))[0] >> np.uint64(64 - bits)))
        data.append(block(some, doc, np.full(len(some[doc]), DECIDED, np.uint8)))
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])


def answer(blocks: list[bytes], names: list[str], key: int, doc: int, want: int) -> pa.RecordBatch | None:
    got = [unblock(b, len(names), doc) for b in blocks]
    columns = [np.concatenate([g[0][i] for g in got]) for i in range(len(names))]
    state = np.concatenate([g[1] for g in got])
    later = state == DECIDED
    take = later.copy()
    rest = np.flatnonzero(~later)
    if len(rest):
        rest = rest[np.argsort(columns[key][rest])]
        keys, docs = columns[key][rest], columns[doc][rest]
        starts = runs(keys)
        sizes = np.diff(np.append(starts, len(keys)))
        low = np.minimum.reduceat(docs, starts)
        after = docs > np.repeat(low, sizes)
        later[rest] = after
        if want == ALL:
            take[rest] = True
        elif want == LATER:
            take[rest] = after
        else:
            shared = (np.maximum.reduceat(docs, starts) > low) | (np.maximum.reduceat(state[rest], starts) == FIRST)
            take[rest] = np.repeat(shared, sizes)
    if not take.any():
        return None
    return pa.RecordBatch.from_arrays([*(pa.array(c[take]) for c in columns), pa.array(later[take])], [*names, "later"])


def meet(source: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]], names: list[str], key: str, bits: int, *, want: int) -> DataFrame:
    """The rows that make() gives for a task's batches (columns `names`, int64), with `later`.

    later: a document with a smaller number than the row's `doc` has the key too. want: ALL rows, those of SHARED keys
    (of several documents), or the LATER ones only.
    """
    dealt, receive, schema = meeting(source, make, names, key, bits, want=want)
    return dealt.mapInArrow(receive, schema)


def meeting(source: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]], names: list[str], key: str, bits: int, *, want: int) -> tuple[DataFrame, Callable, str]:
    """What meet() maps at last, by what, and its schema."""
    where_key, where_doc = names.index(key), names.index("doc")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for columns in make(batches):
            if len(columns[0]):
                held.append(columns)
                n += len(columns[0])
            if n >= FLUSH:
                yield packed([np.concatenate(c).view(np.int64) for c in zip(*held, strict=True)], where_key, where_doc, bits)
                held, n = [], 0
        if n:
            yield packed([np.concatenate(c).view(np.int64) for c in zip(*held, strict=True)], where_key, where_doc, bits)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                if bucket != now and held:
                    out = answer(held, names, where_key, where_doc, want)
                    if out is not None:
                        yield out
                    held = []
                now = bucket
                held.append(data.as_py())
        if held:
            out = answer(held, names, where_key, where_doc, want)
            if out is not None:
                yield out

    dealt = source.mapInArrow(send, "bucket long, data binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt, receive, ", ".join(f"{n} long" for n in names) + ", later boolean"
