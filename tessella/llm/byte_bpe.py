"""Byte-level BPE by corpus-level merge replay (operator 8).

The distinct words of a chunk of the corpus are laid out as one array of symbols. An inverted index leads from each
pair of neighbouring symbols to its positions; merges are replayed over all words at once in rank order, and a merge
touches only the positions of its pair and their two neighbours. Each task keeps the words it has met (bounded, see
words.Encoder), so later chunks replay only new words.

Defined results: a null or empty text has no ids and decodes to nothing; texts are never cut; repeated rows give
repeated rows; an empty table gives none; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship, slices, string_buffers, tokenizer_path
from tessella.llm.words import Encoder


class MergeReplay:
    """Ids of byte words by a table of ranks: of all neighbours whose joint bytes have a rank, the lowest merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        """The rank of two symbols' joint bytes, or -1."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            got = self.pairs[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return got

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rank, whole = self.rank, [self.ranks.get(w) for w in words]
        left = [w for w, r in zip(words, whole, strict=True) if r is None]
        raw = np.frombuffer(b"".join(left), np.uint8)
        sym = np.array(self.byte_ids, np.int64)[raw].tolist()
        n = len(sym)
        sizes = np.array([len(w) for w in left], np.int64)
        heads = np.cumsum(sizes) - sizes
        follow, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        follow[heads + sizes - 1] = -1
        before[heads] = -1
        follow, before = follow.tolist(), before.tolist()
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            if follow[i] >= 0 and (r := rank(sym[i], sym[i + 1])) >= 0:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                j = follow[i]
                if sym[i] < 0 or j < 0 or rank(sym[i], sym[j]) != r:
                    continue  # a neighbour has merged meanwhile
                sym[i], sym[j] = r, -1
                after = follow[i] = follow[j]
                low = r
                if after >= 0:
                    before[after] = i
                    if (x := rank(r, sym[after])) >= 0:
                        if x in index:
                            index[x].append(i)
                        else:
                            index[x] = [i]
                            heapq.heappush(heap, x)
                        low = min(low, x)
                if (h := before[i]) >= 0 and (x := rank(sym[h], r)) >= 0:
                    if x in index:
                        index[x].append(h)
                    else:
                        index[x] = [h]
                        heapq.heappush(heap, x)
                    low = min(low, x)
                if low < r:  # a lower rank has come up: it goes first, the other places of this rank wait
                    index.setdefault(r, []).extend(places[k + 1 :])
                    heapq.heappush(heap, r)
                    break
        symbols = np.array(sym, np.int64)
        kept = symbols >= 0
        count = np.ones(len(words), np.int64)
        merged = np.array([x is None for x in whole], bool)
        if len(left):
            count[merged] = np.add.reduceat(kept.astype(np.int64), heads)
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        out[begin[~merged]] = [x for x in whole if x is not None]
        where = np.repeat(merged, count)
        out[where] = symbols[kept]
        return out, count


class Decoder:
    """Bytes of ids by gathering from the joined bytes of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        words = {v: k for k, v in ranks.items()}
        vocabulary = [words.get(k, b"") for k in range(max(words) + 1)]
        self.sizes = np.array([len(w) for w in vocabulary], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(vocabulary), np.uint8)

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of flat ids and the documents' offsets among them."""
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        data = self.joined[np.repeat(self.begins[ids] - total[:-1], sizes) + np.arange(total[-1])]
        return data, total[offsets]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@functools.cache
def encoder(path: str) -> Encoder:
    replay = MergeReplay(read_ranks(path))
    return Encoder(lambda words: replay.replay([w.encode("utf-8", "surrogatepass") for w in words]), most_words=600_000)


@functools.cache
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def encode(df: DataFrame, ranks: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (binary, <u4)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = encoder(ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = apply(*string_buffers(part.column("text")))
                raw, ends = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
                pieces = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(pieces, pa.binary())], ["id", "n_tokens", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """The rows of encode() with the bytes that their ids stand for, in column decoded."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = decoder(ranks)
        for batch in batches:
            for part in slices(batch, "ids"):
                offsets, raw = string_buffers(part.column("ids"))
                data, ends = apply(np.frombuffer(raw.tobytes(), "<u4"), offsets // 4)
                data, ends = data.tobytes(), ends.tolist()
                texts = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary")


def op8_merge_replay(spark, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    rows = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks), ranks)
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
