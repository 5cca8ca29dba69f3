"""Fuzzy line deduplication by MinHash (operator 10).

Lines of MIN_CHARS characters or more count; with short_lines (as in the query and the pipeline) every shorter line that
holds a word counts too. Equal lines are one node; lines under SHINGLE characters have no shingles, so only equality
links them. A line's signature has a minimum for each of BANDS * ROWS hash functions over its distinct shingles of SHINGLE
characters; lines that agree in all ROWS symbols of a band meet. A pair at the similarity of 0.75 has no band in common
with a chance of 0.0025, one at 0.8 with 0.0002. Candidates are decided by the exact Jaccard similarity of their shingle
sets: a star over the first FIRST_BANDS bands, then, as in operator 7, every pair of members of different components that
share a band, compared within blocks inside tasks. Union-find in Spark joins the links; of each component the line that comes first (by
document id, then by its place) stays and the others go.

Lines are 64-bit digests; the text of a line is only gathered when it shares a band with another line.

Defined results: a null or empty text has no lines that count; the rest of a text is joined again by newlines, so a
text without lost lines comes back as it was; a row with a null id keeps all its lines and takes none; rows with equal
ids are one document, and each keeps the first line of the components at home there; an empty table gives no rows; other
columns of the input are kept by dedup_lines() and ignored otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Stage, others, release, ship, slices, string_buffers
from tessella.llm.components import components
from tessella.llm.meeting import SHARED, bucket_bits, meet
from tessella.llm.neardup import across
from tessella.llm.shingles import distinct, linked, mixed
from tessella.llm.words import random_codes

#: SHINGLE is a power of two.
SHINGLE, ROWS, BANDS, PERCENT, MIN_CHARS = 8, 4, 16, 75, 20
SYMBOLS = ROWS * BANDS
#: Candidates may differ in as many symbols (a pair at the similarity exceeds it with a chance of 2e-12); bands of the star.
FAR, FIRST_BANDS = 42, 2
MULT = np.uint64(0xA0761D6478BD642F)
#: A letter or digit of any script.
WORD = re.compile(r"[^\W_]")


def digest(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def counts(line: bytes, short_lines: bool) -> bool:
    """Whether a line takes part: it is long enough, in characters, or a short one that holds a word."""
    if len(line) >= 4 * MIN_CHARS:
        return True
    if not short_lines and len(line) < MIN_CHARS:
        return False
    text = line.decode("utf-8", "replace")
    return len(text) >= MIN_CHARS or short_lines and WORD.search(text) is not None


def compared(line: bytes, short_lines: bool) -> bool:
    """Whether a line takes part and has shingles."""
    return counts(line, short_lines) and (len(line) >= 4 * SHINGLE or len(line.decode("utf-8", "replace")) >= SHINGLE)


def shingle_runs(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of SHINGLE characters of all lines; where each line's begin among them, and their number."""
    codes = np.frombuffer(b"\n".join(lines).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    begins = np.append(0, ends[:-1] + 1)
    total, size, times = random_codes()[codes], 1, int(MULT)
    while size < SHINGLE:  # hashes of runs of 1, 2, 4, 8 characters
        n = max(len(total) - size, 0)
        longer = total[:n] * np.uint64(times)
        longer += total[size:]
        total, size, times = longer, 2 * size, times * times % (1 << 64)
    return mixed(total), begins, ends - begins - SHINGLE + 1


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each line's runs of SHINGLE characters; every line has one at least."""
    if not lines:
        return []
    hashes, begins, count = shingle_runs(lines)
    return [distinct(hashes[a : a + n]) for a, n in zip(begins.tolist(), count.tolist(), strict=True)]


@functools.cache
def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 32, SYMBOLS, np.uint64).astype(np.uint32), (rng.integers(0, 1 << 31, SYMBOLS, np.uint64) * 2 + 1).astype(np.uint32)


def signatures_of(lines: list[bytes]) -> np.ndarray:
    """Signatures (lines x SYMBOLS) of lines that have shingles: a minimum over each line for each function."""
    out, start = np.empty((len(lines), SYMBOLS), np.uint32), 0
    while start < len(lines):
        stop, size = start, 0
        while stop < len(lines) and size < 1 << 16:
            size += len(lines[stop])
            stop += 1
        hashes, begins, count = shingle_runs(lines[start:stop])
        ends = np.cumsum(count)
        short = (hashes >> np.uint64(32)).astype(np.uint32)[np.repeat(begins - (ends - count), count) + np.arange(ends[-1])]
        work, least = np.empty_like(short), np.empty((SYMBOLS, stop - start), np.uint32)
        for k, (add, times) in enumerate(zip(*hash_functions(), strict=True)):
            np.bitwise_xor(short, add, out=work)
            np.multiply(work, times, out=work)
            np.minimum.reduceat(work, ends - count, out=least[k])
        out[start:stop] = least.T
        start = stop
    return out


def band_keys(signs: np.ndarray) -> np.ndarray:
    """Keys (lines x BANDS) whose low bits are the band's number."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signs), 1))
    bands = signs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = mixed(key * MULT + bands[:, :, r])
    return (key & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def first_band(same: np.ndarray) -> np.ndarray:
    """The first band in which signatures agree, by the symbols that are the same."""
    return same.reshape(-1, BANDS, ROWS).all(2).argmax(1)


def lines_of(part: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    offsets, data = string_buffers(part.column("text"))
    raw, ends = data.tobytes(), offsets.tolist()
    for i, a, b in zip(part.column("doc").to_pylist(), ends[:-1], ends[1:], strict=True):
        yield i, raw[a:b].split(b"\n")


def once(batches: Iterator[pa.RecordBatch], short_lines: bool) -> Iterator[dict[int, bytes]]:
    """The distinct lines with shingles of each slice; lines met lately in the task are left out."""
    lately: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            found = {}
            for _, lines in lines_of(part):
                for line in lines:
                    if compared(line, short_lines) and (key := digest(line)) not in lately and key not in found:
                        found[key] = line
            if len(lately) > 200_000:
                lately.clear()
            lately.update(found)
            yield found


def band_rows(short_lines: bool):
    """key (of a band), doc (the line's digest)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for found in once(batches, short_lines):
            if found:
                keys = band_keys(signatures_of(list(found.values())))
                yield [keys.ravel(), np.repeat(np.array(list(found), np.int64), BANDS)]

    return make


def node_table(docs: DataFrame, wanted: DataFrame, short_lines: bool) -> DataFrame:
    """node, line, n_shingles, signature for the wanted lines."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in once(batches, short_lines):
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "line"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("line").to_pylist()
            signs, sizes = signatures_of(lines), [len(x) for x in shingle_sets(lines)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array([s.tobytes() for s in signs], pa.binary())], ["node", "line", "n_shingles", "signature"])

    lines = docs.mapInArrow(texts, "node long, line binary").join(wanted.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])
    return lines.mapInArrow(measure, "node long, line binary, n_shingles long, signature binary")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs a, b those whose lines are as similar as asked for."""
    side = nodes.select("node", "n_shingles", "line").hint("shuffle_hash")
    both = pairs.join(side.toDF("a", "na", "la"), "a").join(side.toDF("b", "nb", "lb"), "b")
    both = both.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (shingle_sets(batch.column(c).to_pylist()) for c in ("la", "lb"))
                fine = [linked(x, y, PERCENT) for x, y in zip(left, right, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(fine))

    return both.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def star(index: DataFrame) -> DataFrame:
    """Pairs a, b of each bucket's smallest line with every other one in it."""
    hubs = index.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("key", "a")
    return index.join(hubs.hint("shuffle_hash"), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def line_components(docs: DataFrame, short_lines: bool) -> DataFrame:
    """node, component for the lines (digests) that are linked with another."""
    spark = docs.sparkSession
    index = meet(docs, band_rows(short_lines), ["key", "doc"], "key", bucket_bits(docs), want=SHARED)
    index = Stage(index.select("key", F.col("doc").alias("node")).distinct()).df
    release(spark)
    nodes = Stage(node_table(docs, index.select("node").distinct(), short_lines)).df
    release(spark)
    first = index.where((F.col("key").bitwiseAND(F.lit(BANDS - 1))) < FIRST_BANDS)
    links = Stage(verified(star(first), nodes)).df
    labels = components(links).df
    release(spark)
    full = nodes.withColumnRenamed("line", "content").hint("shuffle_hash")
    rest = Stage(across(index, labels.hint("shuffle_hash"), full, first_band, lambda column: shingle_sets(column.to_pylist()), number_bits=BANDS.bit_length() - 1, symbols=SYMBOLS, far=FAR, percent=PERCENT)).df
    if not rest.isEmpty():
        # a component's labels stand for the links before
        labels = components(rest.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))).df
    release(spark)
    return labels


def occurrences(docs: DataFrame, short_lines: bool) -> DataFrame:
    """doc, node, n (occurrences in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, lines in lines_of(part):
                    seen = Counter(digest(line) for line in lines if counts(line, short_lines))
                    rows += [(doc, node, n) for node, n in seen.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc", "node", "n"])

    return docs.mapInArrow(run, "doc long, node long, n long")


def decisions(docs: DataFrame, short_lines: bool) -> DataFrame:
    """doc, lines: of each document the lines (node, component, home) whose component occurs more than once."""
    labels = line_components(docs, short_lines)
    places = occurrences(docs, short_lines).join(labels.hint("shuffle_hash"), "node", "left").select("doc", "node", F.coalesce("component", "node").alias("component"), "n")
    places = Stage(places).df
    release(docs.sparkSession)
    homes = places.groupBy("component").agg(F.min("doc").alias("home"), F.sum("n").alias("n")).where("n > 1")
    homes = Stage(homes.select("component", "home")).df
    known = places.join(homes.hint("shuffle_hash"), "component").select("doc", F.struct("node", "component", (F.col("doc") == F.col("home")).alias("home")).alias("x"))
    return known.groupBy("doc").agg(F.collect_set("x").alias("lines"))


def rest_of(text: bytes, known: list[dict], short_lines: bool) -> tuple[bytes, int, int]:
    """The text without its lost lines, how many lines count, how many are lost."""
    by, met, kept, considered = {x["node"]: x for x in known}, set(), [], 0
    lines = text.split(b"\n")
    if not by:
        return text, sum(counts(line, short_lines) for line in lines), 0
    for line in lines:
        if counts(line, short_lines):
            considered += 1
            x = by.get(digest(line))
            if x is not None:
                if not x["home"] or x["component"] in met:
                    continue
                met.add(x["component"])
        kept.append(line)
    return b"\n".join(kept), considered, len(lines) - len(kept)


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = False) -> DataFrame:
    """Struct `_row` with the input's other columns, `_text` with the lines that stay, n_lines and n_lost, for every row."""
    ship(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).where("doc is not null and text is not null")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), others(df, text_col).alias("_row"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(decisions(docs, short_lines).hint("shuffle_hash"), "doc", "left").select("_row", "text", "lines")
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, out = part.column("text").to_pylist(), []
                for text, known in zip(texts, part.column("lines").to_pylist(), strict=True):
                    left, n, lost = rest_of((text or "").encode(), known or [], short_lines)
                    out.append((text if not lost else left.decode(), n, lost))
                left, n, lost = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())], ["_row", "_text", "n_lines", "n_lost"])

    return rows.mapInArrow(run, f"_row {kind}, _text string, n_lines long, n_lost long")


def op10_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), short_lines=True)
    return rows.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_lost", F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
