"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures (operator 7).

A document's set of five-word shingles has a signature of SYMBOLS b-bit symbols (b = 32). Signatures are split into
CHUNKS chunks; by the pigeonhole principle two signatures that differ in at most RADIUS = CHUNKS * (ERRORS + 1) - 1
symbols agree in some chunk up to ERRORS symbols, so every document is indexed under each chunk with every choice of
ERRORS symbols left out, and all pairs within the radius meet under some key. Pairs at the similarity of 0.75 differ in
a quarter of the symbols on average; the chance that such a pair has no key in common is 0.367 ** 10, about 4e-5, and it
falls fast above. Candidates that differ in more than FAR symbols are dropped (a chance of 5e-13 at 0.75); all
others are decided on the full sets.

Only the links' components are wanted, so pairs already connected needn't be decided:
  1. equal sets are one node; a first star (all members of a bucket against its smallest) over the first chunks
     connects most members of large groups;
  2. a star over all keys, between one member of each component in a bucket, and one from the members of most links;
  3. in buckets that still hold several components, every pair of members of different components is decided inside a
     task, in blocks of BLOCK members, by sizes, signatures and then full sets; only links that join components come out.
So no link between different components is left undecided, and no stage emits the pairs of a group.

Defined results: a null text or one without words has no shingles, no links and its own id as component; rows with equal
doc_id and text stay and share their result; an id in several rows with different texts links them, and only one
of its texts is compared with others where it is the smallest id of several sets; a null id is never
a component's smallest unless all are null (then the component is null and the rows are kept); an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Stage, release, ship, slices, string_buffers
from tessella.llm.components import components
from tessella.llm.shingles import linked, minhash, mixed, shingle_sets

PERCENT, CHUNK, CHUNKS, ERRORS = 75, 5, 10, 1
SYMBOLS, RADIUS = CHUNK * CHUNKS, CHUNKS * (ERRORS + 1) - 1
#: Low bits of a key that number it.
NUMBER_BITS = 6
#: Candidates may differ in as many symbols; chunks of the first star; members of a block in the last pass.
FAR, FIRST_CHUNKS, BLOCK = 36, 2, 1024


def sketches(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_key (a digest of the whole set) and signature; both null for an empty set."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*string_buffers(part.column("text")))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                signs = [minhash(s, SYMBOLS).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["id", "n_shingles", "set_key", "signature"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, set_key binary, signature binary")


def signatures(column: pa.Array, symbols: int = SYMBOLS) -> np.ndarray:
    _, raw = string_buffers(column)
    return np.frombuffer(raw.tobytes(), np.uint32).reshape(-1, symbols)


def chunk_keys(signs: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """Keys (rows x keys, signed) of each signature: every chunk with every choice of ERRORS symbols left out.

    A key's low NUMBER_BITS bits are its number.
    """
    out = []
    for c in range(chunks):
        for left in itertools.combinations(range(CHUNK), ERRORS):
            key = np.full(len(signs), c * 1000 + sum(x * 10**i for i, x in enumerate(left)) + 1, np.uint64)
            for j in range(CHUNK):
                if j not in left:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signs[:, c * CHUNK + j])
            out.append(key >> np.uint64(NUMBER_BITS) << np.uint64(NUMBER_BITS) | np.uint64(len(out)))
    return np.stack(out, 1).view(np.int64)


def indexed(nodes: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """key, node for every key of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(signatures(batch.column("signature")), chunks)
                node = np.repeat(np.asarray(batch.column("node")), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs a, b those whose sizes allow the similarity and whose signatures differ in at most FAR symbols."""
    side = nodes.select("node", "n_shingles", "signature")
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    both = both.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = (signatures(batch.column("sa")) != signatures(batch.column("sb"))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(apart <= FAR))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs a, b those that are linked by their full sets."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fine = [linked(x, y, PERCENT) for x, y in zip(stored_sets(batch.column("sa")), stored_sets(batch.column("sb")), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(fine))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def stored_sets(column: pa.Array) -> list[np.ndarray]:
    offsets, raw = string_buffers(column)
    values = np.frombuffer(raw.tobytes(), np.uint64)
    return [values[a // 8 : b // 8] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def set_table(df: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """node, set (bytes of the sorted shingles) for the wanted nodes, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*string_buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("text"))
    return rows.join(wanted, "node", "left_semi").mapInArrow(run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """key, node, component; a node without links is its own component. Only buckets of several components remain."""
    if labels is None:
        rows = index.withColumn("component", F.col("node"))
    else:
        rows = index.join(labels.withColumnRenamed("component", "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("component"))
    return rows


def star(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs a, b of each bucket's smallest component with every other one in it, a member of each."""
    rows = labelled(index, labels).groupBy("key", "component").agg(F.min("node").alias("node"))
    hubs = rows.groupBy("key").agg(F.min(F.struct("component", "node")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub.*").toDF("key", "hub", "a")
    return rows.join(hubs, "key").where("component <> hub").select("a", F.col("node").alias("b")).distinct()


def star_of_hubs(index: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs a, b of each bucket's member with the most links so far and all its members of other components."""
    ends = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    rows = labelled(index, labels).join(ends, "node", "left").select("key", "node", "component", F.coalesce("degree", F.lit(0)).alias("degree"))
    hubs = rows.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("first"), "node", "component")).alias("hub"), F.min("component").alias("least"), F.max("component").alias("most"))
    hubs = hubs.where("least <> most").select("key", F.col("hub.node").alias("a"), F.col("hub.component").alias("own"))
    return rows.join(hubs, "key").where("component <> own").select("a", F.col("node").alias("b")).distinct()


def first_common(same: np.ndarray) -> np.ndarray:
    """The number of the first key that signatures have in common, by the symbols in which they agree (rows x SYMBOLS)."""
    other = ~same.reshape(-1, CHUNKS, CHUNK)
    chunk = (other.sum(2) <= ERRORS).argmax(1)
    return chunk * CHUNK + other[np.arange(len(other)), chunk].argmax(1)


def across(index: DataFrame, labels: DataFrame, nodes: DataFrame, first: Callable[[np.ndarray], np.ndarray], sets_of: Callable[[pa.Array], list[np.ndarray]], *, number_bits: int = NUMBER_BITS, symbols: int = SYMBOLS, far: int = FAR, percent: int = PERCENT) -> DataFrame:
    """Links a, b between different components that share a bucket, decided on the full sets inside the tasks.

    nodes: node, n_shingles, signature, content (of which sets_of makes the sets). A task reads the buckets one after
    another, two blocks at a time, and goes through the pairs of all buckets it holds by their distance in the order; it
    takes those of different components, near signatures and no earlier key in common (first(), against the number in the
    key's low bits), so that a pair is decided once. Components that a link joins count as one from then on, so a bucket
    gives fewer links than it has members.
    """
    rows = labelled(index, labels)
    several = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    rows = rows.join(several.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.join(nodes.select("node", "n_shingles", "signature", "content"), "node").withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "node", "component", "n_shingles", "signature", "content", "block", other)
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n_shingles", "node", "component", "signature", "content", "block")

    def links_in(rows: pa.RecordBatch, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole buckets; bucket numbers the rows' buckets, which stand one after another."""
        here = np.asarray(rows.column("key")) & ((1 << number_bits) - 1)
        size, node, block = (np.asarray(rows.column(c)) for c in ("n_shingles", "node", "block"))
        apart = np.asarray(rows.column("i")) != np.asarray(rows.column("j"))
        label, sign = np.array(rows.column("component")), signatures(rows.column("signature"), symbols)
        found, sets = [], {}
        for step in range(1, rows.num_rows):
            a = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(a):
                break
            b = a + step
            fine = (label[a] != label[b]) & (size[b] * percent <= size[a] * 100) & (~apart[a] | (block[a] != block[b]))
            a, b = a[fine], b[fine]
            if not len(a):
                continue
            same = sign[a] == sign[b]
            fine = same.sum(1) >= symbols - far
            fine[fine] = first(same[fine]) == here[a[fine]]
            a, b = a[fine], b[fine]
            if lacking := sorted({*a.tolist(), *b.tolist()} - sets.keys()):
                sets.update(zip(lacking, sets_of(rows.column("content").take(pa.array(lacking))), strict=True))
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if label[x] != label[y]:
                    if linked(sets[x], sets[y], percent):
                        found.append((min(node[x], node[y]), max(node[x], node[y])))
                        label[label == label[y]] = label[x]
        if found:
            x, y = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a bucket of which more may come: two blocks at most
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.concat_batches([*held, batch])
            names = [np.asarray(whole.column(c)) for c in ("key", "i", "j")]
            starts = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in names], axis=0)])
            cut = int(np.flatnonzero(starts)[-1])
            if cut:
                yield from links_in(whole.slice(0, cut), np.cumsum(starts[:cut]))
                held = []
            held = [whole.slice(cut)] if cut or not held else [*held, batch]
        if held:
            last = pa.concat_batches(held)
            yield from links_in(last, np.zeros(last.num_rows, np.int64))

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n_shingles", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def connect(first: DataFrame, index: DataFrame, verify: Callable[[DataFrame], DataFrame], last: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component of all links: three stars, each decided by verify(pairs), then last(labels), the rest of the links."""
    links = labels = None
    for found in (lambda: verify(star(first, None)), lambda: verify(star(index, labels)), lambda: verify(star_of_hubs(index, labels, links)), lambda: last(labels)):
        fresh = Stage(found()).df
        if labels is not None and fresh.isEmpty():
            continue  # no link joins anything
        links = fresh if links is None else links.unionByName(fresh)
        # a component's labels stand for the links before
        edges = fresh if labels is None else fresh.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = components(edges).df
        release(fresh.sparkSession)
    return labels


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component, kept for every row."""
    made = Stage(sketches(df, id_col=id_col, text_col=text_col)).df
    nodes = Stage(made.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))).df
    whole = nodes.where("node is not null")
    unique = whole.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    index = indexed(whole)
    met = index.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key")
    # the nodes that share a key with another: only their sets are ever needed, and only their keys
    index = Stage(index.join(met, "key", "left_semi")).df
    sets = Stage(set_table(df, index.select("node").distinct(), id_col=id_col, text_col=text_col)).df
    first = indexed(whole.join(index.select("node").distinct(), "node", "left_semi"), FIRST_CHUNKS)
    full = unique.join(sets.withColumnRenamed("set", "content"), "node")
    labels = connect(first, index, lambda pairs: verified(near(Stage(pairs).df, unique), sets), lambda labels: across(index, labels, full, first_common, stored_sets))
    named = nodes.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    rows = made.join(Stage(named).df, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component"))
    return rows.select("id", "n_shingles", component.alias("component")).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def op7_multi_index(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
