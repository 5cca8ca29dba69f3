"""Operator 7 and the components against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import neardup, shingles
from tessella.llm.common import string_buffers
from tessella.llm.components import components


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for a, b in {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def made_up(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice(["  ", " ", "\n\t"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    common = " ".join(rng.choice(words) for _ in range(60))
    texts += [" ".join(rng.choice(words) for _ in range(80)) + " " + common for _ in range(40)]
    chain = [f"c{i}" for i in range(100)]
    for k in range(12):
        texts.append(" ".join(chain))
        chain[8 * k : 8 * k + 2] = [f"x{k}", f"y{k}"]
    texts += [None, "", " \n", "one", "One", "a b c d", "a b c d e", "É b", "é b", "w " * 40_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = made_up()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_shingles int, component string")
    got = {r.id: (r.n_shingles, r.component, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op7_multi_index(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)


def test_ids_and_empty_tables(spark):
    long = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(None, long), (4, long), (4, long), (None, "alone here"), (7, long + " z")], "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 26, 4, False), (4, 26, 4, True), (4, 26, 4, True), (None, 1, None, True), (7, 27, 4, False)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pigeonhole():
    """All signatures within the radius share a key."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, neardup.SYMBOLS, np.uint64).astype(np.uint32)
    for _ in range(300):
        other = base.copy()
        other[rng.permutation(neardup.SYMBOLS)[: neardup.RADIUS]] += 1
        a, b = neardup.chunk_keys(np.stack([base, other]))
        assert (a == b).any()
        assert neardup.first_common((base == other)[None])[0] == (a == b).argmax()


def test_sets():
    texts = [None, "", "A b\x0bC d e F", "a b c d", "x y z"]
    got = shingles.shingle_sets(*string_buffers(pa.array(texts)))
    assert [len(s) for s in got] == [len(brute_set(t)) for t in texts]
    alone = [shingles.shingle_sets(*string_buffers(pa.array([t], pa.string())))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(got, alone, strict=True))


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (-3, 7)] + [(2000, 2000 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0
