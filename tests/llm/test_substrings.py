"""Operator 6 against brute force."""

import hashlib
import random

import pytest

from tessella.llm import substrings


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = b"\x01" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted(((r._row.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(df, **options).collect()), key=str)


def made_up(seed):
    rng = random.Random(seed)
    words = ["de", "la", "é", "foo", "bar", "quux", "le", "x", " "] + [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = []
    for _ in range(90):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            parts += [p[a : len(p) - rng.randint(0, 10)], " ".join(rng.choice(words) for _ in range(rng.randint(0, 20)))]
        texts.append(" ".join(parts))
    for _ in range(25):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 4)):
            if t:
                t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    texts += [None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 3000, "a" * 3000, "ab" * 700, "ab" * 24 + "a", "b" + "ab" * 40, passages[0] * 30]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made_up(seed)
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, text string, rank string, doc int").repartition(5)
    assert result(df) == brute(rows)


def test_other_length(spark):
    rows = made_up(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, length=21) == brute(rows, 21)


def test_ids_and_empty_tables(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away from it all"
    rows = [(3, t), (3, t), (None, t), (5, t + "!"), (5, t + "!"), (1, "no"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substrings.op6_prefix_doubling(spark, path).collect()), key=str)
    assert got == brute(rows)
