"""Operator 10 against brute force over all pairs of lines that share a shingle."""

import itertools
import random

import pytest

from tessella.llm import lines
from tessella.llm.common import with_text


def brute(rows):
    """(id, remaining text) for each row."""
    sets, places = {}, {}
    for i, t in rows:
        if i is None or t is None:
            continue
        for k, line in enumerate(t.split("\n")):
            if len(line) >= 20:
                sets[line] = {line[j : j + 8] for j in range(len(line) - 7)}
                places.setdefault(line, []).append((i, k))
    parent = {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for line, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(line)
    for a, b in {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}:
        if find(a) != find(b):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    first = {}
    for line, at in places.items():
        root = find(line)
        first[root] = min([first[root], *at] if root in first else at)
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        kept = [line for k, line in enumerate(t.split("\n")) if len(line) < 20 or first[find(line)] == (i, k)]
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def made_up(seed):
    rng = random.Random(seed)
    words = [f"wört{i}" if i % 7 == 0 else f"word{i}" for i in range(400)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 9)):
            line = rng.choice(pool)
            if rng.random() < 0.5 and line:
                parts = line.split(" ")
                for _ in range(rng.randint(0, 2)):
                    parts[rng.randrange(len(parts))] = rng.choice(words)
                line = " ".join(parts)
            text.append(line)
        rows.append((i, "\n".join(text)))
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, "\n\n"), (903, "x" * 19), (904, "x" * 19), (905, "y" * 30), (906, "y" * 50_000 + "\n" + "y" * 30), (None, pool[0]), (907, "é" * 10), (908, "é" * 20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made_up(seed)
    df = spark.createDataFrame([(*r, 5, "d") for r in rows], "doc_id long, text string, node int, `lines` string").repartition(4)
    out = lines.dedup_lines(df)
    assert sorted(((r._row.doc_id, r._text) for r in out.collect()), key=str) == brute(rows)
    assert with_text(out, df.columns, "text", "_text").schema == df.schema


def test_ids_and_empty_tables(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(2, f"{line}\n{line}"), (2, f"{line}\n{line}"), (3, line + "!"), (None, line)], "doc_id long, text string")
    got = sorted(((r._row.doc_id, r._text, r.n_lost) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == sorted([(2, line, 1), (2, line, 1), (3, "", 1), (None, line, 0)], key=str)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r._row.doc_id, r._text) for r in lines.dedup_lines(df).collect()), key=str) == brute(rows)


def test_few_jobs(spark):
    """Groups of lines whose links the first bands, the others and the last pass find: each round of components is many jobs."""
    rows = made_up(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    got = sorted(((r._row.doc_id, r._text) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == brute(rows)
    assert scheduler.numTotalJobs() - before <= 95
