"""Operator 10 and the pipeline's stage on lines under 20 characters, against brute force over all pairs."""

import itertools
import random

import corpus_pipeline
from tessella.llm import lines


def brute(rows):
    """(id, remaining text): every line of 20 characters or with a letter or digit takes part."""
    takes_part = lambda line: len(line) >= 20 or any(c.isalnum() for c in line)
    places = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            if takes_part(line):
                places.setdefault(line, []).append((i, k))
    sets = {x: {x[j : j + 8] for j in range(len(x) - 7)} for x in places}
    home = {x: {x} for x in places}
    for a, b in itertools.combinations(places, 2):
        if home[a] is not home[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            home[a] |= home[b]
            for x in home[b]:
                home[x] = home[a]
    first = {x: min(min(places[y]) for y in home[x]) for x in places}
    return sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if not takes_part(x) or first[x] == (i, k))) for i, t in rows)


def made_up():
    rng = random.Random(5)
    words = ["Les", "And", "ornd", "été", "次の", "ページ", "more", "Read", "share", "page", "7", "Of", "edti", "Section"]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    pool += [x + rng.choice("abc1.") for x in pool if len(x) > 10]
    pool += ["", "---", "* * *", "-" * 30, "_" * 5, "a", "7", "次", "x" * 7, "x" * 8, "x" * 9, "x" * 19, "é" * 7, "é" * 19]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(90)]


def test_short_lines_against_brute_force(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = lines.dedup_lines(df, short_lines=True).select("_row.doc_id", "_text").collect()
    assert sorted((r.doc_id, r._text) for r in out) == brute(rows)


def test_query_and_stage_lose_short_repeats(spark, tmp_path):
    rows = [(1, "Les.\n---\nRead more\nan own line of the first"), (2, "Les.\n---\nRead more\n次のページ"), (3, "次のページ\nLes.\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_lost) for r in lines.op10_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0), 2: (3, 2), 3: (2, 2)}
    out = corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == brute(rows) == [(1, rows[0][1]), (2, "---\n次のページ"), (3, "")]
