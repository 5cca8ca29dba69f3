"""The pipeline against the operators' brute-force versions, one stage after another, and its defined results."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import quality
from tests.llm import test_neardup, test_short_lines

SF = "/root/testdata/sf0.001"


def removed(rows):
    first, out = {}, []
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = duckdb.connect()
    table.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in table.sql(f"select doc_id from ({quality.OP1_SQL}) where kept").fetchall()}
    want = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    steps = [want]
    # the stage takes short lines too
    steps.append(test_short_lines.brute(steps[-1]))
    groups = test_neardup.brute(steps[-1])
    steps.append([r for r in steps[-1] if groups[r[0]][2]])
    steps.append(removed(steps[-1]))
    out = docs
    for (_, stage), expected in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        out = spark.createDataFrame(stage(spark, out, SF).collect(), docs.schema)
        assert out.schema == docs.schema
        assert sorted((r.doc_id, r.text) for r in out.collect()) == expected
        assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    rows = corpus_pipeline.pack(spark, out, SF).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in steps[-1]}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 2048) + 2


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_rows(spark, stage):
    words = " ".join("w" + "abcdefghij"[i // 10] * 3 + "klmnopqrst"[i % 10] * 2 for i in range(80))
    rows = [(None, words, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, words, "en", None, None), (3, words, "en", None, None), (4, words + " more", "en", "s", 9)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int")
    out = stage[1](spark, docs, SF)
    got = out.collect()
    if stage[0] != "pack":
        assert out.columns == docs.columns
        ids = sorted((r.doc_id for r in got), key=str)
        assert ids == {"quality_rules": [3, 3, 4, None], "near_dedup": [1, 2, 3, 3, None]}.get(stage[0], [1, 2, 3, 3, 4, None])
        if stage[0] != "quality_rules":
            assert next(r.text for r in got if r.doc_id == 1) is None
    else:
        assert len(got) == len(rows)


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    def stage(name):
        return name, lambda spark, docs, sf_dir: docs.withColumn("lang", F.concat(F.coalesce("lang", F.lit("")), F.lit(name)))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    rows = corpus_pipeline.run(spark, SF).select("lang").distinct().collect()
    assert all(r.lang.endswith("abc") for r in rows)
    monkeypatch.undo()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "pack"]
