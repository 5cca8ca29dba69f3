"""Written tables start no processes: one that starts shares the JVM's memory for a moment."""

from pathlib import Path

import pytest

from tessella.llm import packing, substrings
from tessella.llm.common import Stage, shared_dir


def reaped(spark) -> int:
    """Page faults of processes that the JVM has started and seen end."""
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    return int(Path(f"/proc/{pid}/stat").read_text().rsplit(")", 1)[1].split()[8])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, f"{i % 7} " + "the same words in every document, again and again " * (1 + i % 3) + str(i)) for i in range(60)]
    path = tmp_path_factory.mktemp("processes")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("query", [packing.op3_sum_of_squares, substrings.op6_prefix_doubling])
def test_queries_start_no_process(spark, folder, query):
    shared_dir(spark)  # the folder for all is made by the JVM, once

    def started() -> bool:
        before = reaped(spark)
        assert len({r.doc_id for r in query(spark, folder).collect()}) == 60
        return reaped(spark) != before

    # Spark may start one for reasons of its own meanwhile, but not each time
    assert not all(started() for _ in range(3))


def same(batches):
    yield from batches


def test_tables_made_by_workers(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 3 as int) part", "if(id % 5 = 0, null, encode(string(id), 'utf-8')) raw")
    table = Stage.made(rows.repartition(5), same, "id long, part int, raw binary")
    assert table.df.schema == table.schema
    assert sorted(table.df.collect()) == sorted(rows.collect())
    folder = Path(table.path.removeprefix("file:"))
    assert all(p.name.startswith("part_") for p in folder.iterdir())
    (part, *_) = sorted(folder.iterdir())
    raw = bytearray(part.read_bytes())
    raw[40] ^= 1
    part.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        table.df.selectExpr("sum(id)").collect()
    table.drop()
    assert not folder.exists()
    empty = Stage.made(rows.limit(0), same, "id long, part int, raw binary")
    assert empty.df.collect() == []


def test_op6_from_a_table_of_few_files(spark, folder, tmp_path):
    # ids that are null or come twice, null and empty texts, on more partitions than the result needs
    same_text = "the same fifty bytes and more stand in each of these rows, " * 2
    rows = [(1, "a " + same_text), (1, "b " + same_text), (None, same_text), (2, None), (3, ""), (4, same_text + "é"), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    kept = substrings.remove_repeats(docs).selectExpr("_row.doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")
    key = lambda r: [str(x) for x in r]
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = substrings.op6_prefix_doubling(spark, str(tmp_path))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, kept.collect()), key=key)
        assert substrings.op6_prefix_doubling(spark, folder).rdd.getNumPartitions() <= 15
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
