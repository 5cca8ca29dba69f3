"""The corpus pipeline: quality rules, line and document deduplication, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; where a stage changes a text, n_chars follows it. The last
returns a row per piece of a document with its sequence and place there.

Defined results: documents without an id pass the deduplicating stages as they are; a document that loses all its lines
or bytes stays with an empty text; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import lines, neardup, packing, quality, substrings
from tessella.llm.common import Stage, tokenizer_path, with_text


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line resembles."""
    return counted(with_text(lines.dedup_lines(docs, short_lines=True), docs.columns, "text", "_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    lost = neardup.near_duplicates(docs).where("not kept and id is not null").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(Stage(lost).df, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has; characters cut in two by that go too."""
    rows = substrings.remove_repeats(docs, as_text=True)
    return counted(with_text(rows, docs.columns, "text", "kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.place(packing.checked_pieces(docs, tokenizer_path("byte_bpe_50k.json"), added_tokens=True)).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pack", pack)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = Stage(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
