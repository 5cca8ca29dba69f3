"""Written tables between steps."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.llm.common import Stage


def test_no_checksum_files_but_checked_pages(spark):
    table = Stage(spark.range(20_000).select(F.xxhash64("id").alias("x")).coalesce(1))
    folder = Path(table.path.removeprefix("file:"))
    assert not [p for p in folder.iterdir() if p.name.endswith(".crc")]
    assert table.df.count() == 20_000
    (part,) = folder.glob("part-*")
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2] ^= 1
    part.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        table.df.agg(F.sum(F.col("x") % 7)).collect()
    table.drop()
    assert not folder.exists()
