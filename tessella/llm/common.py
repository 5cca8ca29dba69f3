"""What the operators share: the shared folder, written tables, and Arrow text columns as numpy arrays."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows of an Arrow batch, where the session leaves Spark's default: texts are long, and a batch is held in whole.
BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, when they share its machine; batches are small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only where that is unset (tests) a local one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


#: How tables are written where the shared folder is a mounted one (file:). Without Hadoop's native library its classes start a
#: chmod for each new file and folder, and its usual class a third of them for files of checksums. Instead of these, the
#: checksums of Parquet's pages are verified.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}
#: Of rows that a Python worker writes together.
GROUP_BYTES = 4 << 20


class Stage:
    """A written table that cuts lineage: any executor can read it again after others are lost."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = shared_dir(self.spark)
        df.write.options(**PLAIN_FILES).parquet(self.path)

    @classmethod
    def made(cls, source: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> Stage:
        """The table of source.mapInArrow(run, schema), whose files the Python workers write where the shared folder is a mounted one.

        So executors start no process for it: one that starts shares the JVM's memory until its command has begun, and
        whoever adds up an executor's processes then counts the JVM twice. A file's name is new at each attempt and hidden
        until the driver shows those of finished tasks.
        """
        spark, made = source.sparkSession, source.mapInArrow(run, schema)
        table = cls.__new__(cls)
        table.spark, table.schema, table.path = spark, made.schema, shared_dir(spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.path)
        where = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
        if where.getScheme() != "file":
            return cls(made)
        base, kind = where.getPath(), to_arrow_schema(made.schema)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import parquet
            from pyspark import TaskContext

            name, out, held, size = f"_{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, [], 0

            def flush() -> None:
                rows = pa.Table.from_batches(held).select(kind.names).cast(kind)
                out.write_table(rows, row_group_size=rows.num_rows)

            for batch in run(batches):
                if batch.num_rows:
                    if out is None:
                        out = parquet.ParquetWriter(f"{base}/{name}", kind, compression="zstd", use_dictionary=False, write_page_checksum=True)
                    held.append(batch)
                    size += batch.nbytes
                if size >= GROUP_BYTES:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_pydict({"name": [name]})

        os.makedirs(base)
        for row in source.mapInArrow(write, "name string").collect():
            os.rename(f"{base}/{row['name']}", f"{base}/part{row['name']}.parquet")
        for left in Path(base).glob("_*"):  # of attempts that failed or came second
            left.unlink()
        return table

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).options(**VERIFIED).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only for tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of finished plans now: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def others(df: DataFrame, text_col: str) -> Column:
    """A struct of all columns but the text, so that a text passes a Python operator once."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col])


def with_text(rows: DataFrame, names: list[str], text_col: str, text: str) -> DataFrame:
    """The columns `names` again, from struct _row and the column `text`."""
    return rows.select(*[F.col(text).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names])


def squeezed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its text as zstandard frames (binary), which a shuffle moves at about half of its own compression's size."""
    fields = ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col).cast(pa.large_binary()).to_pylist()
                yield part.set_column(part.schema.get_field_index(text_col), text_col, pa.array([None if t is None else squeeze(t) for t in texts], pa.binary()))

    return df.mapInArrow(run, fields)


def unsqueezed(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches of squeezed() rows with their texts again, as bytes, few rows at a time."""
    widen = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in slices(batch, text_col, 1 << 18):
            texts = [None if t is None else widen(t) for t in part.column(text_col).to_pylist()]
            yield part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(texts, pa.large_binary()))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, rows + 1, from 0) and the bytes of a string or binary column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20):
    """Row ranges of a batch with about most_bytes of text each; a longer text is a range of its own."""
    if not batch.num_rows:
        return
    offsets, _ = string_buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def codes_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of concatenated UTF-8 texts and the texts' offsets among them."""
    raw = data.tobytes()
    codes = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) == len(data):
        return codes, offsets
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return codes, heads[offsets]


def binary_array(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
