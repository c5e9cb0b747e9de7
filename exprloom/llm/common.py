"""Shared helpers: durable intermediate tables and Arrow utilities."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words and is stripped from lines: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Where it is unset, a folder of our own serves a local master only: on a
    cluster the executors would not see it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="exprloom-")
        context.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts lineage durably: the files outlive every executor, and later scans read them instead
    of computing ``df`` again.  Hadoop removes them when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/exprloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, where = _place(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` returned and nothing reads any more."""
    system, where = _place(df.sparkSession, df._written_to)
    system.delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the fast built-in path; the result is the same."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


class Memo(dict):
    """Answers of ``make`` by word.  Words of over ``longest`` characters are not kept, and beyond ``most`` bytes the memo
    starts afresh, so that text without spaces, whose "words" are long and never come again, takes no memory."""

    #: What an entry costs beside its word, about.
    ENTRY = 150

    def __init__(self, make: Callable, most: int = 96 << 20, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.held = make, most, longest, 0

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[word] = value
            self.held += len(word) + self.ENTRY
        return value


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A ``mapInArrow`` function that applies ``fn`` to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one; null counts as empty."""
    for value in batch.column(column):
        yield value.as_py() or ""


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of the texts of a batch one by one; null counts as empty."""
    for value in batch.column(column):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""
