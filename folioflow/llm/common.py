"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds. A null id is in fold -1."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    return F.coalesce(remainder, F.lit(-1)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only on a local master that names none, a folder of our own is set.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="folioflow-llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and go on from its files.

    Work before it is done once, a lost executor repeats only its own tasks, and the
    plan after it starts from a scan. The folder's owner removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bytes(
    batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `most` bytes; a row is never cut."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        begin = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def give_back() -> None:
    """Return freed memory to the system. Python workers are used again by other stages, and what
    their allocators keep after a partition would add to what those need. Objects that refer to each
    other are collected first; what the caller still has names for stays."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
