"""Catalog and personal library tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

CATALOG = t.StructType(
    [
        t.StructField("id", t.StringType(), False),
        t.StructField("title", t.StringType(), False),
        t.StructField("author", t.StringType()),
        t.StructField("cover_url", t.StringType()),
        t.StructField("book_id", t.StringType(), False),
        t.StructField("parts_count", t.IntegerType()),
        t.StructField("voice", t.StringType()),
        t.StructField("category", t.StringType()),
        t.StructField("file_hash", t.StringType(), False),
        t.StructField("added_by", t.StringType(), False),
        t.StructField("created_at", t.TimestampNTZType(), False),
    ]
)
USER_BOOKS = t.StructType(
    [
        t.StructField("user_id", t.StringType(), False),
        t.StructField("global_book_id", t.StringType(), False),
        t.StructField("current_part_index", t.IntegerType()),
        t.StructField("current_time", t.DoubleType()),
        t.StructField("total_time", t.DoubleType()),
        t.StructField("progress", t.IntegerType()),
        t.StructField("added_at", t.TimestampNTZType(), False),
    ]
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).parquet(path)


def read_user_books(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Progress rows; a user filter reaches the file scan."""
    rows = spark.read.schema(USER_BOOKS).parquet(path)
    return rows if user_id is None else rows.where(F.col("user_id") == user_id)


def hash_known(catalog: DataFrame, file_hash: str) -> bool:
    """Whether the catalog holds a file hash; stops at the first hit."""
    return not catalog.where(F.col("file_hash") == file_hash).select("file_hash").isEmpty()


def written(df: DataFrame, name: str) -> str:
    """Path of a table written to the folder that all executors share.

    The session names it in spark.checkpoint.dir; only a local master without one gets a folder of
    its own. The folder's owner removes the files.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def save_by_hash(catalog: DataFrame, name: str, buckets: int) -> None:
    """Store a catalog as a table bucketed and sorted by file hash.

    Joins on the hash then read it where it lies: only the other side is shuffled, to the same
    buckets. Choose so many buckets that one holds 100 to 200 MB of hashes and keys.
    """
    catalog.write.bucketBy(buckets, "file_hash").sortBy("file_hash").mode("overwrite").saveAsTable(name)
