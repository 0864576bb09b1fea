"""Stored parts, as a table and in the one-file-per-part layout, and upload files."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import file_hash

BOOK_META = "title string, voice string, parts_count int, cover_url string"
BUCKET_BYTES = 1 << 28
#: batch and the number of buckets are part of the path, so they come back as columns.
STORE_COLUMNS = ("batch", "buckets", "bucket")


def input_bytes(df: DataFrame) -> int:
    """Size of the tables a plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def bucket_of(key: Column, buckets) -> Column:
    return F.pmod(F.xxhash64(key), buckets).cast("int")


def write_parts(
    parts: DataFrame,
    path: str,
    batch: str,
    key: str = "book_id",
    buckets: int | None = None,
    repeated: str = "refuse",
) -> None:
    """Add a batch of (key, part_index, text) to the store at `path`.

    Every batch has a folder of its own, so earlier batches stay, and writing a batch
    again replaces just that batch. The number of buckets follows from the size of what
    the batch is made from unless given; it is kept in the batch's path. The rebalance
    hint lets Spark split a bucket that one long book makes too large and merge small
    ones. Rows are sorted in their file, so that a book's row groups can be picked.
    A book that another batch holds is refused, or left out with repeated="skip"; only the
    keys of the other batches are read for that.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"batch {batch!r}: letters, digits, '_', '.' and '-' only")
    if repeated not in ("refuse", "skip"):
        raise ValueError(f"repeated {repeated!r}: 'refuse' or 'skip'")
    others = _books_of_others(parts.sparkSession, path, batch, key)
    if others is not None:
        if repeated == "skip":
            parts = parts.join(others, key, "left_anti")
        else:
            twice = parts.select(key).join(others, key, "left_semi").distinct().limit(3).collect()
            if twice:
                raise ValueError(f"other batches hold {key} {[r[0] for r in twice]}; repeated='skip' leaves them")
    n = buckets or min(100_000, max(1, -(-input_bytes(parts) // BUCKET_BYTES)))
    bucketed = parts.select(key, "part_index", "text", bucket_of(F.col(key), F.lit(n)).alias("bucket"))
    (
        bucketed.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", key, "part_index")
        .withColumn("buckets", F.lit(n))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("buckets", "bucket")
        .parquet(f"{path}/batch={batch}")
    )


def _books_of_others(spark: SparkSession, path: str, batch: str, key: str) -> DataFrame | None:
    """Keys that the store's other batches hold; none if there is no other batch."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    names = [status.getPath().getName() for status in system.listStatus(where)]
    names = [n for n in names if n.startswith("batch=") and n != f"batch={batch}"]
    paths = [f"{path}/{n}" for n in names]
    return spark.read.parquet(*paths).select(key).distinct() if paths else None


def _store(spark: SparkSession, path: str) -> DataFrame:
    # The batch's name stays text whatever it looks like.
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts of all batches; no two of them hold the same book."""
    return _store(spark, path).drop(*STORE_COLUMNS)


def read_book(spark: SparkSession, path: str, book, key: str = "book_id") -> DataFrame:
    """Parts of one book; only its bucket in each batch is read, and there its row groups."""
    parts = _store(spark, path)
    typed = F.lit(book).cast(parts.schema[key].dataType)
    mine = (F.col("bucket") == bucket_of(typed, F.col("buckets"))) & (F.col(key) == typed)
    return parts.where(mine).drop(*STORE_COLUMNS)


def _files(spark: SparkSession, root: str, books: Iterable[str] | None, names: str) -> list[str]:
    """Patterns of the files of some books, or of all; books without such files have none.

    Only the folders of the books asked for are listed.
    """
    if books is None:
        return [f"{root}/*/{names}"]
    books = sorted(set(books))
    odd = [b for b in books if not re.fullmatch(r"[^/*?\[\]{}\\]+", b) or b in (".", "..")]
    if odd:
        raise ValueError(f"no names of books: {odd[:3]}")
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = (f"{root}/{b}/{names}" for b in books)
    return [p for p in found if system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p))]


def read_part_files(
    spark: SparkSession,
    root: str,
    books: Iterable[str] | None = None,
    parts: Iterable[int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Books and parts of a `<book>/metadata.json` + `<book>/part_<n>.txt` layout.

    With `books`, the folders of all others are neither listed nor read; with `parts`, only files of
    these numbers are. Both are meant for a bounded choice, as each book is looked up by the driver.
    Books asked for that are not there have no rows, nor have their missing parts.
    """
    numbers = None if parts is None else sorted({int(n) for n in parts})
    names = "part_*.txt" if numbers is None else f"part_{{{','.join(map(str, numbers))}}}.txt"

    def path_part(pattern: str):
        return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)

    # The path is encoded, but for the plus sign, which decoding would take for a space.
    book = F.url_decode(F.replace(path_part(r"([^/]+)/[^/]+$"), F.lit("+"), F.lit("%2B")))
    about = _files(spark, root, books, "metadata.json")
    if about:
        read = spark.read.schema(BOOK_META).option("multiLine", True).json(about)
        found = read.select(book.alias("book_id"), "title", "voice", "parts_count", "cover_url")
    else:
        found = spark.createDataFrame([], f"book_id string, {BOOK_META}")
    files = _files(spark, root, books, names) if numbers != [] else []
    if not files:
        return found, spark.createDataFrame([], "book_id string, part_index int, text string")
    texts = spark.read.text(files, wholetext=True).select(
        book.alias("book_id"),
        path_part(r"part_(\d+)\.txt$").cast("int").alias("part_index"),
        F.col("value").alias("text"),
    )
    return found, texts


def read_audio_files(spark: SparkSession, root: str) -> DataFrame:
    """Stored audio of a `<book>/audio/part_<n>_<voice slug>.mp3` layout: book_id, part_index, voice_slug.

    Only names are listed; no audio is read.
    """
    files = spark.read.format("binaryFile").load(f"{root}/*/audio/part_*.mp3").select("path")
    at = r"([^/]+)/audio/part_(\d+)_([^/]+)\.mp3$"
    name = F.url_decode("path")
    return files.select(
        F.regexp_extract(name, at, 1).alias("book_id"),
        F.regexp_extract(name, at, 2).cast("int").alias("part_index"),
        F.regexp_extract(name, at, 3).alias("voice_slug"),
    )


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the file sources report it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(where).toString().rstrip("/")


def read_uploads(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """Listed upload files with their size and hash.

    The listing (upload_id, file_path below `root`, file_name, category) leads, because
    the file source leaves out empty files. Equal names in different folders are
    different files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substring(F.url_decode("path"), len(_qualified(spark, root)) + 2, 2**31 - 1)
    found = files.select(
        below.alias("file_path"), F.col("length").alias("_length"), file_hash(F.col("content")).alias("_hash")
    )
    empty = file_hash(F.lit("").cast("binary"))
    return listing.join(found, "file_path", "left").select(
        *listing.columns,
        F.coalesce("_length", F.lit(0)).alias("size_bytes"),
        F.coalesce("_hash", empty).alias("file_hash"),
    )
