"""Document intake: gate, duplicates, parts and catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions import text as T
from folioflow.functions.scalars import or_default
from folioflow.operators.joins import unroll


def intake_gate(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads without their text, with parts_count and `reject_reason`, null if accepted.

    The rules hold in the order in which a client and then a server meet them. A
    file is a duplicate when the catalog has its hash or when an earlier file of
    the batch with that hash was accepted. Files of one hash hold the same text, so
    whether an earlier one had any is seen on the row itself, and the list of first
    files per hash needs no text.
    """
    before = F.when(or_default(F.col("category"), "") == "", "no_category").when(
        F.col("size_bytes") > V.MAX_UPLOAD_BYTES, "too_large"
    )
    after = F.when(
        ~F.endswith(F.lower(F.coalesce("file_name", F.lit(""))), F.lit(".pdf")), "not_pdf"
    ).when(F.col("size_bytes") == 0, "empty_file")
    per_hash = (
        uploads.select(
            "file_hash",
            F.when(before.isNull() & after.isNull(), F.col("upload_id")).alias("_first"),
            F.lit(False).alias("_known"),
        )
        .unionByName(
            known.select("file_hash", F.lit(True).alias("_known")), allowMissingColumns=True
        )
        .groupBy("file_hash")
        .agg(F.min("_first").alias("_first"), F.bool_or("_known").alias("_known"))
    )
    # Texts end here: the joins see the number of parts only.
    counted = uploads.withColumn("_parts", _part_count(F.coalesce("text", F.lit("")))).select(
        *[c for c in uploads.columns if c not in ("text", "size_bytes")],
        before.alias("_before"),
        F.coalesce(after, F.when(F.col("_parts") == 0, "no_text")).alias("_after"),
        "_parts",
    )
    joined = counted.join(per_hash, "file_hash", "left")
    earlier = (F.col("_first") < F.col("upload_id")) & (F.col("_parts") > 0)
    duplicate = F.coalesce("_known", F.lit(False)) | F.coalesce(earlier, F.lit(False))
    reason = F.coalesce("_before", F.when(duplicate, "duplicate"), "_after")
    return (
        joined.withColumn("reject_reason", reason)
        .withColumn("parts_count", F.when(F.col("_after").isNull(), F.col("_parts")))
        .drop("_before", "_after", "_first", "_known", "_parts")
    )


def _part_count(text: Column) -> Column:
    return F.size(T.split_parts(T.clean_text(text)))


def new_documents(arrivals: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """First arrival per hash that the catalog does not hold yet.

    Copies collapse in the map-side aggregation, so a large group of copies
    reaches the shuffle as one row per task. A catalog stored by `tables.save_by_hash`
    is not shuffled; repeated hashes in it do no harm, as none of its columns is taken.
    """
    first = arrivals.groupBy("file_hash").agg(F.min(order).alias(order))
    return first.join(known.select("file_hash"), "file_hash", "left_anti")


def parts_table(docs: DataFrame, key: str, max_chars: int = V.PART_CHARS) -> DataFrame:
    """Raw text to rows of (key, parts_count, part_index, text)."""
    parts = docs.select(
        key, T.split_parts(T.clean_text(F.col("text")), max_chars).alias("_parts")
    ).withColumn("parts_count", F.size("_parts"))
    return unroll(parts, [key, "parts_count"], "_parts", "part_index", "text")


def parts_manifest(docs: DataFrame, key: str) -> DataFrame:
    """Store key, length and digest of every part."""
    return parts_table(docs, key).select(
        key,
        "part_index",
        "parts_count",
        F.concat(
            F.col(key).cast("string"), F.lit("/text/part_"), F.col("part_index").cast("string"), F.lit(".txt")
        ).alias("path"),
        F.length("text").alias("part_chars"),
        T.file_hash(F.col("text")).alias("part_hash"),
    )


def catalog_candidates(accepted: DataFrame) -> DataFrame:
    """New catalog rows of accepted uploads, with the values shown at upload.

    Needs upload_id, file_name, file_hash, category, added_by, parts_count, cover_url
    and arrived_at, which becomes the time of insertion. The store key is the file's
    hash instead of a random id, so a repeated task writes the same row.
    """
    parts = F.nullif(F.col("parts_count"), F.lit(0))
    return accepted.select(
        F.col("upload_id").alias("id"),
        T.derive_title(F.col("file_name")).alias("title"),
        F.lit(V.UPLOAD_AUTHOR).alias("author"),
        or_default(F.col("cover_url"), V.DEFAULT_COVER).alias("cover_url"),
        F.col("file_hash").alias("book_id"),
        "parts_count",
        F.lit(V.DEFAULT_VOICE).alias("voice"),
        "category",
        "file_hash",
        "added_by",
        F.col("arrived_at").alias("created_at"),
        F.coalesce(
            F.concat(F.lit("~"), (parts * V.MINUTES_PER_PART).cast("string"), F.lit("min")),
            F.lit(V.DEFAULT_DURATION),
        ).alias("duration"),
        F.when(parts.isNull(), V.DEFAULT_TOTAL_SECONDS).otherwise(0).alias("total_time"),
    )


def catalog_apply(known: DataFrame, candidates: DataFrame) -> DataFrame:
    """Catalog snapshot with the candidates added; the part count defaults to 1.

    Candidates must have all columns of the catalog. Those whose hash is already there
    stay out, so applying a batch twice changes nothing.
    """
    missing = set(known.columns) - set(candidates.columns)
    if missing:
        raise ValueError(f"candidates lack {sorted(missing)}")
    new = candidates.join(known.select("file_hash"), "file_hash", "left_anti")
    new = new.withColumn("parts_count", F.coalesce("parts_count", F.lit(1)))
    return known.unionByName(new.select(*known.columns))
