"""Which audio parts exist, must be made, or lack their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.scalars import next_part, part_indexes
from folioflow.functions.text import slug

PART = ["book_id", "part_index"]
AUDIO = ["book_id", "part_index", "voice"]


def audio_path(book: Column, part: Column, voice: Column) -> Column:
    """Object key of a part's audio; voices with the same slug share it."""
    number = part.cast("string")
    return F.concat(book, F.lit("/audio/part_"), number, F.lit("_"), slug(voice), F.lit(".mp3"))


def audio_plan(required: DataFrame, stored_text: DataFrame, stored_audio: DataFrame) -> DataFrame:
    """State and object key of every required (book, part, voice).

    stored_audio names voices by their slug. Stored slugs come as one set per part, so
    both joins run on (book, part) and the required rows are shuffled once.
    """
    text = stored_text.select(*PART).distinct().withColumn("_text", F.lit(True))
    audio = stored_audio.groupBy(*PART).agg(F.collect_set("voice_slug").alias("_slugs"))
    made = F.array_contains("_slugs", slug(F.col("voice")))
    state = F.when(made, "hit").when(F.col("_text"), "generate").otherwise("missing_text")
    return (
        required.select(*AUDIO)
        .join(text, PART, "left")
        .join(audio, PART, "left")
        .select(
            *AUDIO,
            audio_path(F.col("book_id"), F.col("part_index"), F.col("voice")).alias("path"),
            state.alias("state"),
        )
    )


def prefetch_plan(
    user_books: DataFrame, catalog: DataFrame, stored_audio: DataFrame, voice: str
) -> DataFrame:
    """Next parts of current positions that have no audio yet, each once."""
    books = catalog.select(F.col("id").alias("global_book_id"), "book_id", "parts_count")
    positions = user_books.select("global_book_id", "current_part_index").distinct()
    following = (
        positions.join(books, "global_book_id").select(
            "book_id",
            next_part(F.col("current_part_index"), F.col("parts_count")).alias("part_index"),
            F.lit(voice).alias("voice"),
        )
        .where(F.col("part_index").isNotNull())
        .distinct()
    )
    stored = stored_audio.where(F.col("voice_slug") == slug(F.lit(voice))).select(*PART)
    return following.join(stored, PART, "left_anti").select(*AUDIO)


def parts_gap_report(catalog: DataFrame, stored_text: DataFrame) -> DataFrame:
    """Declared against stored parts per book."""
    declared = catalog.select("book_id", F.coalesce("parts_count", F.lit(0)).alias("declared"))
    stored = stored_text.select(*PART).distinct()
    inside = stored.join(declared, "book_id").where(F.col("part_index") < F.col("declared"))
    found = inside.groupBy("book_id").agg(F.count("*").cast("int").alias("stored"))
    return declared.join(found, "book_id", "left").select(
        "book_id",
        "declared",
        F.coalesce("stored", F.lit(0)).alias("stored"),
        (F.col("declared") - F.coalesce("stored", F.lit(0))).alias("missing"),
    )


def missing_parts(catalog: DataFrame, stored_text: DataFrame) -> DataFrame:
    """One row per declared part that is not stored."""
    declared = catalog.select(
        "book_id", F.explode(part_indexes(F.col("parts_count"))).alias("part_index")
    )
    return declared.join(stored_text.select(*PART), PART, "left_anti")
