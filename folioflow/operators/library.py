"""Changes to the personal library: pure functions from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["user_id", "global_book_id"]
FIELDS = ["current_part_index", "current_time", "total_time", "progress"]


def library_add(user_books: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert absent rows with zero progress; present keys stay as they are."""
    first = requests.groupBy(*KEY).agg(F.min("ts").alias("added_at"))
    new = first.join(user_books.select(*KEY), KEY, "left_anti").select(
        *KEY,
        F.lit(0).alias("current_part_index"),
        F.lit(0.0).alias("current_time"),
        F.lit(0.0).alias("total_time"),
        F.lit(0).alias("progress"),
        "added_at",
    )
    return user_books.unionByName(new)


def library_remove(user_books: DataFrame, requests: DataFrame) -> DataFrame:
    return user_books.join(requests.select(*KEY).distinct(), KEY, "left_anti")


def library_patch(user_books: DataFrame, patches: DataFrame) -> DataFrame:
    """Set the supplied fields; unknown keys are ignored.

    Patches never set null, so the last non-null value per field is what remains
    after applying them one by one in (ts, event_id) order.
    """
    order = F.struct("ts", "event_id")
    merged = patches.groupBy(*KEY).agg(
        *[
            F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f"_{f}")
            for f in FIELDS
            if f in patches.columns
        ]
    )
    joined = user_books.join(merged, KEY, "left")
    return joined.select(
        *[
            F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in merged.columns else F.col(c)
            for c in user_books.columns
        ]
    )
