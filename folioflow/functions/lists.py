"""Lists that grow inside a fold.

Every append to an array copies it. A fold that collects many items keeps the last
RECENT of them apart, so that the long array is copied only once per RECENT items.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENT = 128


def empty(item_type: str) -> Column:
    none = F.array().cast(f"array<{item_type}>")
    return F.struct(none.alias("done"), none.alias("recent"))


def append(items: Column, item: Column) -> Column:
    full = F.size(items["recent"]) >= RECENT
    moved = F.struct(
        F.concat(items["done"], items["recent"]).alias("done"), F.array(item).alias("recent")
    )
    added = F.struct(
        items["done"].alias("done"), F.concat(items["recent"], F.array(item)).alias("recent")
    )
    return F.when(full, moved).otherwise(added)


def is_empty(items: Column) -> Column:
    return F.size(items["recent"]) == 0


def whole(items: Column) -> Column:
    return F.concat(items["done"], items["recent"])
