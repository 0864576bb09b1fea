"""Joins with a hot key are split by adaptive execution, and results stay the same."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators.catalog import resolve_play, user_library
from folioflow.operators.joins import unroll
from folioflow.session import SETTINGS

SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "6",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tables(spark):
    """A third of all readers have book 1, and there are far over a thousand other hot books."""
    i = F.col("id")
    book = F.when(i % 3 == 0, 1).otherwise(i % 1500)
    mine = spark.range(0, 30_000, numPartitions=12).select(
        i.alias("user_id"),
        book.alias("global_book_id"),
        F.lit(1).alias("current_part_index"),
        F.rand(1).alias("current_time"),
        F.lit(1.0).alias("total_time"),
        F.lit(50).alias("progress"),
        F.expr("timestamp_ntz'2024-01-01'").alias("added_at"),
    )
    books = spark.range(0, 1400, numPartitions=4).select(
        i.alias("id"),
        *[F.concat(F.lit(c), i.cast("string")).alias(c) for c in ("title", "author", "cover_url", "book_id")],
        F.lit(3).alias("parts_count"),
        *[F.lit("x").alias(c) for c in ("voice", "category", "file_hash", "added_by")],
        F.expr("timestamp_ntz'2024-01-01'").alias("created_at"),
    )
    return mine, books


def plan_after_run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_settings_split_skew():
    assert SETTINGS["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert SETTINGS["spark.sql.adaptive.forceOptimizeSkewedJoin"] == "true"


@pytest.mark.parametrize("job", ["library", "play"])
def test_a_hot_book_is_split(spark, small_partitions, job):
    mine, books = tables(spark)
    if job == "library":
        df = user_library(mine, books)
    else:
        df = resolve_play(mine.select("user_id", "global_book_id"), mine, books)
    assert "skew=true" in plan_after_run(df)
    hits = mine.where("global_book_id < 1400").count()
    assert df.count() == hits and df.where("id = 1").count() == mine.where("global_book_id = 1").count()


def test_unroll_keeps_no_empty_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, xs array<string>")
    assert sorted(map(tuple, unroll(df, ["k"], "xs", "at", "x").collect())) == [(1, 0, "a"), (1, 1, "b")]
