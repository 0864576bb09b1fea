"""Fold and throttle against event-at-a-time loops, with hot keys and cut chunks."""

import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from playback_by_hand import fold, throttle
from pyspark.sql import functions as F

from folioflow.functions import scalars as S
from folioflow.operators import playback
from folioflow.operators.playback import playback_fold, saved_events, tick_throttle, unusable_ticks

SCHEMA = "user_id int, global_book_id int, ts timestamp_ntz, event_id long, kind string, value double, parts int"
START = datetime(2024, 1, 1)
PARTS = {1: 1, 2: 4, 3: 7, 4: 0, 5: None}


def make_events(n, seed, hot_share=0.4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if rnd.random() < hot_share else rnd.randint(2, 9)
        book = 3 if user == 1 else rnd.choice(list(PARTS))
        kind = rnd.choice(["tick"] * 3 + ["ended", "seek", "restart", "duration"])
        value = {
            "tick": rnd.choice([0.0, 12.5, 200.0, 500.0, None]),
            "seek": float(rnd.randint(-1, 8)),
            "duration": rnd.choice([0.0, 90.5, float("nan"), None, 33.2]),
        }.get(kind)
        # Many events share a time, so that event_id decides.
        ts = START + timedelta(seconds=rnd.randint(0, n // 3))
        rows.append((user, book, ts, i, kind, value, PARTS[book]))
    return rows


def by_key(rows):
    groups = defaultdict(list)
    for user, book, ts, i, kind, value, _ in rows:
        groups[user, book].append((ts, i, kind, value))
    return groups


def as_dict(df):
    names = ["current_part_index", "current_time", "total_time", "progress"]
    return {(r.user_id, r.global_book_id): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("bucket_ms,span", [(1000, 2), (7000, 512), (60_000, 3), (10**9, 512)])
def test_fold_equals_loop(spark, monkeypatch, bucket_ms, span):
    monkeypatch.setattr(playback, "SPAN", span)
    rows = make_events(3000, seed=span + bucket_ms)
    got = as_dict(playback_fold(spark.createDataFrame(rows, SCHEMA), bucket_ms=bucket_ms))
    assert got == {k: fold(e, PARTS[k[1]]) for k, e in by_key(rows).items()}


def test_fold_goes_on_from_a_snapshot(spark):
    rows = make_events(1200, seed=11)
    cut = START + timedelta(seconds=200)
    df = spark.createDataFrame(rows, SCHEMA)
    first = playback_fold(df.where(F.col("ts") < F.lit(cut)), bucket_ms=3000)
    rest = as_dict(playback_fold(df.where(F.col("ts") >= F.lit(cut)), start=first, bucket_ms=3000))
    want = {k: fold(e, PARTS[k[1]]) for k, e in by_key(rows).items()}
    assert rest and all(want[k] == state for k, state in rest.items())


def test_a_hot_key_is_cut_into_buckets(spark):
    """Events are shuffled once, by key and bucket; no task gets a key whole."""
    df = spark.createDataFrame(make_events(3000, seed=2), SCHEMA)
    folded = playback_fold(df, bucket_ms=10_000)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3 and "rangepartitioning" not in plan
    clock = F.unix_millis(F.col("ts").cast("timestamp"))
    sizes = df.groupBy("user_id", F.floor(clock / 10_000)).count().agg(F.max("count")).first()[0]
    assert sizes < 3000 / 20


def test_events_without_a_time_come_first(spark):
    rows = [(1, 3, None, 5, "ended", None, 7), (1, 3, START, 1, "tick", 24.0, 7)]
    got = as_dict(playback_fold(spark.createDataFrame(rows, SCHEMA)))
    assert got == {(1, 3): (1, 24.0, 0.0, 16)}


def make_ticks(seed):
    """A user who ticks all the time, some who pause, and one with equal clocks."""
    rnd = random.Random(seed)
    rows = []

    def add(user, ms):
        rows.append((user, START + timedelta(milliseconds=ms), len(rows)))

    ms = 0
    for _ in range(3000):
        ms += rnd.randint(1, 400)
        add(1, ms)
    for user in range(2, 6):
        ms = rnd.randint(0, 10_000)
        for _ in range(200):
            ms += rnd.choice([100, 250, 3000, 3001, 50_000])
            add(user, ms)
    for _ in range(300):
        add(6, rnd.randint(0, 20) * 1000)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("gap,bucket", [(3000, 60_000), (3000, 1000), (0, 10_000), (50_000, 7000)])
def test_throttle_equals_loop(spark, gap, bucket):
    rows = make_ticks(gap + bucket)
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    got = defaultdict(list)
    for r in tick_throttle(ticks, gap, bucket).orderBy("clock").collect():
        got[r.user_id].append(r.tick_id)
    groups = defaultdict(list)
    for user, ts, i in rows:
        groups[user].append((round((ts - START).total_seconds() * 1000), i))
    assert dict(got) == {u: throttle(t, gap) for u, t in groups.items()}


@pytest.mark.parametrize("seconds", [100, 111.3, 250.9])
def test_throttle_goes_on_from_earlier_saves(spark, seconds):
    rows = make_ticks(4)
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    cut = START + timedelta(seconds=seconds)
    early, late = ticks.where(F.col("ts") < F.lit(cut)), ticks.where(F.col("ts") >= F.lit(cut))
    first = tick_throttle(early, 3000, 20_000)
    last = first.groupBy("user_id").agg(F.max("clock").alias("last_save"))
    both = first.unionByName(tick_throttle(late, 3000, 20_000, start=last))
    whole = tick_throttle(ticks, 3000, 20_000)
    assert sorted(both.collect()) == sorted(whole.collect())


@pytest.mark.parametrize("span", [2, 3, 50])
@pytest.mark.parametrize("gap,bucket", [(3000, 1000), (50_000, 7000)])
def test_throttle_over_several_levels_of_spans(spark, monkeypatch, span, gap, bucket):
    monkeypatch.setattr(playback, "TICK_SPAN", span)
    monkeypatch.setattr(playback, "CLOCKS", bucket * span**4)
    rows = make_ticks(gap + span)
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    got = defaultdict(list)
    for r in tick_throttle(ticks, gap, bucket).orderBy("clock").collect():
        got[r.user_id].append(r.tick_id)
    groups = defaultdict(list)
    for user, ts, i in rows:
        groups[user].append((round((ts - START).total_seconds() * 1000), i))
    assert dict(got) == {u: throttle(t, gap) for u, t in groups.items()}


def test_moves_compose():
    """Moves of several buckets in turn equal those buckets' one after the other, from any earlier save."""
    rng = random.Random(21)
    for _ in range(400):
        gap, bucket = rng.choice([0, 1, 5, 12, 40]), 10
        clocks = sorted(rng.sample(range(100), rng.randrange(1, 60)))
        children = []
        for begin in range(0, 100, bucket):
            own = np.array([c for c in clocks if begin <= c < begin + bucket])
            if len(own):
                reach = begin + gap - 1
                n = int((own <= reach).sum()) + 1
                moves = own[:n], own[playback.bucket_moves(own, n, gap)]
                children.append((playback._steps(*moves), reach, begin))
        moves = playback.moves_in_turn([m for m, _, _ in children], children[0][1], gap)
        for save in [-(10**6), *range(-3 * gap - 1, children[0][2])]:
            last = save
            for c in clocks:
                last = c if c - last > gap else last
            assert playback.next_save(*moves, np.array([save]), gap)[0] == last
        assert len(moves[0]) <= min(gap, len(clocks)) + 1


def test_one_user_of_a_hundred_thousand_buckets(spark):
    """Thirteen spans, each with one group; no group of all of a user's buckets."""
    n, gap = 100_000, 3000
    clock = F.col("id") * 7_200_000 + F.when(F.col("id") % 3 == 0, 7_199_500).otherwise(F.col("id") % 2500)
    ticks = spark.range(n).select(
        F.lit(1).alias("user_id"), F.timestamp_millis(clock).alias("ts"), F.col("id").alias("tick_id")
    )
    df = tick_throttle(ticks, gap)
    times = [i * 7_200_000 + (7_199_500 if i % 3 == 0 else i % 2500) for i in range(n)]
    assert df.count() == len(throttle(list(zip(times, range(n))), gap)) < n
    sizes = playback._saves_before(
        spark.createDataFrame([], "user_id int, node long, reach long, moves array<struct<first:long,last:long>>"),
        None,
        gap,
        2 * playback.HOUR_MS,
    )
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "span" in plan and plan.count("collect_list") >= 3


def test_unusable_ticks_are_listed(spark):
    rows = [(1, START, 1), (None, START, 2), (1, None, 3), (None, None, 4)]
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    assert [r.tick_id for r in tick_throttle(ticks).collect()] == [1]
    got = sorted((r.tick_id, r.reason) for r in unusable_ticks(ticks).collect())
    assert got == [(2, "no_user"), (3, "no_time"), (4, "no_user")]


def test_dense_ticks_cost_in_proportion(spark):
    def seconds(n):
        rows = spark.range(n).select(
            F.lit(1).alias("user_id"), F.timestamp_millis(F.col("id") * 2).alias("ts"), F.col("id").alias("tick_id")
        )
        began = time.perf_counter()
        saved = tick_throttle(rows, 3000).count()
        assert saved == -(-2 * n // 3002)
        return time.perf_counter() - began

    seconds(3000)
    assert min(seconds(48_000) for _ in range(2)) < 4 * min(seconds(3000) for _ in range(2)) + 1


def test_saved_events_carry_their_columns(spark):
    rows = make_events(800, seed=8)
    events = spark.createDataFrame(rows, SCHEMA)
    kept = saved_events(events, 3000, bucket_ms=20_000)
    ticks = events.where("kind = 'tick'")
    saved = {r.tick_id for r in tick_throttle(ticks.withColumnRenamed("event_id", "tick_id"), 3000, 20_000).collect()}
    want = [r for r in rows if r[4] != "tick" or r[3] in saved]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
    plan = kept.select("event_id", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_throttle_shares_its_shuffle(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumnRenamed("event_id", "tick_id")
    df = tick_throttle(events, 3000)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_progress_expressions(spark):
    row = spark.range(1).select(
        S.progress_pct(F.lit(1), F.lit(4), F.lit(120.0), F.lit(9)).alias("mid"),
        S.progress_pct(F.lit(3), F.lit(4), F.lit(999.0), F.lit(9)).alias("full"),
        S.progress_pct(F.lit(1), F.lit(0), F.lit(1.0), F.lit(9)).alias("no_parts"),
        S.progress_pct(F.lit(1), F.lit(None).cast("int"), F.lit(1.0), F.lit(9)).alias("null_parts"),
        S.in_part_ratio(F.lit(5.0), F.lit(0.0)).alias("no_total"),
        S.seek_forward(F.lit(50.0), F.lit(60.0)).alias("forward"),
        S.seek_forward(F.lit(50.0), F.lit(None).cast("double")).alias("unknown"),
        S.seek_backward(F.lit(4.0)).alias("backward"),
        S.next_part(F.lit(2), F.lit(3)).alias("last"),
        S.next_part(F.lit(None).cast("int"), F.lit(3)).alias("first"),
        S.part_indexes(F.lit(0)).alias("none"),
        S.part_indexes(F.lit(2)).alias("two"),
    ).first()
    assert row.asDict() == {
        "mid": 38,
        "full": 100,
        "no_parts": 9,
        "null_parts": 9,
        "no_total": 0.0,
        "forward": 60.0,
        "unknown": 0.0,
        "backward": 0.0,
        "last": None,
        "first": 1,
        "none": [],
        "two": [0, 1],
    }


def test_format_time(spark):
    seconds = [0.0, 59.9, 60.0, 3599.0, 3600.0, 36_061.5]
    df = spark.createDataFrame([(s,) for s in seconds], "s double")
    labels = [r[0] for r in df.select(S.format_time(F.col("s"))).collect()]
    assert labels == ["0:00", "0:59", "1:00", "59:59", "1:00:00", "10:01:01"]
