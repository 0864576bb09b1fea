"""Playback streams: the save throttle and the progress snapshot.

`throttle_stream` keeps its clocks in the state store. The rows of one user in one
trigger meet in one task there, as clocks and ids only, so bound the trigger's size at
the source (maxFilesPerTrigger, maxBytesPerTrigger or maxOffsetsPerTrigger). The sinks
run the batch operators on each trigger instead, which split users with many events,
and keep their state as tables of changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow import fixed_values as V
from folioflow.operators.playback import (
    HOUR_MS,
    KEY,
    SPAN,
    STATE,
    apply_effect,
    bucket_effects,
    effects_together,
    fresh_state,
    playback_fold,
    saved_events,
    tick_throttle,
    time_bucket,
    unusable_ticks,
    usable_tick,
)
from folioflow.streaming.tables import StateTable, overwrite

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_per_clock(clocks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clocks in order, each once with its smallest id."""
    order = np.lexsort((ids, clocks))
    clocks, ids = clocks[order], ids[order]
    first = np.concatenate(([True], clocks[1:] != clocks[:-1])) if len(clocks) else np.zeros(0, bool)
    return clocks[first], ids[first]


class SaveGate(StatefulProcessor):
    """Lets a user's tick pass if the last one that passed is over a gap ago.

    Ticks of a batch are taken in (clock, tick_id) order. A tick older than one of an
    earlier batch comes too late: it changes nothing and goes out with that reason. Of
    the others one tick per millisecond is held, as only the first of them can pass.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clocks = handle.getValueState("clocks", "last_save bigint, last_seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last_save, last_seen = self.clocks.get() or (None, None)
        clocks, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in rows:
            is_late = np.zeros(len(part), bool) if last_seen is None else (part["clock"] < last_seen).to_numpy()
            if is_late.any():
                yield self._out(key, part["tick_id"][is_late], part["clock"][is_late], "late")
            own, own_ids = part["clock"].to_numpy()[~is_late], part["tick_id"].to_numpy()[~is_late]
            clocks, ids = first_per_clock(np.concatenate((clocks, own)), np.concatenate((ids, own_ids)))
        if not len(clocks):
            return
        picked = []
        at = 0
        if last_save is not None:
            at = int(clocks.searchsorted(last_save + self.gap_ms, side="right"))
        while at < len(clocks):
            picked.append(at)
            last_save = int(clocks[at])
            at = int(clocks.searchsorted(last_save + self.gap_ms, side="right"))
        self.clocks.update((last_save, int(clocks[-1])))
        yield self._out(key, ids[picked], clocks[picked], None)

    @staticmethod
    def _out(key, ids, clocks, reason: str | None) -> pd.DataFrame:
        out = pd.DataFrame({"tick_id": np.asarray(ids), "clock": np.asarray(clocks)})
        out.insert(0, "user_id", key[0])
        out["reason"] = pd.Series([reason] * len(out), dtype=object)
        return out

    def close(self) -> None:
        pass


def throttle_stream(ticks: DataFrame, gap_ms: int = V.SAVE_GAP_MS) -> DataFrame:
    """Saved ticks, with `reason` null, of a stream (user_id, tick_id, ts).

    Late ticks and those without a user or time come out too, with their reason. Ids are
    whole numbers. Needs the RocksDB state store.
    """
    clock = F.unix_millis(F.col("ts").cast("timestamp"))
    clocked = ticks.where(usable_tick()).select("user_id", "tick_id", clock.alias("clock"))
    user_type = clocked.schema["user_id"].dataType.simpleString()
    id_type = clocked.schema["tick_id"].dataType.simpleString()
    judged = clocked.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=SaveGate(gap_ms),
        outputStructType=f"user_id {user_type}, tick_id {id_type}, clock bigint, reason string",
        outputMode="Append",
        timeMode="None",
    )
    rest = unusable_ticks(ticks).withColumn("clock", F.lit(None).cast("bigint"))
    return judged.unionByName(rest)


def snapshot_table(root: str, compact_every: int = 20, cells: int = 16) -> StateTable:
    return StateTable(f"{root}/snapshot", KEY, compact_every, cells)


def clock_table(root: str, compact_every: int = 20, cells: int = 16) -> StateTable:
    return StateTable(f"{root}/clocks", ["user_id"], compact_every, cells)


def read_snapshot(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """Progress rows after a batch of `progress_sink` or `playback_sink`."""
    return snapshot_table(root).read(spark, batch)


def _split_late(
    rows: DataFrame, before: DataFrame, keys: list[str], is_late: Column
) -> tuple[DataFrame, DataFrame]:
    """Rows on time and rows that are late against the `_seen` of their key."""
    joined = rows.join(before, keys, "left")
    late = F.coalesce(is_late, F.lit(False))
    return joined.where(~late).drop("_seen"), joined.where(late).drop("_seen")


def _clock() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _on_time_ticks(ticks: DataFrame, clocks: StateTable, batch: int, late_path: str):
    """Ticks of a batch that no earlier batch has passed by, and the clocks of their users."""
    spark = ticks.sparkSession
    usable = ticks.where(usable_tick())
    before = clocks.read(spark, batch - 1, of=usable)
    if before is None:
        overwrite(usable.limit(0), late_path)
        return usable, None
    seen = before.select("user_id", F.col("last_seen").alias("_seen"))
    on_time, late = _split_late(usable, seen, ["user_id"], _clock() < F.col("_seen"))
    overwrite(late, late_path)
    mine = before.join(on_time.select("user_id").distinct(), "user_id", "left_semi")
    return on_time, mine


def _new_clocks(ticks: DataFrame, saved: DataFrame, before: DataFrame | None) -> DataFrame:
    """The clocks of the users of a batch; saved: user_id, clock."""
    saves = saved.groupBy("user_id").agg(F.max("clock").alias("last_save"))
    clocks = ticks.groupBy("user_id").agg(F.max(_clock()).alias("last_seen")).join(saves, "user_id", "left")
    if before is None:
        return clocks
    old = before.select("user_id", F.col("last_save").alias("_save"))
    return clocks.join(old, "user_id", "left").select(
        "user_id", F.coalesce("last_save", "_save").alias("last_save"), "last_seen"
    )


def throttle_sink(root: str, gap_ms: int = V.SAVE_GAP_MS, compact_every: int = 20, **throttle):
    """foreachBatch function that writes the saved ticks of (user_id, tick_id, ts).

    A batch reads the users' clocks of the batch before and writes those of its own
    users, its saved ticks under `saved`, its late ticks under `late` and those without
    a user or time under `unusable`, so a repeated batch writes the same again. A tick
    older than one of an earlier batch is late.
    """
    clocks = clock_table(root, compact_every)

    def apply(ticks: DataFrame, batch: int) -> None:
        spark = ticks.sparkSession
        overwrite(unusable_ticks(ticks), f"{root}/unusable/batch={batch}")
        ticks, before = _on_time_ticks(ticks, clocks, batch, f"{root}/late/batch={batch}")
        path = f"{root}/saved/batch={batch}"
        overwrite(tick_throttle(ticks, gap_ms, start=before, **throttle), path)
        clocks.write(_new_clocks(ticks, spark.read.parquet(path), before), batch)

    return apply


def _apply_progress(events: DataFrame, batch: int, root: str, table: StateTable) -> None:
    spark = events.sparkSession
    order = F.struct("ts", "event_id")
    before = table.read(spark, batch - 1, of=events)
    if before is None:
        overwrite(events.limit(0), f"{root}/late_events/batch={batch}")
    else:
        seen = before.select(*KEY, F.col("last_event").alias("_seen"))
        events, late = _split_late(events, seen, KEY, order <= F.col("_seen"))
        overwrite(late, f"{root}/late_events/batch={batch}")
    last = events.groupBy(*KEY).agg(F.max(order).alias("last_event"))
    state = playback_fold(events, start=before).join(last, KEY, "inner")
    table.write(state.select(*KEY, *STATE, "last_event"), batch)


def progress_sink(root: str, compact_every: int = 20):
    """foreachBatch function that keeps a progress snapshot under `root`.

    A batch reads the state of its keys' cells after the batch before and writes the keys it changes, so a
    repeated batch gives the same state. Events older than the last one applied to their
    key change nothing; they are kept under `late_events`.
    """
    table = snapshot_table(root, compact_every)
    return lambda events, batch: _apply_progress(events, batch, root, table)


def playback_sink(root: str, gap_ms: int = V.SAVE_GAP_MS, compact_every: int = 20, **throttle):
    """foreachBatch function from player events to progress: only ticks that the throttle
    saves reach the snapshot.

    Late ticks are kept under `late`, late events of a book under `late_events`, ticks
    without a user or time under `unusable`.
    """
    clocks, table = clock_table(root, compact_every), snapshot_table(root, compact_every)

    def apply(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        is_tick = F.col("kind") == "tick"
        ticks = events.where(is_tick)
        unusable = unusable_ticks(ticks.withColumnRenamed("event_id", "tick_id"))
        overwrite(unusable, f"{root}/unusable/batch={batch}")
        ticks, before = _on_time_ticks(ticks, clocks, batch, f"{root}/late/batch={batch}")
        path = f"{root}/saved/batch={batch}"
        overwrite(saved_events(ticks, gap_ms, start=before, **throttle), path)
        saved = spark.read.parquet(path)
        clocks.write(_new_clocks(ticks, saved.select("user_id", _clock().alias("clock")), before), batch)
        rest = events.where(~F.coalesce(is_tick, F.lit(False)))
        _apply_progress(saved.select(*events.columns).unionByName(rest), batch, root, table)

    return apply


class EffectTree:
    """Stored events and their effects, put together by bucket, span and key.

    A key's progress is the effect of its spans, a span's that of its buckets, and a bucket's that of its
    events; so an event that comes late changes its bucket and the path above it, and nothing else is
    computed anew. All tables lie in cells by key, those of events and buckets by span too: a batch reads
    the cells of the spans it adds to.
    """

    def __init__(self, root: str, compact_every: int = 20, cells: int = 16):
        table = lambda name, key, span=None: StateTable(
            f"{root}/{name}", [*KEY, *key], compact_every, cells, by=KEY, span=span
        )
        self.events = table("events", ["event_id"], "_span")
        self.buckets = table("buckets", ["_bucket"], "_span")
        self.spans = table("spans", ["_span"])
        self.snapshot = snapshot_table(root, compact_every, cells)

    def add(self, events: DataFrame, batch: int, bucket_ms: int) -> None:
        spark = events.sparkSession
        if events.isEmpty():
            return
        events = events.withColumn("_bucket", time_bucket(bucket_ms))
        events = events.withColumn("_span", F.floor(F.col("_bucket") / SPAN))
        self.events.write(events, batch)
        # What the batch touches, from its own written rows.
        added = spark.read.parquet(f"{self.events.root}/changes/batch={batch}")
        touched = added.select(*KEY, "_span", "_bucket").distinct()
        spans, keys = touched.select(*KEY, "_span").distinct(), touched.select(*KEY).distinct()
        own = self.events.read(spark, batch, of=touched).join(touched, [*KEY, "_span", "_bucket"], "left_semi")
        effects = bucket_effects(own).withColumn("_span", F.floor(F.col("_bucket") / SPAN))
        self.buckets.write(effects, batch)
        own = self.buckets.read(spark, batch, of=spans).join(spans, [*KEY, "_span"], "left_semi")
        self.spans.write(effects_together(own, [*KEY, "_span"], "_bucket"), batch)
        own = self.spans.read(spark, batch, of=keys).join(keys, KEY, "left_semi")
        whole = effects_together(own, KEY, "_span")
        after = apply_effect(fresh_state(), F.col("_effect"), F.col("parts"))
        self.snapshot.write(whole.select(*KEY, after.alias("_state")).select(*KEY, "_state.*"), batch)


def late_progress_sink(root: str, compact_every: int = 20, cells: int = 16, bucket_ms: int = HOUR_MS):
    """foreachBatch function that keeps a progress snapshot under `root`, whatever order events arrive in.

    After every batch the snapshot is that of `playback_fold` over all events so far. Keys are not null
    and event ids name an event of a key: one that comes again replaces itself.
    """
    tree = EffectTree(root, compact_every, cells)
    return lambda events, batch: tree.add(events, batch, bucket_ms)
