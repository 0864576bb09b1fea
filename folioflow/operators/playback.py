"""Playback events to progress snapshots, and the save throttle.

Both are folds over ordered events, and one reader or book may own a large share
of the events. So no step gathers all events of a key: events are cut into buckets of
time, each bucket is reduced to a small summary of what it does to any state before
it, and only the summaries of a key come together, first by spans of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions import scalars as S

KEY = ["user_id", "global_book_id"]
HOUR_MS = 3_600_000
#: Buckets whose effects are put together before a key's effects meet.
SPAN = 512
#: Buckets or spans of one user whose throttles are put together at a time.
TICK_SPAN = 8192
#: Milliseconds from the first to the last day that a timestamp is defined for, and the first one.
CLOCKS = 10_000 * 366 * 24 * HOUR_MS
FIRST_CLOCK = -62_135_596_800_000
STATE = {
    "current_part_index": "int",
    "current_time": "double",
    "total_time": "double",
    "progress": "int",
}
# Effect of a bucket of events on any state before it:
#   the last tick, if any, happened at part `tick_base` (null: the part before the
#   bucket) plus `tick_ended` finished parts, at position `tick_pos`;
#   `zeroed`: a restart came after it;
#   then the reader jumped to part `base` (null: did not) and `ended` parts finished;
#   `duration` is the last known duration.
EFFECT = {
    "tick_base": "int",
    "tick_ended": "int",
    "tick_pos": "double",
    "zeroed": "boolean",
    "base": "int",
    "ended": "int",
    "duration": "double",
}


def _struct(types: dict[str, str], values: dict[str, Column]) -> Column:
    fields = [x for name, t in types.items() for x in (F.lit(name), values[name].cast(t))]
    return F.named_struct(*fields)


def _changed(types: dict[str, str], old: Column, **new: Column) -> Column:
    return _struct(types, {name: new.get(name, old[name]) for name in types})


def bucket_effect(events: Column, parts: Column) -> Column:
    """Effect of an ordered array of (kind, value) events on a book of `parts` parts."""
    null = F.lit(None)
    start = _struct(
        EFFECT,
        {n: null for n in EFFECT}
        | {"tick_ended": F.lit(0), "ended": F.lit(0), "zeroed": F.lit(False)},
    )

    def step(s: Column, e: Column) -> Column:
        kind, value = e["kind"], e["value"]
        jumped = s["base"].isNotNull()
        tick = _changed(
            EFFECT,
            s,
            tick_base=F.coalesce(s["base"], s["tick_base"]),
            tick_ended=F.when(jumped, s["ended"]).otherwise(s["tick_ended"] + s["ended"]),
            tick_pos=value,
            zeroed=F.lit(False),
            base=null,
            ended=F.lit(0),
        )
        restart = _changed(
            EFFECT,
            s,
            tick_base=null,
            tick_ended=F.lit(0),
            tick_pos=null,
            zeroed=F.lit(True),
            base=F.lit(0),
            ended=F.lit(0),
        )
        inside = (value >= 0) & (value < F.coalesce(parts, F.lit(0)))
        known = (value != 0) & ~F.isnan(value)
        return (
            F.when((kind == "tick") & value.isNotNull(), tick)
            .when(kind == "ended", _changed(EFFECT, s, ended=s["ended"] + 1))
            .when((kind == "duration") & known, _changed(EFFECT, s, duration=F.round(value)))
            .when((kind == "seek") & inside, _changed(EFFECT, s, base=value, ended=F.lit(0)))
            .when(kind == "restart", restart)
            .otherwise(s)
        )

    return F.aggregate(events, start, step)


def apply_effect(state: Column, effect: Column, parts: Column) -> Column:
    """State after a bucket."""
    last = F.coalesce(parts, F.lit(0)) - 1

    def advance(part: Column, ended: Column) -> Column:
        return F.greatest(part, F.least(part + ended, last))

    ticked = effect["tick_pos"].isNotNull()
    tick_part = advance(
        F.coalesce(effect["tick_base"], state["current_part_index"]), effect["tick_ended"]
    )
    progress = S.progress_pct(tick_part, parts, effect["tick_pos"], state["progress"])
    origin = F.coalesce(
        effect["base"], F.when(ticked, tick_part), state["current_part_index"]
    )
    part = advance(origin, effect["ended"])
    position = (
        F.when(effect["base"].isNotNull() | (part > origin), 0.0)
        .when(ticked, effect["tick_pos"])
        .otherwise(state["current_time"])
    )
    return _struct(
        STATE,
        {
            "current_part_index": part,
            "current_time": position,
            "total_time": F.coalesce(effect["duration"], state["total_time"]),
            "progress": F.when(effect["zeroed"], 0).when(ticked, progress).otherwise(state["progress"]),
        },
    )


def then(first: Column, second: Column) -> Column:
    """Effect of one bucket and the next, on any state before both."""
    ticked, jumped = second["tick_pos"].isNotNull(), second["base"].isNotNull()
    since = first["ended"] + F.when(first["base"].isNull(), first["tick_ended"]).otherwise(0)
    tick_ended = second["tick_ended"] + F.when(second["tick_base"].isNull(), since).otherwise(0)
    # With a tick or a restart in the second, only its own place in the book counts.
    fresh = ticked | second["zeroed"]
    keep = {n: F.when(fresh, second[n]).otherwise(first[n]) for n in ("tick_pos", "zeroed")}
    return _struct(
        EFFECT,
        {
            "tick_base": F.when(ticked, F.coalesce(second["tick_base"], first["base"], first["tick_base"]))
            .when(second["zeroed"], F.lit(None))
            .otherwise(first["tick_base"]),
            "tick_ended": F.when(ticked, tick_ended)
            .when(second["zeroed"], F.lit(0))
            .otherwise(first["tick_ended"]),
            **keep,
            "base": F.when(fresh | jumped, second["base"]).otherwise(first["base"]),
            "ended": F.when(fresh | jumped, second["ended"]).otherwise(first["ended"] + second["ended"]),
            "duration": F.coalesce(second["duration"], first["duration"]),
        },
    )


def effects_together(effects: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One effect per group of keys, of its effects in order."""
    ordered = F.sort_array(F.collect_list(F.struct(order, "_effect")))
    grouped = effects.groupBy(*keys).agg(F.max("parts").alias("parts"), ordered.alias("_all"))
    rest = F.slice("_all", F.lit(2), F.size("_all"))
    whole = F.aggregate(rest, F.get("_all", F.lit(0))["_effect"], lambda s, e: then(s, e["_effect"]))
    return grouped.select(*keys, "parts", whole.alias("_effect"))


def time_bucket(bucket_ms: int = HOUR_MS) -> Column:
    """The time bucket of an event; events without a time come first."""
    clock = F.unix_millis(F.col("ts").cast("timestamp"))
    return F.coalesce(F.floor(clock / bucket_ms), F.lit(-(2**62)))


def bucket_effects(events: DataFrame) -> DataFrame:
    """Key, _bucket, parts and _effect of every bucket of events with a _bucket."""
    return (
        events.groupBy(*KEY, "_bucket")
        .agg(
            F.max("parts").alias("parts"),
            F.sort_array(F.collect_list(F.struct("ts", "event_id", "kind", "value"))).alias("_events"),
        )
        .select(*KEY, "_bucket", "parts", bucket_effect(F.col("_events"), F.col("parts")).alias("_effect"))
    )


def fresh_state() -> Column:
    """The state of a book that nothing has happened to."""
    return _struct(STATE, {name: F.lit(0) for name in STATE})


def playback_fold(
    events: DataFrame, start: DataFrame | None = None, bucket_ms: int = HOUR_MS
) -> DataFrame:
    """Progress snapshot per (user, book) from all of its player events.

    `events` has user_id, global_book_id, ts, event_id, kind, value and parts. They are
    shuffled once, by key and time bucket, and a bucket becomes one effect; effects are
    put together by spans of SPAN buckets and then by key. So a task holds what one
    key's player sends in a bucket, and a key's last group one effect per span. Events
    without a time come first. `start` is an earlier snapshot to go on from.
    """
    effects = bucket_effects(events.withColumn("_bucket", time_bucket(bucket_ms)))
    spans = effects_together(effects.withColumn("_span", F.floor(F.col("_bucket") / SPAN)), [*KEY, "_span"], "_bucket")
    per_key = effects_together(spans, KEY, "_span")
    if start is None:
        before = fresh_state()
    else:
        kept = start.select(*KEY, _struct(STATE, {n: F.col(n) for n in STATE}).alias("_old"))
        per_key = per_key.join(kept, KEY, "left")
        old = F.col("_old")
        before = _struct(STATE, {name: F.coalesce(old[name], F.lit(0)) for name in STATE})
    after = apply_effect(before, F.col("_effect"), F.col("parts"))
    return per_key.select(*KEY, after.alias("_state")).select(*KEY, "_state.*")


def usable_tick() -> Column:
    return F.col("user_id").isNotNull() & F.col("ts").isNotNull()


def unusable_ticks(ticks: DataFrame) -> DataFrame:
    """user_id, tick_id and why, of the ticks that no clock can judge."""
    reason = F.when(F.col("user_id").isNull(), "no_user").otherwise("no_time")
    return ticks.where(~usable_tick()).select("user_id", "tick_id", reason.alias("reason"))


def saved_events(events: DataFrame, gap_ms: int = V.SAVE_GAP_MS, **throttle) -> DataFrame:
    """Events that change the stored progress: all but the ticks the throttle holds back.

    Ticks carry their other columns through the throttle. Ticks without a user or time
    are held back too; `unusable_ticks` lists them.
    """
    is_tick = F.col("kind") == "tick"
    others = [c for c in events.columns if c not in ("user_id", "event_id")]
    ticks = events.where(is_tick).withColumnRenamed("event_id", "tick_id")
    saved = tick_throttle(ticks, gap_ms, carry=others, **throttle)
    kept = saved.withColumnRenamed("tick_id", "event_id").select(*events.columns)
    return kept.unionByName(events.where(~F.coalesce(is_tick, F.lit(False))))


def bucket_moves(clocks: np.ndarray, first_places: int, gap_ms: int) -> np.ndarray:
    """For each of the first ticks: the last save if it is the first save, by its place.

    The save after a tick is the first tick over a gap later; following these links is
    done by doubling them, so the cost grows with the ticks.
    """
    link = np.searchsorted(clocks, clocks + gap_ms, side="right")
    places = np.arange(len(clocks))
    link = np.where(link < len(clocks), link, places)
    while True:
        far = link[link]
        if (far == link).all():
            return link[:first_places]
        link = far


def _steps(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same moves without those that the next one repeats."""
    keep = np.append(last[1:] != last[:-1], True)[: len(last)]
    return first[keep], last[keep]


def next_save(first: np.ndarray, last: np.ndarray, saves: np.ndarray, gap_ms: int) -> np.ndarray:
    """The last save after moves (first, last), for each last save before them."""
    at = np.searchsorted(first, saves + gap_ms, side="right")
    passes = at < len(first)
    return np.where(passes, last[np.minimum(at, len(first) - 1)], saves)


def moves_in_turn(children: list[tuple[np.ndarray, np.ndarray]], reach: int, gap_ms: int):
    """The moves of one bucket or span after the other, as moves of them all.

    A save before them plus the gap comes to `reach` at most: moves behind the first one beyond it
    are never taken. What is taken leads to the second's moves from the first's last saves; if no tick
    of the first passes, the second's own moves count.
    """
    first, last = children[0]
    for more, then_last in children[1:]:
        last = next_save(more, then_last, last, gap_ms)
        if first[-1] <= reach:
            first, last = np.concatenate((first, more)), np.concatenate((last, then_last))
            end = int(np.searchsorted(first, reach, side="right")) + 1
            first, last = first[:end], last[:end]
        first, last = _steps(first, last)
    return first, last


def bucket_saves(clocks: np.ndarray, last: int, gap_ms: int) -> list[int]:
    """Places of the saved ticks, after a save at `last`."""
    out, at = [], int(np.searchsorted(clocks, last + gap_ms, side="right"))
    while at < len(clocks):
        out.append(at)
        at = int(np.searchsorted(clocks, clocks[at] + gap_ms, side="right"))
    return out


def _lists(array: pa.Array) -> Iterator[np.ndarray]:
    values = array.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(array.value_lengths().to_numpy(zero_copy_only=False))
    return iter(np.split(values, ends[:-1])) if len(array) else iter(())


MOVES = "array<struct<first:bigint,last:bigint>>"


def _moves_array(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    none = np.empty(0, np.int64)
    columns = [pa.array(np.concatenate([none, *(pair[i] for pair in found)]).astype(np.int64)) for i in (0, 1)]
    ends = np.cumsum([0, *(len(first) for first, _ in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["first", "last"]))


def _children(array: pa.Array) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], int]]:
    """Each row's moves in order, and how far saves before them reach."""
    ends = np.cumsum([0, *array.value_lengths().to_pylist()])
    rows = array.flatten()
    reach, lists = rows.field("reach").to_pylist(), rows.field("moves")
    inner = np.cumsum([0, *lists.value_lengths().to_pylist()])
    pairs = lists.flatten()
    first, last = (pairs.field(n).to_numpy(zero_copy_only=False) for n in ("first", "last"))
    for begin, end in zip(ends[:-1], ends[1:]):
        cuts = [slice(inner[i], inner[i + 1]) for i in range(begin, end)]
        yield [(first[c], last[c]) for c in cuts], reach[begin]


def _saves_before(nodes: DataFrame, start: DataFrame | None, gap_ms: int, bucket_ms: int) -> DataFrame:
    """user_id, node and last_before of nodes(user_id, node, reach, moves): the last save before each bucket.

    The moves of at most TICK_SPAN buckets or spans are put together at a time, up to one group per user;
    from there the last saves go down the same way.
    """

    @F.arrow_udf(MOVES)
    def together(children: pa.Array) -> pa.Array:
        return _moves_array([moves_in_turn(own, reach, gap_ms) for own, reach in _children(children)])

    @F.arrow_udf("array<bigint>")
    def befores(children: pa.Array, save: pa.Array) -> pa.Array:
        found = []
        for (own, _), at in zip(_children(children), save.to_numpy(zero_copy_only=False)):
            saves, at = [], np.array([at])
            for first, last in own:
                saves.append(int(at[0]))
                at = next_save(first, last, at, gap_ms)
            found.append(saves)
        return pa.array(found, pa.list_(pa.int64()))

    index = F.floor((F.col("node") - FIRST_CLOCK) / bucket_ms)
    levels, above = [], nodes.withColumn("index", index)
    # The last level's groups are the users.
    spans = 1
    while TICK_SPAN**spans < CLOCKS / bucket_ms:
        spans += 1
    for level in range(1, spans + 1):
        keys = ["user_id", "span"] if level < spans else ["user_id"]
        groups = (
            above.withColumn("span", F.floor(F.col("index") / TICK_SPAN))
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("index", "node", "reach", "moves"))).alias("children"))
        )
        levels.append((keys, groups))
        if level < spans:
            head = F.get("children", F.lit(0))
            above = groups.select(
                "user_id",
                F.col("span").alias("index"),
                head["node"].alias("node"),
                head["reach"].alias("reach"),
                together("children").alias("moves"),
            )
    never = F.lit(-(2**62))
    saves = None if start is None else start.select("user_id", F.col("last_save").alias("save"))
    for keys, groups in reversed(levels):
        # A left join adds no null checks below `groups`, so both uses of it share their shuffle.
        known = groups.withColumn("save", never) if saves is None else groups.join(saves, keys, "left")
        found = befores("children", F.coalesce("save", never))
        saves = known.select("user_id", F.explode(F.arrays_zip(F.col("children"), found.alias("save")))).select(
            "user_id", F.col("col.children.index").alias("span"), F.col("col.children.node").alias("node"), "col.save"
        )
    return saves.select("user_id", "node", F.col("save").alias("last_before"))


def tick_throttle(
    ticks: DataFrame,
    gap_ms: int = V.SAVE_GAP_MS,
    bucket_ms: int = 2 * HOUR_MS,
    start: DataFrame | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Ticks that are saved: each comes more than `gap_ms` after the one saved before.

    The clock has millisecond steps and there is one per user. Ticks of one user in
    the same millisecond are told apart by tick_id, and only the first can be saved,
    so a bucket of `bucket_ms` holds at most that many ticks. Ticks without a user or
    time are not judged; `unusable_ticks` lists them.

    Which ticks a bucket saves depends on the last save before it, but only through
    the first tick it lets pass, which lies at most one gap behind the first tick.
    The bucket's summary therefore lists, for each tick that may come first, the
    last save that follows from it: a step function from the last save before the
    bucket to the last one in it. Such functions compose, so they are put together by
    spans of TICK_SPAN buckets and spans of spans until one is left per user, and the
    last save before each span and bucket is handed down again. A group never holds
    more than TICK_SPAN functions, however long a user's history is, and the buckets
    are worked off side by side. Only clocks and functions go to Python, where each takes time
    that grows with its ticks. `start` (user_id, last_save) continues from earlier
    saves, none later than the user's first tick here; `carry` names further columns of the
    saved ticks.
    """
    carry = carry or []
    clock = F.unix_millis(F.col("ts").cast("timestamp"))
    timed = ticks.where(usable_tick()).select("user_id", "tick_id", clock.alias("clock"), *carry)
    bucket = F.col("clock") - F.pmod("clock", F.lit(bucket_ms))
    first_of = F.min_by(F.struct("tick_id", *carry), "tick_id")
    buckets = (
        timed.groupBy("user_id", bucket.alias("bucket"), "clock")
        .agg(first_of.alias("_tick"))
        .groupBy("user_id", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("clock", "_tick"))).alias("_ticks"))
    )
    never = F.lit(-(2**62))
    clocks = F.col("_ticks.clock")
    first = F.get(F.col("_ticks"), F.lit(0))["clock"]
    # A save in an earlier bucket reaches at most one gap past the bucket's begin; one
    # in `start` may lie in the same bucket.
    reach = F.col("bucket") + gap_ms - 1 if start is None else first + gap_ms
    reachable = F.size(F.filter(clocks, lambda t: t <= reach)) + 1

    @F.arrow_udf(MOVES)
    def moves(clocks: pa.Array, places: pa.Array) -> pa.Array:
        found = [(c[:n], c[bucket_moves(c, n, gap_ms)]) for c, n in zip(_lists(clocks), places.to_pylist())]
        return _moves_array([_steps(*pair) for pair in found])

    @F.arrow_udf("array<int>")
    def saves(clocks: pa.Array, before: pa.Array) -> pa.Array:
        found = [bucket_saves(c, last, gap_ms) for c, last in zip(_lists(clocks), before.to_pylist())]
        return pa.array(found, pa.list_(pa.int32()))

    nodes = buckets.select(
        "user_id", F.col("bucket").alias("node"), reach.alias("reach"), moves(clocks, reachable).alias("moves")
    )
    entering = _saves_before(nodes, start, gap_ms, bucket_ms).withColumnRenamed("node", "bucket")
    # Every bucket has its entry. The left join, unlike an inner one, adds no null
    # checks below `buckets`, so both uses of it share one shuffle.
    picked = F.transform("_saved", lambda at: F.get("_ticks", at))
    return (
        buckets.join(entering, ["user_id", "bucket"], "left")
        .withColumn("_saved", saves(clocks, F.coalesce("last_before", never)))
        .select("user_id", F.inline_outer(picked))
        .where(F.col("clock").isNotNull())
        .select("user_id", "_tick.tick_id", "clock", *[F.col("_tick")[c].alias(c) for c in carry])
    )
