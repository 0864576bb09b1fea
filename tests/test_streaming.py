"""Streams give what the batch operators give on the same rows."""

import random
from pathlib import Path

from pyspark.sql import functions as F
from test_playback import PARTS, SCHEMA, START, as_dict, by_key, make_events, make_ticks
from playback_by_hand import fold

from folioflow.operators.playback import playback_fold, saved_events, tick_throttle
from folioflow.streaming.intake import upload_sink
from folioflow.streaming.playback import (
    EffectTree,
    clock_table,
    late_progress_sink,
    playback_sink,
    progress_sink,
    read_snapshot,
    snapshot_table,
    throttle_sink,
    throttle_stream,
)
from folioflow.streaming.tables import HashSet, StateTable


def write_slices(spark, df, folder, column, cuts):
    """One file per slice of `column`, in order, and the stream that reads them."""
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.where(F.col(column) >= F.lit(low))
        part = part if high is None else part.where(F.col(column) < F.lit(high))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def times(rows, position, n):
    ordered = sorted({r[position] for r in rows})
    return [ordered[len(ordered) * i // n] for i in range(1, n)]


def run(writer, tmp_path):
    query = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(
        availableNow=True
    ).start()
    try:
        assert query.awaitTermination(180)
    finally:
        query.stop()


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = make_ticks(9)
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    stream = write_slices(spark, ticks, str(tmp_path / "in"), "ts", times(rows, 1, 3))
    out = str(tmp_path / "out")
    run(throttle_stream(stream, 3000).writeStream.format("parquet").option("path", out), tmp_path)
    got = spark.read.parquet(out)
    assert got.where("reason is not null").count() == 0
    want = tick_throttle(ticks, 3000, 30_000)
    assert sorted(got.drop("reason").collect()) == sorted(want.collect())


def test_throttle_stream_marks_late_ticks(spark, tmp_path):
    rows = make_ticks(9)
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    cut = times(rows, 1, 2)[0]
    stream = write_slices(spark, ticks.where(F.col("ts") >= F.lit(cut)), str(tmp_path / "in"), "ts", [])
    ticks.where(F.col("ts") < F.lit(cut)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run(throttle_stream(stream, 3000).writeStream.format("parquet").option("path", out), tmp_path)
    got = spark.read.parquet(out)
    seen = [r.user_id for r in ticks.where(F.col("ts") >= F.lit(cut)).select("user_id").distinct().collect()]
    early = ticks.where((F.col("ts") < F.lit(cut)) & F.col("user_id").isin(seen))
    assert got.where("reason = 'late'").count() == early.count()


def test_throttle_stream_reports_unusable_ticks(spark, tmp_path):
    rows = [(1, START, 1), (None, START, 2), (1, None, 3)]
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    stream = write_slices(spark, ticks, str(tmp_path / "in"), "ts", [])
    out = str(tmp_path / "out")
    run(throttle_stream(stream, 3000).writeStream.format("parquet").option("path", out), tmp_path)
    got = sorted((r.tick_id, r.reason) for r in spark.read.parquet(out).collect())
    assert got == [(1, None), (2, "no_user"), (3, "no_time")]


def test_throttle_sink_equals_batch(spark, tmp_path):
    rows = make_ticks(9)
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    root = str(tmp_path / "state")
    stream = write_slices(spark, ticks, str(tmp_path / "in"), "ts", times(rows, 1, 3))
    sink = throttle_sink(root, 3000, bucket_ms=30_000)
    run(stream.writeStream.foreachBatch(sink), tmp_path)
    got = spark.read.parquet(f"{root}/saved").drop("batch")
    assert sorted(got.collect()) == sorted(tick_throttle(ticks, 3000, 30_000).collect())
    assert spark.read.parquet(f"{root}/late").count() == 0
    clocks = {r.user_id: r.last_save for r in clock_table(root).read(spark, 2).collect()}
    want = got.groupBy("user_id").agg(F.max("clock").alias("c")).collect()
    assert clocks == {r.user_id: r.c for r in want}


def test_throttle_sink_sets_late_ticks_aside(spark, tmp_path):
    rows = make_ticks(9)
    ticks = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, tick_id long")
    cut = times(rows, 1, 2)[0]
    root = str(tmp_path)
    sink = throttle_sink(root, 3000)
    sink(ticks.where(F.col("ts") >= F.lit(cut)), 0)
    early = ticks.where(F.col("ts") < F.lit(cut))
    sink(early, 1)
    known = clock_table(root).read(spark, 0).select("user_id")
    assert spark.read.parquet(f"{root}/late/batch=1").count() == early.join(known, "user_id", "left_semi").count()


def test_progress_sink_equals_batch(spark, tmp_path):
    rows = make_events(1500, seed=21)
    events = spark.createDataFrame(rows, SCHEMA)
    root = str(tmp_path / "state")
    stream = write_slices(spark, events, str(tmp_path / "in"), "ts", times(rows, 2, 3))
    run(stream.writeStream.foreachBatch(progress_sink(root)), tmp_path)
    got = as_dict(read_snapshot(spark, root, 2))
    assert got == as_dict(playback_fold(events))
    assert got == {k: fold(e, PARTS[k[1]]) for k, e in by_key(rows).items()}
    assert spark.read.parquet(f"{root}/late_events").count() == 0


def state(spark, root, batch):
    return sorted(read_snapshot(spark, root, batch).collect())


def test_progress_sink_repeats_and_late_events(spark, tmp_path):
    rows = make_events(600, seed=5)
    events = spark.createDataFrame(rows, SCHEMA)
    cut = times(rows, 2, 2)[0]
    old, new = events.where(F.col("ts") < F.lit(cut)), events.where(F.col("ts") >= F.lit(cut))
    root = str(tmp_path)
    sink = progress_sink(root)
    sink(old, 0)
    sink(new, 1)
    once = state(spark, root, 1)
    sink(new, 1)
    assert state(spark, root, 1) == once
    sink(old, 2)
    known = new.select("user_id", "global_book_id").distinct()
    late = old.join(known, ["user_id", "global_book_id"], "left_semi").count()
    assert spark.read.parquet(f"{root}/late_events/batch=2").count() >= late
    assert state(spark, root, 2) == once


def test_a_small_batch_writes_little(spark, tmp_path):
    i = F.col("id")
    many = spark.range(20_000).select(
        (i % 5000).cast("int").alias("user_id"),
        F.lit(3).alias("global_book_id"),
        F.timestamp_seconds(i).cast("timestamp_ntz").alias("ts"),
        i.alias("event_id"),
        F.lit("tick").alias("kind"),
        F.lit(5.0).alias("value"),
        F.lit(7).alias("parts"),
    )
    root = str(tmp_path)
    sink = progress_sink(root)
    sink(many, 0)
    sink(many.withColumn("ts", F.col("ts") + F.expr("interval 9 days")).limit(3), 1)

    def written(batch):
        folder = Path(root) / "snapshot" / "changes" / f"batch={batch}"
        return sum(f.stat().st_size for f in folder.rglob("*.parquet")), spark.read.parquet(str(folder)).count()

    assert written(0)[1] == 5000 and written(1)[1] <= 3 and written(1)[0] < written(0)[0] / 5
    assert read_snapshot(spark, root, 1).count() == 5000


def test_state_table_compacts_and_clears(spark, tmp_path):
    table = StateTable(str(tmp_path / "t"), ["k"], compact_every=3, cells=1)
    assert table.read(spark, 5) is None
    for batch in range(10):
        rows = [(k, batch) for k in range(batch % 4 + 1)] + [(100 + batch, batch)]
        df = spark.createDataFrame(rows, "k int, v int")
        table.write(df, batch)
        table.write(df, batch)
    got = {r.k: r.v for r in table.read(spark, 9).collect()}
    want = {}
    for batch in range(10):
        want |= {k: batch for k in range(batch % 4 + 1)} | {100 + batch: batch}
    assert got == want
    assert sorted(p.name for p in (tmp_path / "t/base").iterdir()) == ["batch=5", "batch=8"]
    assert sorted(p.name for p in (tmp_path / "t/changes").iterdir()) == [f"batch={i}" for i in (6, 7, 8, 9)]


def test_playback_sink_equals_batch(spark, tmp_path):
    rows = make_events(1500, seed=31)
    events = spark.createDataFrame(rows, SCHEMA)
    root = str(tmp_path / "state")
    stream = write_slices(spark, events, str(tmp_path / "in"), "ts", times(rows, 2, 4))
    sink = playback_sink(root, 3000, compact_every=2, bucket_ms=30_000)
    run(stream.writeStream.foreachBatch(sink), tmp_path)
    want = playback_fold(saved_events(events, 3000, bucket_ms=30_000))
    assert as_dict(snapshot_table(root).read(spark, 3)) == as_dict(want)


def test_upload_sink_lets_each_file_in_once(spark, tmp_path):
    rows = [(i, f"h{i % 7}") for i in range(40)]
    uploads = spark.createDataFrame(rows, "upload_id int, file_hash string")
    root, catalog = str(tmp_path / "out"), str(tmp_path / "catalog")
    spark.createDataFrame([("h2",), ("h5",)], "file_hash string").write.parquet(catalog)
    sink = upload_sink(root, lambda s: s.read.parquet(catalog), compact_every=2)
    sink(uploads.where("upload_id < 3"), 0)
    spark.createDataFrame([("h6",)], "file_hash string").write.mode("append").parquet(catalog)
    for _ in range(2):
        sink(uploads.where("upload_id >= 3 and upload_id < 30"), 1)
    sink(uploads.where("upload_id >= 30 or upload_id < 2"), 2)
    new = {r.upload_id: r.file_hash for r in spark.read.parquet(f"{root}/new").collect()}
    assert new == {0: "h0", 1: "h1", 3: "h3", 4: "h4"}
    assert spark.read.parquet(f"{root}/copies").count() == 40 + 2 - 4


def size_of(df):
    return sum(Path(f.removeprefix("file://")).stat().st_size for f in df.inputFiles())


def test_a_small_batch_reads_little(spark, tmp_path):
    """Only the cells of the batch's keys are read, before and after the base is made anew."""
    i = F.col("id")
    rows = spark.range(60_000).select(i.alias("user_id"), (i % 7).alias("global_book_id"), (i * 31).alias("v"))
    table = StateTable(str(tmp_path), ["user_id", "global_book_id"], compact_every=2, cells=32)
    few = rows.where("user_id in (5, 17)")
    for batch, changed in enumerate((rows, few.withColumn("v", F.lit(-1)), few.withColumn("v", F.lit(-2)))):
        table.write(changed, batch)
        part, whole = table.read(spark, batch, of=few), table.read(spark, batch)
        assert size_of(part) < size_of(whole) / 8
        got = {r.user_id: r.v for r in part.join(few.select("user_id"), "user_id", "left_semi").collect()}
        assert got == ({5: 155, 17: 527} if batch == 0 else {5: -batch, 17: -batch})
        assert whole.count() == 60_000


def test_only_changed_cells_get_a_new_base(spark, tmp_path):
    table = StateTable(str(tmp_path), ["k"], compact_every=1, cells=16)
    table.write(spark.range(500).select(F.col("id").alias("k"), F.lit(0).alias("v")), 0)
    for batch in (1, 2, 3):
        table.write(spark.createDataFrame([(7, batch)], "k long, v int"), batch)
    assert len(list((tmp_path / "base/batch=3").glob("cell=*"))) == 1
    got = {r.k: r.v for r in table.read(spark, 3).collect()}
    assert got == {k: 3 if k == 7 else 0 for k in range(500)}
    # A repeated batch reads what it read the first time.
    assert {r.v for r in table.read(spark, 2).where("k = 7").collect()} == {2}


def test_hash_set_leaves_most_cells_unread(spark, tmp_path):
    name = F.sha2(F.col("id").cast("string"), 256).alias("file_hash")
    table = HashSet(str(tmp_path), "file_hash", compact_every=1, cells=32)
    table.write(spark.range(20_000).select(name), 0)
    new, old = spark.range(20_000, 20_040).select(name), spark.range(3).select(name)
    cells = table.cells_of(new)
    assert len(cells) > 15 and len(table.may_hold(spark, new, 0)) <= 4
    assert table.may_hold(spark, old, 0) == table.cells_of(old)
    both = new.unionByName(old)
    held = table.held(spark, both, 0)
    assert size_of(held) < size_of(table.read(spark, 0)) / 4
    assert sorted(both.join(held, "file_hash", "left_semi").collect()) == sorted(old.collect())
    table.write(new.limit(5), 1)
    assert both.join(table.held(spark, both, 1), "file_hash", "left_semi").count() == 8
    assert both.join(table.held(spark, both, 0), "file_hash", "left_semi").count() == 3


def test_late_progress_sink_equals_batch_in_any_order(spark, tmp_path):
    rows = make_events(900, seed=41)
    random.Random(3).shuffle(rows)
    events = spark.createDataFrame(rows, SCHEMA)
    root, minute = str(tmp_path), 60_000
    sink = late_progress_sink(root, compact_every=2, cells=4, bucket_ms=minute)
    cuts = [0, 300, 301, 650, 900]
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(rows[low:high], SCHEMA)
        sink(part, batch)
        if batch in (1, 3):
            sink(part, batch)
        got = as_dict(read_snapshot(spark, root, batch))
        assert got == {k: fold(e, PARTS[k[1]]) for k, e in by_key(rows[:high]).items()}
    assert got == as_dict(playback_fold(events))
    sink(events.limit(0), 4)
    assert as_dict(read_snapshot(spark, root, 4)) == got


def test_a_late_event_reads_its_span_only(spark, tmp_path):
    i = F.col("id")
    many = spark.range(30_000).select(
        (i % 10).cast("int").alias("user_id"),
        F.lit(3).alias("global_book_id"),
        F.timestamp_seconds(i * 3600).cast("timestamp_ntz").alias("ts"),
        i.alias("event_id"),
        F.lit("tick").alias("kind"),
        F.lit(5.0).alias("value"),
        F.lit(7).alias("parts"),
    )
    tree = EffectTree(str(tmp_path), cells=4)
    tree.add(many, 0, 3_600_000)
    late = many.where("event_id = 12345").withColumns({"event_id": F.lit(99_999), "kind": F.lit("restart")})
    tree.add(late, 1, 3_600_000)
    asked = spark.read.parquet(f"{tmp_path}/events/changes/batch=1")
    assert size_of(tree.events.read(spark, 1, of=asked)) < size_of(tree.events.read(spark, 1)) / 20
    assert tree.buckets.read(spark, 1, of=asked).count() < 30_000 / 20
    got = as_dict(read_snapshot(spark, str(tmp_path), 1))
    assert got == as_dict(playback_fold(many.unionByName(late.select(*many.columns))))
