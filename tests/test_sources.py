"""Stored parts, upload files and tables."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions.text import file_hash
from folioflow.operators.audio import missing_parts, parts_gap_report
from folioflow.operators.intake import parts_table
from folioflow.sources import parts_store, tables


@pytest.fixture(scope="module")
def layout(tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    books = {"b1": (3, [0, 2]), "b2": (2, [0, 1]), "b3": (1, [])}
    for book, (count, present) in books.items():
        (root / book).mkdir()
        meta = {"title": f"Title {book}", "voice": "v1", "parts_count": count}
        if book == "b1":
            meta["cover_url"] = "c.png"
        (root / book / "metadata.json").write_text(json.dumps(meta, indent=1), encoding="utf8")
        for i in present:
            (root / book / f"part_{i}.txt").write_text(f"línea uno\nparte {i}", encoding="utf8")
    return str(root)


def test_part_files_and_gaps(spark, layout):
    books, parts = parts_store.read_part_files(spark, layout)
    assert sorted((r.book_id, r.parts_count, r.cover_url) for r in books.collect()) == [
        ("b1", 3, "c.png"),
        ("b2", 2, None),
        ("b3", 1, None),
    ]
    assert sorted((r.book_id, r.part_index, r.text) for r in parts.collect()) == [
        ("b1", 0, "línea uno\nparte 0"),
        ("b1", 2, "línea uno\nparte 2"),
        ("b2", 0, "línea uno\nparte 0"),
        ("b2", 1, "línea uno\nparte 1"),
    ]
    gaps = sorted(tuple(r) for r in missing_parts(books, parts).collect())
    assert gaps == [("b1", 1), ("b3", 0)]
    report = sorted(tuple(r) for r in parts_gap_report(books, parts).collect())
    assert report == [("b1", 3, 2, 1), ("b2", 2, 2, 0), ("b3", 1, 0, 1)]


def test_part_files_of_some_books(spark, layout):
    books, parts = parts_store.read_part_files(spark, layout, books=["b2", "b3", "none", "b2"])
    assert sorted(r.book_id for r in books.collect()) == ["b2", "b3"]
    assert sorted((r.book_id, r.part_index) for r in parts.collect()) == [("b2", 0), ("b2", 1)]
    assert all("/b2/" in f for f in parts.inputFiles())
    # What is looked up and listed lies in the folders asked for.
    asked = parts_store._files(spark, layout, ["b2", "none"], "part_*.txt")
    assert asked == [f"{layout}/b2/part_*.txt"]


@pytest.mark.parametrize("books", [None, ["b1", "b2", "b3"]])
def test_part_files_of_some_numbers(spark, layout, books):
    _, parts = parts_store.read_part_files(spark, layout, books=books, parts=[2, 1, 7])
    assert sorted((r.book_id, r.part_index) for r in parts.collect()) == [("b1", 2), ("b2", 1)]
    assert len(parts.inputFiles()) == 2


def test_part_files_of_nothing(spark, layout):
    for choice in ({"books": []}, {"books": ["none"]}, {"books": ["b3"]}, {"parts": []}, {"books": ["b2"], "parts": [9]}):
        books, parts = parts_store.read_part_files(spark, layout, **choice)
        assert parts.collect() == [] and parts.columns == ["book_id", "part_index", "text"]
        assert books.columns == ["book_id", "title", "voice", "parts_count", "cover_url"]
    for odd in ("*", "b{1,2}", "../b1", "..", ""):
        with pytest.raises(ValueError, match="no names of books"):
            parts_store.read_part_files(spark, layout, books=[odd])


def test_part_files_of_books_with_odd_names(spark, tmp_path):
    names = ["a b", "a+b", "a%20b", "año"]
    for name in names:
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text('{"title": "t", "parts_count": 1}')
        (tmp_path / name / "part_0.txt").write_text("x")
    for choice in (None, names):
        books, parts = parts_store.read_part_files(spark, str(tmp_path), books=choice)
        assert sorted(r.book_id for r in books.collect()) == sorted(names)
        assert sorted(r.book_id for r in parts.collect()) == sorted(names)


def test_parts_store_keeps_its_batches(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    parts = parts_table(docs, "doc_id").drop("parts_count")
    path = str(tmp_path / "parts")
    halves = [parts.where(f"doc_id % 2 = {i}") for i in (0, 1)]
    parts_store.write_parts(halves[0], path, "a", key="doc_id", buckets=8)
    parts_store.write_parts(halves[1], path, "2024-01", key="doc_id")
    assert sorted(parts_store.read_parts(spark, path).collect()) == sorted(parts.collect())
    parts_store.write_parts(halves[1], path, "2024-01", key="doc_id")
    assert sorted(parts_store.read_parts(spark, path).collect()) == sorted(parts.collect())
    for number in (16, 17):
        book = parts_store.read_book(spark, path, number, key="doc_id")
        assert sorted(book.collect()) == sorted(parts.where(f"doc_id = {number}").collect())
    plan = book._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in plan
    for file in (tmp_path / "parts").rglob("part-*.parquet"):
        keys = [(r.doc_id, r.part_index) for r in spark.read.parquet(str(file)).collect()]
        assert keys == sorted(keys)
    with pytest.raises(ValueError):
        parts_store.write_parts(parts, path, "../x", key="doc_id")


def test_bucket_number_follows_the_input(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(parts_store, "BUCKET_BYTES", 10_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    parts_store.write_parts(parts_table(docs, "doc_id"), str(tmp_path), "a", key="doc_id")
    (folder,) = (tmp_path / "batch=a").glob("buckets=*")
    assert int(folder.name.removeprefix("buckets=")) > 5


def test_upload_files_with_an_empty_one(spark, tmp_path):
    (tmp_path / "more").mkdir()
    for name, content in {"a b.pdf": b"x", "B.PDF": b"yy", "empty.pdf": b"", "more/B.PDF": b"z"}.items():
        (tmp_path / name).write_bytes(content)
    paths = ["a b.pdf", "B.PDF", "empty.pdf", "gone.pdf", "more/B.PDF"]
    listing = spark.createDataFrame(
        [(i, p, p.rpartition("/")[2], "c") for i, p in enumerate(paths, 1)],
        "upload_id int, file_path string, file_name string, category string",
    )
    got = {r.upload_id: r for r in parts_store.read_uploads(spark, str(tmp_path), listing).collect()}
    assert {k: r.size_bytes for k, r in got.items()} == {1: 1, 2: 2, 3: 0, 4: 0, 5: 1}
    want = spark.range(1).select(file_hash(F.lit("yy"))).first()[0]
    assert got[2].file_hash == want and got[5].file_hash != want


def test_audio_files(spark, tmp_path):
    for name in ("b1/audio/part_0_es-MX.mp3", "b1/audio/part_12_a_b.mp3", "b2/audio/part_1_x.mp3", "b2/audio/x.mp3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"a")
    got = sorted(map(tuple, parts_store.read_audio_files(spark, str(tmp_path)).collect()))
    assert got == [("b1", 0, "es-MX"), ("b1", 12, "a_b"), ("b2", 1, "x")]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "user_books")
    rows = spark.range(20).select(
        (F.col("id") % 3).cast("string").alias("user_id"),
        F.col("id").cast("string").alias("global_book_id"),
        F.lit(1).alias("current_part_index"),
        F.lit(1.0).alias("current_time"),
        F.lit(1.0).alias("total_time"),
        F.lit(5).alias("progress"),
        F.expr("timestamp_ntz'2024-01-01'").alias("added_at"),
    )
    rows.write.parquet(path)
    mine = tables.read_user_books(spark, path, "1")
    assert mine.count() == 7
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,1)]" in plan

    catalog = spark.createDataFrame([("h1",), ("h2",)], "file_hash string")
    assert tables.hash_known(catalog, "h1") and not tables.hash_known(catalog, "h9")

    rows = [(str(i), "t", None, None, f"b{i}", 1, "v", "c", f"h{i}", "u") for i in range(3)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tables.CATALOG.fields[:-1])
    books = spark.createDataFrame(rows, schema).withColumn("created_at", F.expr("timestamp_ntz'2024-01-01'"))
    books.write.parquet(str(tmp_path / "catalog"))
    read = tables.read_catalog(spark, str(tmp_path / "catalog"))
    assert read.columns == tables.CATALOG.names and read.count() == 3
    plan = read.select("id", "file_hash")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,file_hash:string>" in plan
    assert tables.hash_known(read, "h1") and not tables.hash_known(read, "h9")


def test_a_book_is_in_one_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *books: spark.createDataFrame(
        [(b, i, f"{b}{i}") for b in books for i in range(2)], "book_id string, part_index int, text string"
    )
    parts_store.write_parts(rows("a", "b"), path, "one")
    parts_store.write_parts(rows("a", "b"), path, "one")
    with pytest.raises(ValueError, match="'b'"):
        parts_store.write_parts(rows("b", "c"), path, "two")
    parts_store.write_parts(rows("b", "c"), path, "two", repeated="skip")
    got = sorted(r.text for r in parts_store.read_parts(spark, path).collect())
    assert got == ["a0", "a1", "b0", "b1", "c0", "c1"]


def test_a_bucketed_catalog_is_not_shuffled(spark):
    from folioflow.operators.intake import new_documents

    known = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("file_hash"), "id")
    tables.save_by_hash(known.unionByName(known.limit(5)), "known_by_hash", 8)
    arrivals = spark.range(1990, 2100).select(
        F.sha2((F.col("id") % 2050).cast("string"), 256).alias("file_hash"), F.col("id").alias("upload_id")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = new_documents(arrivals, spark.table("known_by_hash"), "upload_id")
        got = sorted(r.upload_id for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE known_by_hash")
    assert got == list(range(2000, 2050))
    scan = plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")]
    assert "Exchange" not in scan and "Bucketed: true" in plan
