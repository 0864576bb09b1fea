"""Edge rows of intake, shelves, library changes and clinic reports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions import scalars as S
from folioflow.operators import audio, body, catalog, clinic, intake, library

T0 = datetime(2024, 1, 1)
T1 = datetime(2024, 1, 2)
CATALOG = (
    "id long, title string, author string, cover_url string, book_id string, parts_count int, "
    "voice string, category string, file_hash string, created_at timestamp_ntz"
)
USER_BOOKS = (
    "user_id long, global_book_id long, current_part_index int, current_time double, "
    "total_time double, progress int, added_at timestamp_ntz"
)


@pytest.fixture(scope="module")
def books(spark):
    rows = [
        (1, "Uno", None, None, "b1", None, None, None, "h1", T0),
        (2, "Dos NOVELAS", "Ana", "c", "b2", 3, "v", "Historia", "h2", T1),
        (3, "Tres", "Eva", "c", "b3", 0, "v", "", "h3", T1),
        (4, "Cuatro", "", "c", "b4", 2, "v", "Sin mapa", "h4", None),
    ]
    return spark.createDataFrame(rows, CATALOG)


@pytest.fixture(scope="module")
def mine(spark):
    rows = [
        (7, 1, None, None, None, None, T0),
        (7, 2, 1, 5.0, 60.0, 50, T1),
        (7, 99, 0, 0.0, 0.0, 100, T1),
        (8, 2, 2, 9.0, 60.0, 100, None),
    ]
    return spark.createDataFrame(rows, USER_BOOKS)


def test_defaults_and_order(books, mine):
    rows = catalog.user_library(mine, books, user_id=7).collect()
    assert [r.id for r in rows] == [2, 1]
    assert rows[1].asDict() == {
        "user_id": 7,
        "id": 1,
        "title": "Uno",
        "author": "",
        "cover_url": "",
        "progress": 0,
        "duration": "",
        "current_time": 0.0,
        "total_time": 0.0,
        "added_at": T0,
        "book_id": "b1",
        "parts_count": 1,
        "current_part_index": 0,
        "voice": None,
        "category": None,
        "file_hash": "h1",
    }
    assert rows[1].asDict().keys() == {"user_id", *catalog.BOOK_COLUMNS}
    assert [r.id for r in catalog.catalog_view(books).collect()] == [4, 2, 3, 1]
    assert [tuple(r) for r in catalog.orphan_rows(mine, books).collect()] == [(99, 1)]


def test_shelves(books, mine):
    shelf = catalog.user_library(mine, books)
    assert [r.id for r in catalog.continue_shelf(shelf).collect()] == [2]
    assert [(r.user_id, r.id) for r in catalog.history(shelf).collect()] == [(7, 2), (8, 2)]


def test_pages_of_the_library(spark):
    """Pages in turn are the sorted library: ties and null times, readers of any number of books."""
    shelf = [(i, f"t{i}", None, None, f"b{i}", 1, "v", None, f"h{i}", T0) for i in range(12) if i != 5]
    shelf = spark.createDataFrame(shelf, CATALOG)
    times = [T0, T1, T1, None, T0, T1, None, T0, T1, None, T0, T1]
    rows = [(u, i, 0, 0.0, 0.0, i, times[i]) for u, n in ((1, 12), (2, 4), (3, 1)) for i in range(n)]
    rows += [(None, 1, 0, 0.0, 0.0, 0, T0), (4, 5, 0, 0.0, 0.0, 0, T0)]
    rows = spark.createDataFrame(rows, USER_BOOKS)
    want = {}
    for r in catalog.user_library(rows, shelf).where("user_id IS NOT NULL").collect():
        want.setdefault(r.user_id, []).append(r.id)
    got, after = {}, None
    for step in range(5):
        page = catalog.library_page(rows, shelf, 3, after).where("user_id IS NOT NULL").collect()
        last = {}
        for r in sorted(page, key=lambda r: (r.user_id, r.place)):
            got.setdefault(r.user_id, []).append(r.id)
            last[r.user_id] = (r.user_id, r.added_at, r.id)
            assert len(got[r.user_id]) == 3 * step + r.place
        # Readers at their end stay where they are.
        ends = {} if after is None else {r.user_id: tuple(r) for r in after.collect()}
        after = spark.createDataFrame([*(ends | last).values()], "user_id long, added_at timestamp_ntz, id long")
    assert got == want and len(got[1]) == 11
    assert catalog.library_page(rows.where("false"), shelf, 3).collect() == []
    for cursors, limits in ((None, 2), (after, 3)):
        plan = catalog.library_page(rows, shelf, 3, cursors)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
        # Cut before and after the exchange by reader; with cursors, by slice before both.
        assert plan.count("WindowGroupLimit") == limits
        by_reader = plan.index("Exchange hashpartitioning(user_id#")
        assert "WindowGroupLimit" in plan[by_reader:]


def test_categories_and_search(books):
    def ids(df):
        return sorted(r.id for r in df.collect())

    assert ids(catalog.in_category(books, V.NO_CATEGORY)) == [1, 3]
    assert ids(catalog.in_category(books, "Historia")) == [2]
    assert ids(catalog.in_category(books, V.ALL_CATEGORIES)) == [1, 2, 3, 4]
    assert ids(catalog.catalog_search(books, " novela ")) == [2]
    assert ids(catalog.catalog_search(books, "HISTORIA")) == [2]
    assert ids(catalog.catalog_search(books, "   ")) == [1, 2, 3, 4]
    assert ids(catalog.text_search(books, ["title"], " ")) == [2]
    assert [r.category for r in catalog.used_categories(books).collect()] == [
        "Todas",
        "Sin Clasificar",
        "Historia",
    ]


def test_selectable_categories(spark):
    listed = catalog.category_list(spark, without=(V.ALL_CATEGORIES, V.NEW_CATEGORY))
    assert [r.category for r in listed.orderBy("ord").collect()] == V.CATEGORIES[1:]


def test_play_and_override(spark, books, mine):
    asked = spark.createDataFrame([(7, 2), (7, 2), (9, 2), (7, 3)], "user_id long, global_book_id long")
    got = {(r.user_id, r.id): r for r in catalog.resolve_play(asked, mine, books).collect()}
    assert {k: r.to_add for k, r in got.items()} == {(7, 2): False, (9, 2): True, (7, 3): True}
    assert got[7, 2].current_time == 5.0 and got[9, 2].current_time == 0.0
    assert got[9, 2].added_at == T1
    nowhen = spark.createDataFrame([(7, 2, 1, 5.0, 60.0, 50, None)], USER_BOOKS)
    (personal,) = catalog.resolve_play(asked.where("user_id = 7 and global_book_id = 2"), nowhen, books).collect()
    assert personal.added_at is None and not personal.to_add


def test_override_is_per_reader(spark, books, mine):
    moves = spark.createDataFrame(
        [
            (7, 2, "Viajes", T0, 1),
            (7, 2, "Otro", T1, 2),
            (7, 2, V.ALL_CATEGORIES, T1, 3),
            (8, 2, V.ALL_CATEGORIES, T1, 4),
            (9, 2, "Otro", T1, 5),
        ],
        "user_id long, id long, category string, ts timestamp_ntz, event_id long",
    )
    moved = catalog.category_override(catalog.user_library(mine, books), moves)
    assert {(r.user_id, r.id): r.category for r in moved.collect()} == {(7, 1): None, (7, 2): "Otro", (8, 2): "Historia"}


def test_library_changes(spark, mine):
    request = "user_id long, global_book_id long, ts timestamp_ntz"
    adds = spark.createDataFrame([(7, 2, T1), (8, 5, T1), (8, 5, T0)], request)
    added = library.library_add(mine, adds).where("user_id = 8 and global_book_id = 5").collect()
    assert [tuple(r) for r in added] == [(8, 5, 0, 0.0, 0.0, 0, T0)]
    assert library.library_add(mine, adds).count() == mine.count() + 1
    assert library.library_remove(mine, adds).count() == mine.count() - 1
    patches = spark.createDataFrame(
        [(7, 2, T0, 1, 3, None), (7, 2, T1, 2, None, 70), (7, 2, T1, 3, None, 80), (1, 1, T1, 4, 9, 9)],
        request + ", event_id long, current_part_index int, progress int",
    )
    patched = {(r.user_id, r.global_book_id): r for r in library.library_patch(mine, patches).collect()}
    assert len(patched) == 4 and patched[8, 2].progress == 100
    row = patched[7, 2]
    assert (row.current_part_index, row.current_time, row.progress) == (3, 5.0, 80)


UPLOADS = (
    "upload_id long, file_name string, size_bytes long, category string, text string, "
    "cover_url string, added_by string, file_hash string, arrived_at timestamp_ntz"
)


def test_intake_gate_order(spark):
    rows = [
        (1, "a.pdf", 11 * 2**20, None, "x", None, "u", "n1"),
        (2, "a.pdf", 11 * 2**20, "c", "x", None, "u", "n2"),
        (3, "a.txt", 5, "c", "x", None, "u", "k1"),
        (4, "a.txt", 5, "c", "x", None, "u", "n3"),
        (5, "a.PDF", 0, "c", "x", None, "u", "n4"),
        (6, "a.pdf", 5, "c", " 12 \n", None, "u", "n5"),
        (7, "a.txt", 5, "c", "x", None, "u", "n6"),
        (8, "a.pdf", 10 * 2**20, "c", "x", "", "u", "n6"),
        (9, "a.pdf", 5, "c", "x", None, "u", "n6"),
        (10, "a.pdf", 5, "", "x", None, "u", "n6"),
        (11, None, 5, "c", "x", None, "u", "n7"),
    ]
    uploads = spark.createDataFrame([(*r, T1) for r in rows], UPLOADS)
    known = spark.createDataFrame([("k1",), ("k1",)], "file_hash string")
    gate = intake.intake_gate(uploads, known)
    assert {r.upload_id: r.reject_reason for r in gate.collect()} == {
        1: "no_category",
        2: "too_large",
        3: "duplicate",
        4: "not_pdf",
        5: "empty_file",
        6: "no_text",
        7: "not_pdf",
        8: None,
        9: "duplicate",
        10: "no_category",
        11: "not_pdf",
    }
    (row,) = intake.catalog_candidates(gate.where("reject_reason is null")).collect()
    assert (row.title, row.cover_url, row.duration, row.total_time) == ("a", V.DEFAULT_COVER, "~4min", 0)


def test_candidate_without_parts(spark):
    schema = (
        "upload_id long, file_name string, file_hash string, category string, "
        "cover_url string, added_by string, parts_count int, arrived_at timestamp_ntz"
    )
    rows = [(1, "x.pdf", "h" * 20, "c", "u", "me", None, T0), (2, "y.pdf", "k" * 20, "c", "u", "me", 0, T1)]
    candidates = intake.catalog_candidates(spark.createDataFrame(rows, schema))
    got = [(r.duration, r.total_time, r.book_id) for r in candidates.orderBy("id").collect()]
    assert got == [("~15min", 900, "h" * 20), ("~15min", 900, "k" * 20)]
    known = spark.createDataFrame(
        [(9, "t", 4, "z", T0)], "id long, title string, parts_count int, file_hash string, created_at timestamp_ntz"
    )
    applied = intake.catalog_apply(known, candidates)
    assert {r.id: (r.parts_count, r.created_at) for r in applied.collect()} == {9: (4, T0), 1: (1, T0), 2: (0, T1)}
    assert intake.catalog_apply(applied, candidates).count() == 3
    with pytest.raises(ValueError):
        intake.catalog_apply(known, candidates.drop("created_at"))


def test_new_documents_with_many_copies(spark):
    arrivals = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id"))).alias("file_hash")
    )
    known = spark.createDataFrame([("h1",), ("h1",)], "file_hash string")
    new = intake.new_documents(arrivals, known, "id")
    assert new.count() == 2000 and new.where("file_hash = 'hot'").first().id == 0


SPANS = (
    "doc int, page int, block int, line int, span int, block_type int, "
    "y0 double, y1 double, page_height double, size double, text string"
)


def test_body_text(spark):
    def span(page, block, line, at, size, text, kind=0, y0=100.0, y1=112.0):
        return (1, page, block, line, at, kind, y0, y1, 800.0, size, text)

    rows = [
        span(0, 0, 0, 0, 12.0, "HEADER", y0=0.0, y1=40.0),
        span(0, 1, 0, 1, 12.04, "world. "),
        span(0, 1, 0, 0, 11.98, "Hello "),
        span(0, 1, 1, 0, 11.4, "kept, "),
        span(0, 1, 1, 1, 11.3, "small"),
        span(0, 2, 0, 0, 20.0, "Big"),
        span(0, 3, 0, 0, 12.0, "image", kind=1),
        span(0, 4, 0, 0, 12.0, "footer", y0=753.0, y1=790.0),
        span(1, 0, 0, 0, 12.0, " 14 "),
        span(25, 0, 0, 0, 8.0, "many small characters do not count after page twenty" * 9),
        span(999, 0, 0, 0, 12.0, "last"),
        span(1000, 0, 0, 0, 12.0, "beyond"),
        (2, 0, 0, 0, 0, 0, 100.0, 112.0, 800.0, 9.0, "same"),
        (2, 0, 1, 0, 0, 0, 100.0, 112.0, 800.0, 15.0, "size"),
        (3, 0, 0, 0, 0, 0, 100.0, 112.0, 800.0, 9.0, "ab"),
        (4, 0, 0, 0, 0, 0, 100.0, 112.0, 800.0, 9.0, "1234"),
    ]
    df = spark.createDataFrame(rows, SPANS)
    got = {r.doc: (r.body, r.pages_dropped) for r in body.body_text(df, "doc", max_pages=1000).collect()}
    assert got == {1: ("Hello world. kept, Big last.", 1), 2: ("same size.", 0)}
    (whole,) = body.body_text(df, "doc").where("doc = 1").collect()
    assert (whole.body, whole.pages_dropped) == ("Hello world. kept, Big last beyond.", 0)
    (more,) = body.body_text(df, "doc", sample_pages=30).where("doc = 1").collect()
    assert more.body.startswith("Hello world. kept, small Big many small")


def shuffled_bytes(df):
    """Bytes that the exchanges of a plan that has run sent."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_body_text_leaves_margins_where_they_are(spark):
    long = "margin " * 100_000
    rows = []
    for page in (0, 1, 30, 2000):
        rows.append((1, page, 0, 0, 0, 0, 0.0, 12.0, 800.0, 7.0 if page else 15.0, long))
        rows.append((1, page, 1, 0, 0, 0, 100.0, 112.0, 800.0, 15.0, f"Line {page}."))
        rows.append((1, page, 1, 1, 0, 0, 100.0, 112.0, 800.0, 14.0, "small print, "))
    df = body.body_text(spark.createDataFrame(rows, SPANS), "doc", max_pages=1000)
    (row,) = df.collect()
    # The first margin outweighs all else, and is itself not shown.
    assert (row.body, row.pages_dropped) == ("Line 0. Line 1. Line 30.", 1)
    assert 0 < shuffled_bytes(df) < 10_000


def test_body_text_without_page_numbers_or_sizes(spark):
    rows = [
        (1, None, 0, 0, 0, 0, 0.0, 12.0, 800.0, 9.0, "margin without page"),
        (1, 0, 0, 0, 0, 0, None, None, None, 9.0, "no box"),
        (1, 0, 1, 0, 0, 0, 100.0, 112.0, 800.0, None, "no size"),
        (1, 0, 2, 0, 0, 0, 100.0, 112.0, 800.0, 9.0, None),
        (2, None, 0, 0, 0, 0, 0.0, 12.0, 800.0, 9.0, "only a margin"),
    ]
    df = spark.createDataFrame(rows, SPANS)
    for most in (None, 1000):
        got = [(r.doc, r.body, r.pages_dropped) for r in body.body_text(df, "doc", max_pages=most).collect()]
        assert got == [(1, "no box.", 0)]


def test_body_text_tie_goes_to_the_first_seen(spark):
    rows = [
        (1, 0, 1, 0, 0, 0, 100.0, 112.0, 800.0, 9.0, "late"),
        (1, 0, 0, 0, 0, 0, 100.0, 112.0, 800.0, 15.0, "erst"),
    ]
    got = body.body_text(spark.createDataFrame(rows, SPANS), "doc").collect()
    assert [r.body for r in got] == ["erst."]


def test_page_preview(spark):
    pages = spark.createDataFrame([(1, p, f"p{p}\n{p}") for p in range(7)], "doc int, page int, text string")
    rows = body.page_preview(pages, "doc").orderBy("page").collect()
    assert [r.page for r in rows] == [1, 2, 3, 4, 5]
    assert {(r.total_pages, r.cleaned_text_preview, r.cleaned_text_length) for r in rows} == {(7, "p0 p1.", 6)}


def test_audio(spark, books, mine):
    required = spark.createDataFrame(
        [("b", i, v) for i in range(3) for v in ("a b", "a  b!")], "book_id string, part_index int, voice string"
    )
    stored = required.where("part_index < 2").select("book_id", "part_index")
    schema = "book_id string, part_index int, voice_slug string"
    made = spark.createDataFrame([("b", 0, "a_b"), ("b", 0, "a_b"), ("b", 1, "other")], schema)
    plan = audio.audio_plan(required, stored, made).collect()
    states = {0: "hit", 1: "generate", 2: "missing_text"}
    assert len(plan) == 6 and all(r.state == states[r.part_index] for r in plan)
    assert {r.path for r in plan} == {f"b/audio/part_{i}_a_b.mp3" for i in range(3)}
    none = spark.createDataFrame([], schema)
    assert [tuple(r) for r in audio.prefetch_plan(mine, books, none, "v").collect()] == [("b2", 2, "v")]
    have = spark.createDataFrame([("b2", 2, "v")], schema)
    assert audio.prefetch_plan(mine, books, have, "v").count() == 0


def test_answers(spark):
    schema = "session int, question int, value int, ts timestamp_ntz, event_id long"
    rows = [(1, 0, 3, T0, 1), (1, 1, 2, T0, 2), (1, 0, 1, T1, 3), (1, 1, 0, T0, 4)]
    responses = spark.createDataFrame(rows, schema)
    latest = clinic.responses_latest(responses, 4).orderBy("position").collect()
    assert [(r.question, r.value, r.answer_progress) for r in latest] == [(1, 0, 50.0), (0, 1, 25.0)]
    saved = clinic.saved_answers(responses, 3).orderBy("question").collect()
    assert [r.value for r in saved] == [1, 0, None]


def test_sample_result(spark):
    scores = [("Afectivo", 8, 15, 72), ("Cognitivo", 10, 21, 81), ("Somático", 4, 15, 45), ("Motivacional", 2, 12, 35)]
    schema = "session string, domain_scores array<struct<domain:string,score:int,max_score:int,percentile:int>>"
    results = spark.createDataFrame([("s", scores)], schema)
    profile = clinic.domain_profile(results).collect()
    assert [(r.domain, r.value, r.full_mark) for r in profile] == [(d, p, 100) for d, _, _, p in scores]


def test_clinic_reports(spark):
    patients = spark.createDataFrame(
        [(1, "Nora", "Ansiedad", "active"), (2, "Iván", None, "active"), (3, "Olga", "Insomnio", "inactive")],
        "id int, name string, diagnosis string, status string",
    )
    visits = spark.createDataFrame([(1, "scheduled", "initial"), (2, "completed", "?")], "id int, status string, type string")
    kpis = {r.kpi: r.n for r in clinic.clinic_kpis(patients, visits).collect()}
    assert kpis == {"active_patients": 2, "patients": 3, "scheduled_appointments": 1}
    assert [r.id for r in clinic.patient_search(patients, "ANS").collect()] == [1]
    assert clinic.patient_search(patients, "", "active").count() == 2
    assert [r.type_label for r in clinic.appointment_labels(visits).orderBy("id").collect()] == ["Primera consulta", None]
    feed = spark.createDataFrame([("a", "s", "j", "Research", None)], "title string, summary string, source string, category string, is_new boolean")
    assert clinic.feed_search(feed, "A", "research").count() == 1
    assert tuple(clinic.feed_new_count(feed).first()) == (False, 0)
    assert tuple(clinic.feed_new_count(feed.where("false")).first()) == (False, 0)


def test_small_expressions(spark):
    row = spark.range(1).select(
        S.citation(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit(2020)).alias("three"),
        S.citation(F.array(F.lit("A")), F.lit(2020)).alias("one"),
        S.joined_references(F.array().cast("array<string>")).alias("no_references"),
        S.message_label(F.lit("user"), F.lit("evidence")).alias("user_caption"),
        S.display_name(F.lit(""), F.lit("ana@x.org")).alias("name"),
        S.display_name(F.lit(None).cast("string"), F.lit("plain")).alias("no_at"),
        S.long_date_es(F.expr("timestamp_ntz'2026-01-31 10:30:59'")).alias("date"),
        S.clock_es(S.iso_timestamp(F.lit("2026-01-31T10:30:00+02:00"))).alias("from_iso"),
        S.iso_timestamp(F.lit("soon")).alias("not_iso"),
        S.label(F.lit("?"), V.TEST_CATEGORY_LABELS).alias("raw_code"),
        S.label(F.lit("?"), V.SEVERITY_LABELS, fallback=False).alias("no_label"),
        *[S.overlap_band(F.lit(p)).alias(f"band{p}") for p in (70, 69, 50, 49)],
    ).first()
    assert row.asDict() == {
        "three": "A, B et al. · 2020",
        "one": "A · 2020",
        "no_references": None,
        "user_caption": None,
        "name": "ana",
        "no_at": "plain",
        "date": "31 de enero de 2026, 10:30",
        "from_iso": "08:30",
        "not_iso": None,
        "raw_code": "?",
        "no_label": None,
        "band70": "destructive",
        "band69": "warning",
        "band50": "warning",
        "band49": "muted",
    }
