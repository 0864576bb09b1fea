"""Registered queries: each reads whole driver tables through the views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions import scalars as S
from folioflow.functions import text as T
from folioflow.operators import audio, body, catalog, clinic, intake, library, playback
from folioflow.operators.joins import unroll
from folioflow.sources import tables
from folioflow.sources.views import PLAN_VOICE, QUESTIONS, Views

THROTTLE_GAP_MS = 3_600_000
THROTTLE_BUCKET_MS = 24 * 3_600_000
DOMAINS = 4

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a function of the views under its own name."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    return build


# --- text ----------------------------------------------------------------
@query
def clean_text(v: Views) -> DataFrame:
    return v.raw_docs().select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query
def split_parts(v: Views) -> DataFrame:
    parts = v.docs().select("doc_id", T.split_parts(F.col("text")).alias("_parts"))
    return unroll(parts, ["doc_id"], "_parts", "part_index", "part")


@query
def parts_manifest(v: Views) -> DataFrame:
    return intake.parts_manifest(v.raw_docs(), "doc_id")


@query
def body_text(v: Views) -> DataFrame:
    return body.body_text(v.spans(), "doc_id", max_pages=V.MAX_PAGES)


@query
def page_preview(v: Views) -> DataFrame:
    return body.page_preview(v.page_texts(), "doc_id")


@query
def derive_title(v: Views) -> DataFrame:
    return v.uploads().select("upload_id", T.derive_title(F.col("file_name")).alias("title"))


@query
def slug_key(v: Views) -> DataFrame:
    return v.docs().select(
        F.col("doc_id").alias("id"),
        T.slug(F.col("text")).alias("title_slug"),
        T.slug(F.coalesce("source", F.lit(""))).alias("author_slug"),
    )


@query
def file_hash(v: Views) -> DataFrame:
    return v.docs().select("doc_id", T.file_hash(F.col("text")).alias("file_hash"))


# --- intake --------------------------------------------------------------
@query
def intake_gate(v: Views) -> DataFrame:
    gate = intake.intake_gate(v.uploads(), v.known_catalog())
    return gate.select("upload_id", "file_name", "reject_reason")


@query
def new_documents(v: Views) -> DataFrame:
    return intake.new_documents(v.catalog(), v.known_catalog(), "id")


def _candidates(v: Views) -> DataFrame:
    gate = intake.intake_gate(v.uploads(), v.known_catalog())
    return intake.catalog_candidates(gate.where(F.col("reject_reason").isNull()))


@query
def catalog_candidates(v: Views) -> DataFrame:
    return _candidates(v)


@query
def catalog_apply(v: Views) -> DataFrame:
    return intake.catalog_apply(v.known_catalog(), _candidates(v))


# --- catalog and shelves -------------------------------------------------
def _library(v: Views) -> DataFrame:
    return catalog.user_library(v.user_books(), v.catalog())


@query
def catalog_view(v: Views) -> DataFrame:
    return catalog.catalog_view(v.catalog())


@query
def user_library(v: Views) -> DataFrame:
    return _library(v)


@query
def library_page(v: Views) -> DataFrame:
    """Every reader's second page of three, asked for by the last book of the first."""
    first = catalog.library_page(v.user_books(), v.catalog(), size=3)
    last = first.groupBy("user_id").agg(F.max_by(F.struct("added_at", "id"), "place").alias("last"))
    second = catalog.library_page(v.user_books(), v.catalog(), 3, last.select("user_id", "last.*"))
    return second.select("user_id", "place", "id", "title", "progress", "added_at")


@query
def library_orphans(v: Views) -> DataFrame:
    return catalog.orphan_rows(v.user_books(), v.catalog())


@query
def continue_shelf(v: Views) -> DataFrame:
    return catalog.continue_shelf(_library(v)).select("user_id", "id", "title", "progress")


@query
def history(v: Views) -> DataFrame:
    return catalog.history(_library(v)).select("user_id", "id", "title", "progress", "added_at")


@query
def catalog_by_category(v: Views) -> DataFrame:
    return catalog.in_category(v.catalog(), V.NO_CATEGORY).select("id", "title", "category")


@query
def catalog_search(v: Views) -> DataFrame:
    found = catalog.catalog_search(v.searchable(), "  ThEr tH ")
    return found.select("id", "title", "author", "category")


@query
def used_categories(v: Views) -> DataFrame:
    return catalog.used_categories(v.catalog())


@query
def resolve_play(v: Views) -> DataFrame:
    return catalog.resolve_play(v.changes("click"), v.user_books(), v.catalog())


@query
def category_override(v: Views) -> DataFrame:
    moved = catalog.category_override(_library(v), v.category_choices())
    return moved.select("user_id", "id", "title", "category")


@query
def library_search(v: Views) -> DataFrame:
    """The personal tab's search over whole texts; a book is searched once, whoever has it."""
    found = catalog.catalog_search(v.searchable(), " aN hE ").select("id")
    return _library(v).join(found, "id", "left_semi").select("user_id", "id", "title", "category")


def _stored_catalog(v: Views) -> DataFrame:
    """The catalog before the uploads, written as the stored table and read as such."""
    ids = {c: F.col(c).cast("string") for c in ("id", "book_id")}
    return tables.read_catalog(v.spark, tables.written(v.known_catalog().withColumns(ids), "catalog"))


@query
def stored_catalog(v: Views) -> DataFrame:
    """All rows of the stored catalog, in the declared types."""
    return _stored_catalog(v).withColumn("id", F.col("id").cast("long"))


@query
def hash_known(v: Views) -> DataFrame:
    """Whether the stored catalog holds a file's hash, hash by hash."""
    stored = _stored_catalog(v)
    rows = [(r["file_hash"], tables.hash_known(stored, r["file_hash"])) for r in v.probes().collect()]
    return v.spark.createDataFrame(rows, "file_hash string, known boolean")


@query
def library_categories(v: Views) -> DataFrame:
    return catalog.used_categories(_library(v))


@query
def one_library(v: Views) -> DataFrame:
    return catalog.user_library(v.user_books(), v.catalog(), user_id=7)


# --- library changes -----------------------------------------------------
@query
def library_add(v: Views) -> DataFrame:
    return library.library_add(v.user_books(), v.changes("signup"))


@query
def library_remove(v: Views) -> DataFrame:
    return library.library_remove(v.user_books(), v.changes("error"))


@query
def library_patch(v: Views) -> DataFrame:
    return library.library_patch(v.user_books(), v.patches())


# --- audio ---------------------------------------------------------------
@query
def audio_plan(v: Views) -> DataFrame:
    return audio.audio_plan(v.parts_required(), v.stored_text(), v.stored_audio())


@query
def prefetch_plan(v: Views) -> DataFrame:
    return audio.prefetch_plan(v.user_books(), v.catalog(), v.stored_audio(), PLAN_VOICE)


@query
def parts_gap_report(v: Views) -> DataFrame:
    return audio.parts_gap_report(v.catalog(), v.stored_text())


@query
def missing_parts(v: Views) -> DataFrame:
    return audio.missing_parts(v.catalog(), v.stored_text())


# --- playback ------------------------------------------------------------
@query
def progress_pct(v: Views) -> DataFrame:
    part = (F.col("event_id") % F.col("parts")).cast("int")
    return (
        v.listening()
        .where(F.col("kind") == "tick")
        .select(
            "event_id",
            S.progress_pct(part, F.col("parts"), F.col("value"), F.lit(None)).alias("progress"),
            S.in_part_ratio(F.col("value"), F.lit(V.PART_SECONDS)).alias("in_part"),
        )
    )


@query
def format_time(v: Views) -> DataFrame:
    seconds = F.col("value") * 60
    return v.table("events").select("event_id", S.format_time(seconds).alias("label"))


@query
def seek_clamp(v: Views) -> DataFrame:
    duration = F.when(F.col("event_id") % 4 != 0, F.lit(30.0))
    return v.table("events").select(
        "event_id",
        S.seek_forward(F.col("value"), duration).alias("forward"),
        S.seek_backward(F.col("value")).alias("backward"),
    )


@query
def playback_fold(v: Views) -> DataFrame:
    return playback.playback_fold(v.listening())


@query
def playback_saved(v: Views) -> DataFrame:
    saved = playback.saved_events(v.listening(), THROTTLE_GAP_MS, bucket_ms=THROTTLE_BUCKET_MS)
    return playback.playback_fold(saved)


@query
def tick_throttle(v: Views) -> DataFrame:
    saved = playback.tick_throttle(v.ticks(), THROTTLE_GAP_MS, THROTTLE_BUCKET_MS)
    return saved.unionByName(playback.unusable_ticks(v.ticks()), allowMissingColumns=True)


# --- clinic --------------------------------------------------------------
@query
def responses_latest(v: Views) -> DataFrame:
    return clinic.responses_latest(v.responses(), QUESTIONS)


@query
def saved_answers(v: Views) -> DataFrame:
    return clinic.saved_answers(v.responses(), QUESTIONS)


@query
def domain_profile(v: Views) -> DataFrame:
    return clinic.domain_profile(v.results(DOMAINS))


@query
def clinic_kpis(v: Views) -> DataFrame:
    return clinic.clinic_kpis(v.patients(), v.appointments())


@query
def scheduled_appointments(v: Views) -> DataFrame:
    return clinic.scheduled(v.appointments()).select("id", "patient_id", "type")


@query
def patient_search(v: Views) -> DataFrame:
    return clinic.patient_search(v.patients(), "UILD", "active")


@query
def feed_search(v: Views) -> DataFrame:
    return clinic.feed_search(v.feed(), "The", "en").select("id", "title", "source", "category")


@query
def test_search(v: Views) -> DataFrame:
    found = clinic.test_search(v.tests(), "brand#1", "mood")
    return found.select("id", "name", "short_name", "category")


@query
def feed_new_count(v: Views) -> DataFrame:
    return clinic.feed_new_count(clinic.feed_search(v.feed(), "src1"))


@query
def overlap_band(v: Views) -> DataFrame:
    percentage = F.floor("value") % 101
    return v.table("events").select(
        "event_id", percentage.alias("percentage"), S.overlap_band(percentage).alias("band")
    )


@query
def code_labels(v: Views) -> DataFrame:
    tests = clinic.test_labels(v.tests())

    def rows(kind: str, df: DataFrame, label: str, stars) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            F.col("id").cast("bigint").alias("id"),
            F.col(label).alias("label"),
            stars.cast("int").alias("stars"),
        )

    none = F.lit(None)
    voices = v.catalog().select("id", S.label(F.col("voice"), V.VOICES).alias("voice_label"))
    return (
        rows("test", tests, "category_label", F.col("stars"))
        .unionByName(rows("severity", tests, "severity_label", none))
        .unionByName(rows("appointment", clinic.appointment_labels(v.appointments()), "type_label", none))
        .unionByName(rows("patient", clinic.patient_labels(v.patients()), "status_label", none))
        .unionByName(rows("voice", voices, "voice_label", none))
    )


@query
def citation(v: Views) -> DataFrame:
    return clinic.citations(v.sources())


@query
def message_class(v: Views) -> DataFrame:
    return clinic.message_class(v.messages())


@query
def display_name(v: Views) -> DataFrame:
    name = S.display_name(F.col("full_name"), F.col("email"))
    return v.accounts().select("id", name.alias("display_name"))


@query
def format_date(v: Views) -> DataFrame:
    return v.table("events").select(
        "event_id", S.long_date_es(F.col("ts")).alias("long_date"), S.clock_es(F.col("ts")).alias("clock")
    )
