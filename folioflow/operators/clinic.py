"""Reports over questionnaires, patients, appointments, feeds and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions import scalars as S
from folioflow.functions.text import strip
from folioflow.operators.catalog import text_search


def responses_latest(responses: DataFrame, n_questions: int) -> DataFrame:
    """Last answer per question; a changed answer moves to the end of its session."""
    order = F.struct("ts", "event_id", "value")
    latest = (
        responses.groupBy("session", "question")
        .agg(F.max(order).alias("_last"))
        .select("session", "question", "_last.*")
    )
    # A session has at most one row per question here.
    in_session = Window.partitionBy("session").orderBy("ts", "event_id")
    return latest.select(
        "session",
        "question",
        "value",
        F.row_number().over(in_session).alias("position"),
        ((F.col("question") + 1) / F.lit(float(n_questions)) * 100).alias("answer_progress"),
    )


def saved_answers(responses: DataFrame, n_questions: int) -> DataFrame:
    """Saved answer of every question of a session, null where there is none."""
    answered = responses.groupBy("session", "question").agg(
        F.max(F.struct("ts", "event_id", "value"))["value"].alias("value")
    )
    questions = F.sequence(F.lit(0), F.lit(n_questions - 1))
    grid = responses.select("session").distinct().select(
        "session", F.explode(questions).alias("question")
    )
    return grid.join(answered, ["session", "question"], "left")


def domain_profile(results: DataFrame) -> DataFrame:
    return results.select("session", F.inline("domain_scores")).select(
        "session",
        "domain",
        F.col("percentile").alias("value"),
        F.lit(V.PROFILE_FULL_MARK).alias("full_mark"),
    )


def clinic_kpis(patients: DataFrame, appointments: DataFrame) -> DataFrame:
    """Counts of the dashboard, one row each. Nothing filters on the date."""
    people = patients.agg(
        F.count_if(F.col("status") == "active").alias("active_patients"),
        F.count("*").alias("patients"),
    )
    visits = appointments.agg(
        F.count_if(F.col("status") == "scheduled").alias("scheduled_appointments")
    )

    def as_rows(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "kpi", "n")

    return as_rows(people).unionByName(as_rows(visits))


def scheduled(appointments: DataFrame) -> DataFrame:
    return appointments.where(F.col("status") == "scheduled")


def patient_search(patients: DataFrame, query: str, status: str = "all") -> DataFrame:
    found = text_search(patients, ["name", "diagnosis"], query)
    return found if status == "all" else found.where(F.col("status") == status)


def feed_search(feed: DataFrame, query: str, tab: str = "all") -> DataFrame:
    found = text_search(feed, ["title", "summary", "source"], query)
    return found if tab == "all" else found.where(F.lower("category") == tab)


def test_search(tests: DataFrame, query: str, category: str = "all") -> DataFrame:
    found = text_search(tests, ["name", "short_name"], query)
    return found if category == "all" else found.where(F.col("category") == category)


def feed_new_count(feed: DataFrame) -> DataFrame:
    is_new = F.coalesce("is_new", F.lit(False))
    return feed.agg(
        F.coalesce(F.bool_or(is_new), F.lit(False)).alias("any_new"),
        F.count_if(is_new).alias("new_count"),
    )


def test_labels(tests: DataFrame) -> DataFrame:
    return tests.select(
        "id",
        S.label(F.col("category"), V.TEST_CATEGORY_LABELS).alias("category_label"),
        S.label(F.col("severity"), V.SEVERITY_LABELS, fallback=False).alias("severity_label"),
        S.validity_stars(F.col("validity")).alias("stars"),
    )


def appointment_labels(appointments: DataFrame) -> DataFrame:
    return appointments.select(
        "id", S.label(F.col("type"), V.APPOINTMENT_TYPE_LABELS, fallback=False).alias("type_label")
    )


def patient_labels(patients: DataFrame) -> DataFrame:
    return patients.select(
        "id", S.label(F.col("status"), V.PATIENT_STATUS_LABELS, fallback=False).alias("status_label")
    )


def message_class(messages: DataFrame) -> DataFrame:
    """Style and caption of every message that is not blank."""
    content = strip(F.col("content"))
    return messages.where(F.length(content) > 0).select(
        "conv_id",
        "turn",
        S.message_class(F.col("role"), F.col("type")).alias("style"),
        S.message_label(F.col("role"), F.col("type")).alias("caption"),
        content.alias("content"),
    )


def citations(sources: DataFrame) -> DataFrame:
    return sources.select(
        "id",
        S.citation(F.col("authors"), F.col("year")).alias("citation"),
        S.joined_references(F.col("authors")).alias("references"),
        F.size("authors").alias("n_authors"),
    )
