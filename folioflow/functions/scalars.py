"""Small row expressions used by the catalog, player and clinic reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import fixed_values as V


def or_default(text: Column, default) -> Column:
    """Default on null and on the empty string."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def progress_pct(part: Column, parts: Column, elapsed: Column, current: Column) -> Column:
    """Overall progress in percent; unchanged when the part count is null or 0."""
    share = F.lit(100.0) / parts
    done = F.coalesce(part, F.lit(0)).cast("double") / parts * 100.0
    within = F.least(elapsed / V.PART_SECONDS * share, share)
    return F.when(parts > 0, F.round(done + within).cast("int")).otherwise(current)


def in_part_ratio(elapsed: Column, total: Column) -> Column:
    return F.when(total > 0, elapsed / total).otherwise(F.lit(0.0))


def format_time(seconds: Column) -> Column:
    """Whole seconds as a clock: hours only from one hour on, the rest in two digits."""
    whole = F.floor(seconds).cast("long")
    clock = F.printf(
        F.lit("%d:%02d:%02d"), F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    )
    under_an_hour = F.printf(F.lit("%d:%02d"), F.floor(whole / 60), whole % 60)
    return F.when(whole >= 3600, clock).otherwise(under_an_hour)


def seek_forward(position: Column, duration: Column) -> Column:
    return F.least(position + V.SEEK_SECONDS, F.coalesce(duration, F.lit(0.0)))


def seek_backward(position: Column) -> Column:
    return F.greatest(position - V.SEEK_SECONDS, F.lit(0.0))


def next_part(part: Column, parts: Column) -> Column:
    """Index of the following part, null on the last one."""
    at = F.coalesce(part, F.lit(0))
    return F.when(at < parts - 1, at + 1)


def part_indexes(parts: Column) -> Column:
    """0 .. parts-1; empty for null and 0."""
    return F.when(parts > 0, F.sequence(F.lit(0), parts - 1)).otherwise(
        F.array().cast("array<int>")
    )


def overlap_band(percentage: Column) -> Column:
    return (
        F.when(percentage >= V.HIGH_OVERLAP, "destructive")
        .when(percentage >= V.MEDIUM_OVERLAP, "warning")
        .otherwise("muted")
    )


def validity_stars(validity: Column) -> Column:
    return F.when(validity == "high", 3).when(validity == "moderate", 2).otherwise(1)


def label(code: Column, labels: dict[str, str], fallback: bool = True) -> Column:
    """Label of a code from a short fixed list; else the code itself, or null."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), code)
    return F.coalesce(found, code) if fallback else found


def citation(authors: Column, year: Column) -> Column:
    named = F.array_join(F.slice(authors, 1, 2), ", ")
    more = F.when(F.size(authors) > 2, " et al.").otherwise("")
    return F.concat(named, more, F.lit(" · "), year.cast("string"))


def joined_references(references: Column) -> Column:
    return F.when(F.size(references) > 0, F.array_join(references, ", "))


def message_class(role: Column, kind: Column) -> Column:
    return (
        F.when(role == "user", "message-user")
        .when(kind == "evidence", "message-evidence")
        .otherwise("message-reasoning")
    )


def message_label(role: Column, kind: Column) -> Column:
    return F.when(
        role != "user",
        F.when(kind == "evidence", V.EVIDENCE_LABEL).otherwise(V.REASONING_LABEL),
    )


def display_name(full_name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(full_name, F.lit("")), F.split_part(email, F.lit("@"), F.lit(1)))


def long_date_es(ts: Column) -> Column:
    """'31 de enero de 2026, 10:30' in the session time zone."""
    months = F.array(*[F.lit(m) for m in V.MONTHS_ES])
    return F.concat(
        F.dayofmonth(ts).cast("string"),
        F.lit(" de "),
        F.element_at(months, F.month(ts)),
        F.lit(" de "),
        F.year(ts).cast("string"),
        F.lit(", "),
        clock_es(ts),
    )


def iso_timestamp(text: Column) -> Column:
    """Instant of an ISO 8601 string, null if it is none."""
    return F.try_to_timestamp(text)


def clock_es(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")
