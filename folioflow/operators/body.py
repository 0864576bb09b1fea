"""Body text and previews from page layout tables.

A document is the unit of work: its spans come together once, as they do in the result,
and everything else is an expression over its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions import text as T


def main_size(lines: Column, sample_pages: int) -> Column:
    """Font size with most characters on the first pages; ties to the first seen.

    Lines are in reading order; a span of at most two characters does not count.
    """
    sampled = F.filter(lines, lambda line: line["page"] < sample_pages)
    spans = F.filter(
        F.flatten(F.transform(sampled, lambda line: line["spans"])), lambda s: s["chars"] > 2
    )

    def heaviest(spans: Column) -> Column:
        sizes = F.array_distinct(F.transform(spans, lambda s: s["size"]))

        def weighed(size: Column, at: Column) -> Column:
            chars = F.aggregate(
                spans,
                F.lit(0).cast("long"),
                lambda sum_, s: sum_ + F.when(s["size"] == size, s["chars"]).otherwise(0),
            )
            return F.struct(chars.alias("weight"), (-at).alias("at"), size.alias("size"))

        return F.array_max(F.transform(sizes, weighed))["size"]

    return T.bind(spans, heaviest)


def body_text(
    spans: DataFrame,
    key: str,
    sample_pages: int = V.SAMPLE_PAGES,
    max_pages: int | None = None,
) -> DataFrame:
    """Narration text of every document, without headers, footers and small print.

    The main size comes from the first `sample_pages` pages. Pages from `max_pages` on
    are left out, if it is given; `pages_dropped` says how many had text.

    Spans are shuffled once, by document: lines and then documents are grouped on that
    partitioning. Spans in the margins go along without their text, which is never shown, and
    those of them that cannot weigh in for the main size are not sent at all.
    """
    in_margin = (F.col("y1") < F.col("page_height") * V.TOP_MARGIN) | (
        F.col("y0") > F.col("page_height") * V.BOTTOM_MARGIN
    )
    beyond = F.lit(False) if max_pages is None else F.col("page") >= max_pages
    span = F.struct(
        "span",
        F.round("size", 1).alias("size"),
        "chars",
        "margin",
        "text",
    )
    text = F.col("text")
    sent = (
        spans.where(F.col("block_type") == 0)
        .withColumn("margin", F.coalesce(in_margin, F.lit(False)))
        .where(~F.col("margin") | (F.col("page") < sample_pages) | beyond)
        .select(
            key, "page", "block", "line", "span", "size", "margin",
            F.length(T.strip(text)).alias("chars"),
            F.when(~F.col("margin") & ~beyond, text).alias("text"),
        )
    )
    lines = (
        sent.repartition(key)
        .groupBy(key, "page", "block", "line")
        .agg(F.sort_array(F.collect_list(F.when(~beyond, span))).alias("spans"))
    )
    line = F.struct("page", "block", "line", "spans")
    dropped = F.size(F.collect_set(F.when(beyond, F.col("page"))))
    docs = lines.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(~beyond, line))).alias("_lines"), dropped.alias("pages_dropped")
    )

    def text_of(main: Column) -> Column:
        def kept(line: Column) -> Column:
            large = F.filter(
                line["spans"], lambda s: ~s["margin"] & (s["size"] >= main - V.SIZE_TOLERANCE)
            )
            return T.strip(F.array_join(F.transform(large, lambda s: s["text"]), ""))

        return F.array_join(F.filter(F.transform("_lines", kept), lambda x: x != ""), "\n")

    # Bound, not a column, which Catalyst would put into the loop over the spans.
    body = T.bind(T.bind(main_size(F.col("_lines"), sample_pages), text_of), T.clean_text)
    # An empty body is kept as an empty row while it is computed, not filtered below,
    # where Catalyst would compute it again.
    rows = docs.select(key, F.array(F.struct(body.alias("body"))).alias("_body"), "pages_dropped")
    return rows.select(key, "pages_dropped", F.inline_outer("_body")).where(F.col("body") != "")


def page_preview(pages: DataFrame, key: str) -> DataFrame:
    """First pages as they are, next to a cleaned sample of the document.

    One grouping by document, which carries the text of the shown pages only.
    """
    shown = F.when(F.col("page") < V.PREVIEW_PAGES, F.struct("page", "text"))
    docs = pages.groupBy(key).agg(
        (F.max("page") + 1).alias("total_pages"),
        F.sort_array(F.collect_list(shown)).alias("_pages"),
    )
    first = F.filter("_pages", lambda p: p["page"] < V.PREVIEW_CLEAN_PAGES)
    sample = F.array_join(F.transform(first, lambda p: p["text"]), "\n")
    cleaned = docs.select(
        key,
        "total_pages",
        "_pages",
        # Null without any of the cleaned pages, as those of a document may start later.
        T.bind(
            F.when(F.size(first) > 0, T.clean_text(sample)),
            lambda t: F.struct(
                F.length(t).alias("cleaned_text_length"),
                F.left(t, F.lit(V.PREVIEW_CLEAN_CHARS)).alias("cleaned_text_preview"),
                F.right(t, F.lit(V.PREVIEW_CLEAN_CHARS)).alias("cleaned_text_end"),
            ),
        ).alias("_sample"),
    )
    rows = cleaned.select(key, "total_pages", "_sample", F.explode("_pages").alias("_page"))
    return rows.select(
        key,
        (F.col("_page.page") + 1).alias("page"),
        F.length("_page.text").alias("chars_raw"),
        F.left("_page.text", F.lit(V.PREVIEW_PAGE_CHARS)).alias("preview"),
        "total_pages",
        "_sample.*",
    )
