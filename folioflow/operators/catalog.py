"""Catalog and personal library views, shelves and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions.scalars import or_default

#: Slices of a reader's books that are cut on their own when pages are asked for by their last book.
PAGE_SLICES = 16
BOOK_COLUMNS = [
    "id",
    "title",
    "author",
    "cover_url",
    "progress",
    "duration",
    "current_time",
    "total_time",
    "added_at",
    "book_id",
    "parts_count",
    "current_part_index",
    "voice",
    "category",
    "file_hash",
]


def book_view(rows: DataFrame, *extra: str) -> DataFrame:
    """Joined catalog and progress rows with the view's defaults."""
    return rows.select(
        *extra,
        "id",
        "title",
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("cover_url", F.lit("")).alias("cover_url"),
        F.coalesce("progress", F.lit(0)).alias("progress"),
        F.lit("").alias("duration"),
        F.coalesce("current_time", F.lit(0.0)).alias("current_time"),
        F.coalesce("total_time", F.lit(0.0)).alias("total_time"),
        "added_at",
        "book_id",
        F.coalesce("parts_count", F.lit(1)).alias("parts_count"),
        F.coalesce("current_part_index", F.lit(0)).alias("current_part_index"),
        "voice",
        "category",
        "file_hash",
    )


def catalog_view(catalog: DataFrame) -> DataFrame:
    """Every catalog row as a book without personal progress, newest first."""
    rows = catalog.select(
        "id",
        "title",
        "author",
        "cover_url",
        F.lit(0).alias("progress"),
        F.lit(0.0).alias("current_time"),
        F.lit(0.0).alias("total_time"),
        F.col("created_at").alias("added_at"),
        "book_id",
        "parts_count",
        F.lit(0).alias("current_part_index"),
        "voice",
        "category",
        "file_hash",
    )
    return book_view(rows).orderBy(F.desc_nulls_first("added_at"), "id")


def _with_parent(user_books: DataFrame, catalog: DataFrame) -> DataFrame:
    parents = catalog.drop("lang", "added_by", "created_at").withColumnRenamed("id", "global_book_id")
    joined = user_books.join(parents.withColumn("_found", F.lit(True)), "global_book_id", "left")
    return joined.withColumnRenamed("global_book_id", "id")


def user_library(user_books: DataFrame, catalog: DataFrame, user_id=None) -> DataFrame:
    """Personal books with their catalog data, newest first."""
    if user_id is not None:
        user_books = user_books.where(F.col("user_id") == user_id)
    rows = _with_parent(user_books, catalog).where("_found")
    return book_view(rows, "user_id").orderBy("user_id", F.desc_nulls_first("added_at"), "id")


def library_page(
    user_books: DataFrame, catalog: DataFrame, size: int, after: DataFrame | None = None
) -> DataFrame:
    """One page of every reader's library, newest first; `place` counts from 1 within the page.

    after: user_id, added_at and id of the last book a reader has seen, at most one row a reader;
    readers without one get their first page. A reader has a book once, so this names a
    place in the order of `user_library`, and books that come or go before it move no page.

    The order needs progress rows only: a reader is cut to `size` rows before the shuffle by reader,
    and only the pages meet the catalog's columns. Nothing is sorted as a whole. Rows meet `after` by
    reader and one of `PAGE_SLICES` slices of the books, each cut to `size` rows, so a reader with very
    many books lies in several tasks.
    """
    known = catalog.select(F.col("id").alias("global_book_id"))
    rows = user_books.join(known, "global_book_id", "left_semi")
    order = [F.desc_nulls_first("added_at"), F.col("global_book_id")]
    if after is not None:
        slices = F.explode(F.sequence(F.lit(0), F.lit(PAGE_SLICES - 1))).alias("_slice")
        seen = F.struct(F.col("added_at").alias("at"), F.col("id").alias("book"))
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64("global_book_id"), F.lit(PAGE_SLICES)).cast("int"))
        seen_by = after.select("user_id", seen.alias("_seen"), slices)
        rows = rows.join(seen_by, ["user_id", "_slice"], "left")
        at, book = F.col("_seen.at"), F.col("_seen.book")
        later = F.col("added_at").eqNullSafe(at) & (F.col("global_book_id") > book)
        older = F.col("added_at").isNotNull() & (at.isNull() | (F.col("added_at") < at))
        rows = rows.where(F.col("_seen").isNull() | later | older)
        in_slice = F.row_number().over(Window.partitionBy("user_id", "_slice").orderBy(*order))
        rows = rows.withColumn("_n", in_slice).where(F.col("_n") <= size).drop("_seen", "_slice", "_n")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    page = rows.withColumn("place", place).where(F.col("place") <= size)
    return book_view(_with_parent(page, catalog).where("_found"), "user_id", "place")


def orphan_rows(user_books: DataFrame, catalog: DataFrame) -> DataFrame:
    """Personal rows whose book left the catalog, counted per book."""
    keys = catalog.select(F.col("id").alias("global_book_id"))
    per_book = user_books.groupBy("global_book_id").agg(F.count("*").alias("rows"))
    return per_book.join(keys, "global_book_id", "left_anti")


def continue_shelf(library: DataFrame) -> DataFrame:
    return library.where((F.col("progress") > 0) & (F.col("progress") < 100))


def history(library: DataFrame) -> DataFrame:
    return library.where(F.col("progress") > 0).orderBy(
        "user_id", F.desc_nulls_first("added_at"), "id"
    )


def in_category(books: DataFrame, category: str) -> DataFrame:
    if category == V.ALL_CATEGORIES:
        return books
    return books.where(or_default(F.col("category"), V.NO_CATEGORY) == category)


def text_search(df: DataFrame, columns: list[str], query: str, trim: bool = False) -> DataFrame:
    """Rows with the query, in any case, in one of the columns. '' keeps all rows."""
    needle = query.lower()
    if trim:
        needle = needle.strip()
    if not needle:
        return df
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return df.where(found)


def catalog_search(books: DataFrame, query: str) -> DataFrame:
    return text_search(books, ["title", "author", "category"], query, trim=True)


def category_list(spark: SparkSession, without: tuple[str, ...] = ()) -> DataFrame:
    """The fixed category list with its order."""
    names = F.array(*[F.lit(c) for c in V.CATEGORIES])
    listed = spark.range(1).select(F.posexplode(names).alias("ord", "category"))
    return listed.where(~F.col("category").isin(*without)) if without else listed


def used_categories(books: DataFrame) -> DataFrame:
    """Listed categories that occur, in list order, after the entry for all."""
    spark = books.sparkSession
    used = books.select(or_default(F.col("category"), V.NO_CATEGORY).alias("category")).distinct()
    listed = category_list(spark, without=(V.ALL_CATEGORIES,))
    first = category_list(spark).where(F.col("category") == V.ALL_CATEGORIES)
    kept = used.join(F.broadcast(listed), "category", "inner").select("ord", "category")
    return first.unionByName(kept).orderBy("ord")


def resolve_play(requests: DataFrame, user_books: DataFrame, catalog: DataFrame) -> DataFrame:
    """Book to play per request: the personal row if there is one, else the
    catalog row, which `to_add` marks as new to the library."""
    wanted = requests.select("user_id", "global_book_id").distinct()
    personal = user_books.withColumn("_personal", F.lit(True))
    rows = wanted.join(personal, ["user_id", "global_book_id"], "left")
    parents = catalog.drop("lang", "added_by").withColumnRenamed("id", "global_book_id")
    joined = rows.join(parents, "global_book_id").withColumnRenamed("global_book_id", "id").select(
        "*",
        F.col("_personal").isNull().alias("to_add"),
    )
    since = F.when(F.col("to_add"), F.col("created_at")).otherwise(F.col("added_at"))
    return book_view(joined.withColumn("added_at", since), "user_id", "to_add")


def category_override(library: DataFrame, choices: DataFrame) -> DataFrame:
    """Books as each reader sees them after moving some; a reader's last choice counts.

    The entry for all books is no category, so a choice of it is not taken.
    """
    last = (
        choices.where(F.col("category") != V.ALL_CATEGORIES)
        .groupBy("user_id", "id")
        .agg(F.max_by("category", F.struct("ts", "event_id")).alias("_chosen"))
    )
    joined = library.join(last, ["user_id", "id"], "left")
    return joined.withColumn("category", F.coalesce("_chosen", "category")).drop("_chosen")
