"""Inputs of the registered queries, derived from the driver's tables.

`plans/oracles.py` states the same derivations as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import fixed_values as V
from folioflow.functions import text as T
from folioflow.functions.scalars import part_indexes
from folioflow.operators.joins import unroll

PAGE_LINES = 5
QUESTIONS = 21
PLAN_VOICE = "v1"
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def _first_line() -> Column:
    return F.substring_index(F.col("text"), "\n", 1)


class Views:
    """Lazy DataFrames over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- documents -------------------------------------------------------
    def docs(self) -> DataFrame:
        return self.table("documents")

    def raw_docs(self) -> DataFrame:
        """Documents with page marks, which the driver's text lacks."""
        marked = F.concat(
            F.col("text"),
            F.lit("\n"),
            F.col("doc_id").cast("string"),
            F.lit("\nPágina "),
            F.col("doc_id").cast("string"),
            F.lit("\n- 3 -\nbody page 12\ntail  text"),
        )
        return self.docs().select("doc_id", marked.alias("text"))

    def uploads(self) -> DataFrame:
        """Files as they arrive; upload_id is the arrival order. Some hold no text."""
        i = F.col("doc_id")
        key = i.cast("string")
        text = F.when(i % 40 == 13, "\n 12 \n- 3 -").otherwise(F.col("text"))
        file_name = (
            F.when(i % 9 == 0, "_-_.pdf")
            .when(i % 9 == 1, F.concat(F.lit("notes "), key, F.lit(".txt")))
            .when(i % 9 == 2, F.concat("lang", F.lit("_vol-"), key, F.lit(".PDF")))
            .when(i % 9 == 3, F.concat(F.lit("x."), F.col("source"), F.lit(".pdf")))
            .otherwise(F.concat("source", F.lit("_doc-"), key, F.lit(".pdf")))
        )
        return self.docs().select(
            i.alias("upload_id"),
            file_name.alias("file_name"),
            F.when(i % 50 == 7, 0).otherwise(F.col("n_chars") * 2000).alias("size_bytes"),
            F.when(i % 8 == 3, F.lit(None))
            .when(i % 8 == 4, "")
            .otherwise("Novela")
            .alias("category"),
            text.alias("text"),
            F.when(i % 3 == 0, F.concat(F.lit("cover/"), key)).when(i % 3 == 1, "").alias("cover_url"),
            F.concat(F.lit("u"), (i % 7).cast("string")).alias("added_by"),
            T.file_hash(text).alias("file_hash"),
            F.expr(f"{EPOCH} + make_dt_interval(1, 0, 0, doc_id)").alias("arrived_at"),
        )

    def spans(self) -> DataFrame:
        """Text spans of 40 characters; five lines to a page, the outer two in its margins.

        Lines come two to a block, and spans of a line differ in size.
        """
        split = self.docs().select("doc_id", F.split("text", "\n").alias("_lines"))
        lines = unroll(split, ["doc_id"], "_lines", "pos", "line_text")
        row = F.col("pos") % PAGE_LINES
        cut = F.regexp_extract_all(F.col("line_text"), F.lit("(?s).{1,40}"), F.lit(0))
        spans = unroll(lines.withColumn("_spans", cut), ["doc_id", "pos"], "_spans", "span", "text")
        return spans.select(
            "doc_id",
            F.floor(F.col("pos") / PAGE_LINES).cast("int").alias("page"),
            F.floor(row / 2).cast("int").alias("block"),
            (row % 2).cast("int").alias("line"),
            "span",
            F.when(F.col("pos") % 13 == 12, 1).otherwise(0).alias("block_type"),
            (row * 190.0).alias("y0"),
            (row * 190.0 + 12).alias("y1"),
            F.lit(800.0).alias("page_height"),
            F.when(F.col("pos") % 7 == 0, 8.0)
            .when(F.col("span") % 4 == 1, 11.96)
            .when(F.col("span") % 4 == 2, 11.4)
            .when(F.col("span") % 4 == 3, 11.3)
            .otherwise(12.0)
            .alias("size"),
            "text",
        )

    def page_texts(self) -> DataFrame:
        """Plain text of every page, five lines each."""

        def page_list(lines):
            n_pages = F.ceil(F.size(lines) / PAGE_LINES).cast("int")
            return F.transform(
                F.sequence(F.lit(0), n_pages - 1),
                lambda p: F.array_join(F.slice(lines, p * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"),
            )

        pages = T.bind(F.split("text", "\n"), page_list)
        return unroll(
            self.docs().select("doc_id", pages.alias("_pages")), ["doc_id"], "_pages", "page", "text"
        )

    # --- catalog ---------------------------------------------------------
    def catalog(self, title: Column | None = None) -> DataFrame:
        """The books, titled by the first line of their text unless said otherwise."""
        i = F.col("doc_id")
        key = i.cast("string")
        return self.docs().select(
            i.alias("id"),
            (_first_line() if title is None else title).alias("title"),
            F.nullif(F.col("source"), F.lit("src0")).alias("author"),
            F.when(i % 4 != 1, F.concat(F.lit("cover/"), key)).alias("cover_url"),
            F.concat(F.lit("b"), key).alias("book_id"),
            F.when(i % 10 != 0, F.ceil(F.col("n_chars") / 1000.0).cast("int")).alias("parts_count"),
            F.when(i % 3 == 1, V.DEFAULT_VOICE)
            .when(i % 3 == 2, "es-ES-ElviraNeural")
            .alias("voice"),
            F.when(F.col("lang") == "fr", "Novela")
            .when(F.col("lang") == "de", "Historia")
            .when(F.col("lang") == "es", "Sin mapa")
            .when(i % 2 == 1, "")
            .alias("category"),
            T.file_hash(F.col("text")).alias("file_hash"),
            F.concat(F.lit("u"), (i % 7).cast("string")).alias("added_by"),
            F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, doc_id)").alias("created_at"),
            "lang",
        )

    def known_catalog(self) -> DataFrame:
        """Catalog state before the uploads: everything but the English books."""
        return self.catalog().where(F.col("lang") != "en").drop("lang")

    def probes(self) -> DataFrame:
        """Hashes that arriving files may have: the first, the last and one that no file has."""
        hashes = self.uploads().agg(F.min("file_hash").alias("low"), F.max("file_hash").alias("high"))
        return hashes.select(F.explode(F.array("low", "high", F.lit("none"))).alias("file_hash"))

    def parts_required(self) -> DataFrame:
        """Every declared part of every book in the planned voice."""
        return (
            self.catalog()
            .select("id", "book_id", F.explode(part_indexes(F.col("parts_count"))).alias("part_index"))
            .withColumn("voice", F.lit(PLAN_VOICE))
        )

    def stored_text(self) -> DataFrame:
        parts = self.parts_required()
        return parts.where((F.col("id") + F.col("part_index")) % 7 != 0).select("book_id", "part_index")

    def stored_audio(self) -> DataFrame:
        parts = self.parts_required()
        return parts.where((F.col("id") + F.col("part_index")) % 3 == 0).select(
            "book_id", "part_index", T.slug(F.col("voice")).alias("voice_slug")
        )

    def searchable(self) -> DataFrame:
        """Books with their whole text, on one line, as the title."""
        return self.catalog(F.translate("text", "\n", " "))

    # --- listening -------------------------------------------------------
    def _book(self, of: int):
        """A book for an event: each reader has up to `of` books, spread over all documents."""
        n = self.table("documents").agg(F.count("*")).scalar()
        return (F.col("user_id") * 31 + (F.col("event_id") % of) * 97) % n

    def events(self) -> DataFrame:
        return self.table("events").withColumn("book", self._book(8))

    def listening(self) -> DataFrame:
        """Player events with the part count of their book."""
        value = F.col("value")
        events = self.events().select(
            "user_id",
            F.col("book").alias("doc_id"),
            "ts",
            "event_id",
            F.when(F.col("event_type") == "view", "tick")
            .when(F.col("event_type") == "click", "ended")
            .when(F.col("event_type") == "signup", "duration")
            .when(F.col("event_type") == "error", "seek")
            .when(F.col("event_type") == "purchase", "restart")
            .alias("kind"),
            F.when(F.col("event_type") == "error", F.floor(value) % 6 - 1)
            .when((F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0), 0.0)
            .otherwise(value)
            .cast("double")
            .alias("value"),
        )
        books = self.table("documents").select(
            "doc_id",
            F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 200.0)).cast("int").alias("parts"),
        )
        return events.join(books, "doc_id").withColumnRenamed("doc_id", "global_book_id")

    def ticks(self) -> DataFrame:
        """Ticks of all events; some lack their user, some their time."""
        i = F.col("event_id")
        return self.table("events").select(
            F.when(i % 97 != 5, F.col("user_id")).alias("user_id"),
            F.when(i % 89 != 7, F.col("ts")).alias("ts"),
            i.alias("tick_id"),
        )

    def user_books(self) -> DataFrame:
        book = F.when(F.col("event_id") % 101 == 0, F.lit(-1)).otherwise(F.col("book"))
        first = F.min("event_id")
        return (
            self.events()
            .groupBy("user_id", book.alias("global_book_id"))
            .agg(
                F.when(first % 4 != 0, (F.floor(first / 7) % 3).cast("int")).alias("current_part_index"),
                F.max("value").alias("current_time"),
                F.when(F.count("*") % 3 != 0, F.min("value") * 10).alias("total_time"),
                ((F.floor(F.max("value")) % 3) * 50).cast("int").alias("progress"),
                F.min("ts").alias("added_at"),
            )
        )

    def changes(self, event_type: str) -> DataFrame:
        """Requests of one kind; the last two of a reader's ten books are not in the library."""
        return (
            self.table("events")
            .where(F.col("event_type") == event_type)
            .select(
                "user_id",
                self._book(10).alias("global_book_id"),
                "ts",
                "event_id",
                "value",
            )
        )

    def patches(self) -> DataFrame:
        """Partial updates: each one supplies only some of the fields."""
        i = F.col("event_id")
        return self.changes("view").select(
            "user_id",
            "global_book_id",
            "ts",
            "event_id",
            F.when(i % 2 == 0, (i % 9).cast("int")).alias("current_part_index"),
            F.when(i % 3 != 0, F.col("value")).alias("current_time"),
            F.when(i % 7 == 0, F.col("value") * 2).alias("total_time"),
            F.when(i % 5 == 0, (i % 101).cast("int")).alias("progress"),
        )

    def category_choices(self) -> DataFrame:
        """What readers chose for some of their books; some chose the entry for all."""
        return self.table("events").select(
            "user_id",
            self._book(5).alias("id"),
            F.element_at(
                F.array(*[F.lit(c) for c in V.CATEGORIES]),
                (F.col("event_id") % len(V.CATEGORIES) + 1).cast("int"),
            ).alias("category"),
            "ts",
            "event_id",
        )

    # --- clinic ----------------------------------------------------------
    def responses(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("session"),
            (F.col("event_id") % QUESTIONS).cast("int").alias("question"),
            (F.floor("value") % 4).cast("int").alias("value"),
            "ts",
            "event_id",
        )

    def results(self, n_domains: int) -> DataFrame:
        """Nested result per session: one score struct per domain, out of the possible score."""
        answers = self.responses().groupBy("session", "question").agg(
            F.max(F.struct("ts", "event_id", "value"))["value"].alias("value")
        )
        domains = answers.groupBy("session", (F.col("question") % n_domains).alias("domain")).agg(
            F.sum("value").cast("int").alias("score"), (F.count("*") * 3).cast("int").alias("max_score")
        )
        percentile = F.floor(F.col("score") * 100 / F.col("max_score")).cast("int")
        return domains.groupBy("session").agg(
            F.sort_array(
                F.collect_list(F.struct("domain", "score", "max_score", percentile.alias("percentile")))
            ).alias("domain_scores")
        )

    def patients(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("diagnosis"),
            F.when(F.col("c_acctbal") < 0, "inactive")
            .when(F.col("c_acctbal") > 5000, "completed")
            .otherwise("active")
            .alias("status"),
        )

    def appointments(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("patient_id"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "initial")
            .when(F.col("o_orderpriority") == "2-HIGH", "assessment")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "followup")
            .otherwise(F.col("o_orderpriority"))
            .alias("type"),
            F.when(F.col("o_orderstatus") == "O", "scheduled")
            .when(F.col("o_orderstatus") == "F", "completed")
            .otherwise("cancelled")
            .alias("status"),
        )

    def feed(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            _first_line().alias("title"),
            F.col("text").alias("summary"),
            "source",
            F.upper("lang").alias("category"),
            F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 == 0).alias("is_new"),
        )

    def tests(self) -> DataFrame:
        def pick(divisor: int, names: list[str]):
            codes = F.array(*[F.lit(n) for n in names])
            return F.element_at(codes, F.col("p_size") % divisor + 1)

        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("short_name"),
            pick(6, ["cognitive", "personality", "mood", "anxiety", "trauma", "other"]).alias("category"),
            pick(3, ["high", "moderate", "experimental"]).alias("validity"),
            pick(5, ["minimal", "mild", "moderate", "severe", "none"]).alias("severity"),
        )

    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            "conv_id",
            "turn",
            "role",
            F.when(F.col("turn") % 3 == 2, "evidence").otherwise("reasoning").alias("type"),
            F.when(F.col("turn") % 5 == 4, " \t ").otherwise(F.col("text")).alias("content"),
        )

    def sources(self) -> DataFrame:
        """Every line of a text is an author; some sources have none."""
        lines = F.filter(F.split("text", "\n"), lambda line: line != "")
        none = F.array().cast("array<string>")
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.when(F.col("doc_id") % 5 == 0, none).otherwise(lines).alias("authors"),
            (F.col("doc_id") % 35 + 1990).cast("int").alias("year"),
        )

    def accounts(self) -> DataFrame:
        i = F.col("c_custkey")
        return self.table("customer").select(
            i.alias("id"),
            F.when(i % 3 == 1, "").when(i % 3 == 2, F.col("c_name")).alias("full_name"),
            F.concat(
                F.lower(F.translate("c_name", "#", ".")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")
            ).alias("email"),
        )
