"""A training corpus from raw documents, stage by stage.

Toxic documents go, then documents whose language is not recognised, then all but one document of
each near-duplicate class; what is left is packed into sequences. Each stage works on all rows its
predecessor kept and keeps the columns of documents; the last gives the pieces of the sequences.

Cases: documents without a label are judged by the model like all others. Null texts have no words
and no language, so the second stage rejects them. A row whose doc_id is null is not learned from
and has no class, so the third stage keeps it. Rows with one doc_id and different texts are judged each; of
rows with one doc_id and text that stage keeps one. Empty tables pass through. Extra columns are kept
up to the last stage, also those with names that the stages use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import dart_minhash, language_id, packing, toxicity
from folioflow.llm.common import shared_dir, stage, table

TOXIC = 0.7
CACHED = 150_000


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs begins with, also not after another underscore."""
    while any(c.lower().startswith((name, f"_{name}")) for c in docs.columns):
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; learns from all labelled documents.

    Without labels of both classes there is no model, and all documents stay.
    """
    model = toxicity.train(docs.where(F.col("doc_id").isNotNull()), table(spark, sf_dir, "labels"))
    if model.model is None:
        return docs
    name = unused(docs, "_toxicity")
    scored = toxicity.score_texts(docs, model, output=name)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learns from the languages given."""
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    model = language_id.train(known)
    prefix = unused(docs, "_lang")
    found = language_id.identify(docs, model, prefix=prefix)
    return found.where(~F.col(f"{prefix}_rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that whose doc_id and text name the class."""
    classes = stage(dart_minhash.near_duplicates(docs))
    own = (F.col("doc_id") == F.col("class_id")) & F.col("digest").eqNullSafe(F.col("class_digest"))
    digest, row = unused(docs, "_digest"), unused(docs, "_row")
    named = classes.where(own).select(F.col("doc_id"), F.coalesce("digest", F.lit(b"")).alias(digest)).distinct()
    marked = docs.where(F.col("doc_id").isNotNull())
    marked = marked.withColumn(digest, F.coalesce(dart_minhash.text_digest(F.col("text")), F.lit(b"")))
    kept = marked.join(named, ["doc_id", digest], "left_semi")
    others = F.struct(*[c for c in docs.columns if c != "doc_id"])
    one = kept.groupBy("doc_id", digest).agg(F.min_by(others, F.struct("text")).alias(row))
    return one.select("doc_id", f"{row}.*").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; the workers of earlier stages leave less room for cached ids.

    Tokenizers go after each partition. Tasks take idle workers in turn, so all of them would keep some.
    """
    return packing.digests(packing.pack(docs, cached=CACHED, keep=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_recognised),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
