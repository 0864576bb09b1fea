"""Exact top-k search by inner product, term at a time.

Vectors are rows of integer weights; a component's position is its term. Candidates of a
block become postings (row, weight) per term. For each term the queries that have it scatter
their weight times the postings into a dense score array, the block's best rows are selected,
and the blocks' selections are merged.

Cases: vectors that are null or hold null components take no part, on either side. Vectors may
differ in length; a missing component weighs nothing. A query never meets candidates of its own
id. Every query row is searched; rows of one query id share one ranking, which holds a candidate
once for each of them. Repeated candidate rows each count. Null ids take no part. Empty tables give empty results. Other columns
of either table are ignored. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import stage, table

RESULT = "query_id long, vec_id long, score long"


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, null for vectors that take no part."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(
        as_double,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
    )
    return F.when(usable, F.transform(as_double, lambda x: F.floor(x * scale)))


def _dense(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = vector
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _accumulate(weights: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores of a block's rows for all queries, one term after the other."""
    scores = np.zeros((len(weights), len(block)), np.int64)
    for term in range(min(weights.shape[1], block.shape[1])):
        rows = np.flatnonzero(block[:, term])
        asking = np.flatnonzero(weights[:, term])
        if not len(rows) or not len(asking):
            continue
        added = weights[asking, term][:, None] * block[rows, term]
        if len(rows) == len(block) and len(asking) == len(weights):
            scores += added
        else:
            scores[np.ix_(asking, rows)] += added
    return scores


def _search(
    ids: np.ndarray, copies: np.ndarray, weights: np.ndarray, k: int, block_rows: int, query_rows: int
):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held = [(none, none)] * len(ids)
        for batch in batches:
            for begin in range(0, batch.num_rows, block_rows):
                part = batch.slice(begin, block_rows)
                own = np.asarray(part.column("vec_id").to_numpy(zero_copy_only=False), np.int64)
                vectors = part.column("vector").to_pylist()
                block = _dense(vectors, max(map(len, vectors), default=0))
                for first in range(0, len(ids), query_rows):
                    scores = _accumulate(weights[first : first + query_rows], block)
                    for at, row in enumerate(scores, first):
                        others = own != ids[at]
                        if not others.all():
                            row, near = row[others], own[others]
                        else:
                            near = own
                        at_block = _best(row, near, k)
                        s = np.concatenate((held[at][0], row[at_block]))
                        v = np.concatenate((held[at][1], near[at_block]))
                        keep = _best(s, v, k)
                        held[at] = (s[keep], v[keep])
        held = [(np.repeat(s, n), np.repeat(v, n)) for (s, v), n in zip(held, copies)]
        sizes = [len(s) for s, _ in held]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, sizes)),
                pa.array(np.concatenate([v for _, v in held] or [none])),
                pa.array(np.concatenate([s for s, _ in held] or [none])),
            ],
            ["query_id", "vec_id", "score"],
        )

    return over


def topk_search(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 10,
    query_block: int = 4096,
    block_rows: int = 2048,
    query_rows: int = 64,
) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score.

    Both tables hold vec_id long and vector array<long>. Queries are taken in blocks of
    about `query_block` distinct rows, dealt by a hash of the whole row; equal rows are searched
    once and counted. Of several blocks, one is brought to the driver and sent to the tasks, its
    selections are written, and only then the next is read, so what the driver and a plan hold is
    one block. Each block reads the candidates once. A task keeps k rows a query, and a query's
    selections meet in a window that is cut to k rows before its shuffle.
    """
    usable = F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    usable = usable & F.forall("vector", lambda x: x.isNotNull())
    asked = queries.select("vec_id", "vector").where(usable)
    asked = asked.groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
    searched = candidates.select("vec_id", "vector").where(usable)
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)))
    if blocks > 1:
        asked = stage(asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    def search(block: int) -> DataFrame:
        rows = asked.where(F.col("_block") == block).drop("_block").collect()
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        copies = np.array([min(r["copies"], k) for r in rows], np.int64)
        weights = _dense([r["vector"] for r in rows], max((len(r["vector"]) for r in rows), default=0))
        task = _search(ids, copies, weights, k, block_rows, query_rows)
        return best(searched.mapInArrow(task, RESULT))

    if blocks == 1:
        return search(0)
    selected = [stage(search(block)) for block in range(blocks)]
    return best(reduce(DataFrame.unionAll, selected))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", quantized(F.col("embedding")).alias("vector")
    )
    return topk_search(rows.where(F.col("vec_id") % 100 == 0), rows, k=10)


OP7_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1),
                                        lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
