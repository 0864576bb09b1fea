"""Packing by concatenation: all documents in one line of tokens, cut into equal windows.

First pass: every partition writes its documents' ids with their offset inside the partition.
Second pass: the partitions' totals are summed up to each partition's global offset (one number
per partition), and every document is cut at the multiples of the window. A document that crosses
a window's edge gives a record on either side, so each id lies in exactly one piece.

Cases: a null or empty text is the end token alone. Repeated rows are packed each. A document
longer than a window fills several. An empty table gives an empty result. Columns other than the
named ones are dropped. Only the last window can be partly filled; `padded` is its length: the window,
or a power of two if the fill is just that.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.chunks import ChunkCoder
from folioflow.llm.common import by_bytes, give_back, stage, table

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for the faster library.
RANKS = "byte_bpe_50k.tiktoken"
END = 1
#: Chunks whose ids a Python worker keeps.
CACHED = 600_000
STAGED = "part int, start long, doc_id long, doc_tokens long, ids binary"


class TextIds:
    """Ids of whole texts as the vocabulary's own library gives them, without special tokens.

    Chunks of Latin letters, digits and signs go through the rank file, which gives the same ids
    (tests compare them) several times faster; chunks with other characters, and texts that hold
    a special token's string, go to the library itself.
    """

    LATIN = re.compile(r"[\n -~¡-ɏ]*")

    def __init__(self, path: str, ranks: str, pattern: str, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.chunks = ChunkCoder(self._whole, cached)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        if self.LATIN.fullmatch(text):
            return np.array(self.ranked.encode_ordinary(text), "<u4").tobytes()
        return self._library(text)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._library(text)
        return self.chunks.ids(text)


@lru_cache(maxsize=2)
def text_ids(path: str, ranks: str, pattern: str, cached: int = CACHED) -> TextIds:
    """One per Python worker, which keeps it."""
    return TextIds(path, ranks, pattern, cached)


def tokenized(
    docs: DataFrame, path: str, ranks: str, pattern: str, end: int, cached: int = CACHED, keep: bool = True
) -> DataFrame:
    """Each document's ids and its offset among the tokens of its partition."""
    last = np.array([end], "<u4").tobytes()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = (text_ids if keep else TextIds)(path, ranks, pattern, cached).ids
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in by_bytes([batch], "text"):
                coded = [ids(x or "") + last for x in piece.column("text").to_pylist()]
                sizes = np.array([len(x) // 4 for x in coded], np.int64)
                ends = at + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(coded), part, np.int32)),
                        pa.array(ends - sizes),
                        piece.column("doc_id"),
                        pa.array(sizes),
                        pa.array(coded, pa.binary()),
                    ],
                    ["part", "start", "doc_id", "doc_tokens", "ids"],
                )
                at = int(ends[-1])
        ids = batch = piece = coded = None
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over, STAGED)


def pack(
    docs: DataFrame,
    window: int = 2048,
    path: str | None = None,
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    end: int = END,
    cached: int = CACHED,
    keep: bool = True,
) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, padded, ids (binary).

    start counts the document's ids before the piece, offset the sequence's ids before it. A Python
    worker keeps the ids of about `cached` different chunks of text, some 170 bytes each, and the
    tokenizers: for all its partitions, or unless `keep` until the end of each.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ranks = ranks or public_tokenizers.path(RANKS)
    staged = stage(tokenized(docs, path, ranks, pattern, end, cached, keep))
    # One row per partition of the input: a sum over them in one task, sent to all.
    totals = staged.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    every = totals.agg(F.sum("tokens").alias("every"))
    placed = (
        staged.join(F.broadcast(bases.join(F.broadcast(every))), "part")
        .withColumn("first", F.col("base") + F.col("start"))
        .withColumn("last", F.col("first") + F.col("doc_tokens") - 1)
    )
    size = F.lit(window).cast("long")
    floor = lambda c: F.expr(f"{c} div {window}")

    def piece(sequence):
        begin = F.greatest(F.col("first"), sequence * size)
        length = F.least(F.col("last") + 1, (sequence + 1) * size) - begin
        start = begin - F.col("first")
        # Only the substring is kept: a long document's ids aren't copied for each window.
        cut = F.col("ids").substr((start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(
            start.alias("start"),
            length.alias("length"),
            sequence.alias("sequence_id"),
            (begin - sequence * size).alias("offset"),
            cut.alias("ids"),
        )

    pieces = F.transform(F.sequence(floor("first"), floor("last")), piece)
    fill = F.least(F.col("every") - F.col("sequence_id") * size, size)
    power = F.lit(2).cast("double") ** F.ceil(F.log2(fill.cast("double")))
    return (
        placed.select("doc_id", "doc_tokens", "every", pieces.alias("pieces"))
        .select("doc_id", "doc_tokens", "every", F.inline("pieces"))
        .select(
            "doc_id",
            "start",
            "length",
            "doc_tokens",
            "sequence_id",
            "offset",
            F.when(power == fill, fill).otherwise(size).alias("padded"),
            "ids",
        )
    )


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
