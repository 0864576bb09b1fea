"""Byte-level BPE as a tree reduction over pieces of text, and its inverse.

A piece (one match of the tokenizer's pattern) is halved until its parts are short, the parts are
merged directly, and neighbours are joined on the way up. A join puts the two token lists together
if the pair at the seam is stable, that is if encoding the bytes of the two tokens gives the two
tokens. Otherwise it encodes a window of tokens around the seam anew and doubles the window until
the pairs at its two edges are stable. A list in which every adjacent pair is stable is the
encoding of its bytes, so what lies outside the window is then final. Decoding concatenates
halves up the tree.

Texts are first cut where no match can cross (chunks.py); there a join is concatenation. A worker
keeps the ids of frequent chunks and pieces in tables of bounded size.

Cases: a null text is empty, an empty text has no ids. Texts of any length are encoded whole; one
text is the smallest unit of work. Repeated rows each give a row. Ids that are not in the ranks,
and a byte length that four does not divide, raise an error in decoding; null ids decode to
nothing. An empty table gives an empty result. Columns other than the named ones are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.chunks import Cache, ChunkCoder
from folioflow.llm.common import by_bytes, table

RANKS = "byte_bpe_50k.tiktoken"
NEVER = 1 << 60


def _white(pattern: str) -> str:
    """The pattern with white space as Unicode defines it; the regex module's \\s has more."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class TreeEncoder:
    def __init__(self, path: str, pattern: str, leaf_bytes: int = 16, cached: int = 600_000):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.words = {rank: token for token, rank in self.ranks.items()}
        self.leaf_bytes = leaf_bytes
        self.pattern = regex.compile(_white(pattern))
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Cache(self._packed_piece, cached // 2)
        self.chunks = ChunkCoder(self._whole, cached)

    def merged(self, data: bytes) -> list[int]:
        """Repeatedly merge the adjacent pair of lowest rank, the leftmost first."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (lowest := min(pairs)) != NEVER:
            at = pairs.index(lowest)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NEVER)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
        return [self.ranks[part] for part in parts]

    def stable(self, left: int, right: int) -> bool:
        known = self.stable_pairs.get((left, right))
        if known is None:
            known = self.merged(self.words[left] + self.words[right]) == [left, right]
            if len(self.stable_pairs) >= 500_000:
                self.stable_pairs.clear()
            self.stable_pairs[left, right] = known
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            begin, end = max(0, len(left) - width), min(len(right), width)
            window = self.merged(b"".join(map(self.words.__getitem__, left[begin:] + right[:end])))
            if (begin == 0 or self.stable(left[begin - 1], window[0])) and (
                end == len(right) or self.stable(window[-1], right[end])
            ):
                return left[:begin] + window + right[end:]
            width *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match; a match that is a token itself is taken whole."""
        rank = self.ranks.get(data)
        return self.tree(data) if rank is None else [rank]

    def _packed_piece(self, piece: str) -> bytes:
        return np.array(self.piece(piece.encode()), "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        if text.isascii() and (text[1:] if text[:1] == " " else text).isalpha():
            return self.pieces[text] if len(text) < 64 else self._packed_piece(text)
        return b"".join(
            [
                self.pieces[p] if len(p) < 64 else self._packed_piece(p)
                for p in self.pattern.findall(text)
            ]
        )

    def encode(self, text: str) -> bytes:
        return self.chunks.ids(text)

    def decode(self, ids: bytes, leaf: int = 4096) -> bytes:
        def up(part: list[int]) -> bytes:
            if len(part) <= leaf:
                return b"".join(map(self.words.__getitem__, part))
            half = len(part) // 2
            return up(part[:half]) + up(part[half:])

        if len(ids) % 4:
            raise ValueError(f"{len(ids)} bytes are no 32-bit ids")
        return up(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TreeEncoder:
    """One encoder per Python worker."""
    return TreeEncoder(path, pattern)


def _mapped(df: DataFrame, key: str, source: str, target: str, make) -> DataFrame:
    """Rows (key, target): make() gives the function from a value of `source`."""
    one = df.select(F.col(key), F.col(source).alias(target))
    schema = one.withColumn(target, F.col(target).cast("binary")).schema

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            for part in by_bytes([batch], target):
                values = [change(x) for x in part.column(target).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(values, pa.binary())], [key, target])

    return one.mapInArrow(over, schema)


def encode_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """key and ids (binary, little-endian unsigned 32-bit) of every text."""
    path = path or public_tokenizers.path(RANKS)

    def make():
        encode = encoder(path, pattern).encode
        return lambda x: encode(x or "")

    return _mapped(docs, key, text, "ids", make)


def decode_ids(
    coded: DataFrame,
    key: str = "doc_id",
    ids: str = "ids",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """key and bytes (binary) of every row of ids."""
    path = path or public_tokenizers.path(RANKS)

    def make():
        decode = encoder(path, pattern).decode
        return lambda x: decode(x or b"")

    return _mapped(coded, key, ids, "bytes", make)


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded in one pass: the ids travel beside what they decode to."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    coded = encode_texts(docs, "doc_id", "text", path, pattern)
    keyed = coded.select(
        F.struct(
            "doc_id",
            (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"),
        ).alias("doc"),
        "ids",
    )
    return decode_ids(keyed, "doc", "ids", path, pattern).select(
        "doc.*", F.sha2("bytes", 256).alias("decoded_sha256")
    )
