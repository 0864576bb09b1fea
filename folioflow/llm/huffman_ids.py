"""Token ids as files of canonical, length-limited Huffman codes.

First pass: documents become ids, which are written once, and counted; the counts, at most one per
entry of the vocabulary, give the code lengths (package-merge, optimal under the limit) and these
alone make the code, as codes of one length follow the ids' order. Second pass: documents are put
in the order of their doc_id by range partitioning, and every partition writes files of about
`file_ids` ids. Codes follow each other without gaps; every `block` ids a checkpoint holds the bit at
which the next block begins. So blocks are independent: the reader looks up the next `longest` bits
of all blocks at once in a table that gives the id and how many bits it took, and a part of a file is
decoded from its own blocks only.

A file: HEADER, doc ids (int64), null marks (uint8), sizes (uint64), checkpoints (uint64), codes (most
significant bit first), crc32 of all that. It knows how many ids of its partition come before it; an index
of one row per partition gives the rest. A codebook file holds a length per id. Numbers are
little-endian.

Cases: a null or empty text is the end token alone. Rows with one doc_id are written each, in the
order of the input; null doc_ids come first. A document is never cut by a file, so a file with a very long one is
longer. With one distinct id, its code has one bit. An empty table gives a codebook without codes and
no file. Other columns are ignored. A damaged file, or one of another codebook, raises.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import by_bytes, give_back, stage, table
from folioflow.llm.packing import RANKS, VOCABULARY, text_ids

END = 2
#: Bits of the longest code; tables have two to that power entries.
LONGEST = 20
#: Ids between two checkpoints.
BLOCK = 256
FILE_IDS = 1 << 20
#: Ids that a partition of the ordered documents holds about.
PART_IDS = 1 << 23

#: Fixed values of the format: magic, version, bits of the longest code, crc32 of the codebook,
#: documents, ids, ids of the partition before this file, ids in a block, bytes of codes.
HEADER = struct.Struct("<4sHHIQQQIQ")
MAGIC, VERSION = b"HFID", 1
BOOK = struct.Struct("<4sHHI")
BOOK_MAGIC = b"HFCB"

CODED = "doc_id long, at long, n long, ids binary"
FILES = "path string, part int, start long, n_ids long, content binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of an optimal code of at most `longest` bits for each count; 0 where the count is 0.

    Package-merge: at each of `longest` levels the symbols meet the pairs of the level before, in
    order of weight. A symbol's length is the number of levels in whose cheapest part it is.
    """
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols don't fit in codes of {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used]
    # Of each level, how many symbols are among its first so many items.
    level, symbols = weights, [np.arange(1, len(weights) + 1)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weights, pairs))
        order = np.argsort(both, kind="stable")
        level = both[order]
        symbols.append(np.cumsum(order < len(weights)))
    taken, bits = 2 * len(used) - 2, np.zeros(len(used) + 1, np.int64)
    for among in reversed(symbols):
        own = int(among[taken - 1]) if taken else 0
        bits[0] += 1
        bits[own] -= 1
        taken = 2 * (taken - own)
    lengths[used] = np.cumsum(bits)[:-1]
    return lengths


class Codebook:
    """Codes and decoding table of a length per id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.longest = int(self.lengths.max(initial=0)) or 1
        if self.longest > LONGEST:
            raise ValueError(f"codes of {self.longest} bits")
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        sizes = self.lengths[used].astype(np.int64)
        # A code takes a share of the table; the shares of those before it are where it begins.
        share = np.int64(1) << (self.longest - sizes)
        begin = np.cumsum(share) - share
        if share.sum() > 1 << self.longest:
            raise ValueError("more codes than their lengths allow")
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[used] = begin >> (self.longest - sizes)
        #: Id and length of the code that the next bits begin with; 0 where there is none.
        self.table = np.zeros(1 << self.longest, np.uint32)
        self.table[: share.sum()] = np.repeat((used << 5 | sizes).astype(np.uint32), share)

    def to_bytes(self) -> bytes:
        return BOOK.pack(BOOK_MAGIC, VERSION, self.longest, len(self.lengths)) + self.lengths.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Codebook:
        magic, version, longest, size = BOOK.unpack_from(raw)
        if magic != BOOK_MAGIC or version != VERSION or len(raw) != BOOK.size + size:
            raise ValueError("no codebook")
        return cls(np.frombuffer(raw, np.uint8, size, BOOK.size))

    def crc(self) -> int:
        return zlib.crc32(self.to_bytes())


def encode(ids: np.ndarray, book: Codebook, block: int = BLOCK, step: int = 1 << 15) -> tuple[bytes, np.ndarray]:
    """The ids' codes one after the other, and the bit at which every block begins; works on `step` ids at a time."""
    sizes = book.lengths[ids]
    if len(sizes) and not sizes.min():
        raise ValueError(f"no code for id {ids[np.argmin(sizes)]}")
    bits = int(sizes.sum(dtype=np.int64))
    out, marks, at = np.zeros(bits // 64 + 2, np.uint64), [np.empty(0, np.int64)], 0
    for first in range(0, len(ids), step):
        own = sizes[first : first + step].astype(np.int64)
        begin = np.cumsum(own)
        begin += at - own
        at = int(begin[-1] + own[-1])
        marks.append(begin[-first % block :: block])
        word, codes = begin >> 6, book.codes[ids[first : first + step]]
        left = 64 - (begin & 63) - own
        over = np.flatnonzero(left < 0)
        placed = codes << left.astype(np.uint64)
        placed[over] = codes[over] >> (-left[over]).astype(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[new]] |= np.bitwise_or.reduceat(placed, new)
        # At most one code crosses the end of a word.
        out[word[over] + 1] |= codes[over] << (64 + left[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (bits + 7) // 8], np.concatenate(marks).astype(np.uint64)


def decode(codes: bytes, checkpoints: np.ndarray, n: int, book: Codebook, block: int = BLOCK) -> np.ndarray:
    """n ids from the first checkpoint on; the blocks advance side by side, one id a step."""
    if not n:
        return np.empty(0, np.uint32)
    words = np.frombuffer(codes + bytes(12 + -len(codes) % 4), ">u4").astype(np.uint64)
    windows = words[:-1] << np.uint64(32) | words[1:]
    at = checkpoints.astype(np.int64)
    table, drop = book.table, np.uint64(64 - book.longest)
    out = np.empty((min(block, n), len(at)), np.uint32)
    in_last, end = n - block * (len(at) - 1), 0
    try:
        for step in range(len(out)):
            if step == in_last:
                at, end = at[:-1], at[-1]
            found = table[windows[at >> 5] << (at & 31).astype(np.uint64) >> drop]
            out[step, : len(at)] = found >> 5
            at = at + (found & 31)
    except IndexError as e:
        raise ValueError("codes are cut off or damaged") from e
    at = np.append(at, end) if end else at
    if (at[:-1] != checkpoints[1:]).any() or at[-1] > 8 * len(codes):
        raise ValueError("codes are cut off or damaged")
    return out.T.reshape(-1)[:n]


def pack_file(doc_ids: list, ids: list[np.ndarray], before: int, book: Codebook, block: int = BLOCK) -> bytes:
    """One file of documents in their order; `before` counts the partition's ids before them."""
    sizes = np.array([len(x) for x in ids], np.uint64)
    codes, checkpoints = encode(np.concatenate(ids), book, block)
    raw = b"".join(
        [
            HEADER.pack(
                MAGIC, VERSION, book.longest, book.crc(), len(ids), int(sizes.sum()), before, block, len(codes)
            ),
            np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            sizes.tobytes(),
            checkpoints.tobytes(),
            codes,
        ]
    )
    return raw + struct.pack("<I", zlib.crc32(raw))


class IdFile:
    """A file's documents and, on demand, their ids."""

    def __init__(self, raw: bytes, book: Codebook):
        if len(raw) < HEADER.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("file is cut off or damaged")
        magic, version, longest, crc, docs, n, before, block, size = HEADER.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("no file of ids")
        if crc != book.crc() or longest != book.longest:
            raise ValueError("file belongs to another codebook")
        self.book, self.n, self.before, self.block = book, n, before, block
        at = HEADER.size

        def numbers(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, count, at)
            at += found.nbytes
            return found

        self.doc_ids, self.missing = numbers("<i8", docs), numbers("u1", docs).astype(bool)
        self.sizes = numbers("<u8", docs).astype(np.int64)
        self.checkpoints = numbers("<u8", -(-n // block))
        self.codes = raw[at : at + size]
        self.ends = np.cumsum(self.sizes)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end of the file, from the blocks that hold them."""
        end = self.n if end is None else min(end, self.n)
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.block, -(-end // self.block)
        n = min(last * self.block, self.n) - first * self.block
        marks = self.checkpoints[first:last]
        byte = int(marks[0]) // 8
        stop = -(-int(self.checkpoints[last]) // 8) if last < len(self.checkpoints) else len(self.codes)
        found = decode(self.codes[byte:stop], marks - np.uint64(8 * byte), n, self.book, self.block)
        return found[begin - first * self.block : end - first * self.block]

    def document(self, place: int) -> np.ndarray:
        end = int(self.ends[place])
        return self.ids(end - int(self.sizes[place]), end)


def coded(docs: DataFrame, path: str, ranks: str, pattern: str, end: int) -> DataFrame:
    """doc_id, place in the input, number of ids and ids (unsigned 16 bits if the vocabulary allows it, else 32)."""
    kind = id_kind(path)
    last = np.array([end], "<u4").tobytes()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = text_ids(path, ranks, pattern).ids
        at = TaskContext.get().partitionId() << 40
        for piece in by_bytes(batches, "text"):
            found = [np.frombuffer(ids(x or "") + last, "<u4") for x in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(np.arange(at, at + len(found))),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([x.astype(kind).tobytes() for x in found], pa.binary()),
                ],
                ["doc_id", "at", "n", "ids"],
            )
            at += len(found)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over, CODED)


def id_kind(path: str) -> str:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(staged: DataFrame, kind: str) -> np.ndarray:
    """How often every id occurs, summed over all partitions; one row an id comes to the driver."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = staged.select("ids").mapInArrow(over, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    counts[ids] = n
    return counts


def write_files(
    docs: DataFrame,
    path: str | None = None,
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    end: int = END,
    longest: int = LONGEST,
    block: int = BLOCK,
    file_ids: int = FILE_IDS,
    part_ids: int = PART_IDS,
) -> tuple[DataFrame, DataFrame]:
    """Files (path, part, start, n_ids, content) and the codebook (path, content), both written."""
    path, ranks = path or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    spark, kind = docs.sparkSession, id_kind(path)
    staged = stage(coded(docs, path, ranks, pattern, end))
    counts = id_counts(staged, kind)
    raw = Codebook(code_lengths(counts, longest)).to_bytes()
    parts = max(1, -(-int(counts.sum()) // part_ids))
    ordered = staged.repartitionByRange(parts, "doc_id", "at").sortWithinPartitions("doc_id", "at")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part = Codebook.from_bytes(raw), TaskContext.get().partitionId()
        number = before = size = 0
        names, held = [], []

        def full():
            content = pack_file(names, held, before, book, block)
            values = [[f"part-{part:06d}-{number:05d}.hfid"], [part], [before], [size], [content]]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)], ["path", "part", "start", "n_ids", "content"]
            )

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                names.append(doc)
                held.append(np.frombuffer(ids, kind))
                size += len(held[-1])
                if size >= file_ids:
                    yield full()
                    number, before, size, names, held = number + 1, before + size, 0, [], []
        if held:
            yield full()

    files = stage(ordered.select("doc_id", "ids").mapInArrow(over, FILES), "none")
    book = spark.createDataFrame([("codebook.hfcb", bytearray(raw))], "path string, content binary")
    book = stage(book.coalesce(1), "none")
    return files, book


def read_files(files: DataFrame, book: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32 bits) of all files' documents."""
    raw = bytes(book.select("content").head()["content"])
    # One row per partition of the files: a sum over them in one task, sent to all.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook.from_bytes(raw)
        for batch in batches:
            for path, content, base in zip(*(batch.column(c) for c in ("path", "content", "base"))):
                try:
                    file = IdFile(content.as_py(), book)
                    ids = file.ids()
                except ValueError as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e
                values = ids.astype("<u4").tobytes()
                begins = file.ends - file.sizes
                rows = pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, mask=file.missing),
                        pa.array(base.as_py() + file.before + begins),
                        pa.array(file.sizes),
                        pa.array([values[4 * b : 4 * e] for b, e in zip(begins.tolist(), file.ends.tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                yield from by_bytes([rows], "ids")

    return (
        files.join(F.broadcast(bases), "part")
        .select("path", "content", "base")
        .mapInArrow(over, "doc_id long, start long, n_tokens long, ids binary")
    )


def op11_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, book = write_files(table(spark, sf_dir, "documents"))
    return read_files(files, book).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
