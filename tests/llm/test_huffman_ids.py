import heapq
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from compare import duck
from tokenizers import Tokenizer

from folioflow.llm import huffman_ids as H
from folioflow.llm.packing import VOCABULARY

LIBRARY = Tokenizer.from_file(P.path(VOCABULARY))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def least_bits(counts):
    heap, bits = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        bits += both
        heapq.heappush(heap, both)
    return bits


def test_query(spark, sf):
    rows, at, want = duck(sf).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall(), 0, []
    for doc, text in rows:
        ids = ids_of(text)
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = H.op11_huffman_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_lengths_are_least_and_limited():
    rng = np.random.default_rng(3)
    for _ in range(100):
        counts = (rng.pareto(0.5, rng.integers(2, 120)) * 2).astype(np.int64)
        if np.count_nonzero(counts) < 2:
            continue
        free, tight = H.code_lengths(counts, 60), H.code_lengths(counts, 8)
        assert (free * counts).sum() == least_bits(counts)
        assert tight.max() <= 8 and (tight > 0).tolist() == (counts > 0).tolist()
        for lengths in (free, tight):
            assert sum(2.0 ** -float(x) for x in lengths if x) <= 1
    # Of all codes within the limit none is shorter: every choice of lengths for four symbols.
    counts = np.array([1, 1, 2, 90])
    assert (H.code_lengths(counts, 2) * counts).sum() == 2 * counts.sum()
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(5, int), 2)


def test_codes_round_trip_by_block_and_part():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 10**6, 700) ** 2
    book = H.Codebook.from_bytes(H.Codebook(H.code_lengths(counts)).to_bytes())
    codes = sorted((format(int(c), f"0{n}b")) for c, n in zip(book.codes, book.lengths))
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
    for n in (0, 1, 15, 16, 17, 1000, 4099):
        ids = rng.integers(0, 700, n).astype("<u2")
        raw, marks = H.encode(ids, book, block=16, step=100)
        bits = "".join(format(int(book.codes[i]), f"0{book.lengths[i]}b") for i in ids)
        assert "".join(format(b, "08b") for b in raw)[: len(bits)] == bits
        assert H.decode(raw, marks, n, book, 16).tolist() == ids.tolist()
        docs = np.split(ids, sorted(rng.integers(0, n + 1, 9)))
        file = H.IdFile(H.pack_file(list(range(10)), docs, 0, book, 16), book)
        assert [file.document(i).tolist() for i in range(10)] == [d.tolist() for d in docs]


def test_damage_is_found():
    book = H.Codebook(H.code_lengths(np.array([5, 3, 2, 1])))
    raw = H.pack_file([1], [np.array([0, 1, 2, 3] * 9)], 0, book)
    for broken in (raw[:-1], raw[:30], b"", raw[:60] + bytes([raw[60] ^ 1]) + raw[61:]):
        with pytest.raises(ValueError):
            H.IdFile(broken, book)
    with pytest.raises(ValueError):
        H.IdFile(raw, H.Codebook(H.code_lengths(np.array([1, 3, 2, 5]))))
    with pytest.raises(ValueError):
        H.encode(np.array([9]), H.Codebook(np.array([1, 1] + [0] * 9)))
    codes, marks = H.encode(np.array([0, 1, 2, 3] * 9), book, 4)
    marks[3] += np.uint64(1)
    with pytest.raises(ValueError):
        H.decode(codes, marks, 36, book, 4)
    with pytest.raises(ValueError):
        H.decode(codes[:5], marks, 36, book, 4)


def test_order_files_and_edges(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "cat", "é世", "  x"], k=rng.choice([0, 1, 9, 300]))) for _ in range(60)]
    rows = [(i % 20 - 5, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    files, book = H.write_files(df, block=8, file_ids=200, part_ids=900)
    assert files.count() > 4 and files.select("part").distinct().count() > 1
    got = sorted(H.read_files(files, book).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    ends = 0
    for r in got:
        assert r["start"] == ends and len(r["ids"]) == 4 * r["n_tokens"]
        ends += r["n_tokens"]
    have = sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got)
    assert have == sorted((str(d), np.array(ids_of(t), "<u4").tobytes()) for d, t, _ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert H.read_files(*H.write_files(empty)).collect() == []
    alone = spark.createDataFrame([(7, "")], "doc_id long, text string")
    assert [r["n_tokens"] for r in H.read_files(*H.write_files(alone)).collect()] == [1]
