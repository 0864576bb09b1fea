import random
import zlib

import numpy as np
import public_tokenizers as P
from compare import duck
from tokenizers import Tokenizer

from folioflow.llm.packing import RANKS, VOCABULARY, TextIds, op2_packing, pack

LIBRARY = Tokenizer.from_file(P.path(VOCABULARY))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, texts, window):
    """Every id of every document in one piece, windows full and gapless."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, rows in by_doc.items():
        ids, at = ids_of(texts[doc]), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            cut = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            if "ids_crc32" in r:
                assert r["ids_crc32"] == zlib.crc32(cut)
            else:
                assert bytes(r["ids"]) == cut
            at += r["length"]
        assert at == len(ids)
    last = max(by_sequence, default=-1)
    assert sorted(by_sequence) == list(range(last + 1))
    for sequence, rows in by_sequence.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or (sequence == last and at < window)


def test_query(spark, sf):
    texts = dict(duck(sf).execute("SELECT doc_id, text FROM documents").fetchall())
    check([r.asDict() for r in op2_packing(spark, sf).collect()], texts, 2048)


def test_partitions_and_long_documents(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(["the", "cat", "é世", "  x"], k=rng.choice([0, 1, 9, 300]))) for i in range(60)}
    texts[7] = None
    rows = [(i, t, "x") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(7)
    got = [r.asDict() for r in pack(df, window=16).collect()]
    check(got, texts, 16)


def test_padding(spark):
    for words, padded in ((7, 8), (6, 32), (31, 32), (15, 16), (0, 1)):
        df = spark.createDataFrame([(1, "a" + " a" * (words - 1) if words else "")], "doc_id long, text string")
        assert [r["padded"] for r in pack(df, window=32).collect()] == [padded]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty).collect() == []
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(r["length"] for r in pack(df).collect()) == [2, 2, 2]


def test_fast_chunks_equal_the_library():
    rng = random.Random(9)
    coder = TextIds(P.path(VOCABULARY), P.path(RANKS), P.PATTERN)
    signs = "abcdeéßñÀ019 .,'!?-\n  \t ɏɐ世界\u001c"
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(40)))
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == ids_of(text)[:-1]
    for text in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext"):
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == ids_of(text)[:-1]
