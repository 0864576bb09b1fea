import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from compare import duck
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.bpe_tree import RANKS, TreeEncoder, decode_ids, encode_texts, op4_bpe_tree


def plain():
    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PLAIN = plain()
TREE = TreeEncoder(P.path(RANKS), P.PATTERN, leaf_bytes=3)


def check(text, tree=TREE):
    ids = tree.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert tree.decode(ids, leaf=5) == text.encode()


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    check(text)


@given(st.text("aAbe .,'stlve\n\t  \u001c\u0085é9 ", max_size=120))
@settings(max_examples=600, deadline=None)
def test_spaces_and_short_alphabets(text):
    check(text)


@given(st.text("ab=-0", min_size=1, max_size=400))
@settings(max_examples=200, deadline=None)
def test_long_runs(text):
    check(text)


def test_long_pieces():
    rng = random.Random(1)
    tree = TreeEncoder(P.path(RANKS), P.PATTERN)
    for alphabet in ("a", "ab", "thes", "aeinorst", "0123456789", "=", "-=", "é世a"):
        check("".join(rng.choices(alphabet, k=20_000)), tree)


def test_wrong_ids_raise():
    for bad in (b"abc", np.array([60_000], "<u4").tobytes()):
        with pytest.raises((ValueError, KeyError)):
            TREE.decode(bad)


def test_query_against_library(spark, sf):
    got = {r["doc_id"]: r for r in op4_bpe_tree(spark, sf).collect()}
    rows = duck(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = PLAIN.encode_ordinary(text or "")
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = encode_texts(df)
    back = decode_ids(coded)
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in back.collect()) == [
        (0, b"a"),
        (1, b""),
        (2, b""),
        (3, b"a b"),
        (3, b"a b"),
    ]
    assert coded.where("false").collect() == []
    assert encode_texts(df.where("false")).collect() == []
