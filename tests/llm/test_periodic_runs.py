import hashlib
import random
import re
import zlib

import pytest
from compare import duck

from folioflow.llm import periodic_runs as R


def by_hand(words, least=6, times=4):
    """All runs (start, length, period), period by period."""
    found, n = [], len(words)
    for p in range(1, n // times + 1):
        at = 0
        while at + p < n:
            start = at
            while at + p < n and words[at] == words[at + p]:
                at += 1
            length = at - start + p
            if at > start and length >= max(least, times * p):
                own = words[start : start + length]
                if not any(own[q:] == own[:-q] for q in range(1, p)):
                    found.append((start, length, p))
            at += at == start or at + p < n
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng, most=60):
    letters = [b"%d" % i for i in range(rng.choice([1, 2, 2, 3, 9]))]
    words = rng.choices(letters, k=rng.randrange(most))
    for _ in range(rng.randrange(3)):
        unit = rng.choices(letters, k=rng.randrange(1, 10))
        at = rng.randrange(len(words) + 1)
        words[at:at] = (unit * 9)[: rng.randrange(1, 9 * len(unit))]
    return words


def test_runs_equal_the_definition():
    rng = random.Random(11)
    texts = [random_words(rng) for _ in range(1500)]
    want = [by_hand(t) for t in texts]
    assert R.texts_runs(texts, 6, 4) == want
    assert sum(map(len, want)) > 500 and any(p > 8 for w in want for _, _, p in w)
    assert [R.texts_runs([t], 6, 4)[0] for t in texts[:200]] == want[:200]
    assert R.texts_runs(texts[:300], 1, 6) == [by_hand(t, 1, 6) for t in texts[:300]]
    with pytest.raises(ValueError):
        R.texts_runs(texts, 6, 3)


def test_long_periods_and_long_texts():
    rng = random.Random(12)
    unit = [b"%d" % rng.randrange(10**6) for _ in range(3001)]
    assert R.texts_runs([[b"x", *unit * 4, *unit[:17], b"y"], [b"a"] * 50_000, unit], 6, 4) == [
        [(1, 4 * 3001 + 17, 3001)],
        [(0, 50_000, 1)],
        [],
    ]
    # A thousand repeats, each of a repeat of its own.
    inner = [b"a", b"b"] * 5 + [b"c"]
    (runs,) = R.texts_runs([inner * 1000], 6, 4)
    assert runs[0] == (0, 10, 2) and runs[1] == (0, 11_000, 11) and len(runs) == 1001


def expected(doc, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if words and doc is not None:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_hand(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    out = {i for s, n, p in runs for i in range(s + p, s + n)}
    text = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in out)
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *own, digest(text.encode()), digest(kept))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark, sf, rows_of):
    rows = duck(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    rows = [(d, t) for d, t in rows if len(t or "") < 20_000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(R.digests(R.find_runs(df, change=R.planted)), *COLUMNS)
    assert got == sorted((expected(d, t) for d, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 10
    whole = R.op12_periodic_runs(spark, sf)
    assert sorted(whole.columns) == sorted(COLUMNS)
    assert set(got) <= set(rows_of(whole, *COLUMNS))
    kinds = dict(whole.dtypes)
    assert {kinds[c] for c in COLUMNS[:6]} == {"bigint"}


def test_edges(spark, rows_of):
    schema = "doc_id long, text string, runs string, start int"
    texts = [None, "", " \t\r\n\x0b\x0c", "a", "a\x1fb\x85 c", "é " * 6, "a a a a a", "x y " * 4, "　 " * 9]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)] + [(7, "x y " * 4, "z", 1), (None, "q " * 40, "z", 1)]
    found = R.find_runs(spark.createDataFrame(rows, schema))
    got = rows_of(R.digests(found), *COLUMNS)
    plain = [(None if d is None else d, t) for d, t, _, _ in rows]
    want = []
    for d, t in plain:
        words = (t or "").encode().split()
        runs = by_hand(words)
        want.append((d, len(runs)))
    assert [g[:2] for g in got] == sorted(want, key=repr)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[5]["collapsed"] == "é" and by_id[7]["collapsed"] == "x y" and by_id[6]["runs"] == []
    assert by_id[0]["n_words"] == 0 and by_id[4]["n_words"] == 2
    assert R.digests(R.find_runs(spark.createDataFrame([], schema))).collect() == []
