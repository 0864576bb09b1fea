import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from compare import duck
from pyspark.sql import functions as F

from folioflow.llm import hmm_lm as M


def plain_tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), " "]


def base_by_hand(rows):
    """n_tokens, n_known, train_tokens and base score of rows (id, text, held)."""
    counts = Counter(t for _, text, held in rows if held is False for t in plain_tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for i, text, _ in rows:
        found = plain_tokens(text)
        score = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in found)
        out[i] = (len(found), sum(counts[t] > 0 for t in found), total, score)
    return out


def test_registered_query(spark, sf):
    rows = duck(sf).execute("SELECT doc_id, text FROM documents").fetchall()
    rows = [(i, t, zlib.crc32(str(i).encode()) % 10 == 0) for i, t in rows]
    want = base_by_hand(rows)
    got = M.op3_hmm_lm(spark, sf).collect()
    assert len(got) == len(rows)
    gain = []
    for r in got:
        n, known, total, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - score) < 1e-6 * max(1, abs(score))
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / n)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i, _, h in rows if h}
    assert np.mean(gain) > 0.05


def small(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    emit = np.zeros((M.SYMBOLS, states))
    emit[:symbols] = rng.dirichlet(np.ones(symbols), states).T
    return M.Hmm(
        rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit, rng.dirichlet(np.ones(states))
    )


def paths(model, sequence, start):
    for path in itertools.product(range(len(model.start)), repeat=len(sequence)):
        p = start[path[0]]
        for t, s in enumerate(path):
            p *= model.emit[sequence[t], s]
            if t:
                p *= model.move[path[t - 1], s]
        yield path, p


def test_likelihood_sums_over_all_paths():
    model, rng = small(), np.random.default_rng(1)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 3, 1, 5, 6)]
    got = M.log_likelihoods(model, texts)
    for text, log in zip(texts, got):
        assert abs(log - math.log10(sum(p for _, p in paths(model, text, model.start)))) < 1e-9


def test_likelihoods_of_a_length_sum_to_one():
    model = small()
    texts = [np.array(x, np.uint16) for x in itertools.product(range(5), repeat=3)]
    assert abs((10 ** M.log_likelihoods(model, texts)).sum() - 1) < 1e-9


def test_expected_counts_sum_over_all_paths():
    model, rng = small(2, 4), np.random.default_rng(2)
    texts = [rng.integers(0, 4, n).astype(np.uint16) for n in (4, 2, 5, 1)]
    first = np.array([True, False, True, True])
    emitted, moved, started = np.zeros((M.SYMBOLS, 2)), np.zeros((2, 2)), np.zeros(2)
    for text, begins in zip(texts, first):
        found = list(paths(model, text, model.start if begins else model.resume))
        total = sum(p for _, p in found)
        for path, p in found:
            for t, s in enumerate(path):
                emitted[text[t], s] += p / total
                if t:
                    moved[path[t - 1], s] += p / total
            if begins:
                started[path[0]] += p / total
    got = M.expected(model, texts, first)
    want = np.concatenate((emitted.ravel(), moved.ravel(), started))
    assert np.allclose(got[:-2], want, atol=1e-4) and got[-1] == 12


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(3)
    texts = [np.concatenate([rng.integers(1, 6, 30) + 10 * (i % 2), [0]]).astype(np.uint16) for i in range(40)]
    shares = np.full(M.SYMBOLS, 1 / M.SYMBOLS)
    model = M.first_states(M.company(texts), shares, 2)
    seen = []
    for _ in range(5):
        sums = M.expected(model, texts, np.ones(len(texts), bool))
        seen.append(sums[-2])
        model = M.maximized(sums, shares, 2)
    assert seen == sorted(seen) and seen[-1] > seen[0] + 100


def test_rare_words_and_stretches(spark, monkeypatch):
    """Counts of words that aren't sent come through the join; texts are cut in training only."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        words = rng.choice([f"w{k}" for k in range(80)], int(rng.integers(0, 700)))
        rows.append((i, " ".join(words), bool(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(4)
    counts = M.count_tokens(df.where("not held_out"))
    words = M.gather_words(counts, known=20)
    assert 0 < len(words.known) <= 20
    texts = M.coded(df, words).collect()
    want = base_by_hand(rows)
    for r in texts:
        n, known, *_ = want[r["doc_id"]]
        assert r["n_tokens"] == n and r["n_known"] + len(r["rare"]) >= known
        assert len(r["symbols"]) == 2 * n
    for r in M.score_texts(df, states=2, rounds=2).collect():
        assert abs(r["base_score"] - want[r["doc_id"]][3]) < 1e-6 * abs(want[r["doc_id"]][3]) + 1e-9


def test_edges(spark):
    rows = [
        (1, None, False, 1),
        (2, "", False, 1),
        (3, " \t\n", True, 1),
        (4, "Été A b a", False, 1),
        (4, "Été A b a", False, 1),
        (5, "x " * 200_000, True, 1),
        (None, "never seen", None, 1),
    ]
    schema = "doc_id long, text string, held_out boolean, n_tokens int"
    df = spark.createDataFrame(rows, schema)
    got = {r["doc_id"]: r for r in M.score_texts(df, states=2, rounds=1).collect()}
    want = base_by_hand([r[:3] for r in rows])
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[i][:3]
        assert abs(r["base_score"] - want[i][3]) < 1e-6 * abs(want[i][3]) + 1e-9
        assert math.isfinite(r["score"])
    assert got[1]["n_tokens"] == 1 and got[5]["n_tokens"] == 200_001
    assert M.score_texts(df.where("false")).collect() == []
    none = M.score_texts(df.withColumn("held_out", F.lit(True)), states=2).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
