import zlib

import numpy as np
from compare import duck

from folioflow.llm import language_id as X


def test_registered_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in X.op5_language_id(spark, sf).collect()}
    rows = duck(sf).execute("SELECT doc_id, lang, text FROM documents").fetchall()
    assert sorted(got) == sorted(r[0] for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i, _, text in rows:
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    right = [got[i]["lang_pred"] == lang for i, lang, _ in rows if got[i]["held_out"] and lang]
    assert np.mean(right) >= 0.95
    assert np.mean([r["rejected"] for r in got.values()]) <= 0.01


def plain_rows(text):
    raw = b" " + text.lower().encode().translate(X._WORDS) + b" "
    out = []
    for size in (2, 3, 4):
        for i in range(len(raw) - size + 1):
            part = raw[i : i + size]
            if b" " in part[1:-1] or (size == 2 and part == b"  "):
                out.append(0)
                continue
            code = part[0]
            for b in part[1:]:
                code = (code * 257 + b) % 2**32
            row = (code ^ (code >> 15)) * int(X._MIX[size - 2]) % 2**32
            out.append((row >> 16) % (X.BUCKETS - 1) + 1)
    return out


def test_subwords_against_loop():
    for text in ("", "a", "Ab cd", "é世 x", "the  cat, sat.", "12 b", "x" * 50):
        assert sorted(X.subwords(text).tolist()) == sorted(plain_rows(text))


def test_prediction_is_the_softmax_of_mean_rows():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(X.BUCKETS, 3))
    logits[0] = 0
    model = X.LanguageModel(["a", "b", "c"], logits, 0.5, 0.0)
    rows = [r for r in plain_rows("some words here") if r]
    want = X.softmax(logits.astype(np.float32)[rows].astype(float).mean(0) / 0.5)
    name, score = model.predict("some words here")
    assert name == "abc"[want.argmax()] and abs(score - want.max()) < 1e-6


def test_calibration():
    raw = np.array([[2.0, 0.0]] * 80 + [[0.0, 2.0]] * 20)
    truth = np.array([0] * 100)
    temperature, least = X.calibrate(raw, truth)
    assert abs(X.softmax(np.array([2.0, 0.0]) / temperature)[0] - 0.8) < 0.06
    assert 0 < least <= 1.05 / 2
    assert X.calibrate(np.zeros((0, 2)), np.zeros(0, int)) == (1.0, 0.0)


def test_edges(spark):
    words = {"xx": "tor bal nim", "yy": "ése uña gól"}
    rows = [(i, " ".join([words[n]] * (i % 9 + 1)), n, 3) for i in range(400) for n in words]
    schema = "doc_id long, text string, lang string, lang_score int"
    model = X.train(spark.createDataFrame([*rows, (5, "tor", None, 1), (6, None, "xx", 1)], schema))
    odd = [None, "", "123 !", "世界 中文 日本", "tor " * 200_000, "uña gól", "uña gól"]
    frame = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(odd)], schema)
    got = {r["doc_id"]: (r["lang_pred"], r["lang_rejected"]) for r in X.identify(frame, model).collect()}
    assert [got[i] for i in (0, 1, 2)] == [("und", True)] * 3
    assert got[3][1] and got[4] == ("xx", False) and got[5] == got[6] == ("yy", False)
    assert X.identify(frame.where("false"), model).collect() == []
    nothing = X.train(frame)
    assert {r["lang_pred"] for r in X.identify(frame, nothing).collect()} == {"und"}
    single = X.train(spark.createDataFrame([(1, "tor", "xx", 1)], schema))
    assert X.identify(frame, single).where("doc_id = 5").first()["lang_pred"] == "xx"
