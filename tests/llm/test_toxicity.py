import gc
import weakref
import zlib

import numpy as np
from compare import duck

from folioflow.llm import toxicity as X


def test_registered_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in X.op1_toxicity(spark, sf).collect()}
    con = duck(sf)
    ids = [i for (i,) in con.execute("SELECT doc_id FROM documents").fetchall()]
    assert sorted(got) == sorted(ids)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    # At this size only English documents have their marks repeated often enough to be learned.
    labels = con.execute(
        "SELECT doc_id, max(toxic) FROM labels JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY 1"
    ).fetchall()
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    caught = [p for p, t in held if t]
    wrong = [p for p, t in held if not t]
    assert caught and np.mean(caught) >= 0.85 and np.mean(wrong) <= 0.02


def by_hand(counts, gram):
    """Interpolated Kneser-Ney from its definition, for one class index and the counts of both."""
    levels = [{g: list(map(float, n)) for g, n in counts.items()}]
    for size in range(X.ORDER - 1, 0, -1):
        below = {}
        for g, n in levels[0].items():
            v = [min(x, 1.0) for x in n]
            v = [max(v)] * 2 if size <= X.SHARED else v
            old = below.get(g[1:], [0.0, 0.0])
            below[g[1:]] = [a + b for a, b in zip(old, v)]
        levels.insert(0, below)

    def chance(c, g):
        if not g:
            return 1.0 / (len(levels[0]) + 1)
        level = levels[len(g) - 1]
        once = sum(n[c] == 1 for n in level.values())
        twice = sum(n[c] == 2 for n in level.values())
        d = once / (once + 2 * twice) if once else 0.5
        same = {k: n[c] for k, n in level.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return chance(c, g[1:])
        rest = sum(min(n, d) for n in same.values()) / total
        return max(same.get(g, 0.0) - d, 0) / total + rest * chance(c, g[1:])

    return chance(0, gram), chance(1, gram)


def small_model():
    toxic = ["idiot", "idiots", "the", "scum", "them"] * 2 + ["moron"]
    ordinary = ["the", "them", "there", "sun", "is", "idle"] * 3
    counts = {}
    for at, words in enumerate((toxic, ordinary)):
        for w in words:
            for g in X.grams(w):
                counts.setdefault(g, [0, 0])[at] += 1
    names = list(counts)
    n = np.array([counts[g] for g in names])
    return counts, X.Lookup(X.KneserNey(names, n[:, 0], n[:, 1]))


def test_kneser_ney_against_definition():
    counts, model = small_model()
    for word in ("idiot", "idiotic", "scummy", "the", "zz", "thesun"):
        for g in X.grams(word):
            toxic, ordinary = by_hand(counts, g)
            assert np.isclose(model.log_ratio(g), np.log(toxic / ordinary), rtol=1e-9, atol=1e-12)
            for size in range(1, X.ORDER):
                assert np.allclose(model.of(g[-size:]), by_hand(counts, g[-size:]), rtol=1e-9)


def test_kneser_ney_sums_to_one():
    _, model = small_model()
    letters = list(model.chance[0])
    for context in ("", "\x02id", "xxx", "thed", "\x02\x02\x02\x02"):
        total = np.sum([model.of(context + c) for c in letters], 0) + np.array(model.of(context + "\x00"))
        assert np.allclose(total, 1.0)


def test_a_judge_goes_with_its_tables_at_once():
    """Python workers are used again: tables that only a garbage collection frees would pile up in them."""
    counts, _ = small_model()
    n = np.array(list(counts.values()))
    gc.collect()
    gc.disable()
    try:
        judge = X.Judge(X.KneserNey(list(counts), n[:, 0], n[:, 1]))
        assert judge.features("idiotic scum, there")[0] > judge.features("the sun is there")[0]
        left = [weakref.ref(x) for x in (judge, judge.model, judge.word, judge.gram)]
        del judge
        assert [x() for x in left] == [None] * 4
    finally:
        gc.enable()


def test_edges(spark):
    words = ["vile", "filthy", "nasty"]
    rows = [(i, ("sun and sea " * 9) + (words[i % 3] if i % 2 else "sand"), 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    odd = [(1, None), (2, ""), (3, "!!! ???"), (4, "vile " + "sun and sea " * 20_000), (4, "vile"), (None, "a" * 500_000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in odd], "doc_id long, text string, toxicity int")
    got = X.score_texts(frame, model).collect()
    assert len(got) == 6 and all(0 <= r["toxicity"] <= 1 for r in got)
    by_text = {r["text"]: r["toxicity"] for r in got}
    assert by_text[None] == by_text[""] == by_text["!!! ???"]
    assert by_text["vile"] > 0.7
    assert X.score_texts(frame.where("false"), model).collect() == []
    for some in (labels.where("false"), labels.where("toxic = 0")):
        assert {r["toxicity"] for r in X.score_texts(frame, X.train(docs, some)).collect()} == {0.0}
    assert {r["toxicity"] for r in X.score_texts(frame, X.train(docs.where("false"), labels)).collect()}


def test_few_toxic_labels_still_give_a_model(spark, tmp_path):
    """However the hash deals few toxic documents, the model tells the classes apart."""
    import corpus_pipeline as C

    ids = spark.range(1000).selectExpr("id", "pmod(xxhash64(id, 7), 3) AS part").collect()
    # All toxic documents in the parts of the counts, then all in the part of the curve.
    for parts in ((0, 1), (2,)):
        toxic = [r["id"] for r in ids if r["part"] in parts][:5]
        rows = [(i, "sun and sea " * 9 + ("vile filthy nasty" if i in toxic else "sand")) for i in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i in toxic)) for i, _ in rows], "doc_id long, toxic int")
        model = X.train(docs, labels)
        assert model.model is not None
        scores = model.scores([t for _, t in rows])
        assert scores[toxic].min() > np.delete(scores, toxic).max()
    labels.where("toxic = 1").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.drop_toxic(spark, docs, str(tmp_path)).count() == 300


def test_held_out_labels_change_nothing(spark, sf, tmp_path):
    """Flipping every label of a held-out document leaves all scores as they are, with and without a model."""
    con = duck(sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    none = [(i, q, 0) for i, q, _ in labels]
    flip = lambda rows: [(i, q, 1 - t if held(i) and t is not None else t) for i, q, t in rows]
    assert any(held(i) for i, _, _ in labels)
    for n, (rows, most) in enumerate(((labels, 6000), (labels, 20), (none, 6000))):
        found = []
        for changed in (rows, flip(rows)):
            folder = tmp_path / f"{n}-{len(found)}"
            docs.write.parquet(str(folder / "documents.parquet"))
            spark.createDataFrame(changed, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
            got = X.op1_toxicity(spark, str(folder), most_rows=most).collect()
            found.append(sorted((r["doc_id"], r["score"]) for r in got))
        assert found[0] == found[1]
