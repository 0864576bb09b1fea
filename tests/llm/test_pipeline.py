import gc
import weakref

import pyarrow as pa
import pytest
import test_dart_minhash as near
import test_packing as packing_test
from compare import duck

import corpus_pipeline as C
from folioflow.llm import language_id, toxicity
from folioflow.llm.common import give_back


@pytest.fixture(scope="module")
def written(spark, sf, tmp_path_factory):
    """The rows that go into each stage and out of the last."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, function in C.STAGES:
        path = str(folder / name)
        function(spark, tables[-1], sf).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_stages_keep_the_columns(written):
    for table in written[1:-1]:
        assert table.columns == written[0].columns
    counts = [t.count() for t in written[:4]]
    assert counts == sorted(counts, reverse=True) and counts[3] > 0


def texts(table):
    return {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}


def test_first_stage_drops_what_the_model_calls_toxic(spark, sf, written):
    model = toxicity.train(written[0], spark.read.parquet(f"{sf}/labels.parquet"))
    before = texts(written[0])
    scores = dict(zip(before, model.scores(list(before.values()))))
    assert set(texts(written[1])) == {i for i, s in scores.items() if s < 0.7}
    clean = {i for (i,) in duck(sf).execute("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()}
    lost = clean & (set(before) - set(texts(written[1])))
    assert len(lost) <= 0.02 * len(clean)


def test_second_stage_drops_what_is_not_recognised(written):
    model = language_id.train(written[1])
    before = texts(written[1])
    kept = {i for i, t in before.items() if (p := model.predict(t))[0] != "und" and p[1] >= model.least}
    assert set(texts(written[2])) == kept
    assert len(kept) >= 0.99 * len(before)


def test_third_stage_keeps_one_of_each_class(written):
    before = texts(written[2])
    classes = near.by_hand(list(before.items()))
    assert texts(written[3]) == {i: before[i] for i in set(classes.values())}


def test_last_stage_packs_all_that_is_left(written):
    packing_test.check([r.asDict() for r in written[4].collect()], texts(written[3]), 2048)


def test_last_stage_leaves_no_tokenizers_in_workers(spark, sf, written, monkeypatch):
    """Workers are used again by other stages, in turn."""
    most = 1234
    monkeypatch.setattr(C, "CACHED", most)
    C.pack(spark, written[3].repartition(16), sf).write.format("noop").mode("overwrite").save()

    def kept(batches):
        rows = sum(b.num_rows for b in batches)
        tokenizers = [x for x in gc.get_objects() if type(x).__name__ == "TextIds" and x.chunks.spaced.most == most]
        yield pa.RecordBatch.from_arrays([pa.array([len(tokenizers)] * rows)], ["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 64).mapInArrow(kept, "n long").collect()} == {0}


def test_memory_given_back_includes_cycles():
    class Node:
        pass

    gc.disable()
    try:
        node = Node()
        node.own, left = node, weakref.ref(node)
        del node
        give_back()
        assert left() is None
    finally:
        gc.enable()


def test_run_gives_the_last_stage(spark, sf, written):
    assert sorted(map(tuple, C.run(spark, sf).select("doc_id", "length", "doc_tokens").collect())) == sorted(
        map(tuple, written[4].select("doc_id", "length", "doc_tokens").collect())
    )


def test_edges(spark, sf, tmp_path):
    """Nulls, repeated rows, further columns with names that operators use, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity int, lang_pred string, keys int"
    text = "the cat and the dog went to the old house by the sea"
    rows = [
        (1, None, "en", "s", 0, 1, "a", 1),
        (2, "", "en", "s", 0, 1, "a", 1),
        (3, text, "en", None, 52, 1, "a", 1),
        (3, text, "en", None, 52, 1, "a", 1),
        (4, text, None, "s", 52, 1, "a", 1),
        (None, text, "en", "s", 52, 1, "a", 1),
        (6, "der Hund und die Katze " * 9, "de", "s", None, 1, "a", 1),
    ]
    labels = spark.createDataFrame([(3, 0, 0), (6, 0, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for n, df in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        for name, function in C.STAGES:
            function(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{n}"))
            df = spark.read.parquet(str(tmp_path / f"{name}{n}"))
            if name == "near_dedup":
                kept = sorted((r["doc_id"] or 0) for r in df.collect())
                assert kept == ([0, 3, 6] if n == 0 else [])
                assert df.columns == [f.split()[0] for f in schema.split(", ")]
        assert (df.count() > 0) == (n == 0)


def test_near_dedup_keeps_every_distinct_text(spark, sf):
    a, b = "the cat and the dog went to the old house", "a wholly different text about the sea and the sun"
    rows = [(3, a, 1, "p"), (5, a, 2, "q"), (5, b, 3, "r"), (5, b, 3, "r"), (6, b.upper(), 4, "s"), (5, None, 5, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest int, _row string")
    got = C.drop_near_duplicates(spark, df, sf)
    assert got.columns == df.columns
    want = [(3, a, 1, "p"), (5, b, 3, "r"), (5, None, 5, "t")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_own_columns_keep_their_values(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    from pyspark.sql import functions as F

    docs = docs.withColumn("_toxicity", F.lit("own")).withColumn("_lang_rejected", F.lit(False)).withColumn("_LANG", F.lit(7))
    for function in (C.drop_toxic, C.keep_recognised):
        got = function(spark, docs, sf)
        assert got.columns == docs.columns
        assert got.select("_toxicity", "_lang_rejected", "_LANG").distinct().collect() == [("own", False, 7)]
