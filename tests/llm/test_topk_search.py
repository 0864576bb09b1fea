import random

import duckdb
from compare import differences, duck

from folioflow.llm import topk_search as topk_module
from folioflow.llm.topk_search import OP7_SQL, op7_topk_search, quantized, topk_search


def test_query_equals_sql(spark, sf):
    assert differences(op7_topk_search(spark, sf), duck(sf), OP7_SQL) == ""


def by_hand(queries, candidates, k):
    out = []
    for q, a in queries:
        found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in candidates if c != q)
        out += [(q, r, c, -s) for r, (s, c) in enumerate(found[:k], 1)]
    return sorted(out)


def test_against_loop_with_sparse_rows_ties_and_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0, 0, 0, 1, -2, 5]) for _ in range(rng.choice([0, 3, 6]))]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(5)
    asked = df.where("vec_id % 7 = 0")
    got = topk_search(asked, df, k=4, query_block=9, block_rows=17, query_rows=5)
    want = by_hand([r for r in rows if r[0] % 7 == 0], rows, 4)
    assert sorted(map(tuple, got.collect())) == want


def test_repeated_query_ids_as_in_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i % 230, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(260)] + [(100, [1.0, 0.5, 0.0])] * 14
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert differences(op7_topk_search(spark, str(tmp_path)), con, OP7_SQL) == ""


def test_one_block_of_queries_at_a_time(spark, monkeypatch):
    """A block's selections are written before the next block is brought to the driver."""
    steps = []
    stage, task = topk_module.stage, topk_module._search

    def noted(df):
        steps.append("written")
        return stage(df)

    def counted(ids, *rest):
        steps.append(len(ids))
        return task(ids, *rest)

    monkeypatch.setattr(topk_module, "stage", noted)
    monkeypatch.setattr(topk_module, "_search", counted)
    df = spark.createDataFrame([(i, [i % 5, 1]) for i in range(60)], "vec_id long, vector array<long>")
    topk_search(df, df, k=3, query_block=20)
    assert steps[0] == "written" and steps[2::2] == ["written"] * 3
    assert sum(steps[1::2]) == 60 and max(steps[1::2]) < 40


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, vector string, score int"
    rows = [
        (1, [1.0, 0.5], "x", 1),
        (2, [float("nan"), 1.0], "x", 1),
        (3, [float("inf"), 1.0], "x", 1),
        (4, [None, 1.0], "x", 1),
        (5, None, "x", 1),
        (6, [-0.0001, 2.0], "x", 1),
        (6, [-0.0001, 2.0], "x", 1),
        (None, [1.0, 1.0], "x", 1),
    ]
    df = spark.createDataFrame(rows, schema).select("vec_id", quantized("embedding").alias("vector"), "score")
    got = sorted(map(tuple, topk_search(df, df, k=10).collect()))
    score = 1024 * -1 + 512 * 2048
    # Both rows of id 6 are queries and share a ranking.
    assert got == [(1, 1, 6, score), (1, 2, 6, score), (6, 1, 1, score), (6, 2, 1, score)]
    assert topk_search(df.where("false"), df).collect() == []
    assert topk_search(df, df.where("false")).collect() == []
