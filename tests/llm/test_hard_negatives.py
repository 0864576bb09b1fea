import random

import numpy as np
import pyarrow as pa
from compare import differences, duck
from pyspark.sql import functions as F

from folioflow.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, vector array<long>, rank string"


def by_hand(rows, is_anchor, low=80, high=100, k=5, m=5):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    rows = [r for r in rows if None not in r[:3] and None not in r[2]]
    out = []
    for at, (anchor, label, vector, _) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        others = [(-dot(vector, v), i, own) for n, (i, own, v, _) in enumerate(rows) if n != at]
        same = sorted((s, i) for s, i, own in others if own == label)[:k]
        rest = sorted((s, i) for s, i, own in others if own != label)
        for ps, p in same:
            inside = [(s, i) for s, i in rest if -low * ps <= -100 * s <= -high * ps][:m]
            out += [(anchor, p, n, i, -ps, -s) for n, (s, i) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def answers(rows_of, df):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return rows_of(df, *columns)


def clustered(rng, n, centres=12, width=8, spread=3, most=40):
    middles = [[rng.randrange(-most, most) for _ in range(width)] for _ in range(centres)]
    return [
        (i, rng.randrange(4), [x + rng.randrange(-spread, spread + 1) for x in rng.choice(middles)], "x")
        for i in range(n)
    ]


def test_query(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01")):
        assert differences(H.op13_hard_negatives(spark, folder), duck(folder), H.OP13_SQL) == ""


def test_blocks_and_groups(spark, rows_of):
    rng = random.Random(2)
    rows = clustered(rng, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = by_hand(rows, lambda i: i % 7 == 0)
    assert want
    for group, block in ((1000, 1000), (40, 1000), (1000, 5), (60, 9)):
        got = H.hard_negatives(df, F.col("vec_id") % 7 == 0, group_rows=group, block_anchors=block)
        assert answers(rows_of, got) == want


def test_edges(spark, rows_of):
    rng = random.Random(3)
    rows = [(i % 30, i % 3, [rng.randrange(-3, 9) for _ in range(i % 5)], "x") for i in range(120)]
    rows += [(None, 1, [1, 2], "x"), (5, None, [1, 2], "x"), (5, 1, None, "x"), (5, 1, [1, None], "x")]
    rows += [(40, 9, [5, 5], "x"), (10, 1, [], "x"), (10, 0, [0, 0, 0], "x"), (10, 0, [0, 0, 0], "x")]
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert answers(rows_of, got) == by_hand(rows, lambda i: i % 10 == 0)
    large = [(i, i % 2, [rng.randrange(2**28, 2**29), rng.randrange(-(2**29), 2**29)], "x") for i in range(40)]
    got = H.hard_negatives(spark.createDataFrame(large, SCHEMA), F.col("vec_id") % 10 == 0)
    assert answers(rows_of, got) == by_hand(large, lambda i: i % 10 == 0)
    for empty in ([], [(1, 1, [1], "x")], [(10, 1, [1], "x")]):
        assert H.hard_negatives(spark.createDataFrame(empty, SCHEMA), F.col("vec_id") % 10 == 0).collect() == []


def test_tree_is_least_and_walks_parents_first():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 40):
        points = rng.integers(-9, 9, (n, 3))
        order, parent, edge = H.spanning_tree(points)
        seen = set()
        for node in order.tolist():
            assert parent[node] in seen or (parent[node] == node and not seen)
            seen.add(node)
        assert len(seen) == n
        assert np.allclose(edge, np.sqrt(((points - points[parent]) ** 2).sum(1)) if n else [])
        # Kruskal's sum of edges.
        group, total = list(range(n)), 0.0
        far = sorted((float(np.linalg.norm(points[a] - points[b])), a, b) for a in range(n) for b in range(a))
        for d, a, b in far:
            if group[a] != group[b]:
                total += d
                group = [group[a] if g == group[b] else g for g in group]
        assert np.isclose(edge.sum(), total)


def test_bounds_hold_and_spare_scores():
    rng = random.Random(6)
    rows = clustered(rng, 900, spread=1)
    anchors = [r for r in rows if r[0] % 10 == 0]
    order, parent, edge = H.spanning_tree(np.array([a[2] for a in anchors]))
    place = np.argsort(order)
    table = lambda data: pa.table({k: [d[k] for d in data] for k in data[0]})
    left = table(
        [
            {"rid": a[0], "label": a[1], "vector": a[2], "place": int(place[i]), "parent": int(place[parent[i]]), "edge": float(edge[i])}
            for i, a in enumerate(anchors)
        ]
    )
    task = H._Task(left, table([{"rid": r[0], "vec_id": r[0], "label": r[1], "vector": r[2]} for r in rows]))
    exact = task.scores.rows @ task.scores.anchors.T

    def wanted(anchor, low, high, score):
        assert (low <= exact[:, anchor]).all() and (exact[:, anchor] <= high).all()
        return np.flatnonzero(high >= np.sort(exact[:, anchor])[-50])

    scored = 0
    for anchor, at, found in task.walk(wanted):
        assert (found == exact[at, anchor]).all()
        scored += len(at)
    assert task.scores.done < len(rows) * len(anchors) / 2 and scored
