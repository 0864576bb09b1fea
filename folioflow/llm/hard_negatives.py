"""Hard negatives by score windows, with bounds along a spanning tree of the anchors.

Anchors are dealt into blocks, all rows into groups, and every block meets every group once, in a
task of its own that holds no more than these two. Each block has a minimum spanning tree over its anchors'
vectors, made once. In a task the tree's root is scored against the whole group. For any other anchor
a candidate's score differs from that with the parent by at most the length of the tree's edge times the
candidate's norm, so the parent's scores, or bounds, give bounds for the child. Only candidates
whose bounds overlap what the anchor asks for are scored again; for the others the wider bounds are
handed on. First pass: what may still be among the best rows of the anchor's own label, its
positives. Second pass: what may lie in the window of one of its positives and has another label. The
selections of all groups meet in a window that is cut before its shuffle.

The tree is walked so that a parent's largest branch comes last; so bounds of few anchors are held.

Cases: rows with a null id, label or vector, or a vector with a null component, take no part.
Vectors may differ in length; a missing component weighs nothing. Every row counts by itself, also if
ids repeat: an anchor's other rows are all but that row. Ties go to the smaller id. An anchor without positives, a positive without
rows in its window, and empty tables give no rows. A positive whose score is negative has an
empty window. Other columns are ignored. Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import stage, table
from folioflow.llm.topk_search import quantized

#: Rows of a group and anchors of a block, about.
GROUP = 8192
BLOCK = 4096

POSITIVE = "anchor long, positive_id long, score long"
NEGATIVE = "anchor long, place int, negative_id long, score long"


def dense(vectors: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows of a matrix of at least `width` columns, zeros at the end of shorter ones."""
    lists = vectors.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Scores:
    """Exact inner products of a group's vectors with one anchor after the other."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
        # Floating point is exact while every sum is a whole number under 2**53.
        self.kind = np.float64 if most < 2**53 else np.int64
        self.anchors, self.rows = anchors.astype(self.kind), rows.astype(self.kind)
        self.done = 0

    def __call__(self, anchor: int, at: np.ndarray) -> np.ndarray:
        self.done += len(at)
        rows = self.rows if len(at) == len(self.rows) else self.rows[at]
        return (rows @ self.anchors[anchor]).astype(np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a walk from the first row, and each row's parent (the root's is itself) and edge length.

    Prim's algorithm; a parent comes before its children and its largest branch comes last.
    """
    n, points = len(vectors), vectors.astype(np.float64)
    parent, edge = np.zeros(n, np.int64), np.zeros(n)
    near, out = np.full(n, np.inf), np.ones(n, bool)
    at, grown = 0, [0][:n]
    out[:1] = False
    for _ in range(n - 1):
        far = np.sqrt(((points - points[at]) ** 2).sum(1))
        closer = out & (far < near)
        near[closer], parent[closer] = far[closer], at
        at = int(np.argmin(np.where(out, near, np.inf)))
        out[at], edge[at] = False, near[at]
        grown.append(at)
    size = np.ones(n, np.int64)
    for node in grown[:0:-1]:
        size[parent[node]] += size[node]
    children: list[list[int]] = [[] for _ in range(n)]
    for node in grown[1:]:
        children[parent[node]].append(node)
    order, todo = [], [0] if n else []
    while todo:
        node = todo.pop()
        order.append(node)
        todo += sorted(children[node], key=lambda c: -size[c])
    return np.array(order, np.int64), parent, edge


def walk(order: np.ndarray, parent: np.ndarray, edge: np.ndarray, scores: Scores, wanted):
    """For every anchor in the tree's order: the anchor, rows scored, and their scores.

    wanted(anchor, low, high, score) gives the rows to score, by bounds of all rows' scores; it may
    have some scored before it decides on the others, by calling score.
    """
    norms = np.sqrt((scores.rows.astype(np.float64) ** 2).sum(1))
    lengths = np.sqrt((scores.anchors.astype(np.float64) ** 2).sum(1))
    left = np.bincount(parent, minlength=len(order))
    every = np.arange(len(norms))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for anchor in order.tolist():
        above = int(parent[anchor])
        if above == anchor:
            exact = scores(anchor, every)
            low, high = exact.astype(np.float64), exact.astype(np.float64)
            known = np.ones(len(norms), bool)
        else:
            # A little more than the edge, as it and the norms are rounded.
            reach = norms * (edge[anchor] * (1 + 1e-9) + 1e-9 * lengths[anchor]) + 1e-6
            low, high = held[above][0] - reach, held[above][1] + reach
            exact, known = np.zeros(len(norms), np.int64), np.zeros(len(norms), bool)
        left[above] -= 1
        if not left[above]:
            held.pop(above, None)

        def score(at: np.ndarray) -> np.ndarray:
            new = at[~known[at]]
            if len(new):
                exact[new] = scores(anchor, new)
                low[new] = high[new] = exact[new]
                known[new] = True
            return exact[at]

        at = wanted(anchor, low, high, score)
        found = score(at)
        if left[anchor]:
            held[anchor] = (low, high)
        yield anchor, at, found


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class _Task:
    """A block's anchors and a group's rows as arrays."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        column = lambda t, c: t.column(c).to_numpy()
        place = np.argsort(column(anchors, "place"))
        self.anchors = anchors.take(pa.array(place))
        self.ids, self.rids = column(rows, "vec_id"), column(rows, "rid")
        self.labels, self.own = column(rows, "label"), column(self.anchors, "label")
        self.anchor_rids = column(self.anchors, "rid")
        self.parent, self.edge = column(self.anchors, "parent"), column(self.anchors, "edge")
        vectors = dense(self.anchors.column("vector"))
        others = dense(rows.column("vector"), vectors.shape[1])
        self.scores = Scores(dense(self.anchors.column("vector"), others.shape[1]), others)
        self.order = np.arange(len(place))

    def walk(self, wanted):
        return walk(self.order, self.parent, self.edge, self.scores, wanted)


def best_positives(task: _Task, k: int) -> list[tuple[np.ndarray, ...]]:
    """Anchor's rid, id and score of the k best rows of each anchor's label, but itself."""

    def wanted(anchor, low, high, score):
        at = np.flatnonzero((task.labels == task.own[anchor]) & (task.rids != task.anchor_rids[anchor]))
        if len(at) <= k:
            return at
        # What looks best is scored first; its k-th score is what the others' bounds have to reach.
        likely = at[np.argpartition(-high[at], k - 1)[:k]]
        return at[high[at] >= score(likely).min()]

    out = []
    for anchor, at, found in task.walk(wanted):
        best = _first(task.ids[at], found, k)
        out.append((np.full(len(best), task.anchor_rids[anchor]), task.ids[at][best], found[best]))
    return out


def best_negatives(task: _Task, k: int, low_share: int, high_share: int) -> list[tuple[np.ndarray, ...]]:
    """Anchor's rid, positive's place, id and score of the first k rows of other labels in each window."""
    # The whole numbers from low_share to high_share hundredths of each positive's score.
    windows = [
        [(-(-low_share * s // 100), high_share * s // 100) for s in own or []]
        for own in task.anchors.column("scores").to_pylist()
    ]

    def wanted(anchor, low, high, score):
        meets = np.zeros(len(low), bool)
        for least, most in windows[anchor]:
            meets |= (high >= least) & (low <= most)
        return np.flatnonzero(meets & (task.labels != task.own[anchor]))

    out = []
    for anchor, at, found in task.walk(wanted):
        for place, (least, most) in enumerate(windows[anchor]):
            inside = np.flatnonzero((found >= least) & (found <= most))
            best = inside[_first(task.ids[at][inside], found[inside], k)]
            n = len(best)
            out.append((np.full(n, task.anchor_rids[anchor]), np.full(n, place), task.ids[at][best], found[best]))
    return out


def _table(found: list[tuple[np.ndarray, ...]], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    parts = list(zip(*found)) or [[] for _ in names]
    return pa.Table.from_arrays(
        [pa.array(np.concatenate([np.empty(0, np.int64), *p]).astype(np.int64)).cast(k) for p, k in zip(parts, kinds)],
        names,
    )


def _meet(blocks: DataFrame, rows: DataFrame, n_blocks: int, n_groups: int, work, schema: str) -> DataFrame:
    """work(block's anchors, group's rows) for every block and group."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("group", every(n_groups)).groupBy("group", "block")
    right = rows.withColumn("block", every(n_blocks)).groupBy("group", "block")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in schema.split(", ")]

    def over(anchors: pa.Table, group: pa.Table) -> pa.Table:
        if not anchors.num_rows or not group.num_rows:
            return _table([], names, kinds)
        return _table(work(_Task(anchors, group)), names, kinds)

    return left.cogroup(right).applyInArrow(over, schema)


def _trees(anchors: DataFrame, n_blocks: int) -> DataFrame:
    """Anchors dealt into blocks, with their place in the block's tree, parent's place and edge."""

    def over(rows: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(dense(rows.column("vector")))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for name, values in (("place", place), ("parent", place[parent]), ("edge", edge)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    label = dict(anchors.dtypes)["label"]
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(n_blocks)).cast("int"))
    schema = f"rid long, vec_id long, label {label}, vector array<long>, block int, place long, parent long, edge double"
    return dealt.select("rid", "vec_id", "label", "vector", "block").groupBy("block").applyInArrow(over, schema)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low_share: int = 80,
    high_share: int = 100,
    group_rows: int = GROUP,
    block_anchors: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id long, label, vector array<long>. A negative's score lies between low_share and
    high_share hundredths of the positive's.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    usable = usable & F.forall("vector", lambda x: x.isNotNull())
    rows = rows.where(usable).select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        F.col("vector").cast("array<long>").alias("vector"),
        is_anchor.alias("is_anchor"),
    )
    rows = stage(rows)
    n, asked = rows.agg(F.count("*"), F.count_if("is_anchor")).head()
    n_groups, n_blocks = max(1, -(-n // group_rows)), max(1, -(-asked // block_anchors))
    blocks = stage(_trees(rows.where("is_anchor"), n_blocks))
    group = F.pmod(F.xxhash64("rid"), F.lit(n_groups)).cast("int").alias("group")
    dealt = rows.select("rid", "vec_id", "label", "vector", group)

    found = _meet(blocks, dealt, n_blocks, n_groups, lambda t: best_positives(t, positives), POSITIVE)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    ranked = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    chosen = stage(ranked)
    # At most `positives` rows an anchor.
    lists = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("_all"))
    lists = lists.select(F.col("anchor").alias("rid"), F.col("_all.score").alias("scores"))

    found = _meet(
        blocks.join(lists, "rid", "left"),
        dealt,
        n_blocks,
        n_groups,
        lambda t: best_negatives(t, negatives, low_share, high_share),
        NEGATIVE,
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = blocks.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        ranked.withColumnRenamed("score", "negative_score")
        .join(chosen.withColumnRenamed("score", "positive_score"), ["anchor", "place"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", moved.alias("label"), quantized(F.col("embedding"), 256).alias("vector")
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH r AS (
    SELECT row_number() OVER () AS rid, vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same,
           CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1),
                                                 lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
    FROM r a JOIN r c ON a.rid <> c.rid
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
