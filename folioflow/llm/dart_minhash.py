"""Near-duplicate classes from DartMinHash signatures, banded, with an exact check.

A text is lower-cased and cut at ASCII white space; its elements are the hashes of all sequences
of five words. Every element owns an endless, hashed stream of darts: in each of its weight layers
([0, 1), [1, 2), [2, 4), ...) darts arrive along a rank axis at a rate of the layer's width. A
document takes the darts whose place in the layer lies under its weight for that element; each dart
belongs to one of K coordinates, and the earliest dart of a coordinate is kept. Two documents agree
in a coordinate with the probability of their weighted Jaccard similarity. Only darts up to a rank
of about K ln K over the total weight are thrown; where a coordinate stays empty, more follow.

Coordinates are banded. Members of a bucket are compared with the bucket's centre, its smallest
node, and links of the wanted similarity or more are joined to classes. Pairs whose signatures
agree in less than AGREE of K coordinates are passed over (a pair of similarity 0.8 does so with a
probability of 1e-9), all others are decided from the whole texts. Texts that share much, but not
enough, meet in large buckets; so the members of buckets that still hold several classes are banded
again with longer bands, which tell such texts apart. Where buckets of the first level still hold
several classes after that, small ones are compared pair by pair, and all members of the large ones
go to an exact similarity join: shingles are ordered rarest first, so that two similar texts share
one among their first few, and lengths and places of a shared shingle rule out most other pairs. No
step makes all pairs of a large group that has a passage in common. So a pair is missed only if it
shares no bucket of the first level (a pair of similarity 0.8: probability 3e-6) or agrees in fewer
than AGREE coordinates.

Cases: a class is named by the smallest doc_id in it. Exact copies (of the lower-cased text) are collapsed
first. Texts of fewer than five words belong together if their words are equal; so do texts without words. A null
text is alone with its doc_id. Each row is judged by its own text, so rows of one doc_id with different
texts can be in different classes, which `class_digest` tells apart. A row with a null doc_id has the
class of its exact copies, else null. An empty table gives an empty result. Other columns are
ignored. One text is the smallest unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import by_bytes, give_back, stage, table

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 96
#: Bands and coordinates of a band, for all texts and then for those in buckets of several classes.
LEVELS = ((24, 4), (48, 8), (96, 12))
#: Pairs that agree in fewer coordinates are not compared.
AGREE = 53
#: Buckets of several classes up to this size are compared pair by pair, larger ones by the exact join.
SMALL = 16
#: Shingles are counted in so many slots; the counts only say in which order the join takes them.
SLOTS = 1 << 20
#: Slots whose counts come to the driver as one row.
RANGE = 1 << 14
#: A shingle with more rows than this is dealt over several tasks of the join.
SALTED = 4096
#: Workers that compared texts of fewer bytes in a partition have no memory to give back.
GIVE_BACK = 1 << 21

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """P**i and P**-i modulo 2**64, as far as asked so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.full(size, p, np.uint64) for p in (_P, _PINV))
            for a in (self.up, self.down):
                a[0] = 1
                np.multiply.accumulate(a, out=a)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text, in order."""
    b = np.frombuffer(raw, np.uint8)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + U(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin])


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all sequences of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code = words[:n].copy()
    for i in range(1, size):
        code = code * _Q + words[i : i + n]
    return mix(code)


def elements(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of a text, sorted."""
    return np.unique(shingles(word_hashes(text.lower().encode()), size))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(best, ids, docs, weights, limits, k: int) -> None:
    """Keep in best[doc, coordinate] the earliest dart of rank under the document's limit."""
    layer, low, width = 0, 0.0, 1.0
    while len(ids):
        base = mix(ids + U((layer * 0xD6E8FEB86659FD93 + 0x1234567) & (2**64 - 1)))
        at, doc, weight, limit = base, docs, weights, limits
        rank, step = np.zeros(len(at)), 0
        while len(at):
            dart = mix(at + U((step * 0xA0761D6478BD642F) & (2**64 - 1)))
            rank = rank - np.log(_uniform(dart)) / width
            live = rank < limit
            if not live.all():
                at, doc, weight, limit, rank, dart = (x[live] for x in (at, doc, weight, limit, rank, dart))
            more = mix(dart)
            if low + width > weight.min(initial=np.inf):
                hit = low + width * _uniform(mix(more)) < weight
            else:
                hit = slice(None)
            one = more[hit]
            place = ((one >> U(32)) * U(k)) >> U(32)
            # The rank in front, as positive floats order like their bits, then the dart's own bits.
            value = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (one & U(0xFFFFFFFF))
            np.minimum.at(best, doc[hit] * k + place.astype(np.int64), value)
            step += 1
        layer, low, width = layer + 1, low + width, (width if layer == 0 else 2 * width)
        on = weights > low
        ids, docs, weights, limits = ids[on], docs[on], weights[on], limits[on]


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = COORDINATES) -> np.ndarray:
    """k coordinates of every weighted set (distinct hashes, positive weights); none may be empty."""
    none = np.uint64(2**64 - 1)
    best = np.full((len(sets), k), none, np.uint64)
    weights = weights or [np.ones(len(s)) for s in sets]
    limit = np.array([k * (np.log(k) + 2) / w.sum() for w in weights])
    todo = np.arange(len(sets))
    while len(todo):
        sizes = [len(sets[i]) for i in todo]
        part = np.full(len(todo) * k, none, np.uint64)
        _throw(
            part,
            np.concatenate([sets[i] for i in todo]),
            np.repeat(np.arange(len(todo)), sizes),
            np.concatenate([weights[i] for i in todo]).astype(float),
            np.repeat(limit[todo], sizes),
            k,
        )
        best[todo] = part.reshape(-1, k)
        todo = todo[(best[todo] == none).any(1)]
        limit[todo] *= 2
    return best


def band_places(level: int) -> np.ndarray:
    """Which coordinates each band of a level holds: apart on the first, drawn on the others."""
    bands, rows = LEVELS[level]
    if bands * rows <= COORDINATES:
        return np.arange(bands * rows).reshape(bands, rows)
    rng = np.random.default_rng(level)
    return np.stack([rng.permutation(COORDINATES)[:rows] for _ in range(bands)])


def band_keys(coordinates: np.ndarray, level: int) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    places = band_places(level)
    code = np.broadcast_to(np.arange(1, len(places) + 1, dtype=np.uint64) * _Q, (len(coordinates), len(places))).copy()
    for i in range(places.shape[1]):
        code = mix(code * _Q + coordinates[:, places[:, i]])
    return code.view(np.int64)


def digest_of(text: str | None) -> bytes | None:
    """Equal for texts that are copies: lower-cased, and under five words without regard to spaces."""
    if text is None:
        return None
    raw = text.lower().encode()
    if len(raw.split(None, SHINGLE)) < SHINGLE:
        return xxhash.xxh3_128_digest(b" ".join(raw.split()), seed=1)
    return xxhash.xxh3_128_digest(raw)


def text_digest(text: Column) -> Column:
    @F.arrow_udf("binary")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([digest_of(x.as_py()) for x in batch], pa.binary())
        give_back()

    return digest(text)


def signed(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """doc_id, digest of the text, and signature (null for texts under five words).

    The signature holds 32 bits of each coordinate. weighting: "set" weighs every distinct
    shingle one, "count" by how often it occurs.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes([batch], "text"):
                digests, sets, weights, where = [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    digests.append(digest_of(text))
                    if text is None:
                        continue
                    found = shingles(word_hashes(text.lower().encode()))
                    if len(found):
                        distinct, n = np.unique(found, return_counts=True)
                        sets.append(distinct)
                        weights.append(n if weighting == "count" else np.ones(len(n)))
                        where.append(row)
                none = np.ones(part.num_rows, bool)
                none[where] = False
                found = mix(signatures(sets, weights)) if sets else np.empty(0, np.uint64)
                ends = np.concatenate([[0], np.cumsum(~none) * COORDINATES]).astype(np.int32)
                values = pa.array(found.astype(np.uint32).view(np.int32).ravel())
                signs = pa.ListArray.from_arrays(ends, values, mask=pa.array(none))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digests, pa.binary()), signs], ["doc_id", "digest", "sign"]
                )
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(over, "doc_id long, digest binary, sign array<int>")


def _keys(level: int):
    @F.arrow_udf("array<long>")
    def keys(signs: pa.Array) -> pa.Array:
        coordinates = signs.flatten().to_numpy().view(np.uint32).reshape(-1, COORDINATES)
        found = band_keys(coordinates.astype(np.uint64), level)
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    return keys


def agreement(a: str, b: str) -> Column:
    """In how many coordinates two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def linked(pairs: DataFrame, texts: DataFrame, similarity: float, agree: int = AGREE) -> DataFrame:
    """Those of pairs(node, center) whose whole texts are at least so similar; no pair comes twice.

    texts: node, sign, text. The signature of the centre goes to the members, then the texts of the
    members that agree with it go to the centre. Rows come sorted by centre, whose shingles are made
    once in a row.
    """
    centre_signs = texts.select(F.col("node").alias("center"), F.col("sign").alias("center_sign"))
    member = texts.select("node", "sign", F.col("text").alias("member_text"))
    centre = texts.select(F.col("node").alias("center"), F.col("text").alias("center_text"))
    close = pairs.join(centre_signs, "center").join(member, "node")
    close = close.where(agreement("sign", "center_sign") >= agree).select("node", "center", "member_text")
    both = close.join(centre.hint("merge"), "center")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, held = None, None, 0
        for batch in batches:
            held += batch.nbytes
            for part in by_bytes([batch], "member_text"):
                nodes, centres = part.column("node").to_pylist(), part.column("center").to_pylist()
                texts_of, keep = part.column("member_text"), []
                for row, at in enumerate(centres):
                    if at != last or own is None:
                        last, own = at, elements(part.column("center_text")[row].as_py())
                    if jaccard(elements(texts_of[row].as_py()), own) >= similarity:
                        keep.append(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i in keep], pa.int64()), pa.array([centres[i] for i in keep], pa.int64())],
                    ["node", "center"],
                )
        if held >= GIVE_BACK:
            give_back()

    columns = both.select("node", "center", "member_text", "center_text")
    return columns.mapInArrow(over, "node long, center long")


def components(links: DataFrame, cut: int = 1) -> DataFrame:
    """node, comp: the smallest node that links(a, b) connect with it, for every node of a link.

    Each round takes the smallest label of the neighbours and then the label of that label, so
    the rounds are few even for long chains, and none follows once both ends of all links have one
    label. A label is a minimum, which is summed map-side.
    """
    links = stage(links.where(F.col("a") != F.col("b")).select("a", "b"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(F.explode(ways).alias("way")).select("way.a", "way.b")
    lowest = both.groupBy("a").agg(F.min("b").alias("low"))
    state = stage(lowest.select(F.col("a").alias("node"), F.least("a", "low").alias("comp")))
    while True:
        ends = links.join(state.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), "a")
        ends = ends.join(state.select(F.col("node").alias("b"), F.col("comp").alias("comp_b")), "b")
        if ends.where(F.col("comp_a") != F.col("comp_b")).isEmpty():
            return state
        near = (
            both.join(state.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        lower = state.join(near, "node").select("node", F.least("comp", "near").alias("mid"))
        jump = state.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        lower = lower.join(jump, "mid", "left")
        state = stage(lower.select("node", F.least("mid", F.coalesce("far", "mid")).alias("comp")))


def _labelled(rows: DataFrame, column: str, comps: DataFrame, name: str) -> DataFrame:
    """rows with the class of a node in a column."""
    known = comps.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    return (
        rows.join(known, rows[column] == known["_n"], "left")
        .withColumn(name, F.coalesce("_c", F.col(column)))
        .drop("_n", "_c")
    )


def _several(labelled: DataFrame) -> DataFrame:
    """Key and size of the buckets of rows(key, node, comp) that hold several classes."""
    sizes = labelled.groupBy("key").agg(
        F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    return sizes.where(F.col("low") < F.col("high")).select("key", "size")


def _small_pairs(labelled: DataFrame, several: DataFrame, small: int) -> DataFrame:
    """Pairs of different classes in buckets of at most `small` rows."""
    tiny = labelled.join(several.where(F.col("size") <= small).select("key"), "key")
    lists = tiny.groupBy("key").agg(F.collect_list(F.struct("node", "comp")).alias("rows"))
    each = lists.select(F.explode("rows").alias("x"), "rows").select("x", F.explode("rows").alias("y"))
    each = each.where((F.col("x.node") > F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")))
    return each.select(F.col("x.node").alias("node"), F.col("y.node").alias("center"))


def _slot_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of texts(text) fall in each of SLOTS slots; its size is fixed."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, elements(text.as_py()) & U(SLOTS - 1), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    def together(rows: pa.Table) -> pa.Table:
        at, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
        first, part = int(at[0]) // RANGE * RANGE, np.zeros(RANGE, "<u4")
        part[at - first] = np.minimum(n, 2**32 - 1)
        return pa.table({"first": [first], "counts": pa.array([part.tobytes()], pa.binary())})

    rows = texts.select("text").mapInArrow(over, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    ranges = rows.groupBy(F.floor(F.col("slot") / RANGE)).applyInArrow(together, "first long, counts binary")
    counts = np.zeros(SLOTS, np.uint32)
    for row in ranges.collect():
        counts[row["first"] : row["first"] + RANGE] = np.frombuffer(row["counts"], "<u4")
    return counts


def least_shared(size: int | Column, similarity: float):
    """Of how many shingles together two sets of so similar texts need to share how many at least."""
    need = size * (similarity / (1 + similarity)) - 1e-6
    return F.ceil(need) if isinstance(need, Column) else int(np.ceil(need))


def _prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """node, comp, size of its set, place and shingle of the rarest shingles of texts(node, comp, text).

    Two texts of the similarity share a shingle within these.
    """
    counts = texts.sparkSession.sparkContext.broadcast(_slot_counts(texts))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            for part in by_bytes([batch], "text"):
                firsts, sizes = [np.empty(0, np.uint64)], []
                for text in part.column("text"):
                    own = elements(text.as_py())
                    most = len(own) - int(np.ceil(len(own) * similarity - 1e-6)) + 1
                    firsts.append(own[np.lexsort((own, order[own & U(SLOTS - 1)]))][:most])
                    sizes.append(len(own))
                taken = [len(f) for f in firsts[1:]]
                places = np.concatenate([np.empty(0, np.int64), *map(np.arange, taken)])
                columns = [part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp")]
                columns = [np.repeat(c, taken) for c in (*columns, np.array(sizes, np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*columns, places, np.concatenate(firsts).view(np.int64))],
                    ["node", "comp", "size", "place", "shingle"],
                )

    columns = texts.select("node", "comp", "text")
    return columns.mapInArrow(over, "node long, comp long, size long, place long, shingle long")


def similar_candidates(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs(node, center) of different comp that hold all such pairs of the similarity.

    texts: node, comp, text. Of two texts the shorter is found by the shingles with which it can
    start to share enough with a text as long as itself, so what a group has in common is met only
    by those that have little of their own.
    """
    rows = stage(_prefixes(texts, similarity))
    met = rows.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    met = met.where(F.col("low") < F.col("high"))
    rows = stage(rows.join(met.select("shingle", F.ceil(F.col("n") / SALTED).cast("int").alias("salts")), "shingle"))
    longer = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("y")
    shorter = rows.where(F.col("size") - F.col("place") >= least_shared(2 * F.col("size"), similarity))
    shorter = shorter.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    left = F.least(x("size") - x("place"), y("size") - y("place"))
    both = shorter.join(
        longer,
        (x("shingle") == y("shingle"))
        & (x("salt") == y("salt"))
        & (x("comp") != y("comp"))
        & ((x("size") < y("size")) | ((x("size") == y("size")) & (x("node") < y("node"))))
        & (x("size") >= y("size") * similarity - 1e-6)
        & (left >= least_shared(x("size") + y("size"), similarity)),
    )
    return both.select(x("node").alias("node"), y("node").alias("center")).distinct()


def merged_classes(comps: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp after further links(node, center) between nodes of different classes.

    Only the classes that the new links touch are put together, not all links from the start.
    """
    ends = _labelled(_labelled(links, "node", comps, "a"), "center", comps, "b").select("a", "b")
    joined = components(ends)
    after = joined.select(F.col("node").alias("comp"), F.col("comp").alias("_after"))
    moved = comps.join(after, "comp", "left").select("node", F.coalesce("_after", "comp").alias("comp"))
    return stage(moved.unionByName(joined.join(comps.select("node"), "node", "left_anti")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """doc_id, digest, class_id and class_digest of every row of docs(doc_id, text).

    A class is named by its smallest doc_id, and the smallest digest that doc_id has in it.
    """
    marked = stage(signed(docs))
    # Exact copies collapse in map-side aggregation; what follows sees each text once.
    nodes = stage(
        marked.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
        .groupBy("digest", "doc_id")
        .agg(F.count("*").alias("rows"), F.first("sign").alias("sign"))
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "rows")).alias("_first"), F.first("sign").alias("sign"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "sign", "_first.doc_id", "_first.rows")
    )
    signs = nodes.where(F.col("sign").isNotNull()).select("node", "sign")
    none = docs.sparkSession.createDataFrame([], "node long, center long")
    tried, texts = none, None
    comps = none.select("node", F.col("center").alias("comp"))
    active, first = signs, None

    def compare(pairs: DataFrame, once: bool = False) -> None:
        """Link what is similar of pairs that lie in different classes and were not compared.

        once: no pair comes twice, and none was compared before.
        """
        nonlocal tried, comps
        if not once:
            pairs = pairs.select(F.greatest("node", "center").alias("node"), F.least("node", "center").alias("center"))
            pairs = pairs.distinct().join(tried, ["node", "center"], "left_anti")
        pairs = _labelled(_labelled(pairs, "node", comps, "_a"), "center", comps, "_b")
        pairs = stage(pairs.where(F.col("_a") != F.col("_b")).select("node", "center"))
        if pairs.isEmpty():
            return
        found = stage(linked(pairs, texts, similarity))
        tried = tried.unionAll(pairs)
        if not found.isEmpty():
            comps = merged_classes(comps, found)

    for level in range(len(LEVELS)):
        rows = active.select("node", F.explode(_keys(level)("sign")).alias("key"))
        shared = rows.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("most"))
        shared = shared.where(F.col("center") < F.col("most")).select("key", "center")
        members = stage(rows.join(shared, "key"))
        pairs = members.where("node <> center").select("node", "center")
        if level == 0:
            first, waiting = members, pairs
            texts = stage(_texts_of(docs, nodes.join(members.select("node").distinct(), "node", "left_semi")))
            # Most texts are alike to the smallest of their centres; the other centres wait for that,
            # and go with those of the next level.
            compare(pairs.groupBy("node").agg(F.min("center").alias("center")), once=True)
        else:
            compare(pairs if level > 1 else waiting.unionAll(pairs))
        if level + 1 < len(LEVELS):
            labelled = stage(_labelled(members.select("key", "node"), "node", comps, "comp"))
            several = stage(_several(labelled))
            if several.isEmpty():
                break
            open_nodes = labelled.join(several.select("key"), "key", "left_semi").select("node").distinct()
            active = stage(signs.join(open_nodes, "node", "left_semi"))

    # What is still undecided shares a bucket of the first level.
    if level or len(LEVELS) == 1:
        labelled = stage(_labelled(first.select("key", "node"), "node", comps, "comp"))
        several = stage(_several(labelled))
        pairs = _small_pairs(labelled, several, small)
        large = labelled.join(several.where(F.col("size") > small).select("key"), "key", "left_semi")
        large = stage(large.select("node").distinct().join(texts.select("node", "text"), "node"))
        if not large.isEmpty():
            pairs = pairs.unionAll(similar_candidates(_labelled(large, "node", comps, "comp"), similarity))
        compare(pairs)

    named = nodes.select("node", "digest", F.struct("doc_id", "digest").alias("_own"))
    of_class = named.join(comps, "node").groupBy("comp").agg(F.min("_own").alias("_class"))
    classes = (
        named.join(comps.join(of_class, "comp").select("node", "_class"), "node", "left")
        .select("digest", F.coalesce("_class", "_own").alias("_class"))
        .select("digest", F.col("_class.doc_id").alias("class_id"), F.col("_class.digest").alias("class_digest"))
    )
    alone = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return (
        marked.select("doc_id", "digest")
        .join(classes, "digest", "left")
        .select("doc_id", "digest", alone.alias("class_id"), "class_digest")
    )


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, signature and text of nodes(node, doc_id, digest, rows, sign)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    found = found.withColumn("digest", text_digest(F.col("text")))
    if not nodes.where(F.col("rows") > 1).isEmpty():
        # Rows that are repeated whole collapse before they meet.
        found = found.dropDuplicates(["doc_id", "digest"])
    nodes = nodes.select("node", "doc_id", "digest", "sign")
    return found.join(nodes, ["doc_id", "digest"]).select("node", "sign", "text")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
