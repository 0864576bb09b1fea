"""Toxicity from class-conditional Kneser-Ney models of how words are spelled.

Two models of order `ORDER` over the characters of words, one from toxic and one from ordinary
labelled documents, share the continuation counts of their short contexts; an expression that was
never seen as a whole is thus judged by the stems and endings that either class has shown. Counts
of long contexts are the class's own. A document is judged by the difference of both
log-likelihoods per word, over the whole text and over its most toxic short window, which a
logistic curve turns into a score; the curve is fitted on labelled documents that the counts
have not seen.

Cases: a null or empty text, and one without letters or digits, has no words and gets the score of
a likelihood difference of zero. Very long texts are scored whole. Documents whose label is null or
missing take no part in training; if a document's labels differ, one toxic label makes it toxic.
Repeated rows are scored each. A null id is in no fold that is learned from. If either
class has fewer than two labelled documents with words, every score is the share of toxic labels (0
without labels). An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.chunks import Cache
from folioflow.llm.common import fold, give_back, table

ORDER = 6
#: Contexts of fewer characters than this have counts of both classes together.
SHARED = 3
#: Words whose likelihoods are averaged for the most toxic passage.
WINDOW = 4
BEGIN, END = "\x02", "\x03"
WORD = re.compile(r"[^\W_]+")
#: At most about so many documents of each class are learned from.
MOST_ROWS = 12_000
#: Longer words are judged in slices of this length.
LONGEST = 64
SLOTS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _slices(word: str) -> list[str]:
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def grams(word: str) -> list[str]:
    """Every character of the word and its end, each after the ORDER - 1 characters before it."""
    padded = BEGIN * (ORDER - 1) + word + END
    return [padded[i : i + ORDER] for i in range(len(padded) - ORDER + 1)]


class KneserNey:
    """Interpolated Kneser-Ney over characters, for both classes at once.

    seen: ORDER-grams with their counts in toxic and in ordinary text. At the highest order these
    counts are used, below it the number of different characters that a gram was seen after; up
    to SHARED - 1 characters of context, in either class. Of the highest order only the logarithm
    of the classes' ratio is kept, per gram; below it both chances.
    """

    def __init__(self, seen: list[str], toxic: np.ndarray, ordinary: np.ndarray):
        grams = np.array(seen, f"U{ORDER}")
        n = np.stack([toxic, ordinary], 1).astype(float)
        order = np.argsort(grams)
        levels = [(grams[order], n[order])]
        for size in range(ORDER - 1, 0, -1):
            above, counts = levels[0]
            value = np.minimum(counts, 1.0)
            if size <= SHARED:
                value = np.repeat(value.max(1, keepdims=True), 2, 1)
            names, at = np.unique(_cut(above, 1, size + 1), return_inverse=True)
            levels.insert(0, (names, _summed(value, at, len(names))))
        #: Names and both chances of the grams of each size under ORDER.
        self.chances: list[tuple[np.ndarray, np.ndarray]] = []
        #: Names of the contexts of each size and what they leave to shorter ones.
        self.rests: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = 1.0 / (len(levels[0][0]) + 1)
        lower = np.full((len(levels[0][0]), 2), self.floor)
        for size, (names, counts) in enumerate(levels, 1):
            if size > 1:
                below, value = levels[size - 2][0], lower
                lower = value[np.searchsorted(below, _cut(names, 1, size))]
            once, twice = (counts == 1).sum(0), (counts == 2).sum(0)
            discount = np.where(once > 0, once / np.maximum(once + 2.0 * twice, 1), 0.5)
            places, at = np.unique(_cut(names, 0, size - 1), return_inverse=True)
            total = _summed(counts, at, len(places))
            taken = _summed(np.minimum(counts, discount), at, len(places))
            rest = np.where(total > 0, taken / np.maximum(total, 1e-300), 1.0)
            kept = np.maximum(counts - discount, 0) / np.maximum(total[at], 1e-300)
            lower = kept + rest[at] * lower
            self.rests.append((places, rest))
            if size < ORDER:
                self.chances.append((names, lower))
            else:
                self.ratios = (names, np.log(lower[:, 0] / lower[:, 1]))


class Lookup:
    """A model's tables, with dictionaries of the names' places in the arrays."""

    def __init__(self, model: KneserNey):
        places = lambda names: dict(zip(names.tolist(), range(len(names))))
        self.chance = [places(names) for names, _ in model.chances]
        self.left_over = [places(names) for names, _ in model.rests]
        self.chances = [both for _, both in model.chances]
        self.rests = [both for _, both in model.rests]
        self.ratio = dict(zip(model.ratios[0].tolist(), model.ratios[1].tolist()))
        self.floor = model.floor

    def log_ratio(self, gram: str) -> float:
        """How much likelier the last character is in toxic text, after the others."""
        known = self.ratio.get(gram)
        if known is None:
            toxic, ordinary = self.of(gram)
            known = float(np.log(toxic / ordinary))
        return known

    def of(self, gram: str) -> tuple[float, float]:
        """The last character's chance in toxic and ordinary text; not for seen ORDER-grams."""
        size, toxic, ordinary = len(gram), 1.0, 1.0
        while size:
            found = self.chance[size - 1].get(gram) if size < ORDER else None
            if found is not None:
                both = self.chances[size - 1][found].tolist()
                return toxic * both[0], ordinary * both[1]
            rest = self.left_over[size - 1].get(gram[:-1])
            if rest is not None:
                both = self.rests[size - 1][rest].tolist()
                toxic, ordinary = toxic * both[0], ordinary * both[1]
            gram, size = gram[1:], size - 1
        return toxic * self.floor, ordinary * self.floor


def _cut(names: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Characters begin to end of equally long strings."""
    size = names.dtype.itemsize // 4
    if begin == end:
        return np.full(len(names), "", "U1")
    parts = names.view(np.uint32).reshape(len(names), size)[:, begin:end]
    return np.ascontiguousarray(parts).view(f"U{end - begin}").ravel()


def _summed(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, i], size) for i in range(values.shape[1])], 1)


def _word(seen: dict[str, float], more: dict[str, float], word: str) -> float:
    """A word's likelihood difference from those of its grams: seen ones, and all others."""
    total = 0.0
    for part in _slices(word):
        for gram in grams(part):
            known = seen.get(gram)
            total += more[gram] if known is None else known
    return total


class Judge:
    """Likelihood differences of words and documents, with tables of bounded size.

    The tables don't refer to the judge, so they go with it at once.
    """

    def __init__(self, model: KneserNey, most: int = 200_000):
        self.model = Lookup(model)
        self.gram = Cache(self.model.log_ratio, most // 2)
        self.word = Cache(partial(_word, self.model.ratio, self.gram), most)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Difference per word over the text, over its most toxic window, and the number of words."""
        words = words_of(text)
        if not words:
            return 0.0, 0.0, 0.0
        n = len(words)
        sums = np.zeros(n + 1)
        np.cumsum(np.fromiter(map(self.word.__getitem__, words), float, n), out=sums[1:])
        width = min(WINDOW, n)
        return sums[-1] / n, float((sums[width:] - sums[:-width]).max()) / WINDOW, float(n)


def _inputs(features: np.ndarray) -> np.ndarray:
    """What the curve sees: both differences, and the length that a maximum grows with."""
    f = np.asarray(features, float).reshape(-1, 3)
    return np.column_stack([np.ones(len(f)), 10 * f[:, 0], f[:, 1], np.log1p(f[:, 2])])


def fit_curve(features: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve, by Newton steps with a small penalty."""
    x, beta = _inputs(features), np.zeros(4)
    penalty = np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (p - toxic)) + penalty @ beta
        step = np.linalg.solve(x.T @ (x * (weights * p * (1 - p) + 1e-9)[:, None]) + penalty, slope)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return beta


def curve(beta: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(features) @ beta, -30, 30)))


def training_rows(
    docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, dealt: bool = False
) -> tuple[DataFrame, dict]:
    """text, toxic and part of the labelled documents to learn from, and each class's share taken.

    About `most_rows` documents of each class are chosen by a hash of the id, so the list of ids
    that is sent to the scan is bounded and no text is shuffled. Part 2 fits the curve, parts 0
    and 1 give the counts. dealt: the documents of each class are dealt over the parts in turn.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    # Labels of documents that may not be learned from count nowhere.
    usable = usable.join(docs.select("doc_id"), "doc_id", "left_semi")
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    share = {c: min(1.0, most_rows / rows[c]) if rows.get(c) else 0.0 for c in (0, 1)}
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    limit = F.when(F.col("toxic") == 1, share[1] * SLOTS).otherwise(share[0] * SLOTS)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))
    chosen = one.where(F.col("toxic").isin(0, 1) & (slot < limit)).select(
        F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"), part.alias("_part")
    )
    if dealt:
        turn = Window.partitionBy("_toxic").orderBy(F.xxhash64("_id", F.lit(7)), "_id")
        with_words = docs.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select(F.col("doc_id").alias("_id"))
        chosen = chosen.join(with_words, "_id", "left_semi")
        chosen = chosen.withColumn("_part", F.pmod(F.row_number().over(turn) + 1, F.lit(3)))
    taken = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return taken.select("text", F.col("_toxic").alias("toxic"), F.col("_part").alias("part")), {
        "share": share,
        "rows": rows,
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    words: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words.update((w, toxic) for w in words_of(text))
    found: dict[str, list[int]] = {}
    for (word, toxic), n in words.items():
        for part in _slices(word):
            for gram in grams(part):
                found.setdefault(gram, [0, 0])[1 - toxic] += n
    wide = np.array(list(found), f"U{ORDER}").tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([wide[i : i + 4 * ORDER] for i in range(0, len(wide), 4 * ORDER)], pa.binary()),
            pa.array([n[0] for n in found.values()], pa.int64()),
            pa.array([n[1] for n in found.values()], pa.int64()),
        ],
        ["gram", "n_toxic", "n_ordinary"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _counted(batches)
    give_back()


class ToxicityModel:
    """What `train` has learned; sent to the tasks once."""

    def __init__(self, model: KneserNey | None, beta: np.ndarray | None, prior: float):
        self.model, self.beta, self.prior = model, beta, prior
        self._judge: Judge | None = None

    def __getstate__(self):
        return self.__dict__ | {"_judge": None}

    def forget(self) -> None:
        """Let go of the words judged so far."""
        self._judge = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.prior)
        self._judge = self._judge or Judge(self.model)
        return curve(self.beta, np.array([self._judge.features(t) for t in texts]).reshape(-1, 3))


def train(
    docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, dealt: bool = False
) -> ToxicityModel:
    """Counts and curve from labelled documents; docs holds only those that may be learned from.

    If counts or curve lack a class, as can happen with few labels, both are learned once more from
    parts that its documents are dealt over in turn.
    """
    rows, known = training_rows(docs, labels, most_rows, dealt)
    n = known["rows"]
    prior = n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    if not n.get(0) or not n.get(1):
        return ToxicityModel(None, None, prior)
    summed = (
        rows.where("part < 2")
        .mapInArrow(_count, "gram binary, n_toxic long, n_ordinary long")
        .groupBy("gram")
        .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_ordinary").alias("n_ordinary"))
        .toArrow()
    )
    if not all(summed.num_rows and summed.column(c).to_numpy().any() for c in ("n_toxic", "n_ordinary")):
        return ToxicityModel(None, None, prior) if dealt else train(docs, labels, most_rows, True)
    model = KneserNey(
        np.frombuffer(b"".join(x.as_py() for x in summed.column("gram")), f"U{ORDER}"),
        summed.column("n_toxic").to_numpy(),
        summed.column("n_ordinary").to_numpy(),
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            f = np.array([judge.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(f[:, 2]), batch.column("toxic").cast(pa.int32())],
                ["whole", "window", "words", "toxic"],
            )
        judge = batch = None
        give_back()

    # Sorted here: a sort in Spark would measure all rows a second time, to find its ranges.
    names = ["whole", "window", "words", "toxic"]
    held = rows.where("part = 2").mapInArrow(measure, "whole double, window double, words double, toxic int").toArrow()
    held = held.sort_by([(name, "ascending") for name in names])
    features = np.column_stack([held.column(c).to_numpy() for c in names[:3]])
    toxic = held.column("toxic").to_numpy().astype(float)
    if len(set(toxic)) < 2:
        return ToxicityModel(None, None, prior) if dealt else train(docs, labels, most_rows, True)
    weights = np.where(toxic == 1, 1 / known["share"][1], 1 / known["share"][0])
    sent.destroy()
    beta = fit_curve(features, toxic, weights / weights.mean())
    del summed, held, sent
    give_back()
    return ToxicityModel(model, beta, prior)


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text", output: str = "toxicity") -> DataFrame:
    """The rows of docs with a column of scores, 0 to 1; only the text goes to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = (batch.slice(i, 1000).to_pylist() for i in range(0, len(batch), 1000))
            yield pa.array(np.concatenate([np.empty(0), *map(sent.value.scores, parts)]))
        batch = parts = None
        sent.value.forget()
        give_back()

    return docs.withColumn(output, score(F.col(text)))


def op1_toxicity(
    spark: SparkSession, sf_dir: str, threshold: float = 0.7, most_rows: int = MOST_ROWS
) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold("doc_id", 3)
    learned = docs.where((held != 1) & (held >= 0))
    model = train(learned, table(spark, sf_dir, "labels"), most_rows)
    return score_texts(docs, model).select(
        "doc_id",
        (held == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= threshold).cast("int").alias("predicted"),
    )
