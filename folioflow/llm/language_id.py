"""Language identification from averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; its subwords are the sequences of 2 to 4 bytes of its UTF-8 form that lie in
one word, with the space before or after it. Each is hashed to a row of an embedding table; the
mean of the rows goes through a linear layer and a softmax. Table and layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled texts (whole texts and short
cuts of them). A temperature makes the probabilities honest on labelled texts that were kept out,
and a text is rejected if its probability is lower than that of all but `REJECTED` of the kept-out
texts that were recognised (and under `SURE`).

Cases: a null text, and one without a letter, is `und` with score 0 and rejected. A subword whose row
was never trained says next to nothing, so a text in an unknown script gets a low probability and
is rejected. Very long texts are used whole. Rows without a label are not learned from; without any
labelled row every text is `und`; with a single language each text with letters gets it. Languages
are taken in alphabetical order, so ties go to the first. Repeated rows each give a row. An empty table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import fold, give_back, table

BUCKETS = 1 << 16
WIDTH = 16
#: At most about so many labelled texts of each language are learned from.
MOST_ROWS = 1000
REJECTED = 0.001
SURE = 0.5
NONE = "und"
#: Bytes of the short cuts that are learned beside a whole text, and how many.
CUTS = (24, 60, 200)
SLOTS = 1 << 20
#: ASCII other than letters separates words.
_WORDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def subwords(text: str) -> np.ndarray:
    """Table rows of all subwords of a text; row 0 stands for none."""
    raw = b" " + text.lower().encode().translate(_WORDS) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    space = b == 32
    rows, code, inside = [], b[:-1] * np.uint32(257) + b[1:], None
    for size in (2, 3, 4):
        if size > 2:
            if len(b) < size:
                break
            inner = space[size - 2 : len(b) - 1]
            inside = inner if inside is None else inside[: len(inner)] | inner
            code = code[: len(b) - size + 1] * np.uint32(257) + b[size - 1 :]
        row = (code ^ (code >> np.uint32(15))) * _MIX[size - 2]
        row = (row >> np.uint32(16)) % np.uint32(BUCKETS - 1) + np.uint32(1)
        if inside is None:
            row = np.where(space[:-1] & space[1:], np.uint32(0), row)
        else:
            row = np.where(inside, np.uint32(0), row)
        rows.append(row)
    return np.concatenate(rows)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class LanguageModel:
    """Languages with, for every table row, what it adds to each language's logit."""

    def __init__(self, languages: list[str], logits: np.ndarray, temperature: float, least: float):
        self.languages, self.logits = languages, logits.astype(np.float32)
        self.temperature, self.least = temperature, least

    def raw(self, text: str) -> np.ndarray:
        rows = subwords(text)
        known = np.count_nonzero(rows)
        return np.take(self.logits, rows, axis=0).sum(0, dtype=np.float64) / max(known, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return NONE, 0.0
        chances = softmax(self.raw(text) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def descend(
    examples: list[tuple[np.ndarray, np.ndarray, int]], languages: int, epochs: int = 3, rate: float = 0.5, seed: int = 1
) -> np.ndarray:
    """Stochastic gradient descent over (rows, weights, language); the trained logits of each row."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.5, (WIDTH, languages)).astype(np.float32)
    start, steps, step = table.copy(), max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for at in rng.permutation(len(examples)):
            rows, weights, language = examples[at]
            mean = weights @ table[rows]
            slope = softmax(mean @ layer)
            slope[language] -= 1.0
            now = rate * (1 - step / steps)
            # A mean over many rows moves each row little: the step is scaled by the weights' square sum.
            back = (now / (weights @ weights + 0.01)) * (layer @ slope)
            layer -= (now * 0.1) * np.outer(mean, slope)
            table[rows] -= weights[:, None] * back
            step += 1
    table[(table == start).all(1)] = 0
    table[0] = 0
    return table @ layer


def calibrate(raw: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the probability under which a text is rejected."""
    if not len(raw):
        return 1.0, 0.0
    grid = 2.0 ** np.arange(-6, 4.25, 0.25)
    loss = [-np.log(softmax(raw / t)[np.arange(len(raw)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    chances = softmax(raw / temperature)
    right = chances.argmax(1) == truth
    if not right.any():
        return temperature, 0.0
    # A text that says nothing gets the same chance for all languages; that must not be enough.
    most = max(SURE, 1.05 / raw.shape[1]) if raw.shape[1] > 1 else SURE
    return temperature, min(most, float(np.quantile(chances.max(1)[right], REJECTED)))


def _examples(places: dict[str, int]):
    """Sparse mean vectors of whole texts and of cuts from their middle."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("text", "lang", "held"))
            for text, lang, held in zip(*columns):
                if not has_letter(text):
                    continue
                cuts = [text[len(text) // 2 : len(text) // 2 + n] for n in CUTS if n < len(text)]
                for part in [text] if held else [text, *cuts]:
                    rows, n = np.unique(subwords(part), return_counts=True)
                    n = n[rows > 0]
                    rows = rows[rows > 0]
                    if len(rows):
                        weights = (n / n.sum()).astype(np.float32)
                        out.append((rows.astype("<i4").tobytes(), weights.tobytes(), places[lang], held))
            names = ["rows", "weights", "language", "held"]
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names
            )

    return over


def train(docs: DataFrame, most_rows: int = MOST_ROWS) -> LanguageModel:
    """A model from docs(doc_id, text, lang), which holds only rows that may be learned from.

    About `most_rows` texts of each language are chosen by a hash of the id. A text's example is a
    vector over at most BUCKETS rows however long it is, so what the driver gathers is bounded.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), 1.0, 0.0)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    limit = F.lit(0)
    for name in languages:
        limit = F.when(F.col("lang") == name, int(SLOTS * min(1.0, most_rows / counts[name]))).otherwise(limit)
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 3
    sample = usable.where(slot < limit).select("text", "lang", held.alias("held"))
    places = {name: i for i, name in enumerate(languages)}
    found = sample.mapInArrow(
        _examples(places), "rows binary, weights binary, language int, held boolean"
    ).toArrow()
    seen = sorted(
        (h, language, rows, weights)
        for rows, weights, language, h in zip(*(found.column(i).to_pylist() for i in range(4)))
    )
    parsed = [(h, np.frombuffer(r, "<i4"), np.frombuffer(w, np.float32), k) for h, k, r, w in seen]
    logits = descend([x[1:] for x in parsed if not x[0]], len(languages))
    kept = [x for x in parsed if x[0]]
    raw = np.array([w @ logits[r] for _, r, w, _ in kept]).reshape(len(kept), len(languages))
    temperature, least = calibrate(raw, np.array([k for *_, k in kept], int))
    del found, seen, parsed, kept
    give_back()
    return LanguageModel(languages, logits, temperature, least)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "lang") -> DataFrame:
    """The rows of docs with {prefix}_pred, {prefix}_score and {prefix}_rejected.

    Only the text goes to Python.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("pred string, score double, rejected boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = sent.value
        for batch in batches:
            parts = (batch.slice(i, 1000).to_pylist() for i in range(0, len(batch), 1000))
            found = [known.predict(t) for part in parts for t in part]
            columns = (
                pa.array([name for name, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64()),
                pa.array([name == NONE or score < known.least for name, score in found], pa.bool_()),
            )
            yield pa.StructArray.from_arrays(columns, names=["pred", "score", "rejected"])
        give_back()

    marked = docs.withColumn(f"_{prefix}", predict(F.col(text)))
    parts = {f"{prefix}_{c}": F.col(f"_{prefix}")[c] for c in ("pred", "score", "rejected")}
    return marked.withColumns(parts).drop(f"_{prefix}")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 4)
    model = train(docs.where((held != 2) & (held >= 0)))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (held == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
