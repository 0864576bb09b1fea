"""A hidden Markov language model over whole texts, beside a smoothed word-frequency base.

Tokens are the words of a text (A-Z lower-cased, cut at ASCII white space) and one end. All
training tokens are counted. The most frequent words are the model's own symbols; every other word
is a symbol of its ending's class, times its smoothed share of that class, which does not depend on
the state. Baum-Welch trains the states on all training texts, cut into stretches: each partition
sums its expected counts, the partitions' sums are added in a tree, and the driver holds only arrays
of states x symbols. The states start from groups of frequent words that occur together. A text's
score is its exact likelihood by the scaled forward recursion over all of its tokens.

Counts of frequent words travel with the model (at most KNOWN words); the counts of all others are
joined to the texts that hold them, so no word is left out and nothing sent grows with the corpus.

Cases: a null or empty text, or one of white space only, is the end alone. A null id is in no fold
and is not learned from. Repeated rows are learned from and scored each. Without training texts N
and V are 0, no token is known and the states are equal. Very long texts are scored whole. An empty
table gives an empty result. Other columns are ignored. Words with invalid or unusual characters
are ordinary words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import by_bytes, fold, stage, table

STATES = 8
ROUNDS = 4
#: Words that are symbols of their own, and classes of endings for the rest.
HEAD, ENDINGS = 1 << 14, 1 << 10
#: Words whose counts are sent to the tasks.
KNOWN = 1 << 18
#: Tokens in a training stretch, and tokens that a task works on at a time.
STRETCH, BLOCK = 256, 1_500_000
#: Words whose company starts the states.
FIRST = 256
ADD = 0.1
#: Pseudo-tokens that pull each state's emissions to the words' frequencies.
PRIOR = 50.0
END = " "
SYMBOLS = 1 + HEAD + ENDINGS


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, without the end."""
    return text.encode().lower().split() if text else []


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def count_tokens(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """token and n over all texts; the end is a single space. Pre-summed in each task."""

    def rows(counts: Counter) -> pa.RecordBatch:
        words = [w.decode() for w in counts]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"]
        )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in by_bytes([batch], "text"):
                for text in part.column("text").to_pylist():
                    counts.update(tokens(text))
                counts[END.encode()] += part.num_rows
                if len(counts) > most:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return docs.select("text").mapInArrow(over, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """What tasks need to know of the training words."""

    total: int
    distinct: int
    known: list[tuple[str, int]]  # the most frequent first
    class_total: np.ndarray
    class_distinct: np.ndarray
    ends: int
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def tables(self) -> dict:
        """Lookup tables, made once in each worker."""
        if not self._made:
            words = [w.encode() for w, _ in self.known]
            n = np.array([n for _, n in self.known], float)
            classes = np.array([ending(w) for w in words], np.int64)
            own = np.arange(len(words)) < HEAD
            self._made = {
                "place": {w: i for i, w in enumerate(words)},
                "symbol": np.where(own, 1 + np.arange(len(words)), 1 + HEAD + classes),
                "log": np.log10(n + ADD),
                "own": own,
                "class": classes,
                "norm": np.log10(self.class_total + ADD * (self.class_distinct + 1)),
                "ending": {},
            }
        return self._made

    def shares(self) -> np.ndarray:
        """How frequent each symbol is in the training tokens."""
        n = np.zeros(SYMBOLS)
        n[0] = self.ends
        head = self.known[:HEAD]
        n[1 : 1 + len(head)] = [c for _, c in head]
        n[1 + HEAD :] = self.class_total
        return (n + ADD) / (n + ADD).sum()


def gather_words(counts: DataFrame, known: int = KNOWN, head: int = HEAD) -> Words:
    """Totals, and the words above a count that at most `known` words reach."""
    end = F.col("token") == END
    sums = counts.agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(end, F.col("n"))).alias("ends")
    ).first()
    words = counts.where(~end)
    # Steps of a sixteenth of a doubling: the list of steps is short however long the counts are.
    step = F.floor(F.log2("n") * 16).cast("int")
    heights = sorted(((r["s"], r["count"]) for r in words.groupBy(step.alias("s")).count().collect()), reverse=True)
    least, held = None, 0
    for height, n in heights:
        if held + n > known:
            break
        least, held = height, held + n
    found = [] if least is None else words.where(step >= least).select("token", "n").toArrow().to_pylist()
    ranked = sorted(((r["token"], r["n"]) for r in found), key=lambda x: (-x[1], x[0]))
    rank_limit = ranked[:head]
    classes = F.crc32(F.substring(F.col("token").cast("binary"), -2, 2)) % ENDINGS
    sizes = words.groupBy(classes.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in sizes:
        total[r["c"]], distinct[r["c"]] = r["n"], r["v"]
    for word, n in rank_limit:
        total[ending(word.encode())] -= n
        distinct[ending(word.encode())] -= 1
    return Words(sums["total"] or 0, sums["distinct"], ranked, total, distinct, sums["ends"] or 0)


CODED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_all double, "
    "log_tail double, log_norm double, symbols binary, rare array<string>"
)


def coded(docs: DataFrame, words: Words) -> DataFrame:
    """Every text as symbols, with the sums over the tokens whose counts are known, and the rest."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    names = [x.split()[0] for x in CODED.split(", ")]

    def one(text: str | None, t: dict, ends: int) -> tuple:
        found = tokens(text)
        get = t["place"].get
        at = np.array([get(w, -1) for w in found], np.int64)
        missing = np.flatnonzero(at < 0)
        symbols = np.zeros(len(found) + 1, np.uint16)
        rare = [found[i] for i in missing]
        known = at[at >= 0] if len(rare) else at
        symbols[:-1][at >= 0] = t["symbol"][known]
        classes = []
        for w in rare:
            c = t["ending"].get(w[-2:])
            if c is None:
                c = t["ending"][w[-2:]] = ending(w)
            classes.append(c)
        classes = np.array(classes, np.int64)
        symbols[missing] = 1 + HEAD + classes
        log, tail = t["log"][known], ~t["own"][known]
        end = np.log10(ends + ADD)
        norm = t["norm"][t["class"][known[tail]]].sum() + t["norm"][classes].sum()
        return (
            len(found) + 1,
            len(known) + (ends > 0),
            float(log.sum() + end),
            float(log[tail].sum()),
            float(norm),
            symbols.tobytes(),
            [w.decode() for w in rare],
        )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        t, rid = known.tables(), TaskContext.get().partitionId() << 36
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.binary(), pa.list_(pa.string())]
        for batch in batches:
            for part in by_bytes([batch], "text"):
                rows = [one(x, t, known.ends) for x in part.column("text").to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                ids = pa.array(np.arange(rid, rid + len(rows)))
                rid += len(rows)
                yield pa.RecordBatch.from_arrays([ids, part.column("doc_id"), part.column("held_out"), *columns], names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(over, CODED)


@dataclass
class Hmm:
    start: np.ndarray  # state
    move: np.ndarray  # state, next state
    emit: np.ndarray  # symbol, state
    resume: np.ndarray  # state that a later stretch begins in


def _steps(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by step (longest sequences first), how many sequences each step has, their order."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    step = np.arange(len(flat)) - np.repeat(begin, sizes)
    rank = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.concatenate(([0], np.cumsum(live)[:-1]))
    symbols = np.empty(len(flat), np.int64)
    symbols[offset[step] + rank] = flat
    return symbols, live, order


def expected(model: Hmm, sequences: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of the sequences as one array: emissions, moves, starts, log likelihood.

    first marks the sequences that begin a text.
    """
    states = len(model.start)
    symbols, live, order = _steps(sequences)
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    at = np.concatenate(([0], np.cumsum(live)))
    seen = emit[symbols]
    alpha, scale = np.empty_like(seen), np.empty(len(symbols), np.float32)
    begins = first[order]
    now = np.where(begins[:, None], model.start, model.resume).astype(np.float32)
    for t in range(len(live)):
        row = slice(at[t], at[t + 1])
        now = (now if t == 0 else now[: live[t]] @ move) * seen[row]
        scale[row] = now.sum(1)
        now = now / scale[row][:, None]
        alpha[row] = now
    moved = np.zeros((states, states))
    back = None
    for t in range(len(live) - 1, -1, -1):
        row = slice(at[t], at[t + 1])
        beta = np.ones((live[t], states), np.float32)
        if back is not None:
            n = len(back)
            moved += alpha[at[t] : at[t] + n].T @ back
            beta[:n] = back @ move.T
        back = seen[row] * beta / scale[row][:, None]
        alpha[row] *= beta
    emitted = np.stack([np.bincount(symbols, alpha[:, k], SYMBOLS) for k in range(states)], 1)
    started = alpha[: live[0]][begins].sum(0)
    tail = [float(np.log(scale.astype(np.float64)).sum()), float(len(symbols))]
    return np.concatenate((emitted.ravel(), (moved * model.move).ravel(), started, tail))


def company(sequences: list[np.ndarray]) -> np.ndarray:
    """In how many stretches two of the most frequent words both occur."""
    rows = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    flat = np.concatenate(sequences).astype(np.int64)
    here = (flat > 0) & (flat <= FIRST)
    seen = np.zeros((len(sequences), FIRST), np.float32)
    seen[rows[here], flat[here] - 1] = 1
    return (seen.T @ seen).astype(np.float64).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        for data in batch.column("symbols"):
            held.append(np.frombuffer(data.as_py(), np.uint16))
            size += len(held[-1])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _cut(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [[t[i : i + STRETCH] for i in range(0, len(t), STRETCH)] for t in texts]
    first = np.array([i == 0 for p in parts for i in range(len(p))])
    return [s for p in parts for s in p], first


def summed(training: DataFrame, measure) -> np.ndarray | None:
    """Sum of measure(stretches, first) over all texts: in each task, then in a tree over the tasks."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for texts in _blocks(batches):
            found = measure(*_cut(texts))
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    rows = training.select("symbols").mapInArrow(over, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]).copy())
    nothing = np.zeros(0)

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b if not len(a) else a if not len(b) else a + b

    total = rows.treeAggregate(nothing, add, add, depth=2)
    return total if len(total) else None


def first_states(company: np.ndarray | None, shares: np.ndarray, states: int = STATES) -> Hmm:
    """States that prefer groups of frequent words which keep the same company."""
    emit = np.repeat(shares[:, None], states, 1)
    if company is not None:
        c = company.reshape(FIRST, FIRST)
        present = np.flatnonzero(np.diag(c) > 0)
        if len(present) >= states:
            c = c[np.ix_(present, present)]
            lift = np.log1p(c * c.sum() / np.maximum(np.outer(c.sum(1), c.sum(0)), 1))
            lift -= lift.mean(0)
            lift /= np.maximum(np.linalg.norm(lift, axis=1, keepdims=True), 1e-9)
            chosen = [0]
            while len(chosen) < states:
                chosen.append(int((lift @ lift[chosen].T).max(1).argmin()))
            centres = lift[chosen]
            for _ in range(10):
                group = (lift @ centres.T).argmax(1)
                for k in range(states):
                    if (group == k).any():
                        middle = lift[group == k].sum(0)
                        centres[k] = middle / max(np.linalg.norm(middle), 1e-9)
            emit[1 + present, group] *= 8.0
    emit /= emit.sum(0)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Hmm(even, move, emit, even)


def maximized(sums: np.ndarray, shares: np.ndarray, states: int) -> Hmm:
    """The model of the expected counts; emissions are pulled to the words' frequencies."""
    n = SYMBOLS * states
    emitted, moved = sums[:n].reshape(SYMBOLS, states), sums[n : n + states**2].reshape(states, states)
    started = sums[n + states**2 : n + states**2 + states]
    emit = emitted + PRIOR * shares[:, None]
    move = moved + 0.1
    start = started + 0.1
    resume = emitted.sum(0) + 0.1
    return Hmm(
        start / start.sum(),
        move / move.sum(1, keepdims=True),
        emit / emit.sum(0),
        resume / resume.sum(),
    )


def train(training: DataFrame, words: Words, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over training(symbols), every text in every round."""
    shares = words.shares()
    model = first_states(summed(training, lambda s, _: company(s)), shares, states)
    for _ in range(rounds):
        sent = training.sparkSession.sparkContext.broadcast(model)
        sums = summed(training, lambda s, f, sent=sent: expected(sent.value, s, f))
        sent.unpersist()
        if sums is None:
            break
        model = maximized(sums, shares, states)
    return model


def log_likelihoods(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each whole sequence's probability, all sequences a step at a time."""
    symbols, live, order = _steps(sequences)
    at = np.concatenate(([0], np.cumsum(live)))
    total = np.zeros(len(sequences))
    now = np.repeat(model.start[None], len(sequences), 0)
    for t in range(len(live)):
        now = (now if t == 0 else now[: live[t]] @ model.move) * model.emit[symbols[at[t] : at[t + 1]]]
        size = now.sum(1)
        total[: live[t]] += np.log10(size)
        now /= size[:, None]
    out = np.empty(len(sequences))
    out[order] = total
    return out


def scored(texts: DataFrame, model: Hmm) -> DataFrame:
    """The coded rows without their symbols, with the symbols' likelihood."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in texts.columns if c not in ("symbols", "rare")]
    schema = texts.select(*kept).withColumn("likelihood", F.lit(0.0)).schema

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes([batch], "symbols", 2 * BLOCK):
                found = [np.frombuffer(x.as_py(), np.uint16) for x in part.column("symbols")]
                yield part.select(kept).append_column("likelihood", pa.array(log_likelihoods(sent.value, found)))

    return texts.select(*kept, "symbols").mapInArrow(over, schema)


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text, held_out).

    Learns from rows whose held_out is false; a null is neither learned from nor held out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    counts = stage(count_tokens(docs.where(~F.col("held_out"))))
    words = gather_words(counts)
    texts = stage(coded(docs, words))
    model = train(texts.where(~F.col("held_out")), words, states, rounds)
    rare = texts.select("rid", F.explode("rare").alias("token")).join(counts, "token", "left")
    rest = rare.groupBy("rid").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_log"), F.count("n").alias("rare_known")
    )
    norm = float(np.log10(words.total + ADD * (words.distinct + 1)))
    more = F.coalesce("rare_log", F.lit(0.0))
    return (
        scored(texts, model)
        .join(rest, "rid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(words.total).cast("long").alias("train_tokens"),
            (F.col("log_all") + more - F.col("n_tokens") * norm).alias("base_score"),
            (F.col("likelihood") + F.col("log_tail") + more - F.col("log_norm")).alias("score"),
        )
    )


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 10)
    mark = F.when(held >= 0, held == 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", mark.alias("held_out"))
    return score_texts(docs).withColumn("held_out", F.coalesce("held_out", F.lit(False)))
