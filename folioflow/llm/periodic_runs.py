"""Periodic runs of words, found with a dictionary of basic factors.

For every power of two m, each place gets a name for the m words that begin there: two places have
one name just if their words are equal, and the names for 2m are names of pairs of names for m. The
next place of the same name, if it lies within 2m, is a successor; successors at one distance p from
each other form an arithmetic progression, and three of its places in a row propose the period p there. A
run of period p whose length is at least 4p holds such places for the smallest m that is not below p, as
the factors there recur at distance p and not before. Proposals are then extended to both sides over all
places whose words are p apart and equal, by comparing names from the longest to the shortest,
and equal results are dropped. No proposed period is a multiple of a smaller one of the same
stretch, because the smaller one's successor would have come first.

Documents are worked on many at a time, as one line of words with a word of its own after each
document, so that no factor that crosses an end has a second place. Places whose
name is the only one of its kind are left out of all longer factors, so that ordinary text costs
little more than its first levels.

Cases: a null text has no words, and a text without words has no run. Words are cut at ASCII white space
only. Rows of one doc_id are judged each. A null doc_id is kept. Texts are judged whole; a
text is the smallest unit of work. Runs of different periods may overlap; each counts. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import by_bytes, table

MIN_LENGTH = 6
#: A run holds its period at least so many times; the proposals need four.
MIN_TIMES = 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Factors:
    """Names of the factors of one line of words, level by level, where they occur more than once."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.names: list[np.ndarray] = []
        #: Of each level, the places in order whose factor occurs again, and those with a next such place and its distance.
        self.places: list[np.ndarray] = []
        self.successors: list[tuple[np.ndarray, np.ndarray]] = []
        self._add(np.arange(self.n), np.asarray(words, np.int64))

    def double(self) -> None:
        """Add the level of twice the length; both halves of what occurs again occur again."""
        half, old, at = 1 << (len(self.names) - 1), self.names[-1], self.places[-1]
        at = at[at + half < self.n]
        at = at[old[at + half] >= 0]
        self._add(at, old[at] * (int(old.max(initial=0)) + 1) + old[at + half])

    def _add(self, at: np.ndarray, keys: np.ndarray) -> None:
        """A level from the keys of its factors at some places; elsewhere, names are -1 - place."""
        order = np.argsort(keys, kind="stable")
        ordered, places = keys[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        once = new & np.append(new[1:], True)
        names = -1 - np.arange(self.n)
        names[places[~once]] = (np.cumsum(new) - 1)[~once]
        again = np.zeros(self.n, bool)
        again[places[~once]] = True
        self.names.append(names)
        self.places.append(np.flatnonzero(again))
        distance = np.zeros(self.n, np.int64)
        follows = np.flatnonzero(~new)
        distance[places[follows - 1]] = places[follows] - places[follows - 1]
        before = np.flatnonzero(distance)
        self.successors.append((before, distance[before]))

    def equal(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the factors of 2**k words at a and b are equal; false beyond the line's ends."""
        size = 1 << k
        inside = (a >= 0) & (b >= 0) & (a + size <= self.n) & (b + size <= self.n)
        names = self.names[k]
        same = np.zeros(len(a), bool)
        same[inside] = names[a[inside]] == names[b[inside]]
        return same


def _proposals(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that progressions propose; makes all levels that have a repeated factor."""
    places, periods, k = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while len(factors.places[k]):
        at, far = factors.successors[k]
        near = far <= 2 << k
        at, far = at[near], far[near]
        distance = np.zeros(factors.n, np.int64)
        distance[at] = far
        goes_on = distance[at + far] == far
        at, far = at[goes_on], far[goes_on]
        # Neighbouring places of one period lie in one run: the first of them proposes it.
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (far[1:] != far[:-1])
        places.append(at[first])
        periods.append(far[first])
        factors.double()
        k += 1
    return np.concatenate(places), np.concatenate(periods)


def _extended(factors: Factors, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and first place behind the stretch around `at` whose words recur after the period."""
    right, left = at.copy(), at.copy()
    longest = max(0, len(factors.names) - 2)
    for step in (1, -1):
        moving = right if step > 0 else left
        # Factors of the longest level may fit several times, all shorter ones once after them.
        going = np.arange(len(at))
        while len(going):
            size = 1 << longest
            begin = moving[going] if step > 0 else moving[going] - size
            going = going[factors.equal(longest, begin, begin + period[going])]
            moving[going] += step * size
        for k in range(longest - 1, -1, -1):
            size = 1 << k
            begin = moving if step > 0 else moving - size
            moving[factors.equal(k, begin, begin + period)] += step * size
    return left, right + period


def line_runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> np.ndarray:
    """Rows (start, end, period) of a line of words, by start and period."""
    if min_times < 4:
        raise ValueError("the proposals hold all runs of four periods or more")
    factors = Factors(words)
    at, period = _proposals(factors)
    begin, end = _extended(factors, at, period)
    keep = end - begin >= np.maximum(min_length, min_times * period)
    return np.unique(np.column_stack((begin[keep], end[keep], period[keep])), axis=0)


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words lie in a run (start, length, period) after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def texts_runs(texts: list[list[bytes]], min_length: int, min_times: int) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start and period."""
    names: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    line = np.empty(int((sizes + 1).sum()), np.int64)
    for begin, words in zip(begins, texts):
        line[begin : begin + len(words)] = [names.setdefault(w, len(names)) for w in words]
    line[begins + sizes] = len(names) + np.arange(len(texts))
    found: list[list] = [[] for _ in texts]
    runs = line_runs(line, min_length, min_times)
    of = np.searchsorted(begins, runs[:, 0], side="right") - 1
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    for row, doc in zip(runs[order].tolist(), of[order].tolist()):
        found[doc].append((row[0] - int(begins[doc]), row[1] - row[0], row[2]))
    return found


def find_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_times: int = MIN_TIMES,
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, n_words, runs by start and period, and the collapsed text of docs(doc_id, text).

    The collapsed text lacks every word that lies in a run after its first period. `change` makes the words
    that are judged from a document's id and words.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in by_bytes(batches, "text"):
            texts = [(raw or b"").split() for raw in piece.column("text").to_pylist()]
            if change:
                texts = [change(i, t) for i, t in zip(piece.column("doc_id").to_pylist(), texts)]
            runs = texts_runs(texts, min_length, min_times)
            kept = []
            for words, own in zip(texts, runs):
                if own:
                    words = [w for w, out in zip(words, dropped(own, len(words)).tolist()) if not out]
                kept.append(b" ".join(words))
            starts, lengths, periods = (
                pa.array([r[i] for own in runs for r in own], pa.int64()) for i in range(3)
            )
            ends = pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32))
            rows = pa.StructArray.from_arrays([starts, lengths, periods], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.ListArray.from_arrays(ends, rows),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(over, f"doc_id long, n_words long, runs {RUNS}, collapsed binary").withColumn(
        "collapsed", F.col("collapsed").cast("string")
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the registered query: in a tenth of the documents, chosen by their id, a period goes on to the end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digests(runs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of the runs and of the collapsed text."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"]))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        runs.withColumn("_longest", longest.cast("struct<length:bigint,start:bigint,period:bigint>"))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("_longest.start")).alias("start"),
            "_longest.length",
            (-F.col("_longest.period")).alias("period"),
            F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(table(spark, sf_dir, "documents"), change=planted))
