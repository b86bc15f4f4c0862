"""Toxicity as a severity grade, by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(x.w - threshold_k) for k = 1 .. K-1 with one weight
vector for all thresholds; x holds log(1 + count) of the words of the whole
text and of the beginnings of words (4 to 7 letters).  The expected severity is the sum of these probabilities (0 to K-1).

The labels say only toxic or not, so grades are derived for learning: 0 for
clean rows; toxic rows are graded by their marker words (words far more
frequent in toxic rows), summed as log(1 + count) and cut at the quantiles of
the toxic rows.
The model is fitted on a keyed sample of at most about ``train_rows`` labelled
rows of each class; near copies (equal least word hashes) count once.

Defined results: null and empty texts, and every text if the labels hold only
one class, get severity 0.  Null labels and null ids are not learned from;
repeated rows get a row each.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest
from sys import intern

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import pieces
from parley.llm.language_id import fraction
from parley.llm.linear import cumulative_link, sigmoid

WORDS = re.compile(r"[^\W\d_]+").findall


PREFIXES = (4, 5, 6, 7)  # letters of the beginnings of longer words that are features too


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def word_counts(text: str | None) -> Counter:
    return Counter(WORDS(text.lower())) if text else Counter()


def expanded(words: Counter) -> Counter:
    """Counts of the words and beginnings of words."""
    out: Counter = Counter()
    for word, n in words.items():
        for f in features_of(word):
            out[f] += n
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    cuts: np.ndarray

    def __post_init__(self):
        self.starts = {w.rstrip("*")[:PREFIXES[0]] for w in self.weights}

    def severity(self, text: str | None) -> tuple[float, int]:
        """Expected severity, most probable grade."""
        if not text or not len(self.cuts):
            return 0.0, 0
        found: Counter = Counter()
        for word, n in Counter(WORDS(text.lower())).items():
            if word[:PREFIXES[0]] in self.starts:
                for f in features_of(word):
                    if f in self.weights:
                        found[f] += n
        x = sum(self.weights[w] * float(np.log1p(n)) for w, n in sorted(found.items()))
        p = sigmoid(x - self.cuts)
        grades = -np.diff(np.concatenate([[1.0], p, [0.0]]))
        return float(p.sum()), int(np.argmax(grades))


def grades_of(hits: np.ndarray, toxic: np.ndarray, n_grades: int) -> np.ndarray:
    cuts = np.quantile(hits[toxic == 1], np.linspace(0, 1, n_grades)[1:-1]) if n_grades > 2 else []
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, hits, side="left"), 0)


def fit(rows: list[tuple[Counter, int]], n_grades: int = 3, max_words: int = 400) -> ToxicityModel:
    # The least word hashes and the length put the rows in an order of their own.
    named = [((y, tuple(nsmallest(3, map(xxhash.xxh64_intdigest, c)))), sum(c.values()), len(c), i) for i, (c, y) in enumerate(rows) if c]
    once, seen = [], set()
    for low, _, _, i in sorted(named):
        if low not in seen:
            seen.add(low)
            once.append(rows[i])
    n1 = sum(y for _, y in once)
    n0 = len(once) - n1
    if not n1 or not n0:
        return ToxicityModel({}, np.zeros(0))
    df = [Counter(), Counter()]
    for c, y in once:
        df[y].update(expanded(c).keys())
    least = max(4, n1 // 100)
    odds = {w: np.log((k + 0.5) / (n1 - k + 0.5)) - np.log((df[0][w] + 0.5) / (n0 - df[0][w] + 0.5)) for w, k in df[1].items() if k >= least}
    z = {w: o / np.sqrt(1 / (df[1][w] + 0.5) + 1 / (df[0][w] + 0.5)) for w, o in odds.items()}
    best: dict[tuple[int, int, str], str] = {}  # of a word and its beginnings with equal counts, the longest
    for w in sorted(w for w in z if z[w] > 3):
        best[df[1][w], df[0][w], w[:PREFIXES[0]]] = w
    vocab = sorted(best.values(), key=lambda w: (-z[w], w))[:max_words]
    if not vocab:
        return ToxicityModel({}, np.zeros(0))
    place = {w: i for i, w in enumerate(vocab)}
    x = np.zeros((len(once), len(vocab)))
    for i, (c, _) in enumerate(once):
        e = expanded(c)
        for w in e.keys() & place.keys():
            x[i, place[w]] = np.log1p(e[w])
    markers = [place[w] for w in vocab if odds[w] > 2]
    grade = grades_of(x[:, markers].sum(axis=1), np.array([y for _, y in once]), n_grades)
    w, cuts = cumulative_link(x, grade, int(grade.max()) + 1)
    return ToxicityModel({v: float(w[i]) for v, i in place.items() if w[i]}, cuts)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 2500, n_grades: int = 3, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    rate = F.when(F.col("y") == 1, min(1.0, train_rows / n.get(1, 1))).otherwise(min(1.0, train_rows / n.get(0, 1)))
    # Two classes of about train_rows rows: the bound of the broadcast.
    sample = known.where(fraction(F.col("id"), 5) < rate).limit(4 * train_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", "y").limit(8 * train_rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            out = [word_counts(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(c) for c in out], pa.list_(pa.string())), pa.array([list(c.values()) for c in out], pa.list_(pa.int32()))], names=["y", "w", "n"])

    got = rows.mapInArrow(words, "y int, w array<string>, n array<int>").toArrow()
    learn = []
    for batch in got.to_batches(max_chunksize=256):  # the words are shared between rows
        for y, w, k in zip(*(c.to_pylist() for c in batch.columns)):
            learn.append((Counter(dict(zip(map(intern, w), k))), y))
    return fit(learn, n_grades)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, severity, grade, toxic`` of every row: toxic if the expected
    severity is at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            out = [own.severity(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[0] >= threshold for x in out], pa.bool_())],
                                             names=[id_col, "severity", "grade", "toxic"])

    return rows.mapInArrow(score, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, severity double, grade long, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    return score_toxicity(docs, train(docs, labels, **bounds))
