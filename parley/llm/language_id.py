"""Language identification by hierarchical discrimination.

A text is seen as the relative frequencies of the character trigrams of its
letters.  Linear support vector machines first predict the language family;
within the family, one-versus-one machines separate the languages.  The models
are fitted on a bounded sample of the labelled rows: at most about
``train_per_language`` rows of a language and ``train_rows`` rows in all.

Defined results: ``und`` with score 0 for a text that is null or has no
letter, and for every text if there is no labelled row to learn from; if only
one language can be learned, it is predicted with score 1.  Null ids, repeated
rows, very long texts and empty tables need no special care: the prediction is
a function of the whole text alone.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import pieces
from parley.llm.linear import linear_svm, sigmoid

LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 20  # bytes scored at a time
BITS = 6
FEATURES = 1 << (3 * BITS)
SCALE = 20.0  # of the frequencies, so that rows have a norm near 1
SLOPE = 4.0   # of the logistic that turns a margin into a score

# Language families by ISO 639-1 code.  A language that is not
# listed forms a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "indic": "hi ur bn pa gu mr ne",
    "turkic": "tr az kk uz ky tt",
    "semitic": "ar he am mt",
    "uralic": "fi et hu",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _classes() -> np.ndarray:
    """Letter class of a byte: a-z are 1-26, bytes of longer characters share
    32 classes, all else is 0."""
    to = np.zeros(256, np.uint32)
    to[97:123] = np.arange(1, 27)
    to[128:] = 27 + (np.arange(128, 256) & 31)
    return to


CLASS = _classes()


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Trigram numbers of the lower-cased text, a stretch at a time; stretches
    of other characters count as one space."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8"), np.uint8)
    for at in range(0, len(raw), CHUNK):
        c = CLASS[raw[at:at + CHUNK + 2]]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
        c = c[keep]
        if len(c) > 2:
            yield (c[:-2] << np.uint32(2 * BITS)) | (c[1:-1] << np.uint32(BITS)) | c[2:]


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts: dict | np.ndarray = np.zeros(FEATURES, np.int64)
    n = 0
    for g in trigrams(text):
        counts += np.bincount(g, minlength=FEATURES)
        n += len(g)
    at = np.flatnonzero(counts)
    return at, counts[at] * (SCALE / max(n, 1))


@dataclass
class Duels:
    """One-versus-one machines between the members of ``names``."""
    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    first: int = 0  # column of the first pair in the weight table

    def decide(self, margins: np.ndarray) -> tuple[int, float]:
        """Winner by votes, ties by the sum of margins; its least confidence."""
        if not self.pairs:
            return 0, 1.0
        m = margins[self.first:self.first + len(self.pairs)]
        votes, total = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (a, b), x in zip(self.pairs, m):
            votes[a if x > 0 else b] += 1
            total[a] += x
            total[b] -= x
        won = int(np.lexsort((-np.arange(len(votes)), total, votes))[-1])
        own = [x if a == won else -x for (a, b), x in zip(self.pairs, m) if won in (a, b)]
        return won, float(sigmoid(SLOPE * min(own)))


@dataclass
class LanguageModel:
    weights: np.ndarray  # features x machines
    bias: np.ndarray
    families: Duels
    languages: list[Duels]  # by family

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        total, n = np.zeros(self.weights.shape[1], np.float64), 0
        for g in trigrams(text):
            if self.weights.shape[1]:
                total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        margins = total * (SCALE / max(n, 1)) + self.bias
        family, sure = self.families.decide(margins)
        duels = self.languages[family]
        language, sure_too = duels.decide(margins)
        return duels.names[language], sure * sure_too


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """``rows``: language, trigram numbers, frequencies."""
    rows = sorted(rows, key=lambda r: (r[0], hashlib.blake2b(r[1].tobytes() + r[2].tobytes(), digest_size=16).digest()))  # the order rows arrive in must not count
    langs = sorted({r[0] for r in rows})
    family = {lang: FAMILY_OF.get(lang.lower().split("-")[0], "own " + lang) for lang in langs}
    weights, bias = [], []

    def machines(names: list[str], of) -> Duels:
        duels = Duels(names, first=len(weights))
        for a, b in combinations(range(len(names)), 2):
            own = [(at, v, 1.0 if of(lang) == names[a] else -1.0) for lang, at, v in rows if of(lang) in (names[a], names[b])]
            w, c = linear_svm([(at, v) for at, v, _ in own], np.array([y for *_, y in own]), FEATURES)
            weights.append(w.astype(np.float32))
            bias.append(c)
            duels.pairs.append((a, b))
        return duels

    names = sorted(set(family.values()))
    top = machines(names, family.get)
    inner = [machines([x for x in langs if family[x] == f], lambda lang: lang) for f in names]
    table = np.stack(weights, axis=1) if weights else np.zeros((FEATURES, 0), np.float32)
    return LanguageModel(np.ascontiguousarray(table), np.array(bias), top, inner)


def fraction(key: Column, seed: int = 11) -> Column:
    """A fixed draw in [0, 1) for each value of ``key``."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def train(docs: DataFrame, train_per_language: int = 800, train_rows: int = 6000, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a keyed sample of the rows of ``docs`` with text and language."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    # Bounded: one row a language, and no more languages than sampled rows.
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(train_rows).collect()
    if not counts:
        return fit([])
    per = min(train_per_language, max(1, train_rows // len(counts)))
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per / r["count"]))).otherwise(rate) if len(counts) < 300 else F.lit(min(1.0, train_rows / sum(c["count"] for c in counts)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            out = [(lang, *frequencies(text)) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if LETTER.search(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1].astype(np.int32) for r in out], pa.list_(pa.int32())),
                 pa.array([r[2].astype(np.float32) for r in out], pa.list_(pa.float32()))], names=["lang", "at", "v"])

    sample = labelled.where(fraction(F.col("id")) < rate).select("text", "lang", fraction(F.col("id")).alias("key"))
    # About train_rows rows are drawn; were there many more (one id on many rows), the first by key are taken.
    first = sample.orderBy("key", F.xxhash64("text")).limit(2 * train_rows).select("text", "lang")
    rows = first.repartition(8, F.xxhash64("text")).mapInArrow(features, "lang string, at array<int>, v array<float>").toArrow().combine_chunks()
    # The sample stays in two flat arrays, of which each row is a slice.
    langs = rows.column(0).to_pylist()
    at, v = (rows.column(k).combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32())) for k in (1, 2))
    ends = at.offsets.to_numpy() if len(langs) else np.zeros(1, np.int32)
    at, v = at.values.to_numpy(), v.values.to_numpy()
    return fit([(lang, at[a:b], v[a:b]) for lang, a, b in zip(langs, ends[:-1], ends[1:])])


def held_out(id_col: str) -> Column:
    """Rows kept from learning: the CRC of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
                     keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (the id by default) of every row with ``lang_pred``
    and ``score`` (0 to 1), or other ``names``; a column of ``keep`` of such a
    name is replaced.  One narrow pass; the model is broadcast and its size
    depends on the languages alone."""
    keep = [c for c in keep or [id_col] if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).alias("_lid_text"))  # the text comes last

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            out = [own.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=[*keep, *names])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(predict, f"{schema}, `{names[0]}` string, `{names[1]}` double".removeprefix(", "))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the rows that are
    not held out, predicted for all."""
    model = train(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    out = predict_language(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
