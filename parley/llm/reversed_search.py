"""Ranked lexical search, reversed: the items are indexed, the documents stream.

An inverted index over the terms of the items is broadcast.  A first pass over
the documents gathers how many there are, how many terms they have and how many
hold each term of the index.  In a second pass each document's term counts run
through the index, which gives its scores for all items that share a term; each
task keeps a bounded heap for each item, and the heaps of the tasks are merged
twice, first in groups of tasks, then for the item.  The scores are sums of
whole numbers.

The index is cut into slices of at most ``max_postings`` entries, so what is
broadcast is bounded; a larger set of items takes more passes.  What a task
sends on is ``k`` rows an item at most, and the documents are never shuffled.

Defined results: null and empty texts have no terms, match nothing and count in
no statistic; an item without terms has no rows; repeated items and repeated
documents are ranked like others; equal scores go by ascending id, null last;
empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import as_bytes, pieces, stored

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of the lower-cased bytes: ASCII letters and digits, and all other characters
TOP = 10
POSTINGS = 500_000  # some 100 MB on the driver while an index is built, a third of that when sent
CELLS = 1 << 21      # scores and summands held at a time in a task, beside those of one document
LOW = 26             # bits of the lower half of a summand


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # bytes: A-Z only


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n_docs: int, n_terms: int, n: int) -> int:
    """The part of a score's divisor that grows with the document."""
    return 100 - 90 + (90 * n * n_docs) // n_terms


def item_postings(items: DataFrame, item_text: str) -> DataFrame:
    """``item, term``: the distinct terms of each row of ``items`` (with its
    number ``item``)."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [(i, t) for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))) for t in sorted(set(terms(text)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["item", "term"])

    return items.select("item", item_text).mapInArrow(split, "item long, term binary")


class Index:
    """Inverted index of some items: the number of each term and, for each, the
    places of its items in ``items``."""

    def __init__(self, postings: list[tuple[int, bytes]]):
        self.items = np.array(sorted({i for i, _ in postings}), np.int64)
        at = {i: k for k, i in enumerate(self.items.tolist())}
        self.term = {t: k for k, t in enumerate(sorted({t for _, t in postings}))}
        number = np.array([self.term[t] for _, t in postings], np.int64)
        order = np.argsort(number, kind="stable")
        self.item = np.array([at[i] for i, _ in postings], np.int64)[order]
        self.count = np.bincount(number, minlength=len(self.term))
        self.start = np.cumsum(self.count) - self.count
        self.weight = np.zeros(len(self.term), np.int64)

    def counts(self, text: bytes) -> tuple[int, list[int], list[int]]:
        """Terms of a text, with repeats; numbers and counts of those indexed."""
        found = terms(text)
        known = [(k, c) for t, c in Counter(found).items() if (k := self.term.get(t)) is not None]
        return len(found), [k for k, _ in known], [c for _, c in known]

    def scores(self, docs: list[tuple[int, list[int], list[int]]]) -> np.ndarray:
        """Scores (documents x items) of (length part, term numbers, counts)."""
        sizes = [len(d[1]) for d in docs]
        doc = np.repeat(np.arange(len(docs)), sizes)
        term = np.array([k for d in docs for k in d[1]], np.int64)
        tf = np.array([c for d in docs for c in d[2]], np.int64)
        m = np.repeat(np.array([d[0] for d in docs], np.int64), sizes)
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        # Each (document, term) meets the items of the term.
        n = self.count[term]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[term], n)
        cell = np.repeat(doc * len(self.items), n) + self.item[place]
        part = np.repeat(part, n)
        # Sums of halves are exact in doubles.
        add = lambda x: np.bincount(cell, x, len(docs) * len(self.items)).astype(np.int64)
        return (add(part & ((1 << LOW) - 1)) + (add(part >> LOW) << LOW)).reshape(len(docs), len(self.items))


class Heaps:
    """The ``k`` best documents of each item; the worst one is on top."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # a score must not be below, and be above 0

    def push(self, ids: list[int | None], scores: np.ndarray) -> None:
        for d, i in zip(*(x.tolist() for x in np.nonzero((scores >= self.least) & (scores > 0)))):
            entry = (int(scores[d, i]), -math.inf if ids[d] is None else -ids[d])
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def statistics(rows: DataFrame, index: Index) -> tuple[int, int, list[int]]:
    """Documents with a term, all their terms, and how many documents hold each
    term of the index."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        df, n_docs, n_terms = np.zeros(len(own.term), np.int64), 0, 0
        for batch in pieces(batches):
            for text in as_bytes(batch.column(0)):
                n, known, _ = own.counts(text)
                df[known] += 1
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at]).astype(np.int32)), pa.array(np.concatenate([[n_docs, n_terms], df[at]]))],
                                         names=["term", "n"])

    found = dict(rows.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect())  # a row a term of the index
    return found.get(-2, 0), found.get(-1, 0), [found.get(k, 0) for k in range(len(index.term))]


def best(scored: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_slice(rows: DataFrame, index: Index, k: int) -> DataFrame:
    """``item, rank, doc, score`` of the items of one index."""
    n_docs, n_terms, df = statistics(rows, index)
    index.weight = np.array([weight(n_docs, x) for x in df], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        heaps = Heaps(len(own.items), k)
        ids, docs, load = [], [], 0
        for batch in pieces(batches):
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                n, known, counts = own.counts(text)
                if known:
                    ids.append(i)
                    docs.append((length_part(n_docs, n_terms, n), known, counts))
                    load += len(own.items) + int(own.count[known].sum())
                if load >= CELLS:
                    heaps.push(ids, own.scores(docs))
                    ids, docs, load = [], [], 0
        if docs:
            heaps.push(ids, own.scores(docs))
        out = [(i, s, None if d == -math.inf else -d) for i, heap in zip(own.items.tolist(), heaps.heaps) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["item", "score", "doc"])

    heaps = rows.mapInArrow(stream, "item long, score long, doc long").withColumn("tasks", F.spark_partition_id() % 64)
    return best(best(heaps, ["item", "tasks"], k).drop("rank"), ["item"], k).select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", max_postings: int = POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents that score highest
    for each row of ``items``."""
    # Numbers of the item rows are drawn once: the stored table is read from then on.
    numbered = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), "items")
    postings = stored(item_postings(numbered, "text"), "postings")
    rows, out = rows_of(docs, id_col, text_col), None
    slices = max(1, -(-postings.count() // max_postings))
    for s in range(slices):  # one for a benchmark; an item lies in one slice
        own = postings.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == s).toArrow()
        index = Index(list(zip(own.column(0).to_pylist(), own.column(1).to_pylist())))
        found = search_slice(rows, index, k)
        out = found if out is None else out.unionByName(found)
    # The rows found are k an item at most.
    return out.join(numbered.select("item", F.col("item_id").alias("_item_id")), "item").select(
        F.col("_item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
