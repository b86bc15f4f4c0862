"""Exact duplicate removal with Patricia-trie owners.

Texts are compared after lower-casing A-Z.  Every task first folds the equal
texts it reads into one entry (largest id, number of rows), so a group of
copies reaches its owner as at most one entry for each piece read.  Entries go
to partitions by length and content hash; the owner of a partition inserts the
full byte strings into a compressed radix trie whose terminal nodes hold the
extreme identifier and the number of rows.  A trie that outgrows its budget
moves its largest subtree to a file of the task and goes on; the file is
worked off with a trie of its own afterwards.  The owners' results, one row
for each distinct text, join the rows by the SHA-256 of the text.

Defined results: a null text counts as empty; of equal texts the row with the
largest id stays (null ids are smallest); of rows that share text and id one
stays; if all ids of a group are null, ``keep_id`` is null and one row stays.
An empty table gives an empty result; other columns are ignored by
``exact_classes`` and kept by ``drop_exact``.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import as_bytes, lower_ascii, pieces

TRIE_BYTES = 96 << 20  # of texts and nodes that a trie holds before it spills
NODE_BYTES = 250
Entry = tuple[bytes, int | None, int]  # text, largest id, rows


class Node:
    __slots__ = ("label", "children", "best", "rows")

    def __init__(self, label: bytes, best: int | None = None, rows: int = 0):
        self.label, self.children, self.best, self.rows = label, {}, best, rows


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at:at + n]:
        return n
    low, high = 0, n  # halve: slices compare fast
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[at:at + mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    def __init__(self, budget: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.budget, self.folder = Node(b""), budget, folder
        self.held = 0
        self.spilled: dict[int, str] = {}  # first byte of a subtree that lies in a file

    def insert(self, text: bytes, best: int | None, rows: int) -> None:
        if text and text[0] in self.spilled:
            self._append(self.spilled[text[0]], [(text, best, rows)])
            return
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], best, rows)
                self.held += len(text) - at + NODE_BYTES
                break
            k = common(child.label, text, at)
            if k < len(child.label):  # the edge splits
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = child = upper
                self.held += NODE_BYTES
            node, at = child, at + k
        else:
            node.best = larger(node.best, best) if node.rows else best
            node.rows += rows
        if self.held > self.budget and self.root.children:
            self._spill()

    def _entries(self, node: Node, prefix: bytes) -> Iterator[Entry]:
        stack = [(node, prefix)]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.rows:
                yield text, node.best, node.rows
            stack += [(c, text) for c in node.children.values()]

    def _size(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            stack += node.children.values()
        return total

    def _spill(self) -> None:
        first, (size, node) = max(((b, (self._size(c), c)) for b, c in self.root.children.items()), key=lambda x: x[1][0])
        self.folder = self.folder or tempfile.mkdtemp(prefix="trie-")
        fd, path = tempfile.mkstemp(dir=self.folder)
        os.close(fd)
        self._append(path, self._entries(node, b""))
        self.spilled[first] = path
        del self.root.children[first]
        self.held -= size

    @staticmethod
    def _append(path: str, entries) -> None:
        with open(path, "ab") as f:
            for e in entries:
                pickle.dump(e, f)

    def drain(self) -> Iterator[Entry]:
        """All distinct texts; empties the trie and its files."""
        todo = [(b"", self)]
        while todo:
            head, trie = todo.pop()
            for text, best, rows in trie._entries(trie.root, b""):
                yield head + text, best, rows
            trie.root, trie.held = Node(b""), 0
            for _, path in sorted(trie.spilled.items()):
                # The texts of a subtree part at the end of their common prefix: there the next trie begins.
                prefix = None
                for text, _, _ in self._read(path):
                    prefix = text if prefix is None else prefix[:common(prefix, text, 0)]
                sub = PatriciaTrie(self.budget, self.folder)
                for text, best, rows in self._read(path):
                    sub.insert(text[len(prefix):], best, rows)
                os.unlink(path)
                if sub.spilled:
                    todo.append((head + prefix, sub))  # its own files are still to come
                else:
                    for text, best, rows in sub._entries(sub.root, b""):
                        yield head + prefix + text, best, rows
            trie.spilled = {}
        self.close()

    @staticmethod
    def _read(path: str) -> Iterator[Entry]:
        with open(path, "rb") as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    return

    def close(self) -> None:
        """Remove what lies in the task's folder."""
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a piece become one entry."""
    for batch in pieces(batches, 4096):
        own: dict[bytes, list] = {}
        for text, i in zip((t.lower() for t in as_bytes(batch.column(1))), batch.column(0).to_pylist()):
            e = own.setdefault(text, [None, 0])  # bytes.lower() changes A-Z only
            e[0] = larger(e[0], i)
            e[1] += 1
        texts = list(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(map(len, texts), pa.int64()), pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], pa.int64()), pa.array(texts, pa.binary()),
             pa.array([e[0] for e in own.values()], pa.int64()), pa.array([e[1] for e in own.values()], pa.int64())],
            names=["n", "h", "text", "best", "rows"])


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owner of a partition."""
    trie = PatriciaTrie()
    try:
        yield from _owned(trie, batches)
    finally:  # also if the task fails
        trie.close()


def _owned(trie: PatriciaTrie, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 4096):
        for text, best, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            trie.insert(text, best, rows)
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        sha, best, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(best, pa.int64()), pa.array(n, pa.int64())], names=["text_sha256", "keep_id", "group_size"])

    for text, best, rows in trie.drain():
        out.append((hashlib.sha256(text).hexdigest(), best, rows))
        if len(out) == 10_000:
            yield batch_of(out)
            out = []
    yield batch_of(out)


def classes_by_owner(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text_sha256, keep_id, group_size``: one row for each distinct text."""
    entries = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(fold, "n long, h long, text binary, best long, rows long")
    return entries.repartition("n", "h").select("text", "best", "rows").mapInArrow(own, "text_sha256 string, keep_id long, group_size long")


def sha(text_col: str) -> Column:
    return F.sha2(F.coalesce(lower_ascii(F.col(text_col)), F.lit("")), 256)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), sha(text_col).alias("text_sha256"))
    # Rows that share text and id are told apart before the join, on both keys:
    # so the join by text is the last step, and a hot text can be split there.
    one = Window.partitionBy("text_sha256", "id").orderBy(F.lit(1))
    rows = rows.withColumn("first", F.row_number().over(one) == 1)
    out = rows.join(classes_by_owner(docs, id_col, text_col), "text_sha256")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & F.col("first")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    names = docs.columns
    # Keys without nulls, the same for the join and for what follows it: so the texts are shuffled and sorted once.
    keys = ["_exact_sha", "_exact_id", "_exact_null"]
    keyed = lambda at, i: {keys[0]: at, keys[1]: F.coalesce(i, F.lit(0)), keys[2]: i.isNull()}
    rows = docs.withColumns(keyed(sha(text_col), F.col(id_col).cast("long")))
    stay = classes_by_owner(docs, id_col, text_col)
    stay = stay.select(*[c.alias(k) for k, c in keyed(F.col("text_sha256"), F.col("keep_id")).items()])
    return rows.join(stay, keys, "left_semi").dropDuplicates(keys).select(*names)
