"""Repeated windows of documents, found on Spark.

Shared by the suffix-array and the recompression operator, which differ in
the units (bytes, words), in how a window gets its anchor, and in which of
equal windows stay.  The steps:

1. Every document gives its runs: windows with one anchor.  Runs of equal
   content are folded in the task, then on the partition of their mark.
2. A run whose content no other run has, and whose mark no other run has, holds
   no repeated window.  Of the others the first stays (or none, see ``first``).
   What stays is gathered by document, as a list no longer than the document.
3. Runs that share a mark but not their content may share some windows.  Their
   texts, as suffixes, are dealt to buckets by sampled splitters on the leading
   units at the anchor; a bucket sorts its windows by several keys and compares
   neighbours.  Splitters lie between different leading units and marks, so
   equal windows never lie on two sides of a boundary.  A mark with very many
   different runs sends its windows as hashes, split by their place in the run.
4. The documents are joined with both lists; what no list keeps goes.

Ids need not be unique: if they repeat or are null, rows are numbered in the
order of id and text hash first, and rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.anchors import multikey_order, runs, strung, Sums, window_hashes
from parley.llm.common import as_bytes, pieces, stored

HOT = 512       # different runs of a mark beyond which it is split
SLICE = 16       # windows of a slice of such a mark
BUCKET = 200_000  # windows sorted at a time, at least a whole mark
COUNT_BITS, FLAG_BITS = 9, 3


@dataclass
class Units:
    """How texts are read.  ``parse``: units of each of a list of texts;
    ``piece``: the text of units ``start`` to ``end`` of one text, which parses
    to the same units; ``anchor``: of the windows of a sequence of units;
    ``first``: of equal windows the first stays (else none)."""
    length: int
    first: bool
    parse: Callable[[list[bytes]], list[np.ndarray]]
    piecer: Callable[[bytes], Callable[[int, int], bytes]]
    anchor: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    lead: int  # units at the anchor that lead a suffix


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, id, text``: keys are the ids if these are unique, else numbers in
    the order of id and text hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    odd = rows.groupBy("id").count().where("id is null or count > 1").limit(1)
    if odd.isEmpty():
        return rows.select(F.col("id").alias("key"), "id", "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = rows.select("id", "h").distinct().orderBy("id", "h").withColumn("key", F.monotonically_increasing_id())
    order = stored(order, "order").select("key", F.col("id").alias("_id"), F.col("h").alias("_h"))
    return rows.join(order, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("key", "id", "text")


def occurrences(rows: DataFrame, units: Units) -> DataFrame:
    """``mark, content, key, at, n``: the runs, equal ones of a batch folded;
    ``at`` packs start and count."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in pieces([batch]):
                keys = np.array(part.column(0).to_pylist(), np.int64)
                for r in runs(units.parse(as_bytes(part.column(1))), units.length, units.anchor):
                    out.append((r.mark.view(np.int64), r.content.view(np.int64), keys[r.doc], (r.start << COUNT_BITS) | r.count))
            if not out:
                continue
            mark, content, key, at = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((at, key, content, mark))
            mark, content, key, at = mark[order], content[order], key[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (content[1:] != content[:-1])]))
            n = np.diff(np.append(first, len(mark)))
            for i in range(0, len(first), 50_000):
                f = first[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mark[f], content[f], key[f], at[f], n[i:i + 50_000])], names=["mark", "content", "key", "at", "n"])

    return rows.select("key", "text").mapInArrow(emit, "mark long, content long, key long, at long, n long")


def lists(rows: DataFrame, units: Units) -> DataFrame:
    """``key, packs``: of each document the runs that stay (flag 1), that must
    be compared window by window (flag 2), by a split mark (flag 4)."""
    from pyspark.sql import Window
    runs_ = (occurrences(rows, units).repartition("mark").groupBy("mark", "content")
             .agg(F.min(F.struct("key", "at")).alias("o"), F.sum("n").alias("n")))
    runs_ = runs_.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("mark")))
    stay = F.lit(1) if units.first else F.when(F.col("n") == 1, 1).otherwise(0)
    flags = stay + F.when(F.col("kinds") > 1, 2).otherwise(0) + F.when(F.col("kinds") > HOT, 4).otherwise(0)
    packed = runs_.select(F.col("o.key").alias("key"), (F.shiftleft(F.col("o.at"), FLAG_BITS) + flags).alias("pack"), flags.alias("f")).where("f > 0")
    return stored(packed.groupBy("key").agg(F.collect_list("pack").alias("packs")), "lists")  # at most the runs of one document


def unpacked(packs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.sort(np.asarray(packs, np.int64))
    return p >> (COUNT_BITS + FLAG_BITS), (p >> FLAG_BITS) & ((1 << COUNT_BITS) - 1), p & ((1 << FLAG_BITS) - 1)


EDGES = "lead binary, mark long, part int, key long, start long, stays boolean, body binary"


def suffixes(joined: DataFrame, units: Units) -> DataFrame:
    """The runs that must be compared window by window."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            rows = []
            for key, text, packs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                piece = units.piecer(text)
                for start, count, flag in zip(*(x.tolist() for x in unpacked(packs))):
                    if flag & 2:
                        rows.append((key, start, bool(flag & 1), flag & 4, piece(start, start + count + units.length - 1)))
            if not rows:
                continue
            anchor = leads(units, [r[4] for r in rows])
            out = []
            for (key, start, stays, hot, body), (lead, mark, at) in zip(rows, anchor):
                if not hot:
                    out.append((lead, mark, -1, key, start, stays, body))
                    continue
                h1, h2 = window_hashes(units.parse([body])[0], units.length)
                part = (at - np.arange(len(h1))) // SLICE  # by the distance to the anchor, the same for equal windows
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
                for i, j in zip(edge[:-1], edge[1:]):
                    out.append((lead, mark, int(part[i]), key, start + i, stays, np.stack([h1[i:j], h2[i:j]]).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                names=["lead", "mark", "part", "key", "start", "stays", "body"])

    some = joined.where(F.exists("packs", lambda p: p.bitwiseAND(F.lit(2)) != 0))
    return some.select("key", "text", "packs").mapInArrow(emit, EDGES)


def leads(units: Units, bodies: list[bytes]) -> list[tuple[bytes, int, int]]:
    """Leading units at the anchor of the first window, its mark and place."""
    out = []
    for seqs, doc, place in strung([x[:units.length] for x in units.parse(bodies)], units.length):
        at, mark = units.anchor(seqs)
        first = np.flatnonzero((doc >= 0) & (place == 0))
        for i, offset, m in zip(doc[first].tolist(), (at[first] - first).tolist(), mark[first].view(np.int64).tolist()):
            out.append((units.piecer(bodies[i])(offset, offset + units.lead), m, offset))
    return out


def compared(rows: list[tuple], units: Units) -> Iterator[tuple[int, int, int]]:
    """Key, start, count of the windows that go among ``rows`` of whole marks:
    (part, key, start, stays, body)."""
    body = [r for r in rows if r[0] < 0]
    hashed = [r for r in rows if r[0] >= 0]
    h1, h2, row, place = [], [], [], []
    for seqs, doc, at in strung(units.parse([r[4] for r in body]), units.length):
        a, b = window_hashes(seqs, units.length)
        n = len(a)
        whole = np.flatnonzero((doc[:n] >= 0) & (doc[:n] == doc[units.length - 1:units.length - 1 + n]))
        h1.append(a[whole]), h2.append(b[whole]), row.append(doc[whole]), place.append(at[whole])
    for i, r in enumerate(hashed, len(body)):
        a, b = np.frombuffer(r[4], np.uint64).reshape(2, -1)
        h1.append(a), h2.append(b), row.append(np.full(len(a), i)), place.append(np.arange(len(a)))
    if not h1:
        return
    h1, h2, row, place = (np.concatenate(x) for x in (h1, h2, row, place))
    every = body + hashed
    key, stays = np.array([r[1] for r in every], np.int64)[row], np.array([r[3] for r in every])[row]
    pos = np.array([r[2] for r in every], np.int64)[row] + place
    order, tied = multikey_order([h1, h2])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(~tied) - 1
    if units.first:
        by = np.lexsort((pos, key, group))
        head = by[np.flatnonzero(np.concatenate([[True], np.diff(group[by]) > 0]))]
        goes = (key != key[head][group]) | (pos != pos[head][group])
    else:
        goes = np.bincount(group)[group] > 1
    goes = np.flatnonzero(goes & stays)
    goes = goes[np.lexsort((pos[goes], key[goes]))]
    if len(goes):
        k, p = key[goes], pos[goes]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)]))
        yield from zip(k[new].tolist(), p[new].tolist(), np.diff(np.append(new, len(k))).tolist())


def repeated(edges: DataFrame, units: Units) -> DataFrame:
    """``key, gone``: starts and counts of windows that go, by document."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, last = [], 0, None

        def flush() -> pa.RecordBatch:
            out = list(compared(held, units))
            k, s, n = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, s, n)], names=["key", "start", "count"])

        for batch in pieces(batches, 4096):
            for lead, mark, part, key, start, stays, body in zip(*(c.to_pylist() for c in batch.columns)):
                if windows >= BUCKET and (lead, mark, part) != last:
                    yield flush()
                    held, windows = [], 0
                last = (lead, mark, part)
                held.append((part, key, start, stays, body))
                windows += SLICE if part >= 0 else max(1, len(body) // 4)
        if held:
            yield flush()

    dealt = edges.repartitionByRange("lead", "mark", "part").sortWithinPartitions("lead", "mark", "part")
    out = dealt.mapInArrow(bucket, "key long, start long, count long")
    return out.groupBy("key").agg(F.collect_list(F.struct("start", "count")).alias("gone"))  # of one document


def removed_spans(n_units: int, length: int, packs, gone) -> list[tuple[int, int]]:
    """Maximal stretches of units to remove."""
    n = n_units - length + 1
    if n <= 0:
        return []
    spans, at = [], 0
    if packs is not None:
        start, count, flag = unpacked(packs)
        stay = (flag & 1) == 1
        for s, c in zip(start[stay].tolist(), count[stay].tolist()):
            if s > at:
                spans.append((at, s))
            at = max(at, s + c)
    if at < n:
        spans.append((at, n))
    spans = sorted(spans + [(g["start"], g["start"] + g["count"]) for g in gone or ()])
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length - 1)
        else:
            out.append([s, e + length - 1])
    return [tuple(x) for x in out]


def finished(joined: DataFrame, gone: DataFrame, units: Units, cut: Callable[[bytes, list[tuple[int, int]]], bytes], count: Callable[[bytes], int]) -> DataFrame:
    """``id, n_units, spans, kept`` of every row, from the lists of what stays
    and of the windows that go."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            n, spans, kept = [], [], []
            for text, packs, out in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n.append(count(text))
                spans.append(removed_spans(n[-1], units.length, packs, out))
                kept.append(cut(text, spans[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["id", "n_units", "spans", "kept"])

    final = joined.join(gone.hint("shuffle_hash"), "key", "left").select("id", "text", "packs", "gone")
    return final.mapInArrow(finish, "id long, n_units long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, units: Units, cut: Callable[[bytes, list[tuple[int, int]]], bytes], count: Callable[[bytes], int],
                   id_col: str, text_col: str) -> DataFrame:
    """``id, n_units, spans, kept`` of every row: the removed stretches of units
    and what is left."""
    rows = keyed(docs, id_col, text_col)
    own = lists(rows, units)
    joined = rows.join(own.hint("shuffle_hash"), "key", "left")
    return finished(joined, repeated(suffixes(joined, units), units), units, cut, count)
