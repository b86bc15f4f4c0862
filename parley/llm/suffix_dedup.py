"""Suffix-array removal of repeated byte strings.

Every byte covered by a ``length``-byte string (a window) that also starts
anywhere else, in the same document too, is removed.

The suffix array is sparse.  A window's anchor is the place of its least
128-byte gram, so equal windows have their anchors at the same place and only
suffixes at anchors need sorting; windows next to each other mostly share one
(a run).  A window is repeated if the suffix at its anchor shares enough bytes
with another one, and so do the bytes before it, read backwards.

1. Runs of equal content (a 128-bit BLAKE2 digest of the bytes) are counted, by
   partial sums; runs whose anchor gram no other content has need nothing more.
2. The suffixes at the other anchors are dealt to buckets by sampled splitters
   on their leading bytes.  A gram with very many contents may be split, by all
   the bytes behind and before the anchor.
3. A bucket sorts the suffixes, and the reversed bytes before the anchors, by a
   multikey quicksort, and takes the common prefixes of neighbours.  From these
   follow, for each place in the windows, the classes of equal windows.
4. Where a split gram goes on in the next bucket, windows may equal one across
   the boundary.  One of each class of them is sent on, as a digest, packed by
   the task that compares it with those of the other buckets.

Strings are judged on the input and never cross documents.

Defined results: a null text is empty; a text shorter than ``length`` stays
whole; rows of equal id and text are documents of their own, so both lose what
they share; null ids and repeated ids are allowed; a text of any length is
read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.anchors import least_gram, multikey_order, runs
from parley.llm.common import as_bytes, pieces, stored
from parley.llm.repeats import COUNT_BITS, FLAG_BITS, Units, finished, keyed, leads, unpacked
from parley.llm.words import BYTE

LENGTH, GRAM, LEAD = 400, 128, 16
HOT = 512        # entries of a gram beyond which its suffixes may be split
ROWS = 6000      # suffixes sorted at a time, at least a whole gram that is not split


def parse(texts: list[bytes]) -> list[np.ndarray]:
    return [BYTE[np.frombuffer(t, np.uint8)] for t in texts]


def piecer(text: bytes):
    return lambda start, end: text[start:end]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2]))


def byte_units(length: int = LENGTH, gram: int = GRAM) -> Units:
    gram = min(gram, length)
    return Units(length, False, parse, piecer, partial(least_gram, length=length, gram=gram), min(LEAD, gram))


def digests(parts: list[bytes]) -> np.ndarray:
    """Two numbers for each, from a digest of 128 bits."""
    return np.frombuffer(b"".join(blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)


def occurrences(rows: DataFrame, units: Units) -> DataFrame:
    """``mark, c1, c2, key, at, n``: the runs, equal ones of a batch folded;
    ``at`` packs start and count."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys, texts = np.array(batch.column(0).to_pylist(), np.int64), as_bytes(batch.column(1))
            for r in runs(units.parse(texts), units.length, units.anchor):
                end = r.start + r.count + units.length - 1
                content = digests([texts[d][a:b] for d, a, b in zip(r.doc.tolist(), r.start.tolist(), end.tolist())])
                mark, key, at = r.mark.view(np.int64), keys[r.doc], (r.start << COUNT_BITS) | r.count
                order = np.lexsort((at, key, content[:, 1], content[:, 0]))
                mark, content, key, at = mark[order], content[order], key[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (content[1:] != content[:-1]).any(axis=1)]))
                n = np.diff(np.append(first, len(mark)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mark[first], content[first, 0], content[first, 1], key[first], at[first], n)],
                                                 names=["mark", "c1", "c2", "key", "at", "n"])

    return rows.select("key", "text").mapInArrow(emit, "mark long, c1 long, c2 long, key long, at long, n long")


def lists(rows: DataFrame, units: Units) -> DataFrame:
    """``key, packs``: of each document the runs that stay (flag 1), whose
    suffixes must be sorted (flag 2), with a gram that may be split (flag 4)."""
    entries = stored(occurrences(rows, units), "entries")
    contents = entries.groupBy("mark", "c1", "c2").agg(F.min(F.struct("key", "at")).alias("o"), F.sum("n").alias("n"))
    # Sums of each task: a gram of a third of all documents is no more than a row a task.
    several = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    marks = entries.groupBy("mark").agg(several.alias("several"), (F.count(F.lit(1)) > HOT).alias("hot")).where("several").select("mark", "hot")
    joined = contents.join(marks, "mark", "left")
    flags = F.when(F.col("n") == 1, 1).otherwise(0) + F.when(F.col("hot").isNotNull(), 2).otherwise(0) + F.when(F.col("hot"), 4).otherwise(0)
    packed = joined.select(F.col("o.key").alias("key"), (F.shiftleft(F.col("o.at"), FLAG_BITS) + flags).alias("pack"), flags.alias("f")).where("f > 0")
    return stored(packed.groupBy("key").agg(F.collect_list("pack").alias("packs")), "lists")  # at most the runs of one document


SUFFIX = "lead binary, mark long, tail binary, hot boolean, key long, start long, stays boolean, at int, body binary"


def suffixes(joined: DataFrame, units: Units) -> DataFrame:
    """The suffixes to sort: the bytes of a run, with the place of its anchor;
    ``tail``: what a split goes by, empty where there is none."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            rows = []
            for key, text, packs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                for start, count, flag in zip(*(x.tolist() for x in unpacked(packs))):
                    if flag & 2:
                        rows.append((key, start, bool(flag & 1), bool(flag & 4), text[start:start + count + units.length - 1]))
            out = [(lead, mark, body[at:] + body[:at][::-1] if hot else b"", hot, key, start, stays, at, body)
                   for (key, start, stays, hot, body), (lead, mark, at) in zip(rows, leads(units, [r[4] for r in rows]))]
            types = (pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[c.split()[0] for c in SUFFIX.split(", ")])

    some = joined.where(F.exists("packs", lambda p: p.bitwiseAND(F.lit(2)) != 0))
    return some.select("key", "text", "packs").mapInArrow(emit, SUFFIX)


def sorted_strings(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings of at most ``width`` bytes by group and bytes, and the
    length of the common prefix of each with the one before it in that order
    (-1 for the first of a group)."""
    size = np.array([len(s) for s in strings], np.int64)
    wide = -(-max(width, 1) // 8) * 8
    table = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(len(strings), wide)
    words = table.view(">u8")
    # A shorter string comes first where only the padding makes them equal.
    order, _ = multikey_order([group, *(words[:, i].astype(np.uint64) for i in range(words.shape[1])), size])
    a, b = table[order[1:]], table[order[:-1]]
    differs = a != b
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def shared_with(strings: list[bytes], one: bytes, width: int) -> np.ndarray:
    """Of each string the bytes that it begins with as ``one`` does, at most ``width``."""
    table = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    differs = table != np.frombuffer(one[:width].ljust(width, b"\0"), np.uint8)
    size = np.minimum([len(s) for s in strings], min(len(one), width))
    return np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), width), size)


FOUND = "key long, start long, count long, route int, packed binary"
BEYOND = np.dtype([("c1", "<i8"), ("c2", "<i8"), ("key", "<i8"), ("start", "<i8"), ("stays", "?")])


def twice(classes: np.ndarray) -> np.ndarray:
    """Whether each value is there more than once."""
    by = np.argsort(classes, kind="stable")
    same = classes[by[1:]] == classes[by[:-1]]
    out = np.empty(len(classes), bool)
    out[by] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def compared(rows: list[tuple], length: int, gram: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """What a stretch of the bucket shows: key, start and count of windows that
    go; and, of each class of windows that may equal one beyond the stretch, the
    one to compare there (BEYOND).  ``rows``: of SUFFIX, in their order."""
    mark = np.array([r[1] for r in rows], np.int64)
    group = np.cumsum(np.concatenate([[True], mark[1:] != mark[:-1]]))
    at, bodies = np.array([r[7] for r in rows], np.int64), [r[8] for r in rows]
    count = np.array([len(b) for b in bodies], np.int64) - length + 1
    behind = [b[a:a + length] for a, b in zip(at.tolist(), bodies)]
    before = [b[:a][::-1] for a, b in zip(at.tolist(), bodies)]
    order_r, shared_r = sorted_strings(behind, group, length)
    order_l, shared_l = sorted_strings(before, group, length - gram)

    # Bytes shared with the ends of the stretch where a split gram may go on: of
    # the tails, which the rows go by.  Behind the anchor alone the order is
    # another, as a run that ends early goes on with the bytes before it.
    reach = np.full(len(rows), -1)
    for end in (0, -1):
        if rows[end][3]:
            own = np.flatnonzero(group == group[end])
            reach[own] = np.maximum(reach[own], shared_with([rows[i][2] for i in own], rows[end][2], length))

    n, m = len(rows), length - gram + 1
    key, start, stays = (np.array([r[i] for r in rows]) for i in (4, 5, 6))
    goes, sent = np.zeros((n, m), bool), np.zeros((n, m), bool)  # by the distance of the window's start to its anchor
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(m):
        own = np.flatnonzero((d <= at) & (d > at - count))
        if not len(own):
            continue
        class_r[order_r] = np.cumsum(shared_r < length - d)
        class_l[order_l] = np.cumsum(shared_l < d)
        both = class_r[own] * (n + 1) + class_l[own]
        goes[own, d] = twice(both)
        far = np.flatnonzero(reach[own] >= length - d)  # a class is far as a whole
        sent[own[far[np.unique(both[far], return_index=True)[1]]], d] = True

    out: list[tuple[int, int, int]] = []
    r, d = np.nonzero(goes & stays[:, None])
    if len(r):
        i = at[r] - d
        by = np.lexsort((i, r))
        r, i = r[by], i[by]
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1] + 1)]))
        out = list(zip(key[r[new]].tolist(), (start[r[new]] + i[new]).tolist(), np.diff(np.append(new, len(r))).tolist()))
    r, d = np.nonzero(sent)
    beyond = np.empty(len(r), BEYOND)
    if len(r):
        i = at[r] - d
        content = digests([bodies[x][y:y + length] for x, y in zip(r.tolist(), i.tolist())])
        beyond["c1"], beyond["c2"], beyond["key"], beyond["start"] = content[:, 0], content[:, 1], key[r], start[r] + i
        beyond["stays"] = stays[r] & ~goes[r, d]  # else its fate is known, and it speaks for its class only
    return out, beyond


def sorted_buckets(edges: DataFrame, units: Units, gram: int, routes: int) -> DataFrame:
    """Sort the suffixes bucket by bucket; rows of FOUND: windows that go, or
    packed windows for the task that compares those of a route."""
    length, most = units.length, ROWS

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            found, beyond = compared(held, length, gram)
            route = beyond["c1"] % routes
            beyond = beyond[np.argsort(route, kind="stable")]
            route = np.sort(route)
            first = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]])) if len(route) else np.zeros(0, np.int64)
            packs = [p.tobytes() for p in np.split(beyond, first[1:])] if len(first) else []
            k, s, c = zip(*found) if found else ((), (), ())
            none = [None] * len(packs)
            cols = ([*k, *none], [*s, *none], [*c, *none], [*[None] * len(k), *route[first].tolist()], [*[None] * len(k), *packs])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                              names=[c.split()[0] for c in FOUND.split(", ")])

        for batch in pieces(batches, 4096):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= most and (row[3] or row[1] != held[-1][1]):  # a stretch ends between grams, or within one that may be split
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    dealt = edges.repartitionByRange("lead", "mark", "tail").sortWithinPartitions("lead", "mark", "tail")
    return dealt.mapInArrow(bucket, FOUND)


GONE = "key long, gone array<struct<start:long,count:long>>"


def across_boundaries(packs: DataFrame) -> DataFrame:
    """``key, gone``: windows that equal one of another stretch."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(parts: list[bytes]) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(parts), BEYOND)
            x = x[np.lexsort((x["c2"], x["c1"]))]
            same = (x["c1"][1:] == x["c1"][:-1]) & (x["c2"][1:] == x["c2"][:-1])
            x = x[(np.concatenate([[False], same]) | np.concatenate([same, [False]])) & x["stays"]]
            x = x[np.lexsort((x["start"], x["key"]))]
            first = np.flatnonzero(np.concatenate([[True], x["key"][1:] != x["key"][:-1]])) if len(x) else np.zeros(0, np.int64)
            gone = [[{"start": s, "count": 1} for s in p["start"].tolist()] for p in np.split(x, first[1:])] if len(first) else []
            return pa.RecordBatch.from_arrays([pa.array(x["key"][first]), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("count", pa.int64())])))], names=["key", "gone"])

        last, parts = None, []
        for batch in batches:
            for route, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if route != last and parts:
                    yield settle(parts)
                    parts = []
                last = route
                parts.append(packed)
        if parts:
            yield settle(parts)

    return packs.select("route", "packed").repartition("route").sortWithinPartitions("route").mapInArrow(compare, GONE)


def repeated(edges: DataFrame, units: Units, gram: int) -> DataFrame:
    """``key, gone``: starts and counts of windows that go, by document."""
    routes = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(sorted_buckets(edges, units, gram, routes), "found")
    own = found.where("route is null").select("key", F.array(F.struct("start", "count")).alias("gone"))
    gone = own.unionByName(across_boundaries(found.where("route is not null")))
    return gone.groupBy("key").agg(F.flatten(F.collect_list("gone")).alias("gone"))  # of one document


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans`` (removed stretches, byte offsets), ``kept``
    (the remaining bytes) of every row of ``docs``."""
    units, gram = byte_units(length, gram), min(gram, length)
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(lists(rows, units).hint("shuffle_hash"), "key", "left")
    out = finished(joined, repeated(suffixes(joined, units), units, gram), units, cut, len)
    return out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_bytes"), "spans", "kept")
