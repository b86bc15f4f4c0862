"""Anchors of the windows of a sequence.

Every window of ``length`` units gets an anchor: a place inside it chosen from
the content of the window alone, so equal windows have their anchors at the
same offset and with the same fingerprint, wherever they stand.  Neighbouring
windows with one anchor form a run.  A sequence of some thousand units has
few runs, and only runs with equal fingerprints can hold equal windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from parley.llm.common import mix64
from parley.llm.words import BASE, CHUNK, INVERSE, power_table

BLOCK = CHUNK // 2  # windows worked on at a time
PLACE = np.uint64((1 << 22) - 1)  # low bits of a priority that hold the place
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
INVERSE2 = np.uint64(pow(int(BASE2), -1, 1 << 64))


class Sums:
    """Prefix sums that give the polynomial hash of any stretch."""

    def __init__(self, seq: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = INVERSE):
        n = len(seq)
        self.inverse = power_table_of(inverse, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(seq * power_table_of(base, n + 1)[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """Of each stretch of ``length`` units."""
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


_tables: dict[int, np.ndarray] = {}


def power_table_of(base: np.uint64, n: int) -> np.ndarray:
    if base in (BASE, INVERSE):
        return power_table(base, n)[:n]
    have = _tables.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK + 1), base, np.uint64)
        p[0] = 1
        have = _tables[int(base)] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    p = 1
    while 2 * p <= width:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[:len(x) - (width - p)], x[width - p:]) if p < width else x


def least_gram(seq: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and fingerprint of the anchor of each window: its least gram."""
    g = Sums(seq).every(gram)
    ranked = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
    at = (sliding_min(ranked, length - gram + 1) & PLACE).astype(np.int64)
    return at, g[at]


@dataclass
class Level:
    """Symbols of one round: name, span, and the context that they depend on."""
    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    clo: np.ndarray
    chi: np.ndarray


FAR = 1 << 40


def recompress(level: Level, turn: int) -> Level:
    """One round: runs of a symbol, then pairs of symbols, get new names.

    A name is a hash of what it stands for, so it is the same everywhere.  The
    context grows by the neighbours that decided: on both sides for a run, on
    the side that could have paired for a symbol that stays alone."""
    n = len(level.name)
    first = np.flatnonzero(np.concatenate([[True], level.name[1:] != level.name[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    many = (last - first + 1).astype(np.uint64)
    name = level.name[first]
    name = np.where(many > 1, mix64(name * BASE + many + np.uint64(2 * turn)), name)
    lo, hi = level.lo[first], level.hi[last]
    clo = np.where(first > 0, level.clo[np.maximum(first - 1, 0)], -FAR)
    chi = np.where(last < n - 1, level.chi[np.minimum(last + 1, n - 1)], FAR)

    m = len(name)
    right = (mix64(name + np.uint64(2 * turn + 1)) & np.uint64(1)).astype(bool)
    opens = np.zeros(m, bool)
    opens[:-1] = ~right[:-1] & right[1:]
    closes = np.zeros(m, bool)
    closes[1:] = opens[:-1]
    keep = np.flatnonzero(~closes)
    end = keep + opens[keep]
    paired = opens[keep]
    new = np.where(paired, mix64((name[keep] * BASE + name[end]) * BASE2 + np.uint64(turn)), name[keep])
    alone_right = ~paired & right[keep]
    alone_left = ~paired & ~right[keep]
    new_clo = np.where(alone_right, np.where(keep > 0, clo[np.maximum(keep - 1, 0)], -FAR), clo[keep])
    new_chi = np.where(alone_left, np.where(keep < m - 1, chi[np.minimum(keep + 1, m - 1)], FAR), chi[end])
    return Level(new, lo[keep], hi[end], new_clo, new_chi)


def high_symbol(seq: np.ndarray, length: int, rounds: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and fingerprint of the anchor of each window: the symbol of the
    highest round whose context, at most ``context`` units, lies in the window
    (a unit by itself always does); of these the one of the least hash."""
    n = len(seq) - length + 1
    sums = Sums(seq)
    unit = np.arange(len(seq))
    levels = [Level(seq, unit, unit + 1, unit, unit + 1)]
    for turn in range(1, rounds + 1):
        levels.append(recompress(levels[-1], turn))
    at, mark = np.full(n, -1), np.zeros(n, np.uint64)
    for turn in range(rounds, -1, -1):
        v = levels[turn]
        ok = np.flatnonzero((v.clo >= 0) & (v.chi <= len(seq)) & (v.chi - v.clo <= (context if turn else length)))
        todo = np.flatnonzero(at < 0)
        if not len(ok) or not len(todo):
            continue
        clo, chi = v.clo[ok], v.chi[ok]
        print_ = mix64(sums.hash(clo, chi) + v.name[ok] * BASE + (v.lo[ok] - clo).astype(np.uint64) * BASE2 + np.uint64(turn))
        ranked = np.append((print_ & ~PLACE) | np.arange(len(ok), dtype=np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
        # The contexts are in order: those inside a window are neighbours.
        low = np.searchsorted(clo, todo, side="left")
        high = np.searchsorted(chi, todo + length, side="right")
        has = low < high
        todo, low, high = todo[has], low[has], high[has]
        if len(todo):
            best = (np.minimum.reduceat(ranked, np.stack([low, high], axis=1).ravel())[::2] & PLACE).astype(np.int64)
            at[todo], mark[todo] = clo[best], print_[best]
    return at, mark


@dataclass
class Runs:
    """``doc`` (number in the batch), ``start`` and ``count`` of windows, the
    anchor's fingerprint ``mark`` and the hash ``content`` of all the units."""
    doc: np.ndarray
    mark: np.ndarray
    content: np.ndarray
    start: np.ndarray
    count: np.ndarray


MOST = 500  # windows in a run


def strung(seqs: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences strung together, with a unit of their own between them, to
    about BLOCK units: the units; the document of each unit (-1 between); the
    place of each unit in its document.  Longer sequences are cut with an
    overlap that leaves every window whole."""
    units, doc, place, held = [], [], [], 0
    for i, seq in enumerate(seqs):
        for at in range(0, max(len(seq) - length + 1, 0), BLOCK):
            part = seq[at:at + BLOCK + length - 1]
            units += [part, np.array([(0x5851F42D4C957F2D * (held + 1)) & 0xFFFFFFFFFFFFFFFF], np.uint64)]
            doc += [np.full(len(part), i), np.array([-1])]
            place += [np.arange(at, at + len(part)), np.array([0])]
            held += len(part) + 1
            if held >= BLOCK:
                yield np.concatenate(units), np.concatenate(doc), np.concatenate(place)
                units, doc, place, held = [], [], [], 0
    if held:
        yield np.concatenate(units), np.concatenate(doc), np.concatenate(place)


def runs(seqs: list[np.ndarray], length: int, anchor: Callable) -> Iterator[Runs]:
    """The runs of the sequences.  Where a long sequence is cut a run may be
    cut, which changes how runs are compared but not which windows are equal.
    What stands beside a document does not count: a context that reaches over
    its end lies in none of its windows."""
    for units, doc, place in strung(seqs, length):
        at, mark = anchor(units)
        n = len(at)
        ends = place[length - 1:length - 1 + n]
        whole = (doc[:n] >= 0) & (doc[:n] == doc[length - 1:length - 1 + n]) & (ends - place[:n] == length - 1)
        new = np.flatnonzero(whole & np.concatenate([[True], (at[1:] != at[:-1]) | (mark[1:] != mark[:-1]) | ~whole[:-1]]))
        if not len(new):
            continue
        stop = np.flatnonzero(~whole)
        until = np.append(stop, n)[np.searchsorted(stop, new)]
        count = np.minimum(np.append(new[1:], n), until) - new
        while count.max() > MOST:
            long = np.flatnonzero(count > MOST)
            new = np.insert(new, long + 1, new[long] + MOST)
            more = count[long] - MOST
            count[long] = MOST
            count = np.insert(count, long + 1, more)
        content = Sums(units).hash(new, new + count + length - 1)
        content = mix64(content + count.astype(np.uint64) * BASE2 + (at[new] - new).astype(np.uint64))
        yield Runs(doc[new], mark[new], content, place[new], count)


def window_hashes(seq: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window."""
    return Sums(seq).every(length), Sums(seq, BASE2, INVERSE2).every(length)


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by several keys, and for each place in it whether it is
    equal to the one before in all keys.  As in a multikey quicksort only
    what is still tied is looked at with the next key."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.zeros(len(order), bool)
    tied[1:] = keys[0][order[1:]] == keys[0][order[:-1]]
    for key in keys[1:]:
        at = np.flatnonzero(tied | np.append(tied[1:], False))  # places in groups of two or more
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        sub = order[at]
        by = np.lexsort((key[sub], group))
        order[at] = sub[by]
        k, g = key[order[at]], group[by]
        tied[at] = np.append(False, (k[1:] == k[:-1]) & (g[1:] == g[:-1]))
    return order, tied
