"""Words of a text as 64-bit hashes, on NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from parley.llm.common import mix64

CHUNK = 1 << 20
LONG = 256  # bytes of a word
_draw = np.random.default_rng(20240501)
BYTE = np.frombuffer(_draw.bytes(256 * 8), np.uint64)  # a random number for each byte value
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
OTHER = np.ones(256, bool)  # all but ASCII letters and digits and the bytes of longer characters
OTHER[48:58] = OTHER[65:91] = OTHER[97:123] = OTHER[128:] = False


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.empty(n, np.uint64)
    if n:
        p[0] = 1
        p[1:] = base
    return np.cumprod(p, dtype=np.uint64)


_powers = {int(b): powers(b, CHUNK + 1) for b in (BASE, INVERSE)}


def power_table(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[int(base)]) < n:
        return powers(base, n)  # for a word longer than a chunk
    return _powers[int(base)]


def chunks(raw: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about CHUNK bytes that end after a byte of ``stop``."""
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        if end < len(raw):
            inside = np.flatnonzero(stop[raw[at:end]])
            if len(inside):
                end = at + int(inside[-1]) + 1
            else:
                while end < len(raw) and not stop[raw[end]]:
                    end += 1
        yield at, end
        at = end


def words(text: bytes, stop: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each maximal run of bytes outside ``stop``."""
    raw = np.frombuffer(text, np.uint8)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at, end in chunks(raw, stop):
        b = raw[at:end]
        inside = ~stop[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        start, stop_at = edge[0::2], edge[1::2]
        if not len(start):
            continue
        n = stop_at - start
        first = np.cumsum(n) - n
        offset = np.arange(int(n.sum())) - np.repeat(first, n)
        h = mix64(np.add.reduceat(BYTE[b[inside]] * power_table(BASE, int(n.max()))[offset], first) + n.astype(np.uint64) * BASE)
        # Powers modulo 2^64 fail on some texts of a thousand bytes and more: long words have a digest.
        for i in np.flatnonzero(n > LONG):
            h[i] = int.from_bytes(blake2b(b[start[i]:stop_at[i]].tobytes(), digest_size=8).digest(), "little")
        out.append((h, start + at, stop_at + at))
    return tuple(np.concatenate(x) for x in zip(*out))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of ``k`` consecutive words; of all words if there are fewer."""
    if not len(h):
        return h
    k = min(k, len(h))
    s = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        s = s * BASE + h[i:len(h) - k + 1 + i]
    return mix64(s)
