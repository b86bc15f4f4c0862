"""Removal of repeated passages of words by recompression.

In rounds, runs of a symbol and then pairs of symbols get new names.  A name
is a hash of what it stands for, so it is global without an exchange: equal
passages get the same symbols inside, up to the few next to their ends, and
each symbol knows the stretch of words (its context) that decided on it.  A
window is known by its highest symbol whose context lies inside it; shared
symbols reveal the windows that may be equal, and these are verified word by
word hash over the whole window (see ``repeats``).

A window is ``length`` consecutive words of a document; each word covered by a
window whose words also start earlier (smaller id, or the same document and
an earlier place) is removed.  Windows are judged on the input.

Defined results: words are runs of bytes other than space and 0x09-0x0D, kept
unchanged; a null text has none; a text of fewer than ``length`` words stays
whole; null ids come first; rows of equal id and text count as one document,
other rows of equal id follow the order of their text hash; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.anchors import high_symbol
from parley.llm.repeats import Units, remove_repeats
from parley.llm.words import words

LENGTH, ROUNDS, CONTEXT, LEAD = 20, 2, 8, 3


def parse(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text; the texts are read as one."""
    h, start, _ = words(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(h, np.searchsorted(start, ends[:-1])) if texts else []


def piecer(text: bytes):
    own = text.split()  # bytes split at space and 0x09-0x0D
    return lambda start, end: b" ".join(own[start:end])


def count(text: bytes) -> int:
    return len(text.split())


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    own = text.split()
    edges = [0, *(x for s in spans for x in s), len(own)]
    return b" ".join(w for a, b in zip(edges[0::2], edges[1::2]) for w in own[a:b])


def word_units(length: int = LENGTH, rounds: int = ROUNDS, context: int = CONTEXT) -> Units:
    return Units(length, True, parse, piecer, partial(high_symbol, length=length, rounds=rounds, context=min(context, length)), LEAD)


def remove_repeated_passages(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS, context: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans`` (removed stretches, word numbers), ``kept``
    (the remaining words, one space between) of every row of ``docs``."""
    out = remove_repeats(docs, word_units(length, rounds, context), cut, count, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_words"), "spans", "kept")
