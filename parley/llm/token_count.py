"""Token counts of byte-pair encodings with word ends.

Each word is a linked list of symbols; a heap holds its adjacent pairs by
merge rank.  The pair of lowest rank is popped and merged again and again;
the token count is the number of initial symbols minus the number of merges,
so no identifiers are made.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts of any
length are counted whole; repeated rows and null ids each give a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parley.llm.common import pieces

CACHE_WORDS = 600_000  # words whose counts a worker keeps

# Where the Unicode tables of the vocabularies' library differ from those of Python and of ``regex``.
# Its classes are those of Unicode 16: these code points, assigned later, are neither letters nor numbers there.
NO_LETTERS = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
    10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
    16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
    1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
    1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
# Its lower case is that of Unicode 17: capitals Python does not know, and how far their small letters lie.
NEW_CAPITALS = {"1C89": 1, "A7CB": 0x264 - 0xA7CB, "A7CC": 1, "A7CE": 1, "A7D2": 1, "A7D4": 1, "A7DA": 1, "A7DC": 0x19B - 0xA7DC,
                "10D50-10D65": 0x20, "16EA0-16EB8": 0x1B}


def code_points(ranges: str) -> list[int]:
    out = []
    for r in ranges.split():
        low, _, high = r.partition("-")
        out += range(int(low, 16), int(high or low, 16) + 1)
    return out


LOWER = {c: c + by for r, by in NEW_CAPITALS.items() for c in code_points(r)}
OTHER = regex.compile("[" + "".join(f"\\U{int(r.split('-')[0], 16):08x}-\\U{int(r.split('-')[-1], 16):08x}" for r in NO_LETTERS.split()) + "]")
NEWER = regex.compile("[" + "".join(map(chr, LOWER)) + "]")
NEUTRAL = "\ue000"  # neither letter, number nor space


def byte_symbols() -> list[str]:
    """The printable symbol of every byte value, as byte-level vocabularies
    define it: printable Latin-1 bytes stand for themselves, the others follow
    from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class BpeCounter(dict):
    """Maps a word to its number of tokens; a word not seen before is merged
    and remembered (the store is emptied when it is full)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = frozenset(model["vocab"])
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special)))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.cache_words = cache_words

    def __missing__(self, word: str) -> int:
        n = self.merge_count(word)
        if len(self) >= self.cache_words:
            self.clear()
        self[word] = n
        return n

    def merge_count(self, word: str) -> int:
        sym = [self.symbols[b] for b in word.encode("utf-8")]
        sym[-1] += self.end
        sym = [s for s in sym if s in self.vocab]  # no unknown token: such symbols give none
        n = len(sym)
        if n < 2:
            return n
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            merges += 1
            sym[i], sym[j] = a + b, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return len(parts) - 1 + sum(map(self.count_plain, parts))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
            if NEWER.search(text):
                text = text.translate(LOWER)
            text = text.lower()
            if OTHER.search(text):  # split where the library does
                return sum(self[text[m.start():m.end()]] for m in self.split.finditer(OTHER.sub(NEUTRAL, text)))
            return sum(map(self.__getitem__, self.split.findall(text)))
        return sum(map(self.__getitem__, self.split.findall(text.lower())))


_counters: dict[str, BpeCounter] = {}


def counter(path: str) -> BpeCounter:
    """The counter of a vocabulary file, one for each Python worker."""
    if path not in _counters:
        _counters[path] = BpeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``vocabulary`` is the path of the vocabulary file on the executors (a
    file of an installed package).  One narrow pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(vocabulary)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [bpe.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
