"""Benchmark decontamination: SimHash fingerprints of item-sized windows.

Words are the lower-cased runs of letters and digits; shingles are five words
(all words of a shorter item).  A window is as many words of a document as a
benchmark item has, at every place; a text with fewer words is one window.
Where an item in line with a shared shingle would stick out of the text, there
is a window cut at the end of the text as well.  Only windows that no other
beats are built, see ``best_starts``.  The SimHash fingerprints (64 bits,
shingles weighted by their counts) of the distinct windows are compared with
those of the items of that size through multi-index Hamming blocks: two
fingerprints within ``radius`` bits agree in at least one of ``radius + 1``
blocks, so all of them are found.  Candidates are verified by the exact
weighted-shingle similarity, the sum of the smaller counts over the sum of the
larger ones.

Items of fewer than five words have one shingle, all of theirs; so has a window
of as many words, and the two are as similar as they are equal.  Texts are held
against such items in windows of that size at every place.

DataFrame functions only.  The shingles of the benchmark are broadcast only
if they were counted to be few; else they are joined by shuffle.  A common
passage or many copies of a document cost one fingerprint: windows are folded
by content before they are compared.

Defined results: null and empty texts and items have no shingles and match
nothing; a document or item shorter than five words has one shingle of all its
words; an item of fewer words is found in texts of any length; each row of ``docs`` gets a row, repeated rows and null ids too; ties
for the best item go to the smallest item id; empty tables give results
without matches.  Other columns are ignored by ``decontamination`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stored

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BITS = 64
BROADCAST_SHINGLES = 1_000_000  # of 24 bytes


def words_of(text: Column) -> Column:
    """The lower-cased words; an empty array for null."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """A 64-bit hash of each shingle of an array of words, in order."""
    n = F.size(words)
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return (F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(F.array_join(words, " "))))
            .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), at)))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def weighted(rows: DataFrame, key: list[str], shingles: str) -> DataFrame:
    """``key, h, w``: the shingles of each row and their counts."""
    return rows.select(*key, F.explode(shingles).alias("h")).groupBy(*key, "h").agg(F.count(F.lit(1)).alias("w"))


def simhash(weights: DataFrame, key: list[str]) -> DataFrame:
    """``key, fp, total``: the fingerprint and the sum of weights."""
    bit = lambda b: F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1
    sums = weights.groupBy(*key).agg(F.sum("w").alias("total"), *[F.sum(F.when(bit(b), F.col("w")).otherwise(-F.col("w"))).alias(f"b{b}") for b in range(BITS)])
    fp = reduce(lambda a, c: a.bitwiseOR(c), [F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)])
    return sums.select(*key, fp.alias("fp"), "total")


def blocks(fp: Column, radius: int) -> Column:
    """``radius + 1`` blocks of the fingerprint, with their numbers."""
    n = radius + 1
    edge = [round(BITS * i / n) for i in range(n + 1)]
    part = lambda i: F.shiftrightunsigned(fp, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("block"), part(i).alias("value")) for i in range(n)])


def best_starts(hits: DataFrame, similarity: float) -> DataFrame:
    """``text_key, n, start`` of the windows to build.  ``hits``: the places
    ``pos`` of a text of ``size`` words with a shingle that an item of ``n``
    words has at its place ``at``.  For no item is the best window lost:

    - a window that begins with another shingle shares no less if it begins at
      the next hit, or at the last place;
    - ``m`` shared shingles of ``a`` and ``b`` give at most m / (a + b - m), so
      at least s / (1 + s) * (a + b) hits must lie in the window;
    - a whole window whose hits all lie in that of the hit before is no better.
    """
    start = F.col("pos") - F.col("at")
    rows = (hits.withColumn("edge", F.when((start < 0) | (start + F.col("n") > F.col("size")), start))
            .groupBy("text_key", "n", "size").agg(F.sort_array(F.collect_set("pos")).alias("ps"), F.collect_set("edge").alias("edges"))  # of one text
            .withColumn("own", F.greatest(F.col("n") - SHINGLE + 1, F.lit(1))).withColumn("all", F.greatest(F.col("size") - SHINGLE + 1, F.lit(1))))
    ps, own, whole = F.col("ps"), F.col("own"), F.least("own", "all")
    last = F.col("all") - whole
    least = lambda total: F.greatest(F.ceil(F.lit(similarity / (1 + similarity)) * (total + own) - F.lit(1e-9)).cast("int"), F.lit(1))
    from_left = lambda need, i, end: F.coalesce(F.get(ps, i + need - 1) <= end, F.lit(False))
    to_right = lambda need, begin: F.coalesce(F.get(ps, F.size(ps) - need) >= begin, F.lit(False))

    def inside(p: Column, i: Column) -> Column:
        need = least(own)
        gains = F.exists(F.slice(ps, i + need, own - need + 1), lambda q: (q >= F.get(ps, i - 1) + own) & (q < p + own))
        return (p <= last) & from_left(need, i, p + own - 1) & ((i == 0) | gains)

    def cut(s: Column) -> Column:
        return F.when(s < 0, from_left(least(F.least(own + s, F.col("all"))), F.lit(0), s + own - 1)).otherwise(to_right(least(F.col("all") - s), s))

    at_end = F.when(to_right(least(whole), last), F.array(last)).otherwise(F.array().cast("array<int>"))
    starts = F.array_distinct(F.concat(F.when(own <= F.col("all"), F.filter(ps, inside)).otherwise(F.array().cast("array<int>")), at_end, F.filter("edges", cut)))
    return rows.select("text_key", "n", F.explode(starts).alias("start"))


def short_matches(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame | None:
    """``text_key, item_id, start, similarity`` for items of fewer than five
    words; None if there are none.  Only the sizes that occur are looked at."""
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # four at most
    if not sizes:
        return None
    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    texts = texts.withColumn("size", F.size("words"))
    at = lambda k: F.transform(F.sequence(F.lit(0), F.col("size") - k), lambda i: F.struct(F.lit(k).alias("n"), i.alias("start"), F.slice("words", i + 1, k).alias("words")))
    none = F.array().cast("array<struct<n:int,start:int,words:array<string>>>")
    windows = F.concat(*[F.when(F.col("size") >= k, at(k)).otherwise(none) for k in sizes])
    some = items.select("n", "words", "item_id")
    some = F.broadcast(some) if some.count() <= BROADCAST_SHINGLES // 64 else some  # of up to four words
    met = texts.select("text_key", F.explode(windows).alias("w")).select("text_key", "w.n", "w.start", "w.words").join(some, ["n", "words"])
    return met.select("text_key", "item_id", "start", F.lit(1.0).alias("similarity"))


def contaminated_texts(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``text_key, item_id, start, similarity``: the windows of a distinct text
    (by its MD5) that match an item, with the best one of each item."""
    bench = items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    # Items of equal words are compared once, under their smallest id.
    bench = bench.groupBy("words").agg(F.min("item_id").alias("item_id")).withColumn("n", F.size("words"))
    every = stored(bench, "bench")
    few = short_matches(docs, every.where(F.col("n") < SHINGLE), text_col)
    bench = stored(every.where(F.col("n") >= SHINGLE).withColumn("h", shingle_hashes(F.col("words"))), "items")
    places = stored(bench.select("n", F.posexplode("h").alias("at", "h")).distinct(), "places")
    lookup = F.broadcast(places) if places.count() <= BROADCAST_SHINGLES else places

    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    hits = texts.select("text_key", F.size("words").alias("size"), F.posexplode(shingle_hashes(F.col("words"))).alias("pos", "h")).join(lookup, "h")
    # Which stretches of which texts: start may lie before the text.
    starts = stored(best_starts(hits, similarity), "starts")
    # The texts that are hit grow with the documents, so they are never broadcast.
    hit = starts.select("text_key").distinct().hint("shuffle_hash")
    found = (docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).join(hit, "text_key", "left_semi")
             .dropDuplicates(["text_key"]).select("text_key", words_of(F.col("text")).alias("words")))
    window = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n") + F.least(F.col("start"), F.lit(0)))
    windows = stored(starts.join(found, "text_key").select("text_key", "n", "start", window.alias("win")).withColumn("win_key", F.md5(F.array_join("win", " "))), "windows")

    distinct = windows.groupBy("n", "win_key").agg(F.first("win").alias("win"))
    win_w = stored(weighted(distinct.withColumn("s", shingle_hashes(F.col("win"))), ["n", "win_key"], "s"), "winw")
    item_w = weighted(bench, ["n", "item_id"], "h")
    win_fp, item_fp = simhash(win_w, ["n", "win_key"]), stored(simhash(item_w, ["n", "item_id"]), "itemfp")
    a = win_fp.select("n", "win_key", "fp", F.col("total").alias("win_total"), F.explode(blocks(F.col("fp"), radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    b = item_fp.select("n", "item_id", F.col("fp").alias("item_fp"), F.col("total").alias("item_total"), F.explode(blocks(F.col("fp"), radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    near = (a.join(b, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .groupBy("n", "win_key", "item_id").agg(F.first("win_total").alias("win_total"), F.first("item_total").alias("item_total")))
    both = near.join(win_w, ["n", "win_key"]).join(item_w.withColumnRenamed("w", "item_w"), ["n", "item_id", "h"])
    same = both.groupBy("n", "win_key", "item_id", "win_total", "item_total").agg(F.sum(F.least("w", "item_w")).alias("shared"))
    match = same.withColumn("similarity", F.col("shared") / (F.col("win_total") + F.col("item_total") - F.col("shared"))).where(F.col("similarity") >= similarity)
    found = windows.select("text_key", "n", "start", "win_key").join(match.select("n", "win_key", "item_id", "similarity"), ["n", "win_key"])
    found = found.select("text_key", "item_id", "start", "similarity")
    return found if few is None else found.unionByName(few)


def decontamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``doc_id, contaminated, n_items, best_item, best_similarity`` of every
    row of ``docs``."""
    found = contaminated_texts(docs, items, text_col=text_col, **bounds)
    by_item = found.groupBy("text_key", "item_id").agg(F.max("similarity").alias("s"))
    best = by_item.groupBy("text_key").agg(F.count(F.lit(1)).alias("n_items"), F.min(F.struct(-F.col("s"), F.col("item_id"))).alias("b"))
    best = stored(best.select("text_key", "n_items", F.col("b.item_id").alias("best_item"), (-F.col("b.col1")).alias("best_similarity")), "matches")
    rows = docs.select(F.col(id_col).alias(id_col), text_key(F.col(text_col)).alias("text_key"))
    return rows.join(best, "text_key", "left").select(
        id_col, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "best_item", "best_similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs`` without a match, with their columns."""
    bad = stored(contaminated_texts(docs, items, text_col=text_col, **bounds).select("text_key").distinct(), "contaminated")
    names = docs.columns
    return docs.withColumn("_text_key", text_key(F.col(text_col))).join(bad, F.col("_text_key") == bad["text_key"], "left_anti").select(*names)
