"""Near duplicates by ProbMinHash.

The elements of a document are the hashes of its shingles of five words (all
words of a shorter text; words are lower-cased runs of ASCII letters, digits
and other alphabets), weighted by their counts.  Each element is a Poisson
process whose rate is its weight; every arrival falls into a random register,
which keeps its earliest arrival, and an element stops as soon as its next
arrival is later than the latest register.  Two documents agree in a register
with the probability Jaccard similarity of their weighted shingles.  Bands of
registers give candidates; these are verified by the exact probability Jaccard
similarity of the whole texts; documents linked at ``similarity`` or more,
directly or through others, form a class.

Texts of equal words are folded first.  No bucket is expanded to pairs: buckets
that share texts form a cluster, found on ids alone.  A task takes whole
clusters of bounded size and spreads out from one text: what it is linked to
is taken out and looks for others in turn, so classes are exact and a group
around one original costs about two comparisons a text; a text of which too
little lies in any other is not compared at all.  Of a cluster beyond the bound
the tasks take buckets; a bucket beyond the bound is cut to parts, any two of
which meet in a task.  So every two texts that share a bucket are compared.
Components are found by alternating large and small stars.  Joins that a hot
key would slow are split by Spark (skewed joins), and sums start in the tasks.

Defined results: a text without words (null, empty) is a class of its own; the
class id is the smallest id in the class (null ids come first); repeated rows
belong to one class; an empty table gives an empty result; other columns are
ignored by ``near_classes`` and kept by ``drop_near``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import mix64, pieces, stored
from parley.llm.words import OTHER, shingles, words

BANDS, ROWS = 16, 4
CLUSTER_BYTES = 24 << 20  # of text that one task compares
NODE_BYTES = 1000
SIMILARITY = 0.8
_STEP, _SIDE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def elements(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; distinct shingles, ascending, and their counts."""
    h = words((text or "").lower().encode("utf-8"), OTHER)[0]
    s, n = np.unique(shingles(h), return_counts=True)
    return h, s, n


def prob_min_hash(s: np.ndarray, weight: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The element that each of ``m`` registers keeps."""
    best, kept = np.full(m, np.inf), np.zeros(m, np.uint64)
    t, rate, elem, arrival = np.zeros(len(s)), weight.astype(float), s, 0
    while len(elem):
        many = max(1, 4 * m // len(elem))  # a few elements send several arrivals at a time
        number = np.arange(arrival + 1, arrival + many + 1, dtype=np.uint64) * _STEP
        arrival += many
        u = mix64(elem[:, None] + number[None, :])
        gap = -np.log(((u >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate[:, None]
        times = t[:, None] + np.cumsum(gap, axis=1)
        t = times[:, -1]
        register = (mix64(u ^ _SIDE) % np.uint64(m)).astype(np.int64).ravel()
        now, flat = best.copy(), times.ravel()
        np.minimum.at(now, register, flat)
        hit = np.flatnonzero((flat == now[register]) & (flat < best[register]))
        kept[register[hit]] = elem[hit // many]
        best = now
        go = t < best.max()
        t, rate, elem = t[go], rate[go], elem[go]
    return kept


def band_keys(signature: np.ndarray) -> np.ndarray:
    x = signature.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key + x[:, i])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over the common elements d of 1 / sum_e max(w_e / w_d, v_e / v_d)."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    w, v = a[1].astype(float), b[1].astype(float)
    if w.max() == 1 and v.max() == 1:
        return len(both) / (len(w) + len(v) - len(both))
    cw, cv = w[ia], v[ib]
    order = np.argsort(cw / cv, kind="stable")
    cw, cv = cw[order], cv[order]
    ratio = cw / cv
    at = np.searchsorted(ratio, ratio, side="left")  # elements of at least this ratio count by w, others by v
    more = np.concatenate([np.cumsum(cw[::-1])[::-1], [0.0]])[at] + (w.sum() - cw.sum())
    less = np.concatenate([[0.0], np.cumsum(cv)])[at] + (v.sum() - cv.sum())
    return float((1.0 / (more / cw + less / cv)).sum())


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_key, node, bands``: the node is a hash of the words, null for
    texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            nodes, bands, seen = [], [], {}
            for text in batch.column(2).to_pylist():
                h, s, n = elements(text)
                node = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None
                if node is not None and node not in seen:
                    seen[node] = band_keys(prob_min_hash(s, n))
                nodes.append(node)
                bands.append(seen.get(node))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "text_key", "node", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_key string, node binary, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (``a, b``) but the roots: the
    smallest node that it is linked to, by alternating large and small stars.
    They end when each node has only larger neighbours or a single smaller one."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        least = stored(least.select("u", F.least("m", "u").alias("m"), ((F.col("m") < F.col("u")) & (F.col("m") < F.col("most"))).alias("open")), "least")
        if least.where("open").isEmpty():
            return least.where("m < u").select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = both.join(least.drop("open"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = stored(small.select(pairs.alias("e")).select("e.*").where("u <> v").distinct(), "edges")


class Cluster:
    """Texts that may be similar, in one task: their classes, exactly."""

    def __init__(self, texts: list[str]):
        found = [elements(t)[1:] for t in texts]
        self.s, self.w = [f[0] for f in found], [f[1] for f in found]
        self.size, self.total = np.array([len(x) for x in self.s]), np.array([w.sum() for w in self.w], float)
        self.plain = np.array([bool((w == 1).all()) for w in self.w])
        self.first = np.cumsum(self.size) - self.size
        ids, self.flat = np.unique(np.concatenate(self.s), return_inverse=True)
        self.count = np.concatenate(self.w).astype(float)
        self.mark = np.zeros(len(ids))
        shared = np.bincount(self.flat)[self.flat] > 1
        self.met = np.add.reduceat(np.where(shared, self.count, 0.0), self.first)  # of the total, what lies in other texts too
        self.narrow(np.ones(len(texts), bool))

    def narrow(self, open_: np.ndarray) -> None:
        """From now on only the open texts are looked at."""
        self.left, inside = np.flatnonzero(open_), np.repeat(open_, self.size)
        size = self.size[self.left]
        self.left_first = np.cumsum(size) - size
        self.left_flat, self.left_share = self.flat[inside], self.count[inside] / np.repeat(self.total[self.left], size)

    def places(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the elements of ``texts`` lie, and where each text begins among these."""
        size = self.size[texts]
        first = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(self.first[texts] - first, size), first

    def weighted(self, i: int, others: np.ndarray) -> np.ndarray:
        """``probability_jaccard`` with each of ``others`` (with common
        elements), up to rounding; ``mark`` has the counts of ``i``."""
        owner, at = np.repeat(np.arange(len(others)), self.size[others]), self.places(others)[0]
        cw, cv = self.mark[self.flat[at]], self.count[at]
        both = cw > 0
        owner, cw, cv = owner[both], cw[both], cv[both]
        ratio = cw / cv
        order = np.lexsort((ratio, owner))
        owner, cw, cv, ratio = owner[order], cw[order], cv[order], ratio[order]
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        new = (np.diff(owner, prepend=-1) > 0) | (np.diff(ratio, prepend=np.nan) != 0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))  # elements of at least this ratio count by w, others by v
        before_w, before_v = np.cumsum(cw) - cw, np.cumsum(cv) - cv
        more = self.total[i] - (before_w[at] - before_w[start][owner])
        less = before_v[at] - before_v[start][owner] + (self.total[others] - np.add.reduceat(cv, start))[owner]
        return np.add.reduceat(1.0 / (more / cw + less / cv), start)

    def similar(self, i: int, open_: np.ndarray, similarity: float) -> np.ndarray:
        """Which open texts are linked to ``i``: the common elements of all
        that are left are counted in one pass, or of those few that have enough
        in other texts.  Where shingles are repeated, the sum s of the lesser
        shares of both texts bounds the similarity, at most s and at least
        s / (2 - s); few pairs need more."""
        still = open_[self.left]
        others = self.left[still]
        plain = self.plain[others] & self.plain[i]
        most = np.minimum(self.met[others], self.met[i])  # that two plain texts can have in common
        may = ~plain | (most >= similarity * (self.size[others] + self.size[i] - most) - 1e-9)
        if not may.any():
            return others[:0]
        still[still], others, plain = may, others[may], plain[may]
        first, flat, share = self.left_first, self.left_flat, self.left_share
        if 8 * self.size[others].sum() < len(flat):
            at, first = self.places(others)
            flat, share, still = self.flat[at], self.count[at] / np.repeat(self.total[others], self.size[others]), slice(None)
        own = slice(self.first[i], self.first[i] + self.size[i])
        self.mark[self.flat[own]] = self.count[own]
        seen = self.mark[flat]
        common = np.add.reduceat(seen, first)[still]
        yes = plain & (common >= similarity * (self.size[others] + self.size[i] - common) - 1e-9)
        if not plain.all():
            s = np.add.reduceat(np.minimum(seen / self.total[i], share), first)[still]
            yes |= ~plain & (s > 0) & (s / (2 - s) > similarity + 1e-9)
            near = np.flatnonzero(~plain & ~yes & (s > 0) & (s > similarity - 1e-9))
            if len(near):
                value = self.weighted(i, others[near])
                yes[near] = value >= similarity
                for k in near[np.abs(value - similarity) < 1e-9]:
                    j = others[k]
                    yes[k] = probability_jaccard((self.s[i], self.w[i]), (self.s[j], self.w[j])) >= similarity
        self.mark[self.flat[own]] = 0
        return others[yes]

    def classes(self, similarity: float) -> np.ndarray:
        """For each text the number of the first text of its class: what is
        reached is taken out and looks for others in turn.  When half of the
        texts are out, the others close up.  No similarity is more than the part
        of a text that lies in others: a text with less of it is alone."""
        label, open_ = np.arange(len(self.s)), self.met > (similarity - 1e-9) * self.total
        self.narrow(open_)
        for i in range(len(self.s)):
            if not open_[i]:
                continue
            open_[i], reached = False, [i]
            while reached and open_.any():
                got = self.similar(reached.pop(), open_, similarity)
                open_[got], label[got] = False, i
                reached += got.tolist()
                if 2 * np.count_nonzero(open_) <= len(self.left):
                    self.narrow(open_)
        return label


def small_clusters(rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: within each ``root`` of ``rows`` (``root, node, text``; the
    texts of a root fit a task) the least node ``a`` of the class of ``b``, if
    that is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(nodes: list[bytes], texts: list[str]) -> pa.RecordBatch:
            order = sorted(range(len(nodes)), key=nodes.__getitem__)
            label = Cluster([texts[i] for i in order]).classes(similarity)
            names = [nodes[i] for i in order]
            return pa.RecordBatch.from_arrays([pa.array([names[j] for j in label], pa.binary()), pa.array(names, pa.binary())], names=["a", "b"])

        last, nodes, texts = None, [], []
        for batch in pieces(batches):
            for root, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if root != last and nodes:
                    yield solve(nodes, texts)
                    nodes, texts = [], []
                last = root
                nodes.append(node)
                texts.append(text)
        if nodes:
            yield solve(nodes, texts)

    dealt = rows.select("root", "node", "text").repartition("root").sortWithinPartitions("root")
    return dealt.mapInArrow(run, "a binary, b binary").where("a <> b")


def large_clusters(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the same for the buckets of clusters that are too large for a
    task.  A bucket that is too large itself is cut to parts of half the bound,
    and any two parts are a root."""
    bytes_ = texts.select("node", (F.octet_length("text") + NODE_BYTES).alias("bytes"))
    buckets = members.join(bytes_, "node").groupBy("band", "key").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("bytes") > CLUSTER_BYTES, F.least(F.ceil(2 * F.col("bytes") / CLUSTER_BYTES), "n")).otherwise(1).cast("long")
    rows = members.join(buckets.select("band", "key", parts.alias("parts")), ["band", "key"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("other <> part or parts = 1")
    rows = rows.select(F.concat_ws(" ", "band", "key", F.least("part", "other"), F.greatest("part", "other")).alias("root"), "node")
    return small_clusters(rows.join(texts, "node"), similarity)


def cluster_roots(members: DataFrame) -> DataFrame:
    """``node, root``: the clusters of nodes that share buckets (``band, key,
    node`` and ``a``, the least node of the bucket).  Components are sought
    among these least nodes alone, of which even a very large group has few;
    a node meets at most one for each band."""
    own = stored(members.groupBy("node").agg(F.min("a").alias("m"), F.collect_set("a").alias("as")), "leaders")
    # A least node that meets a smaller one has both among its own.
    root = components(own.select(F.explode("as").alias("a"), F.col("m").alias("b")))
    return stored(own.select("node", "m").join(root.toDF("m", "root"), "m", "left").select("node", F.coalesce("root", "m").alias("root")), "roots")


def linked(docs: DataFrame, nodes: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``node, root``: of every node that is linked to a smaller one, directly
    or through others, the smallest."""
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where("n > 1").drop("n")
    members = members.join(shared, ["band", "key"])
    root = cluster_roots(members)
    wanted = nodes.join(root, "node").select("node", "root", F.col("row.id").alias("_id"), F.col("row.text_key").alias("_key"))
    texts = (docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
             .join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("node", "root", "text").dropDuplicates(["node"]))
    texts = stored(texts, "texts")
    sizes = texts.groupBy("root").agg(F.sum(F.octet_length("text") + NODE_BYTES).alias("bytes"))
    large = stored(sizes.where(F.col("bytes") > CLUSTER_BYTES).select("root"), "large")
    classes = small_clusters(texts.join(large, "root", "left_anti"), similarity).toDF("root", "node").select("node", "root")
    if not large.isEmpty():
        big = texts.join(large, "root", "left_semi")
        members = stored(members.drop("a").join(big.select("node"), "node", "left_semi"), "members")
        classes = classes.unionByName(components(large_clusters(members, big.select("node", "text"), similarity)))
    return stored(classes, "classes")


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, text_key, node`` of each row, ``node, root`` of each node, and
    ``root, first, class_size`` of each class: ``first`` is the row that stays,
    the one of the least id and text key."""
    rows = stored(signatures(docs, id_col, text_col), "signatures")
    # Texts without words are classes of their own, told apart by row id and key.
    rows = rows.withColumn("node", F.coalesce("node", F.encode(F.concat(F.lit("empty "), F.coalesce(F.col("id").cast("string"), F.lit("null"))), "utf-8")))
    nodes = stored(rows.groupBy("node").agg(F.first("bands").alias("bands"), F.min(F.struct("id", "text_key")).alias("row"), F.count(F.lit(1)).alias("n")), "nodes")
    root = linked(docs, nodes, similarity, id_col, text_col)
    nodes = nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "row", "n")
    whole = nodes.groupBy("root").agg(F.min("row").alias("first"), F.sum("n").alias("class_size"))
    return rows.drop("bands"), nodes.select("node", "root"), whole


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, kept`` of every row of ``docs``."""
    rows, nodes, whole = classes(docs, similarity, id_col, text_col)
    c = rows.join(nodes.join(whole, "root"), "node")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
    return c.select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "class_size", kept.alias("kept"))


def drop_near(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their columns."""
    stay = classes(docs, similarity, id_col, text_col)[2].select(F.col("first.id").alias("_near_id"), F.col("first.text_key").alias("_near_key"))
    names = docs.columns
    rows = docs.withColumns({"_own_id": F.col(id_col).cast("long"), "_own_key": F.md5(F.coalesce(text_col, F.lit("")))})
    rows = rows.join(stored(stay, "stay"), F.col("_own_id").eqNullSafe(F.col("_near_id")) & (F.col("_own_key") == F.col("_near_key")), "left_semi")
    return rows.dropDuplicates(["_own_id", "_own_key"]).select(*names)
