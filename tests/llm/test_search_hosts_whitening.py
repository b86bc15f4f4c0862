"""Whitening, host rules and reversed search against brute force on small
tables: nulls, empty and long texts, ties, repeated rows, empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import host_rules, reversed_search, spectral, whitening
from parley.llm.queries import QUERIES
from test_llm import LONG, SMOKE, frame, prose


# ------------------------------------------------------------------ whitening
@pytest.mark.parametrize("values", [[5.0], [2.0, 1.0], [3.0, 3.0, 3.0], [1.0, 1.0, 2.0, 2.0, 7.0], [0.0, 0.0, 4.0], [1.0, 1 + 1e-9, 1e-18, 8.0], [0.0, 0.0], list(range(40))])
def test_leading_components(values):
    n = len(values)
    basis = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))[0]
    a = basis * np.array(values) @ basis.T
    found, vectors = spectral.leading_components(a, 32)
    top = max(map(abs, values)) or 1.0
    assert found == pytest.approx(sorted(values, reverse=True)[:32], abs=1e-13 * top)
    assert vectors.T @ vectors == pytest.approx(np.eye(len(found)), abs=1e-13) and a @ vectors == pytest.approx(vectors * found, abs=1e-12 * top)


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    w, v = np.linalg.eigh(a)
    assert spectral.polar_factor(a) == pytest.approx(v * np.sign(w) @ v.T, abs=1e-11)
    assert spectral.polar_factor(np.diag([1.0, 0.0])) is None and spectral.polar_factor(np.zeros((2, 2))) is None


def whitened_by_hand(vectors):
    """Fixed-point rows, deviations, whitened rows and shares, by eigh."""
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    d = x - sums // n - (sums % n) / n
    v = d.T @ d / n
    w, u = np.linalg.eigh(v)
    w, u = w[::-1], u[:, ::-1]
    return ((n * x - sums) ** 2).sum(axis=1), d @ (u / np.sqrt(w)), w / np.trace(v)


def test_whitening(spark):
    r = np.random.default_rng(2)
    good = [(None if i == 7 else i, (r.standard_normal(6) * [8, 5, 3, 2, 1, 0.5] + 3).astype(np.float32).tolist()) for i in range(60)]
    good.append(good[3])  # a repeated row
    bad = [(100, None), (101, []), (102, [1.0] * 5 + [None]), (103, [1.0] * 5 + [float("nan")]), (104, [float("inf")] * 6), (105, [1.0] * 3), (106, [1e30] * 6)]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).repartition(5)
    got = whitening.whitened_embeddings(table, components=4).collect()
    deviation, white, explained = whitened_by_hand([v for _, v in good])
    key = lambda i: -1 if i is None else i
    assert sorted((key(a.vec_id), a.deviation) for a in got) == sorted((key(i), d) for (i, _), d in zip(good, deviation))
    mine = np.array([a.whitened for a in sorted(got, key=lambda a: (key(a.vec_id), a.whitened))])
    want = white[:, :4] * np.sign((white[:, :4] * np.array([next(a.whitened for a in got if a.vec_id == i and a.deviation == d) for (i, _), d in zip(good, deviation)])).sum(axis=0))
    want = np.array([w for _, w in sorted(((key(i), w.tolist()) for (i, _), w in zip(good, want)))])
    assert mine == pytest.approx(want, abs=1e-9)
    assert got[0].explained == pytest.approx(explained[:4], rel=1e-9) and got[0].identity_error < 1e-9 and got[0].n == 61
    assert len({tuple(a.explained) for a in got}) == 1


def test_whitening_without_variance(spark):
    rows = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    flat = whitening.whitened_embeddings(rows([1.0, 2.0], [1.0, 2.0])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in flat] == [(2, 0, [])] * 2
    line = whitening.whitened_embeddings(rows([0.0, 0.0], [1.0, 1.0], [2.0, 2.0])).collect()
    assert [len(r.whitened) for r in line] == [1] * 3 and line[0].explained == pytest.approx([1.0])
    assert whitening.whitened_embeddings(rows([1.0]).limit(0)).count() == 0 and whitening.whitened_embeddings(rows(None, [])).count() == 0
    far = whitening.whitened_embeddings(rows([-1e12, 0.0], [1e12, 1.0], [1e12, 3.0])).collect()  # n^2 d^2 does not fit a long
    assert {r.deviation for r in far} == {None}


def test_whitening_query(spark):
    out = QUERIES["op11_whitening"](spark, SMOKE)
    rows = out.collect()
    vectors = spark.read.parquet(f"{SMOKE}/embeddings.parquet").collect()
    deviation, white, explained = whitened_by_hand([r.embedding for r in vectors])
    assert len(rows) == 32 * len(vectors) and {r.component for r in rows} == set(range(1, 33)) and {r.n for r in rows} == {len(vectors)}
    assert {r.vec_id: r.deviation for r in rows} == {r.vec_id: d for r, d in zip(vectors, deviation)}
    at = {r.vec_id: k for k, r in enumerate(vectors)}
    mine = np.zeros((len(vectors), 32))
    for r in rows:
        mine[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(mine) == pytest.approx(np.abs(white[:, :32]), abs=1e-8)
    assert {r.component: r.explained for r in rows} == pytest.approx({k + 1: e for k, e in enumerate(explained[:32])}, rel=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


# ----------------------------------------------------------------- host rules
def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(again))


TEXTS = [None, "", " \t\x0b\x0c\r\n ", "one", "one two", "a b c", "a b c a b c", "a a a a", "x y z q x y z r x y z", "é ü #tag <b> $5 & | %",
         "line\nline\n\n line\nline\r\nother", "ab c a bc ab c a bc", LONG, "na " * 500, prose(30, 120), "\n".join([prose(31, 5)] * 40)]


def test_measures(spark):
    rows = list(enumerate(TEXTS))
    got = host_rules.measured(frame(spark, rows).select("doc_id", F.col("text").alias("t")), "t").collect()
    mine = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in got}
    assert mine == {i: measures(t) for i, t in rows}


def shrunk(hosts):
    """Rates of (documents, failures) by host, shrunk by hand."""
    n, k = sum(a for a, _ in hosts), sum(b for _, b in hosts)
    m = k / n
    s = sum(a * (b / a - m) ** 2 for a, b in hosts)
    room = n - sum(a * a for a, _ in hosts) / n - (len(hosts) - 1)
    alike = (s - m * (1 - m) * (len(hosts) - 1)) / (m * (1 - m) * room) if 0 < m < 1 and room > 0 else 0
    strength = max(min((1 - alike) / alike, 1e6) if alike > 0 else 1e6, 1e-6)
    return [(b + m * strength) / (a + strength) for a, b in hosts]


def test_host_verdicts(spark):
    good, poor = prose(32, 80), "short"
    rows, counts = [], {"fine": (300, 3), "bad": (200, 190), "tiny": (2, 2), "half": (40, 12), None: (30, 0), "": (5, 1)}
    for host, (n, failed) in counts.items():
        rows += [(len(rows) + i, poor if i < failed else f"{good} {i}", host) for i in range(n)]
    rows.append((None, good, "fine"))
    counts["fine"] = (301, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"kept": F.lit(1), "host": F.lit("clash"), "n_words": F.lit("x")})
    got = host_rules.quality(docs, F.col("source")).collect()
    assert len(got) == len(rows)
    want = dict(zip(counts, shrunk(list(counts.values()))))
    assert {r.host: r.host_few_words for r in got} == pytest.approx(want)
    assert {r.host for r in got if r.host_bad} == {h for h, x in want.items() if x > 0.5} == {"bad", "tiny"}
    assert all(r.kept == (not r.base_failed and r.host not in ("bad", "tiny")) for r in got) and {r.host_docs for r in got if r.host is None} == {30}
    assert next(r for r in got if r.doc_id is None).kept
    # Among hosts that seldom differ, a few failures do not make a bad host.
    calm = [(i, poor if i in (0, 1) else good, f"h{i // 2}") for i in range(400)]
    out = host_rules.quality(spark.createDataFrame(calm, "doc_id long, text string, source string"), F.col("source")).where("host = 'h0'").first()
    assert out.host_few_words == pytest.approx(shrunk([(2, 2)] + [(2, 0)] * 199)[0])
    assert host_rules.quality(docs.limit(0), F.col("source")).count() == 0


def test_prior_of_one_host_and_of_none_that_fails():
    assert host_rules.beta_prior(10, 100, 1, 4, 0.0) == pytest.approx((0.4e6, 0.6e6))
    assert host_rules.beta_prior(10, 50, 2, 0, 0.0) == (0.0, 1e6)
    a, b = host_rules.beta_prior(20, 200, 2, 10, 5.0)  # all of one host, none of the other
    assert a == b and a + b < 1e-3


def test_host_of(spark):
    urls = ["https://www.Example.com/a?b", "http://x.org:80/", "no url", None, "http://[bad"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(host_rules.host_of(F.col("u"))).collect()
    assert [r[0] for r in got] == ["example.com", "x.org", None, None, None]


# ------------------------------------------------------------ reversed search
def ranked_by_hand(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: term.findall((t or "").translate(low))
    tf = [(i, Counter(split(t))) for i, t in docs]
    big_n, big_l = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in tf:
            if c:
                m = 100 - 90 + (90 * sum(c.values()) * big_n) // big_l
                s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t])
                if s > 0:
                    rows.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_reversed_search(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["Ärger", "the", "THE", "fox-trot", "naïve", "a1", "b_c", "x", "y", "z", "中文", "k"]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    docs += [(500, docs[4][1]), (501, docs[4][1]), (4, docs[4][1]), (None, docs[4][1]), (502, None), (503, ""), (504, "!? .,"), (505, LONG + " fox")]
    items = [(1, "The fox trot"), (2, "ärger ÄRGER the"), (3, None), (4, "..."), (5, "unknown words"), (6, docs[4][1]), (6, docs[4][1]), (None, "x the"), (7, "中文 naïve k a1")]
    want = ranked_by_hand(docs, items)
    table = frame(spark, docs).repartition(6)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int").repartition(3)
    got = lambda **how: sorted((tuple(x) for x in reversed_search.search(table, bench, **how).collect()), key=str)
    assert got() == want and got(max_postings=5) == want
    monkeypatch.setattr(reversed_search, "CELLS", 8)
    assert got(k=3) == ranked_by_hand(docs, items, 3)
    assert reversed_search.search(table.limit(0), bench).count() == 0 and reversed_search.search(table, bench.limit(0)).count() == 0


def test_sums_of_large_scores_are_exact():
    index = reversed_search.Index([(0, b"a"), (0, b"b"), (1, b"b")])
    index.weight = np.array([3 ** 20, 5 ** 13], np.int64)
    part = lambda w, tf, m: w * ((10 ** 9 * tf) // (1000 * tf + 8 * m))
    got = index.scores([(11, [0, 1], [7, 2]), (10, [1], [1])])
    assert got.tolist() == [[part(3 ** 20, 7, 11) + part(5 ** 13, 2, 11), part(5 ** 13, 2, 11)], [part(5 ** 13, 1, 10)] * 2]
