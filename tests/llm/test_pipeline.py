"""The corpus pipeline: run() against a plain version of all its stages, and
every stage with nulls, empty and long texts, ties, repeated rows, columns whose
names clash, and empty tables.  The learners against plain arithmetic."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import language_id, linear, near_dedup
from parley.llm.queries import QUERIES
from test_llm import LONG, SMOKE, jaccard, prose, shares

ENGLISH = "the house of the people and that which they would have with them in the morning was not there when she".split()
GERMAN = "das haus und die leute sie wollten nicht mit ihnen sein weil der morgen schon vorbei war als ich kam".split()


def sentence(words, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "s", "ed", str(seed % 7)]) for _ in range(n))


def documents():
    item = prose(11, 40)
    rows = [(i, sentence(ENGLISH if i % 3 else GERMAN, i, 60 + i % 40), "en" if i % 3 else "de", f"s{i % 4}") for i in range(120)]
    near = rows[5][1].split()
    near[30] = "changed"
    rows += [(200, rows[5][1].upper(), "en", "s1"), (201, rows[5][1], None, None), (202, " ".join(near), "en", "s2"), (203, rows[9][1], "de", "s0"), (203, rows[9][1], "de", "s0"),
             (204, rows[4][1] + " " + item + " " + rows[7][1], "en", "s3"), (205, item.upper() + "!", "en", "s3"), (206, None, "en", "s0"), (207, "", "en", "s0"), (208, "123 !?", "en", "s1"),
             (209, "a | b", "en", "s1"), (None, rows[20][1] + " odd", "en", "s2"), (210, LONG[:20000], "en", None), (211, LONG[:20000] + " tail", "en", None)]
    return rows, [(1, item), (2, None), (3, "Two of it")]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_run(rows, items):
    """The stages one after another, all pairs and all windows."""
    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    low = lambda t: t.encode().lower()
    key = lambda i: -1 if i is None else i
    best = {}
    for r in rows:
        if low(r[1]) not in best or key(r[0]) > key(best[low(r[1])][0]):
            best[low(r[1])] = r
    rows = list(best.values())
    sets = [dict(zip(*(x.tolist() for x in near_dedup.elements(r[1])[1:]))) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) > 0.7 * max(len(sets[i]), len(sets[j])) and label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    rows = [min((r for r, x in zip(rows, label) if x == c), key=lambda r: key(r[0])) for c in sorted(set(label))]

    def dirty(text):
        w = words(text)
        for _, it in items:
            it = words(it)
            if 0 < len(it) < 5:
                if any(w[s:s + len(it)] == it for s in range(len(w))):
                    return True
            elif it and any(w[s] in it and shares(w[s:s + len(it)], it) >= 0.8 for s in range(max(len(w) - len(it), 0) + 1)):
                return True
        return False
    rows = [r for r in rows if not dirty(r[1])]

    topic = lambda t: "table" if " | " in t else "shouted" if "!! " in t else "symbols" if any(x in t for x in ("*** ", "$$$ ", "### ")) else "prose"
    cells, of = {}, []
    for r in rows:
        of.append((r[3], r[2], topic(r[1])))
        cells[of[-1]] = cells.get(of[-1], 0) + len(re.findall(r"[^ \t\n\x0b\f\r]+", r[1]))
    target = []
    for d in range(3):
        t = {}
        for c, n in cells.items():
            t[c[d]] = t.get(c[d], 0) + n
        target.append({v: n ** 0.8 / sum(x ** 0.8 for x in t.values()) for v, n in t.items()})
    whole = sum(cells.values())
    weight = {c: n / whole for c, n in cells.items()}
    for _ in range(40):
        for d in range(3):
            sums = {}
            for c, w in weight.items():
                sums[c[d]] = sums.get(c[d], 0) + w
            weight = {c: w * target[d][c[d]] / sums[c[d]] for c, w in weight.items()}
    total, out = sum(weight.values()), []
    for r, c in zip(rows, of):
        p = whole * weight[c] / total / cells[c]
        name = str(r[0]) if r[0] is not None else "text " + hashlib.md5(r[1].encode()).hexdigest()
        drawn = int(hashlib.md5(f"mix {name}".encode()).hexdigest()[:8], 16) / 2 ** 32
        copies = int(p) + (drawn < p - int(p))
        if copies:
            out.append((r[0], c[2], round(p, 4), copies))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = documents()
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_run_equals_the_plain_stages(spark, folder):
    rows, items = documents()
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "topic", "tokens", "p", "copies"]
    want = plain_run(rows, items)
    assert sorted(((r.doc_id, r.topic, round(r.p, 4), r.copies) for r in got.collect()), key=str) == want and 60 < len(want) < 120


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, folder, stage):
    name, f = corpus_pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = {c: F.lit("x") for c in ("lang_pred", "score", "text_key", "node", "key", "p", "topic", "tokens", "copies", "kept", "words", "h", "best", "root", "id", "label")}
    nulls = docs.limit(2).select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    wide = docs.unionByName(docs.where("doc_id in (7, 206, 210)")).unionByName(nulls).withColumns(clash)
    out = f(spark, wide, folder)
    plain = f(spark, docs.unionByName(docs.where("doc_id in (7, 206, 210)")).unionByName(nulls), folder)
    ids = lambda t: sorted((r.doc_id for r in t.select("doc_id").collect()), key=str)
    if stage < 4:
        assert out.columns == wide.columns and plain.columns == docs.columns
        assert ids(out) == ids(plain)
        assert {r.label for r in out.select("label").distinct().collect()} <= {"x"}
    else:  # the topic is a column of the documents here
        assert out.columns == plain.columns and out.count() > 0
    assert f(spark, docs.limit(0), folder).count() == 0
    if stage < 4:
        assert f(spark, wide.limit(0), folder).columns == wide.columns


def test_languages_recomputed(spark):
    """Votes and margins of every prediction from the weights, trigram by trigram."""
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op3_language_id"](spark, SMOKE).collect()}

    def classes(text):
        out = []
        for b in (" " + text.lower() + " ").encode():
            c = 1 + b - 97 if 97 <= b <= 122 else 27 + (b & 31) if b >= 128 else 0
            if c or not out or out[-1]:
                out.append(c)
        return out

    for r in docs.collect():
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        c = classes(r.text)
        grams = [(a << 12) | (b << 6) | x for a, b, x in zip(c, c[1:], c[2:])]
        total = np.zeros(model.weights.shape[1])
        for g in grams:
            total += model.weights[g]
        margins = total * language_id.SCALE / max(len(grams), 1) + model.bias

        def duel(d):
            votes, sums = [0] * len(d.names), [0.0] * len(d.names)
            own = {}
            for (a, b), m in zip(d.pairs, margins[d.first:d.first + len(d.pairs)]):
                votes[a if m > 0 else b] += 1
                sums[a] += m
                sums[b] -= m
                own.setdefault(a, []).append(m)
                own.setdefault(b, []).append(-m)
            won = max(range(len(votes)), key=lambda k: (votes[k], sums[k], -k))
            return won, 1 / (1 + np.exp(-language_id.SLOPE * min(own[won]))) if own else 1.0
        family, sure = duel(model.families)
        lang, sure_too = duel(model.languages[family])
        assert got[r.doc_id][0] == model.languages[family].names[lang] and got[r.doc_id][1] == pytest.approx(sure * sure_too, abs=1e-6)


def test_support_vectors_meet_their_conditions():
    """A separable case: the dual solution satisfies the optimality conditions."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(1, 1, (40, 6)), r.normal(-1, 1, (40, 6))])
    y = np.repeat([1.0, -1.0], 40)
    w, b = linear.linear_svm([(np.arange(6), v) for v in x], y, 6, c=1.0, sweeps=4000)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    for _ in range(300):
        step = r.normal(0, 1, 7) * 10 ** r.uniform(-4, -1)
        assert loss(w + step[:6], b + step[6]) >= best - 1e-6


def test_ordinal_regression_is_at_its_least_loss():
    r = np.random.default_rng(2)
    x = (r.random((300, 5)) < 0.3).astype(float)
    true = x @ np.array([2.0, 1.0, 0.0, 0.0, 3.0]) + r.logistic(0, 1, 300)
    grade = (true[:, None] > np.array([1.0, 2.5, 4.0])[None, :]).sum(axis=1)
    w, cut = linear.cumulative_link(x, grade, 4, steps=6000, rate=0.02)
    above = np.stack([grade >= k for k in range(1, 4)], axis=1)

    def loss(w, cut):
        p = linear.sigmoid((x @ w)[:, None] - cut[None, :])
        return -(np.log(np.where(above, p, 1 - p))).sum() / len(x) + 0.5 * 1e-4 * (w @ w)
    best = loss(w, cut)
    assert (w >= 0).all() and (np.diff(cut) >= 0).all()
    for _ in range(300):
        step = r.normal(0, 1, 8) * 10 ** r.uniform(-3, -1)
        assert loss(np.maximum(w + step[:5], 0), np.sort(cut + step[5:])) >= best - 2e-4


def test_near_copies_of_a_large_group_take_no_rounds(spark, monkeypatch):
    """At 6 GB the copies of a hot text are beyond a task, and half of them are far from each other."""
    base, names, real = sentence(ENGLISH, 7, 120).split(), [], near_dedup.stored
    rows = []
    for k in range(24):
        w = list(base)
        for j in random.Random(k).sample(range(120), 14 if k < 14 else k % 3):
            w[j] = f"own{k}x{j}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near_dedup, "CLUSTER_BYTES", 12_000)
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: names.append(name) or real(df, name))
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == [*range(15)]  # of 14 to 23 the least
    assert names.count("members") == 1 and not {"front", "open", "todo", "reached"} & {*names}
