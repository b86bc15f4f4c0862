"""Property tests (hypothesis): each example is a whole table processed by
one Spark job."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.operators import audio as A
from parley.operators import dialogue as D
from parley.operators import episode as E
from parley.operators import text as X

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
WS = [" ", "\t", "\n", " ", "　", " ", "\x1c", "  "]
word = st.text(alphabet=st.characters(blacklist_categories=("Cs", "Zs", "Zl", "Zp", "Cc")), min_size=1, max_size=6)
doc = st.lists(st.tuples(word, st.sampled_from(WS)), max_size=60).map(lambda ps: "".join(w + s for w, s in ps))


@SETTINGS
@given(docs=st.lists(doc, min_size=1, max_size=12), n=st.integers(1, 7))
def test_chunks_rebuild_words(spark, docs, n):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = X.word_chunks(df, n=n).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.chunk_idx, r.text, r.n_words))
    for i, t in enumerate(docs):
        chunks = sorted(by.get(i, []))
        assert " ".join(c[1] for c in chunks) == " ".join(t.split())
        assert sum(c[2] for c in chunks) == len(t.split())
        assert all(c[2] == n for c in chunks[:-1])


text = st.text(alphabet=st.sampled_from(list('ab "\\\n\'xy,()[]')), max_size=30)


@SETTINGS
@given(turns=st.lists(st.tuples(st.sampled_from(["Speaker 1", "Speaker 2"]), text), min_size=1, max_size=10))
def test_render_parse_round_trip(spark, turns):
    rows = [(7, i, sp, t) for i, (sp, t) in enumerate(turns)]
    seg = spark.createDataFrame(rows, "episode_id long, seg_idx long, speaker string, text string")
    back = sorted(tuple(r) for r in D.parse_replies(D.render_reply_lines(seg)).collect())
    assert back == rows


synth_rows = st.lists(st.tuples(st.sampled_from(["Speaker 1", "Speaker 2", "Speaker 3"]),
                                st.integers(100, 4000), st.booleans(), st.sampled_from(["error", "no_reply"])),
                      min_size=1, max_size=25)


@SETTINGS
@given(episodes=st.lists(synth_rows, min_size=1, max_size=4))
def test_timeline_and_counter_properties(spark, episodes):
    rows = [(e, i, sp, d, ok, None if ok else fk) for e, segs in enumerate(episodes)
            for i, (sp, d, ok, fk) in enumerate(segs)]
    df = spark.createDataFrame(rows, "episode_id long, seg_idx long, speaker string, dur_ms long, "
                                     "ok boolean, fail_kind string")
    dyn = sorted((r.episode_id, r.seg_idx, r.start_ms, r.end_ms) for r in E.timeline_dynamic(df).collect())
    last = {}
    for e, i, start, end in dyn:
        assert end >= last.get(e, 2000)          # durations >= 1000 ms > any crossfade
        assert start <= end
        last[e] = end
    for r in E.run_counts(df).collect():
        assert r.n_ok + r.n_failed == r.n_total
        assert r.n_ok_openai + r.n_failed_openai + r.n_uncounted_openai == r.n_total


@SETTINGS
@given(arrays=st.lists(st.lists(st.floats(-3, 3, allow_nan=False), max_size=40), min_size=1, max_size=10))
def test_normalised_peak(spark, arrays):
    df = spark.createDataFrame([(a,) for a in arrays], "s array<double>")
    for src, r in zip(arrays, df.select(A.normalise(F.col("s")).alias("n")).collect()):
        p = max((abs(v) for v in src), default=0.0)
        if p == 0:
            assert r.n == src
        else:
            assert math.isclose(max(abs(v) for v in r.n), 10 ** (-0.1 / 20), rel_tol=1e-12)
