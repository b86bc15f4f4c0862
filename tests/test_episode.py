"""Timelines and counters against plain-Python loops that follow the
original append loops step by step."""

import pytest
from pyspark.sql import functions as F

from parley.operators import episode as E
from parley.operators.scan import Linked, previous_non_null, running_sum

SEGS = [  # episode, idx, speaker, dur_ms, ok, fail_kind
    (1, 0, "Speaker 1", 1200, True, None), (1, 1, "Speaker 2", 250, True, None),
    (1, 2, "Speaker 2", 2000, True, None), (1, 3, "Speaker 1", 900, True, None),
    (1, 4, "Speaker 1", 3000, False, "error"), (1, 5, "Speaker 1", 1500, True, None),
    (2, 0, "Speaker 2", 800, False, "no_reply"), (2, 1, "Speaker 3", 1100, True, None),
    (3, 0, "Speaker 1", 400, False, "error"),
    (4, 0, "Speaker 1", 5000, True, None),
]
PAUSE = {(e, i): 200 + (e * 17 + i * 13) % 600 for e, i, *_ in SEGS}


@pytest.fixture()
def synth(spark):
    return spark.createDataFrame(SEGS, "episode_id long, seg_idx long, speaker string, dur_ms long, "
                                       "ok boolean, fail_kind string")


def by_episode():
    eps = {}
    for row in SEGS:
        eps.setdefault(row[0], []).append(row)
    return eps


def loop_plain():
    out = {}
    for e, segs in by_episode().items():
        total = 0
        for e_, i, sp, dur, ok, _ in segs:
            if i > 0:
                total += 500
            if ok:
                total += dur
            out[(e, i)] = total
    return out


def loop_jitter():
    out = {}
    for e, segs in by_episode().items():
        total = 0
        for e_, i, sp, dur, ok, _ in segs:
            if i > 0:
                total += 500
            if ok:
                if i > 0:
                    if dur >= 300:            # append with a 300 ms crossfade
                        total += dur - 300 + PAUSE[(e, i)]
                else:
                    total += dur
            out[(e, i)] = total
    return out


def loop_dynamic():
    out = {}
    for e, segs in by_episode().items():
        total, prev = 2000, None
        for e_, i, sp, dur, ok, _ in segs:
            if ok and dur >= 1000:
                xf = 500 if prev is None else (450 if prev == sp else 300)
                total += dur - xf
                prev = sp
            out[(e, i)] = total
    return out


def test_plain(synth):
    got = {(r.episode_id, r.seg_idx): r.end_ms for r in E.timeline_plain(synth).collect()}
    assert got == loop_plain()


def test_jitter(spark, synth):
    p = spark.createDataFrame([(e, i, v) for (e, i), v in PAUSE.items()], "episode_id long, seg_idx long, pause_ms long")
    got = {(r.episode_id, r.seg_idx): r.end_ms for r in E.timeline_jitter(synth, p).collect()}
    assert got == loop_jitter()


def test_scan_keeps_rows_without_a_place(spark):
    rows = [(None, 0, 5), (None, 5000, 6), (1, None, 7), (1, 0, 1), (1, 1, 2)]
    s = spark.createDataFrame(rows, "episode_id long, seg_idx long, v long")
    got = {(r.episode_id, r.seg_idx, r.v): r.total for r in running_sum(s, "episode_id", "seg_idx", "v", "total").collect()}
    assert got == {(None, 0, 5): None, (None, 5000, 6): None, (1, None, 7): None, (1, 0, 1): 1, (1, 1, 2): 3}
    prev = previous_non_null(s, "episode_id", "seg_idx", "v", "p").collect()
    assert {(r.episode_id, r.seg_idx): r.p for r in prev if r.p is not None} == {(1, 1): 1}


def test_audio_positions(spark):
    """Two segments of 5,000 and 4,000 ms: the second is appended with a 300 ms
    crossfade after a gap of 500 ms, so it lies at 5,200 to 9,200."""
    s = spark.createDataFrame([(1, 0, "Speaker 1", 5000, True), (1, 1, "Speaker 2", 4000, True),
                               (1, 2, "Speaker 1", 100, True)],
                              "episode_id long, seg_idx long, speaker string, dur_ms long, ok boolean")
    t = E.timeline_jitter(s, F.lit(200)).orderBy("seg_idx").collect()
    assert [(r.audio_start_ms, r.xfade_ms) for r in t] == [(0, 0), (5200, 300), (None, 0)]
    parts = {(r.seg_idx, r.kind): r.start_ms for r in E.timeline_parts(s, F.lit(200)).collect()}
    assert parts == {(0, "audio"): 0, (1, "gap"): 5000, (1, "audio"): 5200, (1, "pause"): 9200, (2, "gap"): 9400}
    plain = E.timeline_plain(s).orderBy("seg_idx").collect()
    assert [r.audio_start_ms for r in plain] == [0, 5500, 10000]


def test_dynamic(synth):
    got = {(r.episode_id, r.seg_idx): r.end_ms for r in E.timeline_dynamic(synth).collect()}
    assert got == loop_dynamic()


def test_counts_property(synth):
    for r in E.run_counts(synth).collect():
        assert r.n_ok + r.n_failed == r.n_total
        assert r.n_ok_openai + r.n_failed_openai + r.n_uncounted_openai == r.n_total
    r2 = {r.episode_id: r for r in E.run_counts(synth).collect()}[2]
    assert (r2.n_ok_openai, r2.n_failed_openai, r2.n_uncounted_openai) == (1, 0, 1)


def test_pairs_agree_with_lag(synth):
    pairs = {(r.episode_id, r.seg_idx): r.prev_speaker for r in E.adjacent_pairs(synth).collect()}
    lag = previous_non_null(synth, "episode_id", "seg_idx", F.when(F.col("ok"), F.col("speaker")), "p",
                            block_rows=2)
    lag = {(r.episode_id, r.seg_idx): r.p for r in lag.where("ok").collect()}
    assert pairs == lag


def test_blocked_scans_equal_plain(spark):
    rows = [(k, i, (k * 13 + i * 7) % 10, None if (i * k) % 3 == 0 else f"s{i}") for k in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, v long, s string")
    for b in (1, 4, 7, 1000):
        rs = {(r.k, r.i): r.c for r in running_sum(df, "k", "i", "v", "c", block_rows=b).collect()}
        pn = {(r.k, r.i): r.p for r in previous_non_null(df, "k", "i", "s", "p", block_rows=b).collect()}
        acc, last = {}, {}
        for k, i, v, s in rows:
            acc[k] = acc.get(k, 0) + v
            assert rs[(k, i)] == acc[k]
            assert pn[(k, i)] == last.get(k)
            if s is not None:
                last[k] = s


def test_overlap_join_equals_all_pairs(spark):
    iv = [(1, i, s, s + d) for i, (s, d) in enumerate([(0, 100), (50, 30), (60, 200), (300, 10), (305, 1), (900, 5)])]
    df = spark.createDataFrame(iv, "episode_id long, seg_idx long, start_ms long, end_ms long")
    got = sorted(tuple(r) for r in E.overlap_join(df, bucket_ms=64).collect())
    exp = sorted((1, a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in iv for b in iv
                 if a[1] < b[1] and a[2] < b[3] and b[2] < a[3])
    assert got == exp


def test_overlap_sweep_of_many_intervals(spark):
    """Many-fold overlaps, equal starts, several episodes, rows without a place."""
    import random
    r = random.Random(4)
    iv = [(e, i, s, s + r.randrange(1, 400)) for e in ("a", "b") for i in range(60) for s in [r.randrange(0, 900)]]
    odd = [(None, 1, 0, 500), ("a", None, 0, 500), ("a", 99, None, 500), ("a", 98, 700, 700)]
    df = spark.createDataFrame(iv + odd, "episode_id string, seg_idx int, start_ms long, end_ms long").repartition(5)
    got = sorted(tuple(x) for x in E.overlap_join(df, bucket_ms=100).collect())
    assert got == sorted((a[0], a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in iv for b in iv
                         if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3]) and len(got) > 500


def linked_loop(rows, step):
    """Last value before and running sum, by key, in a plain loop."""
    out, state = {}, {}
    for k, i, v, x in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:2]):
        prev, total = state.get(k, (None, 0))
        total += step(prev, v, x)
        out[k, i] = (prev, total)
        state[k] = (v if v is not None else prev, total)
    return out, state


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_linked_scan_equals_loop(spark, block):
    """Steps that depend on the last value, over blocks without a value, blocks
    that begin without one, gaps in the index and rows without a place."""
    import random
    r = random.Random(block)
    rows = [(k, i * (1 + k), None if r.random() < 0.6 or 10 < i < 30 else r.choice("xyz"), r.randrange(100)) for k in range(3) for i in range(60)]
    odd = [(None, 3, "x", 5), (1, None, "y", 7), (None, None, None, 1)]
    df = spark.createDataFrame(rows + odd, "k int, i long, v string, x long").repartition(4)
    same = lambda p, v: 0 if p is None else (3 if p == v else 5)
    step = lambda prev, of: F.when(of("v").isNull(), of("x")).otherwise(
        of("x") - F.when(prev.isNull(), 0).when(prev == of("v"), 3).otherwise(5)).cast("long")
    scan = Linked("k", "i", F.col("v"), {"s": step}, ["v", "x"], block)
    want, last = linked_loop(rows, lambda p, v, x: x if v is None else x - same(p, v))
    got = scan.scan(df, "p").collect()
    assert {(a.k, a.i): (a.p, a.s) for a in got if a.k is not None and a.i is not None} == want
    assert len(got) == len(rows) + 3 and all(a.p is None and a.s is None for a in got if a.k is None or a.i is None)
    totals = {a.k: (a.s, a.n) for a in scan.totals(df, n=F.count(F.lit(1))).collect()}
    assert totals == {k: (last[k][1], 60 + (k == 1)) for k in range(3)} | {None: (0, 2)}


def test_episode_totals_equal_timelines(spark, synth):
    odd = spark.createDataFrame([(1, None, "Speaker 1", 5000, True, None), (None, 2, "Speaker 1", 5000, True, None), (5, 0, None, 2000, True, None),
                                 (5, 1, None, 2000, True, None), (5, 2, "Speaker 1", None, None, None)], synth.schema)
    both = synth.unionByName(odd)
    got = {r.episode_id: (r.n_segments, r.n_ok, r.duration_ms, r.duration_dynamic_ms) for r in E.episode_totals(both).collect()}
    plain, dynamic = loop_plain(), loop_dynamic()
    for e, segs in by_episode().items():
        n_ok = sum(s[4] and s[3] >= 1000 for s in segs)
        assert got[e] == (len(segs) + (e == 1), n_ok + (e == 1), max(plain[e, s[1]] for s in segs), max(dynamic[e, s[1]] for s in segs))
    assert got[None] == (1, 1, None, None) and got[5] == (3, 2, 2000 + 2500 + 500, 2000 + 1500 + 1700)
    t = {(r.episode_id, r.seg_idx): (r.xfade_ms, r.start_ms, r.end_ms) for r in E.timeline_dynamic(both).collect()}
    assert t[5, 0] == (500, 1500, 3500) and t[5, 1] == (300, 3200, 5200) and t[5, 2] == (0, 5200, 5200) and t[1, None][1:] == (None, None)


def test_hot_episode_default_blocks(spark):
    """One episode far larger than a block (default block size) next to
    small ones: the blocked timeline equals the loop."""
    n = 10_000
    rows = [(0, i, "Speaker 1" if (i // 3) % 2 else "Speaker 2", 900 + (i * 37) % 400, i % 5 != 0, None)
            for i in range(n)]
    rows += [(e, i, "Speaker 1", 1200, True, None) for e in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "episode_id long, seg_idx long, speaker string, dur_ms long, "
                                     "ok boolean, fail_kind string")
    got = {(r.episode_id, r.seg_idx): r.end_ms for r in E.timeline_dynamic(df).collect()}
    exp, prev, total, last_e = {}, None, 2000, None
    for e, i, sp, dur, ok, _ in rows:
        if e != last_e:
            prev, total, last_e = None, 2000, e
        if ok and dur >= 1000:
            xf = 500 if prev is None else (450 if prev == sp else 300)
            total += dur - xf
            prev = sp
        exp[(e, i)] = total
    assert got == exp


def test_jitter_with_keyed_pause_column(spark, synth):
    from parley.functions.audio_math import keyed_uniform
    pause = F.floor(keyed_uniform(200.0, 800.0, F.col("episode_id"), F.col("seg_idx"), 17, 13))
    by_col = {(r.episode_id, r.seg_idx): r.end_ms for r in E.timeline_jitter(synth, pause).collect()}
    table = synth.select("episode_id", "seg_idx", pause.cast("long").alias("pause_ms"))
    by_table = {(r.episode_id, r.seg_idx): r.end_ms for r in E.timeline_jitter(synth, table).collect()}
    assert by_col == by_table
