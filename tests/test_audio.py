"""Audio operators against NumPy loops that follow the definitions directly."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import audio as A
from parley.operators import blocks as B

RNG = np.random.default_rng(7)


def mixed(df, crossfade, block=7):
    """The mix as frames, through blocks of a few frames."""
    return B.frames(B.mix(df, crossfade, block), block)


def loop_low(x, fc, rate):
    rc, dt = 1 / (2 * math.pi * fc), 1 / rate
    a = dt / (rc + dt)
    y = [x[0]]
    for v in x[1:]:
        y.append(y[-1] + a * (v - y[-1]))
    return np.array(y)


def loop_high(x, fc, rate):
    rc, dt = 1 / (2 * math.pi * fc), 1 / rate
    a = rc / (rc + dt)
    y = [x[0]]
    for i in range(1, len(x)):
        y.append(a * (y[-1] + x[i] - x[i - 1]))
    return np.array(y)


def loop_compress(x, thr_db, ratio, att, rel, look):
    thr = 10 ** (thr_db / 20)
    out, a = [], 0.0
    for i in range(len(x)):
        w = x[max(0, i - look):i]
        lvl = math.sqrt(sum(v * v for v in w) / len(w)) if len(w) else 0.0
        m = (1 - 1 / ratio) * max(0.0, 20 * math.log10(lvl / thr)) if lvl > 0 else 0.0
        a = min(a + m / att, m) if lvl > thr and a <= m else max(a - m / rel, 0.0)
        out.append(x[i] * 10 ** (-a / 20))
    return np.array(out)


@pytest.mark.parametrize("n", [1, 2, 33, 64, 257, 5000])
def test_filters_equal_loops(n):
    x = RNG.normal(0, 0.3, n)
    assert np.allclose(A.low_pass_array(x, 4000, 24000), loop_low(x, 4000, 24000), atol=1e-12)
    assert np.allclose(A.high_pass_array(x, 150, 24000), loop_high(x, 150, 24000), atol=1e-12)


def test_compress_array_equals_loop():
    x = np.concatenate([RNG.normal(0, 0.5, 300), RNG.normal(0, 0.01, 300)])
    assert np.allclose(A.compress_array(x, -20, 2.5, 5, 50, 5), loop_compress(x, -20, 2.5, 5, 50, 5), atol=1e-12)


def test_mix_equals_sequential_append(spark):
    waves = [(1, k, [float(v) for v in RNG.normal(0, 0.2, 20)]) for k in range(4)]
    df = spark.createDataFrame(waves, "episode_id long, seg_idx long, samples array<double>")
    c = 4
    out = np.array(waves[0][2])
    for _, k, s in waves[1:]:
        s = np.array(s)
        ramp_in = np.arange(1, c + 1) / (c + 1)
        ramp_out = ramp_in[::-1]
        out = np.concatenate([out[:-c], out[-c:] * ramp_out + s[:c] * ramp_in, s[c:]])
    got = np.array([r.amp for r in mixed(df, c).orderBy("t").collect()])
    assert np.allclose(got, out, atol=1e-12)


def test_mix_leaves_out_short_segments(spark):
    waves = [(1, 0, [0.1] * 20), (1, 1, [0.2] * 3), (1, 2, None), (1, 3, [0.3] * 20)]
    df = spark.createDataFrame(waves, "episode_id long, seg_idx long, samples array<double>")
    t = [r.t for r in mixed(df, 8).orderBy("t").collect()]
    assert t == list(range(20 + 20 - 8))
    assert sorted(r.seg_idx for r in A.too_short(df, 8).collect()) == [1, 2]


def test_mix_with_a_crossfade_for_each_segment(spark):
    own = {3: 9, 4: 0, 7: 6, 8: 2}      # indexes with gaps; the first crossfade does not count
    waves = [(1, k, [float(v) for v in RNG.normal(0, 0.2, 20 + k)], c) for k, c in own.items()]
    waves += [(1, 5, [0.5] * 3, 4), (2, 0, [0.1, 0.2], 0)]   # shorter than its crossfade; alone
    df = spark.createDataFrame(waves, "episode_id long, seg_idx long, samples array<double>, c int")
    out = np.array(waves[0][2])
    for _, k, s, c in waves[1:4]:
        s = np.array(s)
        ramp = np.arange(1, c + 1) / (c + 1)
        out = np.concatenate([out[:len(out) - c], out[len(out) - c:] * ramp[::-1] + s[:c] * ramp, s[c:]])
    rows = mixed(df, "c").orderBy("episode_id", "t").collect()
    assert [r.t for r in rows if r.episode_id == 1] == list(range(len(out)))
    assert np.allclose([r.amp for r in rows if r.episode_id == 1], out, atol=1e-12)
    assert [r.amp for r in rows if r.episode_id == 2] == [0.1, 0.2]
    assert [r.seg_idx for r in A.too_short(df, "c").collect()] == [5]


def test_segment_ambience(spark):
    tone, rate = [0.1, -0.2, 0.3], 20.0     # slices of 20 frames, crossfades of 1
    df = spark.createDataFrame([(1, 0, [0.0] * 47), (1, 1, [0.0] * 19), (1, 2, None), (1, 3, [])], "e long, k long, samples array<double>")
    amb = A.segment_ambience(F.col("samples"), tone, -6.0, F.col("e"), F.col("k"), rate, jitter_db=0.0)
    got = {r.k: r.x for r in df.select("k", amb.alias("x")).collect()}
    g = 10 ** (-6 / 20)
    bed = [tone[i % 3] * g for i in range(20)]
    second = [tone[(20 + i) % 3] * g for i in range(20)]
    exp = bed[:19] + [bed[19] * 0.5 + second[0] * 0.5] + second[1:] + [0.0] * 8
    assert np.allclose(got[0], exp, atol=1e-12)
    assert got[1] == [0.0] * 19 and got[2] is None and got[3] == []


def test_window_sums():
    for n, look in [(1, 1), (5, 1), (7, 3), (240, 240), (1000, 24)]:
        x = RNG.normal(0, 1, n)
        exp = [x[i:i + look].sum() for i in range(n - look + 1)]
        assert np.allclose(A.window_sums(x, look), exp, atol=1e-12)


def test_quantise_and_normalise(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (1.3,), (-0.5,), (-2.0,)], "x double")
    assert [r.q for r in df.select(A.quantise(F.col("x")).alias("q")).collect()] == [32767, -32767, 32767, -16383, -32768]
    z = spark.createDataFrame([([0.0, 0.0],), ([0.5, -0.25],)], "s array<double>")
    got = [r.n for r in z.select(A.normalise(F.col("s")).alias("n")).collect()]
    assert got[0] == [0.0, 0.0]
    assert abs(max(abs(v) for v in got[1]) - 10 ** (-0.1 / 20)) < 1e-12


@pytest.mark.parametrize("n", [500, 1000, 2500])
def test_ambience_lengths(spark, n):
    base = B.silence(spark.createDataFrame([("e",)], "episode_id string"), n, 300)
    tone = [0.01 * (i + 1) for i in range(16)]
    keyed = base.withColumn("episode_id", F.lit(1).cast("long"))
    got = {r.t: r.amp for r in B.frames(B.ambience(keyed, tone, -50.0, block_frames=300), 300).collect()}
    slices = n // 1000
    bed = slices * 1000 - (slices - 1) * 50 if slices else 0
    assert len(got) == n
    assert all(v != 0.0 for t, v in got.items() if t < bed)
    assert all(v == 0.0 for t, v in got.items() if t >= bed)


def test_resample_length(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "s array<double>")
    r = df.select(A.resample(F.col("s"), F.lit(1.5)).alias("r")).first().r
    assert len(r) == math.floor(3 * 1.5) + 1
    assert np.allclose(r, [j / 1.5 for j in range(len(r))])


def test_master_chain_equals_numpy(spark):
    waves = [(e, k, [float(v) for v in RNG.normal(0, 0.3, 40)]) for e in (1, 2) for k in range(5)]
    df = spark.createDataFrame(waves, "episode_id long, seg_idx long, samples array<double>")
    got = {}
    for r in B.frames(B.master_chain(B.mix(df, 4, 23, 10), 1000.0, 23), 23).collect():
        got.setdefault(r.episode_id, {})[r.t] = r.amp
    for e in (1, 2):
        segs = [np.array(s) for ee, k, s in waves if ee == e]
        out = segs[0]
        ramp = np.arange(1, 5) / 5
        for s in segs[1:]:
            out = np.concatenate([out[:-4], out[-4:] * ramp[::-1] + s[:4] * ramp, s[4:]])
        n = len(out)
        out = out * np.minimum(1.0, (n - np.arange(n)) / 2000.0)
        out = loop_compress(out, -15, 1.5, 10, 100, 10)
        out = out * (10 ** (-0.1 / 20)) / np.max(np.abs(out))
        g = np.array([got[e][t] for t in range(n)])
        assert np.allclose(g, out, atol=1e-12)


def test_blocked_rolling_rms(spark):
    x = RNG.normal(0, 0.4, 300)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "episode_id long, i long, amp double")
    got = {r.i: r.level for r in A.rolling_rms(df, "episode_id", "i", 5, block_frames=16).collect()}
    for i in range(300):
        w = x[max(0, i - 5):i]
        if len(w) == 0:
            assert got[i] is None
        else:
            assert abs(got[i] - math.sqrt(float(np.mean(w * w)))) < 1e-12


@pytest.mark.parametrize("fc", [20.0, 150.0, 4000.0, 11000.0])
def test_low_pass_long_signal_any_cutoff(fc):
    x = RNG.normal(0, 0.3, 20_000)
    assert np.allclose(A.low_pass_array(x, fc, 24000), loop_low(x, fc, 24000), atol=1e-10)
    assert np.allclose(A.high_pass_array(x, fc, 24000), loop_high(x, fc, 24000), atol=1e-10)


# --------------------------------------------------- long signals in blocks
def signal_blocks(spark, x, block, halo=0, key=1):
    """A signal in blocks, cut from one segment."""
    df = spark.createDataFrame([(key, 0, [float(v) for v in x])], "episode_id long, seg_idx long, samples array<double>")
    return B.mix(df, 0, block, halo)


def signal_of(blocks, block):
    return np.array([r.amp for r in B.frames(blocks, block).orderBy("t").collect()])


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_filters_on_blocks_equal_the_array_form(spark, block):
    x = RNG.normal(0, 0.3, 1000)
    b = signal_blocks(spark, x, block, 3)
    for fc in (150.0, 4000.0):
        assert np.allclose(signal_of(B.low_pass(b, F.lit(fc), 24000.0, block), block), A.low_pass_array(x, fc, 24000), atol=1e-12)
        assert np.allclose(signal_of(B.high_pass(b, F.lit(fc), 24000.0, block), block), A.high_pass_array(x, fc, 24000), atol=1e-12)


def test_filters_of_several_signals_with_their_own_cutoff(spark):
    x, y = RNG.normal(0, 0.3, 230), RNG.normal(0, 0.3, 91)
    b = signal_blocks(spark, x, 20).unionByName(signal_blocks(spark, y, 20, key=2))
    out = B.high_pass(B.low_pass(b, F.when(F.col("episode_id") == 1, 4000).otherwise(5000), 24000.0, 20),
                      F.when(F.col("episode_id") == 1, 100).otherwise(150), 24000.0, 20)
    for k, s, low, high in ((1, x, 4000, 100), (2, y, 5000, 150)):
        got = signal_of(out.where(F.col("episode_id") == k), 20)
        assert np.allclose(got, loop_high(loop_low(s, low, 24000), high, 24000), atol=1e-12)


def loud_and_quiet(n, seed):
    r = np.random.default_rng(seed)
    level = np.repeat(r.choice([0.0, 0.003, 0.05, 0.4, 0.9], n // 40 + 1), 40)[:n]
    return r.normal(0, 1, n) * level


@pytest.mark.parametrize("attack,release", [(5, 50), (50, 5), (1, 1), (0, 20), (7, 0), (0.5, 3)])
def test_attenuation_maps_equal_the_ordered_pass(attack, release):
    """The composed map of a stretch, for any attenuation before it."""
    r = np.random.default_rng(int(attack * 10 + release))
    for _ in range(60):
        n = int(r.integers(0, 80))
        targets = np.where(r.random(n) < 0.3, 0.0, r.choice([0.5, 1.0, 3.0, 6.0]) * r.random(n))
        most = 8.0
        m = np.array(B.attenuation_map(targets, attack, release, most).numbers())
        for before in [0.0, most, *(r.random(20) * most), *targets[:5]]:
            want = A.attenuations(targets, float(before), attack, release)[-1] if n else before
            assert B.AttenuationMap.apply(m, float(before)) == pytest.approx(want, abs=1e-12)


def test_loud_stretches_leave_one_value():
    m = B.attenuation_map(A.attenuation_targets(loud_and_quiet(4000, 1), np.zeros(0), -20, 2.5, 120)[0], 120, 1200, 12.0)
    assert len(m.upto) <= 3


@pytest.mark.parametrize("block", [5, 64, 4000])
def test_compressor_on_blocks_equals_the_ordered_pass(spark, block):
    for seed, (thr, ratio, att, rel) in enumerate([(-15, 1.5, 2, 6), (-20, 2.5, 5, 50)]):
        x = loud_and_quiet(3000, seed)
        b = signal_blocks(spark, x, block, B.look_back((thr, ratio, att, rel), 1000.0))
        got = signal_of(B.compress(b, thr, ratio, att, rel, 1000.0, block), block)
        assert np.allclose(got, loop_compress(x, thr, ratio, att, rel, att), atol=1e-12)


def test_compressor_needs_its_halo(spark):
    with pytest.raises(Exception, match="looks back 5 frames"):
        B.compress(signal_blocks(spark, RNG.normal(0, 1, 100), 20, 2), -20, 2.5, 5, 50, 1000.0, 20).collect()


def test_hot_signal_spreads(spark):
    """The blocks of one signal lie in many partitions, and so does the work on them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these tables are tiny
    try:
        b = signal_blocks(spark, RNG.normal(0, 0.5, 4000), 50, 5)
        rows = [(r.p, r.block) for r in b.select(F.spark_partition_id().alias("p"), "block").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 80 and len({p for p, _ in rows}) == 8


def test_assembly_with_gaps(spark):
    """Segments with silence between them, ramps of their own, an odd key type;
    blocks that no segment reaches are silent; segments without a place go."""
    rows = [("a", 0, [1.0] * 10, 5, 0, 0, 100), ("a", 1, [2.0] * 8, 60, 4, 2, 100), ("b", 0, [], 0, 0, 0, 7), ("b", 1, [3.0] * 3, 4, 0, 0, 7)]
    df = spark.createDataFrame(rows, "episode_id string, seg_idx int, samples array<double>, start long, own int, following int, total int")
    for block, halo in ((7, 0), (7, 3), (16, 16), (200, 9)):
        blocks = B.assemble(df, block, halo, gaps=True)
        want = {"a": np.zeros(100), "b": np.zeros(7)}
        want["a"][5:15] = 1.0
        want["a"][60:68] = 2.0 * np.array([.2, .4, .6, .8, 1, 1, 2 / 3, 1 / 3])
        want["b"][4:] = 3.0
        for k, w in want.items():
            own = blocks.where(F.col("episode_id") == k)
            assert np.allclose(signal_of(own, block), w)
            for r in own.collect():
                assert r.lead == min(halo, r.block * block) and r.peak == pytest.approx(np.abs(r.samples[r.lead:]).max())
                assert np.allclose(r.samples, w[r.block * block - r.lead:(r.block + 1) * block])
    assert B.assemble(df.limit(0), 7, gaps=True).count() == 0


def test_blocks_of_an_empty_table(spark):
    none = spark.createDataFrame([], "episode_id long, seg_idx long, samples array<double>")
    assert B.frames(B.master_chain(B.mix(none, 2, 10, 10), 1000.0, 10), 10).count() == 0
    odd = spark.createDataFrame([(None, 0, [1.0]), (1, None, [1.0]), (1, 0, None), (1, 1, [])], none.schema)
    assert B.mix(odd, 0, 10).count() == 0


def test_place_with_gaps_equals_appending(spark):
    """The append loop of the variant with gaps, crossfades and pauses."""
    rows = [(1, 0, [0.5] * 9), (1, 1, None), (1, 2, [0.25] * 12), (1, 3, [0.1] * 3), (1, 4, [-0.5] * 6), (1, 5, []), (2, 0, None), (2, 1, [1.0] * 6), (3, 0, None)]
    df = spark.createDataFrame(rows, "episode_id long, seg_idx long, samples array<double>")
    out = {}
    for e, i, x in rows:
        a = out.setdefault(e, [])
        if i > 0:
            a += [0.0] * 7
        if x and (i == 0 or len(x) >= 5):
            if i > 0:
                head = [a[len(a) - 5 + k] * (5 - k) / 6 + x[k] * (k + 1) / 6 for k in range(5)]
                a[len(a) - 5:] = head + x[5:] + [0.0] * (i + 2)
            else:
                a += x
    got = B.assemble(A.place_with_gaps(df, 7, 5, F.col("seg_idx") + 2), 4, gaps=True)
    for e in (1, 2):
        assert np.allclose(signal_of(got.where(F.col("episode_id") == e), 4), out[e])
    assert got.where("episode_id = 3").count() == 0   # no segment succeeded
    with pytest.raises(ValueError):
        A.place_with_gaps(df, 3, 5)
