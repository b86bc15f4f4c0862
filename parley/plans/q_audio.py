"""Queries over waveforms and frames (audio assembly)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import audio_math as M
from parley.functions import fixed as FXV
from parley.operators import audio as A
from parley.operators import blocks as B
from parley.plans.registry import query
from parley.sources import fixtures as FX

XF = FX.CROSSFADE_FRAMES
COMP_RATE = 1000.0          # compressor frame rate for the 64-frame fixtures: 1 frame = 1 ms
LOOK = 5                    # segment compressor: 5 ms attack -> 5-frame level window
W_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
H = repr(A.HEADROOM)


def _gain_db_sql() -> str:
    return "(-6.0::DOUBLE + 6.0::DOUBLE * (((7 * episode_id + 29 * seg_idx) % 10007) / 10007.0::DOUBLE))"


def _gain_db(k, i):
    return M.keyed_uniform(-6.0, 0.0, k, i, 7, 29)


@query("src_frames", "SELECT episode_id, seg_idx, i, amp FROM f_frames")
def src_frames(spark, sf_dir):
    """Waveform source: array<double> per segment to one row per sample."""
    return FX.frames(spark, sf_dir).select("episode_id", "seg_idx", "i", "amp")


@query("aud_quantise", """
    SELECT episode_id, seg_idx, i, CAST(trunc(greatest(-32768.0, least(32767.0, amp * 32767.0))) AS BIGINT) AS pcm
    FROM f_frames""")
def aud_quantise(spark, sf_dir):
    f = FX.frames(spark, sf_dir)
    return f.select("episode_id", "seg_idx", "i", A.quantise(F.col("amp")).alias("pcm"))


@query("aud_silence", """
    SELECT episode_id, CAST(sum(500) AS BIGINT) AS n_silence_frames, 0.0::DOUBLE AS silence_peak
    FROM f_segments WHERE seg_idx > 0 GROUP BY episode_id""")
def aud_silence(spark, sf_dir):
    """Silence parts of the plain timeline (500 ms before every later segment)
    as zero arrays: frame counts and peak per episode."""
    s = FX.segments(spark, sf_dir).where(F.col("seg_idx") > 0)
    z = s.select("episode_id", A.silence(F.lit(FXV.GAP_MS)).alias("z"))
    return z.groupBy("episode_id").agg(F.sum(F.size("z")).cast("long").alias("n_silence_frames"),
                                       F.max(A.peak(F.col("z"))).alias("silence_peak"))


@query("aud_gain", f"""
    SELECT episode_id, seg_idx, i, round(amp * pow(10.0, {_gain_db_sql()} / 20.0), 6) AS amp FROM f_frames""")
def aud_gain(spark, sf_dir):
    """Gain in dB per segment (keyed value in [-6, 0) dB)."""
    w = FX.waves(spark, sf_dir)
    g = M.db_to_gain(_gain_db(F.col("episode_id"), F.col("seg_idx")))
    f = A.to_frames(w.select("episode_id", "seg_idx", A.apply_gain(F.col("samples"), g).alias("samples")))
    return f.select("episode_id", "seg_idx", "i", F.round("amp", 6).alias("amp"))


@query("agg_peak", """
    SELECT episode_id, seg_idx, max(abs(amp)) AS peak FROM f_frames GROUP BY episode_id, seg_idx""")
def agg_peak(spark, sf_dir):
    """Peak per segment, computed on the array without a shuffle."""
    w = FX.waves(spark, sf_dir)
    return w.select("episode_id", "seg_idx", A.peak(F.col("samples")).alias("peak"))


@query("aud_normalise", f"""
    SELECT f.episode_id, f.seg_idx, f.i,
           round(CASE WHEN p.peak > 0 THEN (f.amp / p.peak) * {H}::DOUBLE ELSE f.amp END, 6) AS amp
    FROM f_frames f JOIN (SELECT episode_id, seg_idx, max(abs(amp)) AS peak FROM f_frames GROUP BY ALL) p
      ON f.episode_id = p.episode_id AND f.seg_idx = p.seg_idx""")
def aud_normalise(spark, sf_dir):
    w = FX.waves(spark, sf_dir)
    f = A.to_frames(w.select("episode_id", "seg_idx", A.normalise(F.col("samples")).alias("samples")))
    return f.select("episode_id", "seg_idx", "i", F.round("amp", 6).alias("amp"))


def _filter_sql(kind: str) -> str:
    rc = "(1.0 / (2 * pi() * fc))"
    dt = "(1.0 / 24000.0)"
    if kind == "low":
        fc = "CASE WHEN speaker = 'Speaker 1' THEN 4000.0 ELSE 5000.0 END"
        coef = f"{dt} / ({rc} + {dt})"
        step = "r.y + c.a * (c.amp - r.y)"
    else:
        fc = "CASE WHEN speaker = 'Speaker 1' THEN 100.0 ELSE 150.0 END"
        coef = f"{rc} / ({rc} + {dt})"
        step = "c.a * (r.y + c.amp - r.x)"
    return f"""
    WITH RECURSIVE c AS (
        SELECT episode_id, seg_idx, i, amp, {coef} AS a FROM (SELECT *, {fc} AS fc FROM f_frames)),
    r AS (
        SELECT episode_id, seg_idx, i, amp AS x, amp AS y FROM c WHERE i = 0
        UNION ALL
        SELECT c.episode_id, c.seg_idx, c.i, c.amp, {step}
        FROM r JOIN c ON c.episode_id = r.episode_id AND c.seg_idx = r.seg_idx AND c.i = r.i + 1)
    SELECT episode_id, seg_idx, i, round(y, 6) AS amp FROM r"""


@query("aud_low_pass", _filter_sql("low"))
def aud_low_pass(spark, sf_dir):
    """First-order low-pass at 4 kHz (Speaker 1) / 5 kHz (other), 24 kHz frames."""
    w = FX.waves(spark, sf_dir)
    first = F.col("speaker") == FXV.SPEAKER_1
    lp = F.when(first, FXV.LOW_PASS_HZ["Speaker 1"]).otherwise(FXV.LOW_PASS_HZ["other"])
    y = w.select("episode_id", "seg_idx", A.low_pass(F.col("samples"), lp, F.lit(24000.0)).alias("samples"))
    return A.to_frames(y).select("episode_id", "seg_idx", "i", F.round("amp", 6).alias("amp"))


@query("aud_high_pass", _filter_sql("high"))
def aud_high_pass(spark, sf_dir):
    """First-order high-pass at 100 Hz (Speaker 1) / 150 Hz (other)."""
    w = FX.waves(spark, sf_dir)
    first = F.col("speaker") == FXV.SPEAKER_1
    hp = F.when(first, FXV.HIGH_PASS_HZ["Speaker 1"]).otherwise(FXV.HIGH_PASS_HZ["other"])
    y = w.select("episode_id", "seg_idx", A.high_pass(F.col("samples"), hp, F.lit(24000.0)).alias("samples"))
    return A.to_frames(y).select("episode_id", "seg_idx", "i", F.round("amp", 6).alias("amp"))


@query("win_rolling_rms", f"""
    SELECT episode_id, seg_idx, i,
           round(sqrt(avg(amp * amp) OVER (PARTITION BY episode_id, seg_idx ORDER BY i
                      ROWS BETWEEN {LOOK} PRECEDING AND 1 PRECEDING)), 6) AS level
    FROM f_frames""")
def win_rolling_rms(spark, sf_dir):
    f = FX.frames(spark, sf_dir).select("episode_id", "seg_idx", "i", "amp")
    r = A.rolling_rms(f, ["episode_id", "seg_idx"], "i", LOOK)
    return r.select("episode_id", "seg_idx", "i", F.round("level", 6).alias("level"))


def _compress_sql(src: str, keys: str, thr_db: float, ratio: float, att: float, rel: float, look: int) -> str:
    join_keys = " AND ".join(f"l.{k} = r.{k}" for k in keys.split(", "))
    return f"""
    WITH RECURSIVE lv AS (
        SELECT *, CASE WHEN lvl > 0 THEN (1 - 1 / {ratio}::DOUBLE)
                       * greatest(0.0, 20 * log10(lvl / pow(10.0, {thr_db}::DOUBLE / 20))) ELSE 0.0 END AS m
        FROM (SELECT {keys}, i, amp,
                     sqrt(avg(amp * amp) OVER (PARTITION BY {keys} ORDER BY i
                          ROWS BETWEEN {look} PRECEDING AND 1 PRECEDING)) AS lvl
              FROM {src})),
    r AS (
        SELECT {keys}, i, amp, 0.0::DOUBLE AS att
        FROM lv WHERE i = 0
        UNION ALL
        SELECT {', '.join('l.' + k for k in keys.split(', '))}, l.i, l.amp,
               CASE WHEN l.m > 0 AND r.att <= l.m THEN least(r.att + l.m / {att}::DOUBLE, l.m)
                    ELSE greatest(r.att - l.m / {rel}::DOUBLE, 0.0) END
        FROM r JOIN lv l ON {join_keys} AND l.i = r.i + 1)
    SELECT {keys}, i, round(amp * pow(10.0, -att / 20), 6) AS amp FROM r"""


_THR, _RATIO, _ATT, _REL = FXV.SEGMENT_COMPRESSOR


@query("aud_compress", _compress_sql("f_frames", "episode_id, seg_idx", _THR, _RATIO,
                                     _ATT * COMP_RATE / 1000, _REL * COMP_RATE / 1000, LOOK))
def aud_compress(spark, sf_dir):
    """Segment compressor (-20 dB, 2.5:1, 5 ms, 50 ms) at 1 frame = 1 ms,
    applied per segment array (Arrow-batched, no shuffle)."""
    w = FX.waves(spark, sf_dir)
    c = w.select("episode_id", "seg_idx",
                 A.compress_samples(F.col("samples"), _THR, _RATIO, _ATT, _REL, COMP_RATE).alias("samples"))
    return A.to_frames(c).select("episode_id", "seg_idx", "i", F.round("amp", 6).alias("amp"))


_PLACE_SQL = f"""
    SELECT episode_id, seg_idx, len(samples) AS n,
           CAST(coalesce(sum(len(samples) - {XF}) OVER (PARTITION BY episode_id ORDER BY seg_idx {W_BEFORE}), 0)
               AS BIGINT) AS start,
           seg_idx > 0 AS has_prev, seg_idx < max(seg_idx) OVER (PARTITION BY episode_id) AS has_next
    FROM f_wave"""
_XF_SQL = f"""
    SELECT f.episode_id, f.seg_idx, f.i, p.start + f.i AS t,
           f.amp * ((CASE WHEN p.has_prev AND f.i < {XF} THEN (f.i + 1) / {XF + 1.0}::DOUBLE ELSE 1.0 END)
                  * (CASE WHEN p.has_next AND f.i >= p.n - {XF} THEN (p.n - f.i) / {XF + 1.0}::DOUBLE ELSE 1.0 END))
               AS amp
    FROM f_frames f JOIN ({_PLACE_SQL}) p ON f.episode_id = p.episode_id AND f.seg_idx = p.seg_idx"""
_MIX_SQL = f"SELECT episode_id, t, sum(amp) AS amp FROM ({_XF_SQL}) GROUP BY episode_id, t"


BLOCK = int(COMP_RATE)      # a second of the fixture's signals


def _mix(spark, sf_dir, halo: int = 0):
    return B.mix(FX.waves(spark, sf_dir), XF, BLOCK, halo)


def _frames(blocks, digits: int = 6, block_frames: int = BLOCK):
    return B.frames(blocks, block_frames).select("episode_id", "t", F.round("amp", digits).alias("amp"))


@query("aud_crossfade", f"SELECT episode_id, seg_idx, i, t, round(amp, 6) AS amp FROM ({_XF_SQL})")
def aud_crossfade(spark, sf_dir):
    """Segments placed with an 8-frame crossfade and complementary ramps."""
    f = A.crossfaded_frames(FX.waves(spark, sf_dir), XF)
    return f.select("episode_id", "seg_idx", "i", "t", F.round("amp", 6).alias("amp"))


@query("agg_mix_frames", f"SELECT episode_id, t, round(amp, 6) AS amp FROM ({_MIX_SQL})")
def agg_mix_frames(spark, sf_dir):
    """Episode signal: overlapping frames summed, in blocks of a second."""
    return _frames(_mix(spark, sf_dir))


@query("aud_fade", f"""
    SELECT m.episode_id, m.t,
           round(m.amp * (least(1.0, m.t / 1000.0::DOUBLE) * least(1.0, (n.total - m.t) / 2000.0::DOUBLE)), 6)
               AS amp
    FROM ({_MIX_SQL}) m JOIN (SELECT episode_id, max(t) + 1 AS total FROM ({_MIX_SQL}) GROUP BY episode_id) n
      ON m.episode_id = n.episode_id""")
def aud_fade(spark, sf_dir):
    """Fade-in over the first 1,000 frames and fade-out over the last 2,000
    of each mixed episode (1 frame = 1 ms)."""
    return _frames(B.fade(_mix(spark, sf_dir), FXV.INTRO_FADE_IN_MS, FXV.OUTRO_FADE_OUT_MS, BLOCK))


_ROOM_GAIN = repr(10 ** (FXV.ROOM_VOLUME_DB / 20))


@query("join_looped_overlay", f"""
    SELECT m.episode_id, m.t, round(m.amp + tn.amp * {_ROOM_GAIN}::DOUBLE, 9) AS amp
    FROM ({_MIX_SQL}) m JOIN f_tone tn ON m.t % 16 = tn.t""")
def join_looped_overlay(spark, sf_dir):
    """Room tone looped under each mixed episode (-50 dB), joined on t % 16."""
    o = A.looped_overlay(B.frames(_mix(spark, sf_dir), BLOCK), FX.tone(spark), F.lit(10 ** (FXV.ROOM_VOLUME_DB / 20)))
    return o.select("episode_id", "t", F.round("amp", 9).alias("amp"))


def _amb_part(s: str) -> str:
    j = f"(p - {s} * 950)"
    valid = f"({s} >= 0 AND {s} < 2 AND {j} >= 0 AND {j} < 1000)"
    gain_db = (f"(-45.0::DOUBLE + (-3.0::DOUBLE + 6.0::DOUBLE * (((7 * episode_id + 29 * {s}) % 10007) "
               f"/ 10007.0::DOUBLE)))")
    ramp = (f"((CASE WHEN {s} > 0 AND {j} < 50 THEN ({j} + 1) / 51.0::DOUBLE ELSE 1.0 END) * "
            f"(CASE WHEN {s} < 1 AND {j} >= 950 THEN (1000 - {j}) / 51.0::DOUBLE ELSE 1.0 END))")
    tone = f"(SELECT amp FROM f_tone WHERE f_tone.t = ({s} * 1000 + {j}) % 16)"
    return f"CASE WHEN {valid} THEN {tone} * pow(10.0, {gain_db} / 20.0) * {ramp} ELSE 0.0 END"


@query("aud_ambience", f"""
    SELECT episode_id, p AS t, round(0.0 + {_amb_part('s1')} + {_amb_part('(s1 - 1)')}, 9) AS amp
    FROM (SELECT episode_id, p, p // 950 AS s1
          FROM (SELECT DISTINCT episode_id FROM f_segments), range(2000) r(p))""")
def aud_ambience(spark, sf_dir):
    """Room-tone intro: 2,000 ms of silence with ambience at -45 dB (two
    1-second slices, per-slice keyed jitter, 50 ms crossfade)."""
    eps = FX.segments(spark, sf_dir).select("episode_id").distinct()
    base = B.silence(eps, FXV.INTRO_MS, BLOCK)
    return _frames(B.ambience(base, _tone(), FXV.INTRO_ROOM_VOLUME_DB, block_frames=BLOCK), 9)


def _tone() -> list[float]:
    """The room tone of the fixtures (``f_tone``)."""
    return [(t - 8) / 80.0 for t in range(16)]


_RATE_SQL = "(0.95::DOUBLE + 0.10000000000000009::DOUBLE * (((31 * episode_id + 17 * seg_idx) % 10007) / 10007.0::DOUBLE))"


@query("aud_resample", f"""
    SELECT episode_id, seg_idx, j, CAST(floor(24000 * rate) AS BIGINT) AS frame_rate,
           round(samples[i0 + 1] * (1.0 - (j / rate - i0)) + samples[least(i0 + 2, len(samples))] * (j / rate - i0), 6)
               AS amp
    FROM (SELECT *, CAST(floor(j / rate) AS BIGINT) AS i0
          FROM (SELECT episode_id, seg_idx, samples, rate, unnest(range(CAST(floor((len(samples) - 1) * rate) AS BIGINT) + 1)) AS j
                FROM (SELECT *, {_RATE_SQL} AS rate FROM f_wave)))""")
def aud_resample(spark, sf_dir):
    """Linear-interpolation resampling at a keyed rate in [0.95, 1.05); the new
    frame rate is carried with the samples."""
    w = FX.waves(spark, sf_dir)
    rate = M.keyed_uniform(0.95, 1.05, F.col("episode_id"), F.col("seg_idx"), 31, 17)
    r = w.select("episode_id", "seg_idx", A.resample(F.col("samples"), rate).alias("samples"),
                 F.floor(F.lit(24000) * rate).cast("long").alias("frame_rate"))
    f = A.to_frames(r).withColumnRenamed("i", "j")
    return f.select("episode_id", "seg_idx", "j", "frame_rate", F.round("amp", 6).alias("amp"))


@query("arr_second_slices", """
    SELECT episode_id, seg_idx, k AS slice_idx, len(samples[k * 16 + 1 : (k + 1) * 16]) AS n_frames,
           round(list_sum(samples[k * 16 + 1 : (k + 1) * 16]), 6) AS slice_sum
    FROM (SELECT *, unnest(range(CAST(ceil(len(samples) / 16.0) AS BIGINT))) AS k FROM f_wave)""")
def arr_second_slices(spark, sf_dir):
    """Array slicing into fixed-length slices (16 frames), sizes and sums."""
    w = FX.waves(spark, sf_dir)
    s = w.select("episode_id", "seg_idx", F.posexplode_outer(A.slices(F.col("samples"), 16)).alias("slice_idx", "sl"))
    s = s.where(F.col("sl").isNotNull())
    return s.select("episode_id", "seg_idx", "slice_idx", F.size("sl").alias("n_frames"),
                    F.round(F.aggregate("sl", F.lit(0.0), lambda a, x: a + x), 6).alias("slice_sum"))




# ---- oracles for the two chains (recursive CTEs, one per sequential stage)
def _rec_filter(name: str, src: str, keys: str, kind: str, rate: float) -> str:
    """CTE text for a first-order filter over ``src(keys, i, x, speaker)``."""
    on = " AND ".join(f"c.{k} = r.{k}" for k in keys.split(", "))
    rc = "(1.0 / (2 * pi() * fc))"
    dt = f"(1.0 / {rate})"
    if kind == "low":
        fc = "CASE WHEN speaker = 'Speaker 1' THEN 4000.0 ELSE 5000.0 END"
        coef, step = f"{dt} / ({rc} + {dt})", "r.y + c.a * (c.x - r.y)"
    else:
        fc = "CASE WHEN speaker = 'Speaker 1' THEN 100.0 ELSE 150.0 END"
        coef, step = f"{rc} / ({rc} + {dt})", "c.a * (r.y + c.x - r.x)"
    cols = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""{name}_c AS (SELECT *, {coef} AS a FROM (SELECT *, {fc} AS fc FROM {src})),
    {name} AS (
        SELECT {keys}, i, speaker, x, x AS y FROM {name}_c WHERE i = 0
        UNION ALL
        SELECT {cols}, c.i, c.speaker, c.x, {step}
        FROM {name} r JOIN {name}_c c ON {on} AND c.i = r.i + 1)"""


def _rec_compress(name: str, src: str, keys: str, thr_db: float, ratio: float, att: float, rel: float,
                  look: int, order: str = "i") -> str:
    """CTE text for the compressor over ``src(keys, order, x)``; output column ``y``."""
    on = " AND ".join(f"l.{k} = r.{k}" for k in keys.split(", "))
    cols = ", ".join(f"l.{k}" for k in keys.split(", "))
    return f"""{name}_lv AS (
        SELECT *, CASE WHEN lvl > 0 THEN (1 - 1 / {ratio}::DOUBLE)
                       * greatest(0.0, 20 * log10(lvl / pow(10.0, {thr_db}::DOUBLE / 20))) ELSE 0.0 END AS m
        FROM (SELECT {keys}, {order}, x,
                     sqrt(avg(x * x) OVER (PARTITION BY {keys} ORDER BY {order}
                          ROWS BETWEEN {look} PRECEDING AND 1 PRECEDING)) AS lvl
              FROM {src})),
    {name} AS (
        SELECT {keys}, {order}, x, 0.0::DOUBLE AS att
        FROM {name}_lv WHERE {order} = 0
        UNION ALL
        SELECT {cols}, l.{order}, l.x,
               CASE WHEN l.m > 0 AND r.att <= l.m THEN least(r.att + l.m / {att}::DOUBLE, l.m)
                    ELSE greatest(r.att - l.m / {rel}::DOUBLE, 0.0) END
        FROM {name} r JOIN {name}_lv l ON {on} AND l.{order} = r.{order} + 1)"""


_SR = float(FXV.SAMPLE_RATE)
_SEG_ATT, _SEG_REL = _ATT * _SR / 1000, _REL * _SR / 1000
_SEG_CHAIN_SQL = f"""
    WITH RECURSIVE nrm AS (
        SELECT f.episode_id, f.seg_idx, f.i, f.speaker,
               CASE WHEN p.peak > 0 THEN (f.amp / p.peak) * {H}::DOUBLE ELSE f.amp END AS x
        FROM f_frames f JOIN (SELECT episode_id, seg_idx, max(abs(amp)) AS peak FROM f_frames GROUP BY ALL) p
          ON f.episode_id = p.episode_id AND f.seg_idx = p.seg_idx),
    {_rec_filter("lp", "nrm", "episode_id, seg_idx", "low", _SR)},
    hp_in AS (SELECT episode_id, seg_idx, i, speaker, y AS x FROM lp),
    {_rec_filter("hp", "hp_in", "episode_id, seg_idx", "high", _SR)},
    cp_in AS (SELECT episode_id, seg_idx, i, y AS x FROM hp),
    {_rec_compress("cp", "cp_in", "episode_id, seg_idx", _THR, _RATIO, _SEG_ATT, _SEG_REL, max(int(round(_SEG_ATT)), 1))}
    SELECT episode_id, seg_idx, i, round(x * pow(10.0, -att / 20), 6) AS amp FROM cp"""

_M_THR, _M_RATIO, _M_ATT, _M_REL = FXV.MASTER_COMPRESSOR
_M_ATT_F, _M_REL_F = _M_ATT * COMP_RATE / 1000, _M_REL * COMP_RATE / 1000
_MASTER_SQL = f"""
    WITH RECURSIVE mx AS ({_MIX_SQL}),
    fd AS (SELECT m.episode_id, m.t, m.amp * (1.0 * least(1.0, (n.total - m.t) / 2000.0::DOUBLE)) AS x
           FROM mx m JOIN (SELECT episode_id, max(t) + 1 AS total FROM mx GROUP BY episode_id) n
             ON m.episode_id = n.episode_id),
    {_rec_compress("mc", "fd", "episode_id", _M_THR, _M_RATIO, _M_ATT_F, _M_REL_F, max(int(round(_M_ATT_F)), 1), "t")},
    out AS (SELECT episode_id, t, x * pow(10.0, -att / 20) AS y FROM mc)
    SELECT o.episode_id, o.t, round(CASE WHEN p.peak > 0 THEN (o.y / p.peak) * {H}::DOUBLE ELSE o.y END, 6) AS amp
    FROM out o JOIN (SELECT episode_id, max(abs(y)) AS peak FROM out GROUP BY episode_id) p
      ON o.episode_id = p.episode_id"""


@query("aud_segment_chain", _SEG_CHAIN_SQL)
def aud_segment_chain(spark, sf_dir):
    """Per-segment chain: normalise -> low-pass -> high-pass -> compress
    (24 kHz frames, segment compressor)."""
    w = FX.waves(spark, sf_dir)
    w = w.withColumn("samples", A.normalise(F.col("samples")))
    w = A.speaker_eq(w)
    w = w.withColumn("samples", A.compress_samples(F.col("samples"), *FXV.SEGMENT_COMPRESSOR,
                                                   float(FXV.SAMPLE_RATE)))
    f = A.to_frames(w.select("episode_id", "seg_idx", "samples"))
    return f.select("episode_id", "seg_idx", "i", F.round("amp", 6).alias("amp"))


@query("aud_master_chain", _MASTER_SQL)
def aud_master_chain(spark, sf_dir):
    """Master chain on the mixed episode: fade-out 2 s -> compress (-15 dB,
    1.5:1, 10 ms, 100 ms) -> normalise (1 frame = 1 ms)."""
    halo = B.look_back(FXV.MASTER_COMPRESSOR, COMP_RATE)
    return _frames(B.master_chain(_mix(spark, sf_dir, halo), COMP_RATE, BLOCK))


# ---- the whole episode at 100 frames a second; the waves are repeated so that they last 0.6 to 2.6 seconds.
# Each repeat is quieter: an exactly recurring level meets the jump of the compressor's rule (att <= m), where
# the last bit of a double decides.
EP_RATE = 100
_EP_SLICE, _EP_STEP = 100, 95


def _bed_sql(s: str, count: str, seg: str, volume: float) -> str:
    j = f"(i - {s} * {_EP_STEP})"
    over = _EP_SLICE - _EP_STEP
    gain = f"pow(10.0, ({volume}::DOUBLE + (-3.0::DOUBLE + 6.0::DOUBLE * (((7 * episode_id + 29 * ({seg} * 97 + {s})) % 10007 + 10007) % 10007 / 10007.0::DOUBLE))) / 20.0)"
    ramp = (f"(CASE WHEN {s} > 0 AND {j} < {over} THEN ({j} + 1) / {over + 1}.0::DOUBLE ELSE 1.0 END) * "
            f"(CASE WHEN {s} < {count} - 1 AND {j} >= {_EP_STEP} THEN ({_EP_SLICE} - {j}) / {over + 1}.0::DOUBLE ELSE 1.0 END)")
    tone = f"((({s} * {_EP_SLICE} + {j}) % 16 - 8) / 80.0::DOUBLE)"
    return f"CASE WHEN {s} >= 0 AND {s} < {count} AND {j} < {_EP_SLICE} THEN {tone} * {gain} * {ramp} ELSE 0.0 END"


def _with_bed(x: str, count: str, seg: str, volume: float) -> str:
    return f"{x} + {_bed_sql(f'(i // {_EP_STEP})', count, seg, volume)} + {_bed_sql(f'(i // {_EP_STEP} - 1)', count, seg, volume)}"


def _rate(ms: float) -> float:
    return ms * EP_RATE / 1000


_EPISODE_SQL = f"""
    WITH RECURSIVE src AS (
        SELECT episode_id, seg_idx, speaker, flatten([[x * (1 - z / 10.0::DOUBLE) for x in samples] for z in range(1 + (seg_idx * 3) % 4)]) AS samples
        FROM f_wave WHERE (episode_id * 31 + seg_idx) % 11 <> 0),
    okd AS (
        SELECT *, len(samples) AS n, lag(speaker) OVER (PARTITION BY episode_id ORDER BY seg_idx) AS prev
        FROM src WHERE len(samples) * 1000 // {EP_RATE} >= {FXV.MIN_AMBIENCE_MS}),
    seg AS (SELECT *, CASE WHEN prev IS NULL THEN 50 WHEN prev = speaker THEN 45 ELSE 30 END AS xf FROM okd),
    ex AS (SELECT episode_id, seg_idx, speaker, k AS i, samples[k + 1] AS amp FROM (SELECT *, unnest(range(len(samples))) AS k FROM seg)),
    nrm AS (
        SELECT f.episode_id, f.seg_idx, f.i, f.speaker, CASE WHEN p.peak > 0 THEN (f.amp / p.peak) * {H}::DOUBLE ELSE f.amp END AS x
        FROM ex f JOIN (SELECT episode_id, seg_idx, max(abs(amp)) AS peak FROM ex GROUP BY ALL) p
          ON f.episode_id = p.episode_id AND f.seg_idx = p.seg_idx),
    {_rec_filter("lp", "nrm", "episode_id, seg_idx", "low", float(EP_RATE))},
    hp_in AS (SELECT episode_id, seg_idx, i, speaker, y AS x FROM lp),
    {_rec_filter("hp", "hp_in", "episode_id, seg_idx", "high", float(EP_RATE))},
    cp_in AS (SELECT episode_id, seg_idx, i, y AS x FROM hp),
    {_rec_compress("cp", "cp_in", "episode_id, seg_idx", _THR, _RATIO, _rate(_ATT), _rate(_REL), max(int(round(_rate(_ATT))), 1))},
    voiced AS (SELECT episode_id, seg_idx, i, x * pow(10.0, -att / 20) AS x FROM cp),
    parts AS (
        SELECT v.episode_id, v.seg_idx, v.i, {_with_bed('x', '(n // 100)', 'v.seg_idx', FXV.ROOM_VOLUME_DB).replace('episode_id', 'v.episode_id')} AS x, n, xf
        FROM voiced v JOIN seg ON v.episode_id = seg.episode_id AND v.seg_idx = seg.seg_idx
        UNION ALL
        SELECT episode_id, -1, i, ({_with_bed('0.0', '2', '(-1)', FXV.INTRO_ROOM_VOLUME_DB)}) * least(1.0, i / 100.0::DOUBLE), 200, 0
        FROM (SELECT DISTINCT episode_id FROM seg), range(200) r(i)),
    lens AS (SELECT DISTINCT episode_id, seg_idx, n, xf FROM parts),
    place AS (
        SELECT *, sum(n - xf) OVER w - n AS start, coalesce(lead(xf) OVER (PARTITION BY episode_id ORDER BY seg_idx), 0) AS nxt
        FROM lens WINDOW w AS (PARTITION BY episode_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    mx AS (
        SELECT p.episode_id, CAST(q.start + p.i AS BIGINT) AS t,
               sum(p.x * (CASE WHEN p.i < q.xf THEN (p.i + 1) / (q.xf + 1.0::DOUBLE) ELSE 1.0 END)
                   * (CASE WHEN p.i >= q.n - q.nxt THEN (q.n - p.i) / (q.nxt + 1.0::DOUBLE) ELSE 1.0 END)) AS amp
        FROM parts p JOIN place q ON p.episode_id = q.episode_id AND p.seg_idx = q.seg_idx GROUP BY ALL),
    fd AS (
        SELECT m.episode_id, m.t, m.amp * least(1.0, (n.total - m.t) / 200.0::DOUBLE) AS x
        FROM mx m JOIN (SELECT episode_id, max(t) + 1 AS total FROM mx GROUP BY episode_id) n ON m.episode_id = n.episode_id),
    {_rec_compress("mc", "fd", "episode_id", _M_THR, _M_RATIO, _rate(_M_ATT), _rate(_M_REL), max(int(round(_rate(_M_ATT))), 1), "t")},
    out AS (SELECT episode_id, t, x * pow(10.0, -att / 20) AS y FROM mc)
    SELECT o.episode_id, o.t, round(CASE WHEN p.peak > 0 THEN (o.y / p.peak) * {H}::DOUBLE ELSE o.y END, 6) AS amp
    FROM out o JOIN (SELECT episode_id, max(abs(y)) AS peak FROM out GROUP BY episode_id) p ON o.episode_id = p.episode_id"""


@query("flow_episode_audio", _EPISODE_SQL)
def flow_episode_audio(spark, sf_dir):
    """Flow D: voice chain, room ambience, dynamic crossfades onto the intro,
    master, at 100 frames a second (segments repeated to last 0.6 to 2.6 s)."""
    from parley.plans.flows import flow_d
    w = FX.waves(spark, sf_dir)
    repeat = lambda z: F.transform("samples", lambda x: x * (F.lit(1.0) - z / F.lit(10.0)))
    w = w.withColumn("samples", F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("seg_idx") * 3 % 4), repeat)))
    w = w.withColumn("ok", (F.col("episode_id") * 31 + F.col("seg_idx")) % 11 != 0)
    return _frames(flow_d(w, _tone(), float(EP_RATE)), block_frames=EP_RATE)


def _gaps_sql(crossfade: int, pause: str) -> str:
    """The assembled episodes, a row a frame: ``episode_id, t, x``."""
    gap = int(_rate(FXV.GAP_MS))
    return f"""
    s AS (
        SELECT episode_id, seg_idx, samples, len(samples) AS n, (episode_id * 31 + seg_idx) % 11 <> 0 AS ok,
               CASE WHEN seg_idx > 0 THEN {gap} ELSE 0 END AS gap, CASE WHEN seg_idx > 0 THEN {crossfade} ELSE 0 END AS xf,
               CASE WHEN seg_idx > 0 THEN {pause} ELSE 0 END AS pause FROM f_wave),
    p AS (
        SELECT *, sum(gap + CASE WHEN ok THEN n - xf + pause ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY seg_idx
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM s),
    x AS (
        SELECT episode_id, e - pause - n + k AS t, samples[k + 1] * CASE WHEN k < xf THEN (k + 1) / (xf + 1.0::DOUBLE) ELSE 1.0 END AS x
        FROM (SELECT *, unnest(range(n)) AS k FROM p WHERE ok)),
    a AS (
        SELECT f.episode_id, f.t, coalesce(x.x, 0.0) AS x
        FROM (SELECT episode_id, unnest(range(CAST(max(e) AS BIGINT))) AS t FROM p GROUP BY episode_id HAVING bool_or(ok)) f
             LEFT JOIN x ON x.episode_id = f.episode_id AND x.t = f.t)"""


def _synthesised(spark, sf_dir):
    ok = (F.col("episode_id") * 31 + F.col("seg_idx")) % 11 != 0
    return FX.waves(spark, sf_dir).select("episode_id", "seg_idx", F.when(ok, F.col("samples")).alias("samples"))


@query("flow_episode_gaps", f"WITH {_gaps_sql(0, '0')} SELECT episode_id, t, round(x, 6) AS amp FROM a")
def flow_episode_gaps(spark, sf_dir):
    """Flow F: the assembled episodes of the variant with gaps only, at 100
    frames a second; every eleventh segment failed."""
    from parley.plans.flows import flow_f
    return _frames(flow_f(_synthesised(spark, sf_dir), float(EP_RATE)), block_frames=EP_RATE)


_PAUSE_SQL = f"((episode_id * 17 + seg_idx * 13) % 600 + 200) * {EP_RATE} // 1000"


@query("flow_episode_pauses", f"""
    WITH {_gaps_sql(int(_rate(FXV.BASE_CROSSFADE_MS)), _PAUSE_SQL)}
    SELECT a.episode_id, a.t, round(CASE WHEN p.peak > 0 THEN a.x / p.peak * {H}::DOUBLE ELSE a.x END, 6) AS amp
    FROM a JOIN (SELECT episode_id, max(abs(x)) AS peak FROM a GROUP BY episode_id) p ON a.episode_id = p.episode_id""")
def flow_episode_pauses(spark, sf_dir):
    """Flow E: the assembled episodes of the variant with gaps, crossfades into
    them, pauses and a final normalisation, at 100 frames a second."""
    from parley.plans.flows import flow_e
    pause = (F.col("episode_id") * 17 + F.col("seg_idx") * 13) % 600 + 200
    return _frames(flow_e(_synthesised(spark, sf_dir), pause, float(EP_RATE)), block_frames=EP_RATE)


_EQ_SQL = f"""
    WITH RECURSIVE eq_in AS (
        SELECT episode_id, t AS i, CASE WHEN episode_id % 2 = 0 THEN 'Speaker 1' ELSE 'Speaker 2' END AS speaker, amp AS x FROM ({_MIX_SQL})),
    {_rec_filter("lp", "eq_in", "episode_id", "low", _SR)},
    hp_in AS (SELECT episode_id, i, speaker, y AS x FROM lp),
    {_rec_filter("hp", "hp_in", "episode_id", "high", _SR)}
    SELECT episode_id, i AS t, round(y, 6) AS amp FROM hp"""


@query("aud_filter_blocks", _EQ_SQL)
def aud_filter_blocks(spark, sf_dir):
    """Both filters over whole mixed episodes in blocks: each block is an affine
    map of the state before it (4 kHz and 100 Hz for even episodes, 5 kHz and
    150 Hz for odd ones, at 24 kHz)."""
    from parley.session import cut_lineage
    even = F.col("episode_id") % 2 == 0
    cutoff = lambda of: F.when(even, of["Speaker 1"]).otherwise(of["other"])
    low = B.low_pass(cut_lineage(_mix(spark, sf_dir), "mixed"), cutoff(FXV.LOW_PASS_HZ), _SR, BLOCK)
    return _frames(B.high_pass(cut_lineage(low, "low"), cutoff(FXV.HIGH_PASS_HZ), _SR, BLOCK))
