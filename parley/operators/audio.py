"""Audio of segments: waveforms as arrays (``array<double>`` per segment).

Per-segment work (gain, peak, normalisation, filters, compressor, ambience) is
narrow.  Whole episodes are blocks of samples, see
:mod:`parley.operators.blocks`.  Definitions are our own (full scale is 1.0):

* crossfade of ``c`` frames: the incoming head frame ``i < c`` is scaled by
  ``(i+1)/(c+1)``, the outgoing tail frame ``i >= n-c`` by ``(n-i)/(c+1)``;
  overlapping frames are summed;
* low-pass ``y0 = x0, y_i = y_{i-1} + a (x_i - y_{i-1})``, ``a = dt/(RC+dt)``;
  high-pass ``y0 = x0, y_i = a (y_{i-1} + x_i - x_{i-1})``, ``a = RC/(RC+dt)``,
  ``RC = 1/(2 pi f_c)``;
* compressor: level ``L_i`` = RMS of the ``look`` previous frames, target
  ``m_i = (1 - 1/ratio) * max(0, 20 log10(L_i / thr))`` dB; the attenuation
  rises to ``min(att + m_i/attack, m_i)`` where ``L_i > thr`` and
  ``att <= m_i``, else falls to ``max(att - m_i/release, 0)`` (attack and
  release in frames), output ``x_i * 10^(-att_i/20)``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from parley.functions import audio_math as M
from parley.functions import fixed as FX
from parley.operators.dims import bounded_broadcast, join_small
from parley.operators.scan import composite_scan

KEY = "episode_id"
IDX = "seg_idx"
HEADROOM = 10 ** (-FX.NORMALISE_HEADROOM_DB / 20)


# ------------------------------------------------------------------ array form
def peak(samples: Column) -> Column:
    """Largest absolute sample of an array (0 for an empty array)."""
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0))


def apply_gain(samples: Column, gain: Column) -> Column:
    return F.transform(samples, lambda x: x * gain)


def normalise(samples: Column) -> Column:
    """Scale to a peak of -0.1 dBFS; silent input is returned unchanged.
    ``(x / peak) * headroom`` stays finite even for a subnormal peak."""
    p = peak(samples)
    return F.when(p > 0, F.transform(samples, lambda x: (x / p) * F.lit(HEADROOM))).otherwise(samples)


def quantise(x: Column) -> Column:
    """PCM16 value: clamp to the int16 range, then truncate toward zero."""
    return M.clip(x * FX.PCM_MAX, float(FX.PCM_MIN), float(FX.PCM_MAX)).cast("smallint")


def silence(n_frames: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n_frames)


def slices(samples: Column, frames: int) -> Column:
    """Consecutive slices of ``frames`` samples (the last may be short)."""
    n = F.size(samples)
    idx = F.sequence(F.lit(0), F.floor((n - 1) / F.lit(frames)).cast("int"))
    return F.when(n > 0, F.transform(idx, lambda i: F.slice(samples, i * frames + 1, F.lit(frames))))


def resample(samples: Column, rate: Column) -> Column:
    """Linear interpolation at positions j / rate, j = 0 .. floor((n-1) * rate)."""
    n = F.size(samples)
    m = F.floor((n - 1) * rate).cast("int")

    def at(j):
        x = j / rate
        i0 = F.floor(x).cast("int")
        frac = x - i0
        a = F.element_at(samples, i0 + 1)
        b = F.element_at(samples, F.least(i0 + 2, n))
        return a * (F.lit(1.0) - frac) + b * frac
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), m), at))


def _solve_first_order(p: float, q: np.ndarray, y0: float, block: int | None = None) -> np.ndarray:
    """y_0 = y0, y_i = p * y_{i-1} + q_i (i >= 1), vectorised per block.

    Within a block of length L the solution is a cumulative sum scaled by
    powers of p; L is chosen so that p^-(L-1) stays far inside the double
    range (at most 256)."""
    n = q.shape[0]
    y = np.empty(n)
    if n == 0:
        return y
    y[0] = y0
    if p < 1e-3:                       # tiny p: powers would overflow; plain loop
        for i in range(1, n):
            y[i] = p * y[i - 1] + q[i]
        return y
    if block is None:
        block = 256 if p >= 1.0 else max(1, min(256, int(200 / math.log10(1 / p))))
    pw = p ** np.arange(1, block + 1)  # p^1 .. p^L
    inv = p ** -np.arange(0, block)    # p^0 .. p^-(L-1)
    carry = y0
    for s in range(1, n, block):
        qb = q[s:s + block]
        L = qb.shape[0]
        acc = np.cumsum(qb * inv[:L]) * (pw[:L] / p)
        yb = pw[:L] * carry + acc
        y[s:s + L] = yb
        carry = yb[-1]
    return y


def low_pass_array(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    rc = 1.0 / (2 * math.pi * cutoff)
    dt = 1.0 / rate
    a = dt / (rc + dt)
    if x.size == 0:
        return x
    return _solve_first_order(1.0 - a, a * x, float(x[0]))


def high_pass_array(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    rc = 1.0 / (2 * math.pi * cutoff)
    dt = 1.0 / rate
    a = rc / (rc + dt)
    if x.size == 0:
        return x
    q = np.empty_like(x)
    q[0] = 0.0
    q[1:] = a * (x[1:] - x[:-1])
    return _solve_first_order(a, q, float(x[0]))


def _filter_series(fn):
    def run(samples: pd.Series, cutoff: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else fn(np.asarray(s, dtype=float), c, r)
                          for s, c, r in zip(samples, cutoff, rate)])
    return run


def low_pass(samples: Column, cutoff: Column, rate: Column) -> Column:
    """First-order low-pass per array (Arrow-batched pandas UDF)."""
    udf = pandas_udf(_filter_series(low_pass_array), ArrayType(DoubleType()))
    return udf(samples, cutoff.cast("double"), rate.cast("double"))


def high_pass(samples: Column, cutoff: Column, rate: Column) -> Column:
    udf = pandas_udf(_filter_series(high_pass_array), ArrayType(DoubleType()))
    return udf(samples, cutoff.cast("double"), rate.cast("double"))


def speaker_eq(df: DataFrame, samples: str = "samples", rate: Column | None = None) -> DataFrame:
    """Speaker-dependent EQ: low-pass 4 kHz / 5 kHz, then high-pass 100 / 150 Hz."""
    rate = rate if rate is not None else F.lit(float(FX.SAMPLE_RATE))
    first = F.col("speaker") == FX.SPEAKER_1
    lp = F.when(first, FX.LOW_PASS_HZ["Speaker 1"]).otherwise(FX.LOW_PASS_HZ["other"])
    hp = F.when(first, FX.HIGH_PASS_HZ["Speaker 1"]).otherwise(FX.HIGH_PASS_HZ["other"])
    d = df.withColumn(samples, low_pass(F.col(samples), lp, rate))
    return d.withColumn(samples, high_pass(F.col(samples), hp, rate))


# ------------------------------------------------------------------ long form
def to_frames(waves: DataFrame, samples: str = "samples", keys=(KEY, IDX)) -> DataFrame:
    """Array form -> one row per sample ``i``."""
    keep = [c for c in waves.columns if c != samples]
    return (waves.select(*keep, F.posexplode_outer(samples).alias("i", "amp"))
            .where(F.col("amp").isNotNull()))


def rolling_rms(frames: DataFrame, keys, order: str, look: int, out: str = "level",
                block_frames: int = 65_536) -> DataFrame:
    """RMS of the ``look`` previous frames of the same key (null on the first).

    The window runs per (key, block of ``block_frames`` positions); the last
    ``look`` frames of each block are copied into the next block as context,
    so a long signal is spread over many tasks and every window is exact.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    block_frames = max(block_frames, look)
    blk = F.floor(F.col(order) / block_frames)
    own = frames.withColumn("_blk", blk).withColumn("_own", F.lit(True))
    ctx = (frames.where((F.col(order) % block_frames) >= block_frames - look)
           .withColumn("_blk", blk + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(-look, -1)
    both = own.unionByName(ctx).withColumn(out, F.sqrt(F.avg(F.col("amp") * F.col("amp")).over(w)))
    return both.where("_own").drop("_blk", "_own")


def window_sums(v: np.ndarray, look: int) -> np.ndarray:
    """Sums of all ``look`` consecutive values, from prefix and suffix sums of
    blocks of ``look``.  Nothing is subtracted, so quiet passages after loud
    ones keep their precision."""
    m = -(-v.shape[0] // look) + 1
    b = np.zeros(m * look)
    b[:v.shape[0]] = v
    b = b.reshape(m, look)
    head = np.zeros_like(b)
    head[:, 1:] = np.cumsum(b, axis=1)[:, :-1]
    rest = np.cumsum(b[:, ::-1], axis=1)[:, ::-1]
    return (rest[:-1] + head[1:]).ravel()[:v.shape[0] - look + 1]


def attenuation_targets(x: np.ndarray, tail: np.ndarray, threshold_db: float, ratio: float, look: int) -> tuple[np.ndarray, np.ndarray]:
    """Target attenuation of each frame of a stretch, from the level of the
    ``look`` frames before it; ``tail`` holds the squares of up to ``look`` frames
    before the stretch.  Returns the targets and the squares at the end."""
    n = x.shape[0]
    sq = np.concatenate([tail, x * x])
    sums = window_sums(np.concatenate([np.zeros(look - tail.shape[0]), sq]), look)[:n]
    cnt = np.minimum(np.arange(n) + tail.shape[0], look)
    level = np.sqrt(sums / np.maximum(cnt, 1))
    over = 20 * np.log10(np.where(level > 0, level, 1.0) / 10 ** (threshold_db / 20))
    return (1 - 1 / ratio) * np.maximum(0.0, np.where(level > 0, over, 0.0)), sq[-look:]


def attenuations(targets: np.ndarray, att: float, attack_frames: float, release_frames: float) -> list[float]:
    """The attenuation behind each frame, from ``att`` before the first.  An
    attack or release of 0 frames moves at once."""
    # The update is sequential; iterate over Python floats (several times
    # faster per step than numpy scalars).
    out = []
    append = out.append
    for m in targets.tolist():
        if m > 0 and att <= m:
            att = min(att + m / attack_frames, m) if attack_frames > 0 else m
        elif m > 0:
            att = max(att - m / release_frames, 0.0) if release_frames > 0 else 0.0
        append(att)
    return out


def compress_array(x: np.ndarray, threshold_db: float, ratio: float, attack_frames: float,
                   release_frames: float, look: int) -> np.ndarray:
    """Sequential compressor over one array."""
    if not x.shape[0]:
        return x
    targets = attenuation_targets(x, np.zeros(0), threshold_db, ratio, look)[0]
    return x * 10 ** (-np.asarray(attenuations(targets, 0.0, attack_frames, release_frames)) / 20)


def compress_samples(samples: Column, threshold_db: float, ratio: float, attack_ms: float,
                     release_ms: float, frame_rate: float) -> Column:
    """Compressor applied to each array (one segment) in an Arrow-batched
    pandas UDF: no shuffle, the group is one row."""
    att_f, rel_f = attack_ms * frame_rate / 1000.0, release_ms * frame_rate / 1000.0
    look = max(int(round(att_f)), 1)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else
                          compress_array(np.asarray(x, dtype=float), threshold_db, ratio, att_f, rel_f, look)
                          for x in s])
    return pandas_udf(run, ArrayType(DoubleType()))(samples)


def crossfade_gain(i: Column, n: Column, own: Column, following: Column) -> Column:
    """Linear complementary ramps over the ``own`` frames shared with the
    segment before and the ``following`` frames shared with the one after
    (0 for none)."""
    fade_in = F.when(i < own, (i + 1) / (own + 1.0)).otherwise(F.lit(1.0))
    fade_out = F.when(i >= n - following, (n - i) / (following + 1.0)).otherwise(F.lit(1.0))
    return fade_in * fade_out


def _own_crossfade(crossfade: int | str) -> Column:
    return (F.col(crossfade) if isinstance(crossfade, str) else F.lit(crossfade)).cast("long")


def place_segments(waves: DataFrame, crossfade: int | str) -> DataFrame:
    """Episode start frame of each segment when appended in order, overlapping
    the one before by ``crossfade`` frames: a number, or the column that holds
    each segment's own crossfade (that of an episode's first segment does not
    count).  Adds n, start, total, and the overlaps ``own`` (with the segment before)
    and ``following`` (with the one after), 0 for none.  A segment shorter
    than its crossfade cannot be appended: it fails and is left out
    (:func:`too_short` lists them).

    The placement is one composite scan over (episode, segment, length), which
    also gives the ``total`` length of the episode; that table is joined
    back by (episode, segment) with a size-checked broadcast
    (:func:`join_small`), so the sample arrays are not shuffled for the
    placement."""
    waves = waves.where(F.size("samples") >= _own_crossfade(crossfade))
    meta = waves.select(KEY, IDX, F.size("samples").cast("long").alias("n"), _own_crossfade(crossfade).alias("_x"))
    none = F.lit(0).cast("long")
    advance = F.col("n") - F.col("_x")   # with the first crossfade counted as well
    local = [lambda w: {"_sum": F.coalesce(F.sum(advance).over(w.before), none), "_rank": F.count(F.lit(1)).over(w.before), "_lead": F.lead("_x").over(w.ordered)}]
    summary = {"_bs": F.sum(advance), "_bn": F.count(F.lit(1)), "_bx": F.min_by("_x", IDX)}
    carry = [lambda w: {"_cs": F.coalesce(F.sum("_bs").over(w.before), none), "_cn": F.coalesce(F.sum("_bn").over(w.before), none), "_cx": F.lead("_bx").over(w.ordered),
                        "_x0": F.first("_bx").over(w.upto), "_all": F.sum("_bs").over(w.whole)}]
    rows = composite_scan(meta.where(F.col(KEY).isNotNull() & F.col(IDX).isNotNull()), KEY, IDX, local, summary, carry, ["_cs", "_cn", "_cx", "_x0", "_all"])
    place = F.col("_cn") + F.col("_rank")
    # The crossfade of the next segment is one of its own: known before and after it.
    meta = rows.select(KEY, IDX, "n", (F.col("_cs") + F.col("_sum") - F.col("_x") + F.col("_x0")).alias("start"), F.when(place > 0, F.col("_x")).otherwise(none).alias("own"),
                       F.coalesce("_lead", "_cx", none).alias("following"), (F.col("_all") + F.col("_x0")).alias("total"))
    return join_small(waves, meta, [KEY, IDX])


def place_with_gaps(waves: DataFrame, gap: int, crossfade: int = 0, pause: Column | None = None) -> DataFrame:
    """Segments appended with ``gap`` frames of silence before every one after
    index 0 (also before failed ones), each fading in over the last
    ``crossfade`` frames of its gap and followed by ``pause`` frames of silence.
    A segment without samples, or shorter than its crossfade, fails: it takes
    its gap and is left out.  Adds start, own, following and total (see
    :func:`place_segments`) by one scan of the lengths."""
    if crossfade > gap:
        raise ValueError("a crossfade longer than the gap would reach the segment before")
    later, none = F.col(IDX) > 0, F.lit(0).cast("long")
    only_later = lambda x: F.when(later, x).otherwise(0).cast("long")
    n = F.coalesce(F.size("samples"), F.lit(0)).cast("long")
    ok = (n > 0) & (n >= only_later(F.lit(crossfade)))
    meta = waves.select(KEY, IDX, ok.alias("_ok"), only_later(F.lit(gap - crossfade)).alias("_before"), only_later(F.lit(crossfade)).alias("own"),
                        (only_later(F.lit(gap)) + F.when(ok, n + only_later((F.lit(0) if pause is None else pause) - F.lit(crossfade))).otherwise(none)).alias("_inc"))
    rows = composite_scan(meta.where(F.col(KEY).isNotNull() & F.col(IDX).isNotNull()), KEY, IDX,
                          [lambda w: {"_sum": F.coalesce(F.sum("_inc").over(w.before), none)}], {"_bs": F.sum("_inc")},
                          [lambda w: {"_cs": F.coalesce(F.sum("_bs").over(w.before), none), "total": F.sum("_bs").over(w.whole)}], ["_cs", "total"])
    placed = rows.where("_ok").select(KEY, IDX, (F.col("_cs") + F.col("_sum") + F.col("_before")).alias("start"), "own", none.alias("following"), "total")
    return join_small(waves, placed, [KEY, IDX])


def too_short(waves: DataFrame, crossfade: int | str) -> DataFrame:
    """Segments that the mix leaves out: no samples, or fewer than the crossfade."""
    return waves.where(F.coalesce(F.size("samples") < _own_crossfade(crossfade), F.lit(True))).select(KEY, IDX)


def crossfaded_frames(waves: DataFrame, crossfade: int | str) -> DataFrame:
    """Per-segment frames with their episode position ``t`` and ramp gain applied."""
    p = place_segments(waves, crossfade)
    f = to_frames(p.select(KEY, IDX, "samples", "n", "start", "own", "following"))
    g = crossfade_gain(F.col("i"), F.col("n"), F.col("own"), F.col("following"))
    return f.select(KEY, IDX, "i", (F.col("start") + F.col("i")).alias("t"), (F.col("amp") * g).alias("amp"),
                    ((F.col("i") < F.col("own")) | (F.col("i") >= F.col("n") - F.col("following"))).alias("_overlap"))


def looped_overlay(frames: DataFrame, tone: DataFrame, gain: Column, order: str = "t") -> DataFrame:
    """Add a looped tone under the whole signal: broadcast equi-join on
    ``t % tone_length``; the output keeps the base length."""
    n_tone = tone.count()
    if n_tone == 0:                       # no room tone: nothing to add
        return frames
    tb = bounded_broadcast(tone.select(F.col("t").alias("_tt"), F.col("amp").alias("_ta")))
    d = frames.join(tb, (F.col(order) % n_tone) == F.col("_tt"))
    return d.withColumn("amp", F.col("amp") + F.col("_ta") * gain).drop("_tt", "_ta")


def segment_ambience(samples: Column, tone: list[float], volume_db: float, key: Column, idx: Column, frame_rate: float,
                     jitter_db: float = FX.ROOM_JITTER_DB) -> Column:
    """Room ambience under one segment (array form): the tone, looped over the
    segment, is cut into whole slices of a second (a shorter tail is dropped);
    each gets ``volume_db`` and a jitter keyed by (``key``, ``idx``, slice), and
    they are joined with crossfades of 50 ms.  The bed is laid under the start
    of the segment, whose length stays.  ``tone`` is one short recording and
    travels with the function."""
    size = int(FX.ROOM_SLICE_MS * frame_rate / 1000)
    step = size - int(FX.ROOM_SLICE_CROSSFADE_MS * frame_rate / 1000)
    wave = np.asarray(tone, dtype=float)
    count = F.floor(F.size(samples) / F.lit(size)).cast("int")
    draw = lambda s: M.keyed_uniform(-jitter_db, jitter_db, key, idx * 97 + s, 7, 29)
    gains = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
                                          lambda s: M.db_to_gain(F.lit(volume_db) + draw(s))))

    def run(xs: pd.Series, gs: pd.Series) -> pd.Series:
        out = []
        over = size - step
        ramp = np.arange(1, over + 1) / (over + 1)
        for x, g in zip(xs, gs):
            if x is not None and g is not None and wave.size:
                x = np.array(x, dtype=float)
                for s, gain in enumerate(g):
                    part = wave[(s * size + np.arange(size)) % wave.size] * gain
                    if s > 0:
                        part[:over] *= ramp
                    if s < len(g) - 1:
                        part[step:] *= ramp[::-1]
                    x[s * step:s * step + size] += part
            out.append(x)
        return pd.Series(out)
    return pandas_udf(run, ArrayType(DoubleType()))(samples, gains)
