"""Long signals as blocks of samples.

A signal is a table of blocks: ``episode_id``, ``block`` (its frames are
``block * block_frames`` and on), ``lead``, ``total`` (frames of the whole
signal), ``peak`` (largest absolute own sample) and ``samples``.  The first
``lead`` samples repeat the end of what lies before the block (its halo), so that an
operator that looks back a little needs no exchange.  With blocks of a second
an hour is 3,600 rows, and an episode of any length is spread over many tasks.

* :func:`assemble` cuts placed segments at the block borders, deals the pieces
  out by (episode, block) and sums them: crossfades, gaps and halos in one
  shuffle of arrays.
* Pointwise operators (:func:`fade`, :func:`normalise`, :func:`ambience`) are
  narrow.
* Operators with a memory (:func:`low_pass`, :func:`high_pass`,
  :func:`compress`) turn each block into a small function of the state before
  it: an affine map for the filters, a piecewise map for the compressor.
  :func:`states` applies these in order, a row a block, and the blocks are then
  computed side by side from the state that each begins with.

The definitions are those of :mod:`parley.operators.audio`.  Segments without
samples, episode or index are not placed; a null sample counts as not a number.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import audio_math as M
from parley.functions import fixed as FX
from parley.operators import audio as A
from parley.operators.dims import join_small

KEY, IDX = A.KEY, A.IDX
SECOND = FX.SAMPLE_RATE


# ------------------------------------------------------------------- helpers
def arrays(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column, as views."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def list_column(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64()))


def top(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if len(x) else 0.0


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


BLOCK = "block long, lead int, total long, peak double, samples array<double>"


def block_rows(keys: pa.Array, rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    """A batch of blocks from (block, lead, total, samples)."""
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
            pa.array([top(r[3][r[1]:]) for r in rows], pa.float64()), list_column([r[3] for r in rows])]
    return pa.RecordBatch.from_arrays([keys, *cols], names=[KEY, "block", "lead", "total", "peak", "samples"])


# ------------------------------------------------------------------ assembly
def ramped(x: np.ndarray, own: int, following: int) -> np.ndarray:
    """A segment with linear ramps over the frames it shares with the segment
    before and the one after."""
    if own or following:
        x = np.array(x)
        n = len(x)
        if own:
            x[:own] *= (np.arange(min(own, n)) + 1) / (own + 1.0)
        if following:
            i = np.arange(max(n - following, 0), n)
            x[i] *= (n - i) / (following + 1.0)
    return x


def assemble(placed: DataFrame, block_frames: int = SECOND, halo: int = 0, gaps: bool = False) -> DataFrame:
    """Blocks of the sum of placed segments (``episode_id, seg_idx, samples``,
    ``start``, ramps ``own`` and ``following``, ``total``; see
    :func:`parley.operators.audio.place_segments`).  With ``gaps`` the segments
    need not meet: blocks without any are silent."""
    kind = _kind(placed, KEY)
    seg = placed.select(KEY, F.col(IDX).cast("long").alias(IDX), *[F.col(c).cast("long").alias(c) for c in ("start", "own", "following", "total")], "samples")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, (i, s, own, following, total, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), arrays(batch.column(6)))):
                x = ramped(x, own, following)
                for b in range(s // block_frames, min((s + len(x) - 1 + halo) // block_frames, (total - 1) // block_frames) + 1):
                    first = b * block_frames - min(halo, b * block_frames)
                    a, e = max(first - s, 0), min((b + 1) * block_frames - s, len(x))
                    if a < e:
                        rows.append((r, b, i, total, s + a - first, x[a:e]))
            cols = [pa.array([x[c] for x in rows], pa.int64()) for c in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(cols[0]), *cols[1:], list_column([x[5] for x in rows])],
                                             names=[KEY, "block", IDX, "total", "at", "samples"])

    pieces = seg.mapInArrow(cut, f"{KEY} {kind}, block long, {IDX} long, total long, at long, samples array<double>")
    if gaps:
        signals = seg.groupBy(KEY).agg(F.max("total").alias("total")).where("total > 0")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_frames)))
        none = F.array().cast("array<double>")
        pieces = pieces.unionByName(signals.select(KEY, every.alias("block"), F.lit(0).cast("long").alias(IDX), "total", F.lit(0).cast("long").alias("at"),
                                                   none.alias("samples")))
    dealt = pieces.repartition(KEY, "block").sortWithinPartitions(KEY, "block", IDX, "at")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, total, lead, whole = None, None, 0, 0, None
        for batch in batches:
            keys, done = batch.column(0), []
            for k, b, n, place, x in zip(keys.to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(),
                                         arrays(batch.column(5))):
                if whole is None or (k, b) != (key, at):
                    if whole is not None:
                        done.append((key, at, lead, total, whole))
                    key, at, total, lead = k, b, n, min(halo, b * block_frames)
                    whole = np.zeros(lead + min(block_frames, n - b * block_frames))
                whole[place:place + len(x)] += x
            if done:
                yield block_rows(pa.array([d[0] for d in done], keys.type), [d[1:] for d in done])
        if whole is not None:
            yield block_rows(pa.array([key], keys.type), [(at, lead, total, whole)])

    return dealt.mapInArrow(add, f"{KEY} {kind}, {BLOCK}")


def mix(waves: DataFrame, crossfade: int | str, block_frames: int = SECOND, halo: int = 0) -> DataFrame:
    """Segments appended in order, each with its crossfade."""
    return assemble(A.place_segments(waves, crossfade), block_frames, halo)


def silence(episodes: DataFrame, n_frames: int, block_frames: int = SECOND, frames_per_task: int = 4_000_000) -> DataFrame:
    """``n_frames`` frames of silence for each row of ``episodes``.  The few keys
    that Spark would leave in one task are dealt out by the frames that come of
    them (one count of the keys)."""
    long = lambda x: F.lit(x).cast("long")
    keys = episodes.select(KEY)
    tasks = max(-(-keys.count() * n_frames // frames_per_task), keys.sparkSession.sparkContext.defaultParallelism)
    b = keys.repartition(tasks, KEY).select(KEY, F.explode(F.sequence(long(0), long((n_frames - 1) // block_frames))).alias("block"))
    size = F.least(long(block_frames), long(n_frames) - F.col("block") * block_frames).cast("int")
    return b.select(KEY, "block", F.lit(0).alias("lead"), long(n_frames).alias("total"), F.lit(0.0).alias("peak"), A.silence(size).alias("samples"))


def frames(blocks: DataFrame, block_frames: int = SECOND) -> DataFrame:
    """A row for each frame: ``episode_id, t, amp``."""
    own = F.slice("samples", F.col("lead") + 1, F.size("samples"))
    rows = blocks.select(KEY, "block", F.posexplode_outer(own).alias("_i", "amp")).where(F.col("_i").isNotNull())
    return rows.select(KEY, (F.col("block") * block_frames + F.col("_i")).alias("t"), "amp")


# ------------------------------------------------------ pointwise operators
def map_blocks(blocks: DataFrame, fn: Callable[..., np.ndarray], block_frames: int, *more: Column, halos: bool = True) -> DataFrame:
    """Blocks with the samples ``fn(samples, first frame, total, *more)``, in
    one narrow pass; ``more``: values of the row.  Without ``halos`` the function
    returns a block's own samples only."""
    rows, n = blocks.select(KEY, "block", "lead", "total", "samples", *[c.alias(f"_more{i}") for i, c in enumerate(more)]), len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = [batch.column(5 + i).to_pylist() for i in range(n)]
            rows = list(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), arrays(batch.column(4)), *extra))
            yield block_rows(batch.column(0), [(b, lead * halos, total, fn(x, b * block_frames - lead, total, *rest)) for b, lead, total, x, *rest in rows])

    return rows.mapInArrow(run, f"{KEY} {_kind(blocks, KEY)}, {BLOCK}")


def fade(blocks: DataFrame, fade_in: int, fade_out: int, block_frames: int = SECOND) -> DataFrame:
    """Linear fade-in over the first and fade-out over the last frames."""
    def run(x: np.ndarray, first: int, total: int) -> np.ndarray:
        t = first + np.arange(len(x))
        gain = np.minimum(1.0, t / fade_in) if fade_in > 0 else 1.0
        return x * (gain * (np.minimum(1.0, (total - t) / fade_out) if fade_out > 0 else 1.0))
    return map_blocks(blocks, run, block_frames)


def scaled(blocks: DataFrame, gain: Column, block_frames: int = SECOND) -> DataFrame:
    """Blocks times a value of the row."""
    return map_blocks(blocks, lambda x, _, __, g: x * g, block_frames, gain)


def normalise(blocks: DataFrame, block_frames: int = SECOND) -> DataFrame:
    """Each signal scaled to a peak of -0.1 dBFS; silence stays.  The peak of a
    signal is the largest of its blocks' peaks, which are columns; ``blocks``
    should be stored, as it is read twice."""
    peak = blocks.groupBy(KEY).agg(F.max("peak").alias("_peak"))
    rows = join_small(blocks, peak, KEY)
    return map_blocks(rows, lambda x, _, __, p: x / p * A.HEADROOM if p > 0 else x, block_frames, F.col("_peak"))


def ambience(blocks: DataFrame, tone: list[float], volume_db: float, slice_frames: int = FX.ROOM_SLICE_MS,
             xfade: int = FX.ROOM_SLICE_CROSSFADE_MS, jitter_db: float = FX.ROOM_JITTER_DB, block_frames: int = SECOND) -> DataFrame:
    """Room ambience under whole signals: the tone, looped, in whole slices of
    ``slice_frames`` with a keyed gain each, joined with crossfades; the end of
    the signal gets none (see :func:`parley.operators.audio.ambience_bed`).  A
    block computes the slices that reach into it; ``tone`` is one short
    recording and travels with the function."""
    wave, step = np.asarray(tone, float), slice_frames - xfade
    if not wave.size:
        return blocks
    begin = F.col("block") * block_frames - F.col("lead")
    first = F.greatest(F.floor(begin / step) - 1, F.lit(0))
    last = F.greatest(F.floor((begin + F.size("samples")) / step), first)
    gains = F.transform(F.sequence(first, last), lambda s: M.db_to_gain(F.lit(volume_db) + M.keyed_uniform(-jitter_db, jitter_db, F.col(KEY), s, 7, 29)))
    ramp = np.arange(1, xfade + 1) / (xfade + 1.0)

    def run(x: np.ndarray, at: int, total: int, low: int, gain: list[float]) -> np.ndarray:
        count, x = total // slice_frames, np.array(x)
        for s in range(low, min(low + len(gain), count)):
            a, e = max(at, s * step), min(at + len(x), s * step + slice_frames)
            if a < e:
                j = np.arange(a - s * step, e - s * step)
                part = wave[(s * slice_frames + j) % wave.size] * gain[s - low]
                if s > 0:
                    part[j < xfade] *= ramp[j[j < xfade]]
                if s < count - 1:
                    part[j >= step] *= ramp[::-1][j[j >= step] - step]
                x[a - at:e - at] += part
        return x

    return map_blocks(blocks, run, block_frames, first, gains)


# --------------------------------------------------- operators with a memory
def summaries(blocks: DataFrame, fn: Callable[..., list[float]], *more: Column) -> DataFrame:
    """``episode_id, block, f``: the numbers that ``fn(samples, lead, *more)``
    gives for each block."""
    rows, n = blocks.select(KEY, "block", "lead", "samples", *[c.alias(f"_more{i}") for i, c in enumerate(more)]), len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = [batch.column(4 + i).to_pylist() for i in range(n)]
            out = [np.array(fn(x, lead, *rest), float) for lead, x, *rest in zip(batch.column(2).to_pylist(), arrays(batch.column(3)), *extra)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_column(out)], names=[KEY, "block", "f"])

    return rows.mapInArrow(run, f"{KEY} {_kind(blocks, KEY)}, block long, f array<double>")


def states(functions: DataFrame, step: Callable[[list[float] | None, np.ndarray], list[float]]) -> DataFrame:
    """``episode_id, block, state``: the state that each block begins with (null
    for the first).  ``step(state, f)`` gives the state behind a block.  A row a
    block is shuffled, in order, and only one state is held."""
    dealt = functions.repartition(KEY).sortWithinPartitions(KEY, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, f in zip(batch.column(0).to_pylist(), arrays(batch.column(2))):
                if k != key:
                    key, state = k, None
                out.append(state)
                state = step(state, f)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=[KEY, "block", "state"])

    return dealt.mapInArrow(run, f"{KEY} {_kind(functions, KEY)}, block long, state array<double>")


def with_state(blocks: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """Blocks with the numbers ``_s0`` and on of their states: broadcast if they
    are few (some words a block), else joined by shuffle."""
    return join_small(blocks, state.select(KEY, "block", *[F.get("state", F.lit(i)).alias(f"_s{i}") for i in range(width)]), [KEY, "block"])


def _low(cutoff: float, rate: float) -> float:
    """Factor of the new sample in the low-pass."""
    rc, dt = 1.0 / (2 * math.pi * cutoff), 1.0 / rate
    return dt / (rc + dt)


def low_pass(blocks: DataFrame, cutoff: Column, rate: float, block_frames: int = SECOND) -> DataFrame:
    """First-order low-pass of whole signals.  A block maps the output before
    it, y, to p^n y + b.  ``blocks`` should be stored, as it is read twice; the
    result has no halos.  ``cutoff`` is one value for each signal."""
    def affine(x: np.ndarray, lead: int, fc: float) -> list[float]:
        a, x = _low(fc, rate), x[lead:]
        return [(1 - a) ** len(x), A._solve_first_order(1 - a, np.concatenate([[0.0], a * x]), 0.0)[-1], x[0] if len(x) else 0.0]

    def step(state, f):
        return [f[0] * (f[2] if state is None else state[0]) + f[1]]  # the first output is the first input

    def run(x: np.ndarray, _, __, lead: int, fc: float, y: float | None) -> np.ndarray:
        a, x = _low(fc, rate), x[lead:]
        if not len(x):
            return x
        return A._solve_first_order(1 - a, np.concatenate([[0.0], a * x]), x[0] if y is None else y)[1:]

    rows = with_state(blocks, states(summaries(blocks, affine, cutoff.cast("double")), step), 1)
    return map_blocks(rows, run, block_frames, F.col("lead"), cutoff.cast("double"), F.col("_s0"), halos=False)


def high_pass(blocks: DataFrame, cutoff: Column, rate: float, block_frames: int = SECOND) -> DataFrame:
    """First-order high-pass of whole signals.  A block maps the output y and
    the input x before it to p^n (y - x) + b.  ``blocks`` should be stored, as
    it is read twice; the result has no halos."""
    def changes(x: np.ndarray, a: float, before: float) -> np.ndarray:
        return a * np.diff(np.concatenate([[before], x]))

    def affine(x: np.ndarray, lead: int, fc: float) -> list[float]:
        a, x = 1 - _low(fc, rate), x[lead:]
        if not len(x):
            return [1.0, 0.0, 0.0, 0.0, a]
        return [a ** len(x), A._solve_first_order(a, np.concatenate([[0.0], changes(x, a, 0.0)]), 0.0)[-1], x[0], x[-1], a]

    def begin(first: float, a: float) -> tuple[float, float]:
        return first / a, first  # the first output is the first input

    def step(state, f):
        y, x = begin(f[2], f[4]) if state is None else state
        return [f[0] * (y - x) + f[1], f[3]]

    def run(x: np.ndarray, _, __, lead: int, fc: float, y: float | None, before: float | None) -> np.ndarray:
        a, x = 1 - _low(fc, rate), x[lead:]
        if not len(x):
            return x
        y, before = begin(x[0], a) if y is None else (y, before)
        return A._solve_first_order(a, np.concatenate([[0.0], changes(x, a, before)]), y)[1:]

    rows = with_state(blocks, states(summaries(blocks, affine, cutoff.cast("double")), step), 2)
    return map_blocks(rows, run, block_frames, F.col("lead"), cutoff.cast("double"), F.col("_s0"), F.col("_s1"), halos=False)


class AttenuationMap:
    """How a stretch of signal takes the attenuation before it, from 0 to
    ``most``, to that behind it: pieces up to ``upto`` (inclusive), on each of
    which the result is either the input plus ``value`` or ``value`` itself.

    One frame raises an attenuation up to its target and lowers one above it by
    a fixed amount, so it shifts a piece, and cuts off what reaches the target
    (or 0), where all inputs give the same.  Loud frames thus soon leave few
    pieces, often a single value."""

    def __init__(self, most: float):
        self.upto, self.moves, self.value = [most], [True], [0.0]

    def frame(self, target: float, up: float, down: float) -> None:
        """A frame of positive ``target``, with steps ``up`` and ``down``."""
        upto, moves, value, low = [], [], [], 0.0

        def put(u: float, m: bool, v: float) -> None:
            if moves and not m and not moves[-1] and value[-1] == v:
                upto[-1] = u
            else:
                upto.append(u)
                moves.append(m)
                value.append(v)

        for u, m, v in zip(self.upto, self.moves, self.value):
            if not m:
                put(u, False, min(v + up, target) if v <= target else max(v - down, 0.0))
            else:
                edge = target - v              # inputs up to here have reached at most the target
                if edge >= low:                # the lowest input of a piece is the end of the one before
                    rise = edge - up
                    if rise > low:
                        put(min(rise, u), True, v + up)
                    if rise < u:
                        put(min(edge, u), False, target)
                if edge < u:
                    if max(edge, low) + v < down:
                        put(min(down - v, u), False, 0.0)
                    if u + v > down:
                        put(u, True, v - down)
            low = u
        self.upto, self.moves, self.value = upto, moves, value

    def numbers(self) -> list[float]:
        return [*self.upto, *map(float, self.moves), *self.value]

    @staticmethod
    def apply(numbers: np.ndarray, before: float) -> float:
        n = len(numbers) // 3
        k = min(bisect_left(numbers[:n], before), n - 1)
        return float(numbers[2 * n + k] + (before if numbers[n + k] else 0.0))


def attenuation_map(targets: np.ndarray, attack: float, release: float, most: float) -> AttenuationMap:
    """The map of consecutive frames with these targets; attack and release in
    frames, 0 for at once."""
    m = AttenuationMap(most)
    loud = targets[targets > 0]
    for at, target in enumerate(loud.tolist()):
        if len(m.upto) == 1 and not m.moves[0]:  # one value is left
            m.value[0] = A.attenuations(loud[at:], m.value[0], attack, release)[-1]
            break
        m.frame(target, target / attack if attack > 0 else target, target / release if release > 0 else math.inf)
    return m


def look_back(params: tuple[float, float, float, float], rate: float) -> int:
    """Frames that the compressor's level looks back: the halo it needs."""
    return max(int(round(params[2] * rate / 1000.0)), 1)


def compress(blocks: DataFrame, threshold_db: float, ratio: float, attack_ms: float, release_ms: float, rate: float,
             block_frames: int = SECOND) -> DataFrame:
    """Compressor over whole signals (the definition of
    :mod:`parley.operators.audio`); the halos must hold :func:`look_back`
    frames.  The frames of a block are composed to one map of the attenuation.
    ``blocks`` should be stored, as it is read twice; the result has no halos."""
    attack, release = attack_ms * rate / 1000.0, release_ms * rate / 1000.0
    look = look_back((threshold_db, ratio, attack_ms, release_ms), rate)

    def targets(x: np.ndarray, lead: int, block: int) -> np.ndarray:
        if lead < min(look, block * block_frames):
            raise ValueError(f"the compressor looks back {look} frames, the halo has {lead}")
        return A.attenuation_targets(x[lead:], (x[:lead] * x[:lead])[-look:], threshold_db, ratio, look)[0]

    def function(x: np.ndarray, lead: int, block: int, peak: float) -> list[float]:
        # No level is above the peak of the signal, so no attenuation is above its target.
        most = (1 - 1 / ratio) * max(0.0, 20 * math.log10(peak / 10 ** (threshold_db / 20))) if peak > 0 else 0.0
        return attenuation_map(targets(x, lead, block), attack, release, most * (1 + 1e-9)).numbers()

    def run(x: np.ndarray, first: int, __, lead: int, block: int, before: float | None) -> np.ndarray:
        att = A.attenuations(targets(x, lead, block), before or 0.0, attack, release)
        return x[lead:] * 10 ** (-np.asarray(att) / 20)

    highest = join_small(blocks, blocks.groupBy(KEY).agg(F.max("peak").alias("_top")), KEY)
    functions = summaries(highest, function, F.col("block"), F.col("_top"))
    rows = with_state(blocks, states(functions, lambda s, f: [AttenuationMap.apply(f, s[0] if s else 0.0)]), 1)
    return map_blocks(rows, run, block_frames, F.col("lead"), F.col("block"), F.col("_s0"), halos=False)


def master_chain(blocks: DataFrame, rate: float, block_frames: int = SECOND, materialize=None) -> DataFrame:
    """Episode mastering: fade-out 2 s -> compressor (-15 dB, 1.5:1, 10 ms,
    100 ms) -> peak normalisation.  The inputs of the last two steps are read
    more than once and stored by ``materialize`` (the shared checkpoint folder)."""
    from parley.session import cut_lineage
    materialize = materialize or cut_lineage
    faded = materialize(fade(blocks, 0, int(FX.OUTRO_FADE_OUT_MS * rate / 1000), block_frames), "faded")
    done = materialize(compress(faded, *FX.MASTER_COMPRESSOR, rate, block_frames), "compressed")
    return normalise(done, block_frames)
