"""The dynamic timeline of episodes as a stream: state, timers and side tables.

Turns are placed strictly in index order, so the result does not depend on how
they are split into files or batches and equals the batch timeline.  The state
of an episode (``transformWithStateInPandas``) is one value (previous success,
end, next index), a map entry for each turn that arrived before an earlier one,
and a map entry for each gap that was given up.  A batch touches the entries of
its own turns only.

A timer ends a gap: when a turn has waited for ``wait_ms`` the gap before it is
given up and it is placed, also if no turn arrives any more (the query must be
running, see :func:`start_episode_state`; a finite run lets timers fire in the
next run).  Turns that were placed already (replays) are ignored.  A turn of a
gap that was given up is written once as ``late``.

What is not in the timeline is in a side table of the same run folder:
:func:`late_turns`, :func:`unplaced_turns` (no episode or no index; these never
reach the state, so many of them do not meet in one task),
:func:`turns_without_duration` (placed as failed turns, as in the batch
timeline) and :func:`waiting_turns`.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parley.functions import fixed as FX
from parley.session import make_folder, new_folder
from parley.streaming.ingest import arriving, run_available

CONV_SCHEMA = "conv_id long, turn long, role string, text string"
TURN = ["episode_id", "seg_idx", "speaker", "dur_ms", "ok"]
PLACED = ["episode_id", "seg_idx", "ok_eff", "prev_speaker", "xfade_ms", "end_ms"]
SINK = ("episode_id long, seg_idx long, ok_eff boolean, prev_speaker string, xfade_ms long, end_ms long, "
        "kind string, speaker string, dur_ms long, ok boolean")
COLUMNS = [c.split()[0] for c in SINK.split(", ")]
WAIT_MS = 3_600_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Turn = tuple[str | None, int | None, bool]  # speaker, duration, ok


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


class EpisodeTimeline(StatefulProcessor):
    """State and timer of one episode."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # n_ok: successes so far; timer_ms: when the present timer fires (-1: none); gap_end: behind the last gap given up (0: none)
        self.carry = handle.getValueState("carry", "prev_speaker string, n_ok long, end_ms long, next_idx long, n_waiting long, timer_ms long, gap_end long")
        self.waiting = handle.getMapState("waiting", "seg_idx long", "speaker string, dur_ms long, ok boolean, since_ms long")
        self.gaps = handle.getMapState("gaps", "first long", "behind long")

    def _load(self) -> None:
        c = self.carry.get() if self.carry.exists() else (None, 0, FX.INTRO_MS, 0, 0, -1, 0)
        self.prev, self.n_ok, self.end, self.next, self.n_waiting, self.timer, self.gap_end = c

    def _save(self) -> None:
        self.carry.update((self.prev, int(self.n_ok), int(self.end), int(self.next), int(self.n_waiting), int(self.timer), int(self.gap_end)))

    def _place(self, key: int, turn: Turn, out: list) -> None:
        """Write the turn of the next index."""
        speaker, dur, ok = turn
        good, before, xfade = bool(ok) and dur is not None and dur >= FX.MIN_AMBIENCE_MS, self.prev, 0
        if good:
            same = int(min(FX.MAX_CROSSFADE_MS, FX.BASE_CROSSFADE_MS * FX.SAME_SPEAKER_FACTOR))
            xfade = FX.FIRST_CROSSFADE_MS if not self.n_ok else same if speaker is not None and before == speaker else FX.BASE_CROSSFADE_MS
            self.end, self.prev, self.n_ok = self.end + dur - xfade, speaker, self.n_ok + 1
        kind = "placed" if dur is not None else "no duration"
        out.append((key, self.next, good, before, xfade, self.end, kind, speaker, dur, bool(ok)))
        self.next += 1

    def _follow(self, key: int, new: dict[int, Turn], out: list) -> None:
        """Place the turns that follow without a gap, new or waiting."""
        while True:
            if self.next in new:
                self._place(key, new.pop(self.next), out)
            elif self.n_waiting and self.waiting.containsKey((self.next,)):
                turn = self.waiting.getValue((self.next,))
                self.waiting.removeKey((self.next,))
                self.n_waiting -= 1
                self._place(key, tuple(turn[:3]), out)
            else:
                return

    def _late(self, key: int, i: int, turn: Turn, out: list) -> None:
        """A turn behind the end: of a gap that was given up, or a replay."""
        if i >= self.gap_end:
            return
        gap = next(((k[0], v[0]) for k, v in self.gaps.iterator() if k[0] <= i < v[0]), None)
        if gap:
            self.gaps.removeKey((gap[0],))
            for first, behind in ((gap[0], i), (i + 1, gap[1])):
                if first < behind:
                    self.gaps.updateValue((first,), (behind,))
            out.append((key, i, None, None, None, None, "late", *turn))

    def _set_timer(self, at: int) -> None:
        if self.timer >= 0 and self.timer != at:
            self.handle.deleteTimer(self.timer)
        if at >= 0 and self.timer != at:
            self.handle.registerTimer(at)
        self.timer = at

    def _frame(self, out: list) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=COLUMNS)
        return made.astype({"episode_id": "Int64", "seg_idx": "Int64", "ok_eff": "boolean", "xfade_ms": "Int64", "end_ms": "Int64", "dur_ms": "Int64", "ok": "boolean"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        now, k, out, new = timerValues.getCurrentProcessingTimeInMs(), int(key[0]), [], {}
        for pdf in rows:
            for i, speaker, dur, ok in zip(pdf["seg_idx"], pdf["speaker"], pdf["dur_ms"], pdf["ok"]):
                i, turn = int(i), (None if pd.isna(speaker) else speaker, _whole(dur), not pd.isna(ok) and bool(ok))
                if i < self.next:
                    self._late(k, i, turn, out)
                elif not (self.n_waiting and self.waiting.containsKey((i,))):
                    new.setdefault(i, turn)
        self._follow(k, new, out)
        for i, turn in new.items():
            self.waiting.updateValue((i,), (*turn, int(now)))
        self.n_waiting += len(new)
        if not self.n_waiting:
            self._set_timer(-1)
        elif self.timer < 0:
            self._set_timer(int(now) + self.wait_ms)
        self._save()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Give up the gaps before all turns that have waited long enough."""
        self._load()
        now, k, out = timerValues.getCurrentProcessingTimeInMs(), int(key[0]), []
        self.timer = -1  # it has fired
        since = {i[0]: v[3] for i, v in self.waiting.iterator()}
        due = max((i for i, t in since.items() if t + self.wait_ms <= now), default=-1)
        for i in sorted(since):
            if self.next <= i <= due:
                if i > self.next:
                    self.gaps.updateValue((self.next,), (i,))
                    self.next, self.gap_end = i, i
                self._follow(k, {}, out)
        left = [t for i, t in since.items() if i >= self.next]
        self._set_timer(min(left) + self.wait_ms if left else -1)
        self._save()
        yield self._frame(out)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocks(spark: SparkSession):
    """Map state and timers need the RocksDB store; the query keeps what is set
    when it starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def episode_state_stream(synth: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """A stream of turns (episode_id, seg_idx, speaker, dur_ms, ok) -> rows of
    the sink: placed turns, and those of the side tables but the waiting ones."""
    turns = synth.select(*TURN)
    whole = F.col("episode_id").isNotNull() & F.col("seg_idx").isNotNull()
    placed = turns.where(whole).groupBy("episode_id").transformWithStateInPandas(EpisodeTimeline(wait_ms), SINK, "append", "ProcessingTime")
    none = {"ok_eff": "boolean", "prev_speaker": "string", "xfade_ms": "long", "end_ms": "long"}
    apart = turns.where(~whole).withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"kind": F.lit("unplaced")})
    return placed.unionByName(apart.select(*COLUMNS))


def _synth(spark: SparkSession, conversations_dir: str, to_synth: Callable[[DataFrame], DataFrame], glob: str, max_files: int | None) -> DataFrame:
    return to_synth(arriving(spark, CONV_SCHEMA, conversations_dir, glob, max_files))


def start_episode_state(spark: SparkSession, conversations_dir: str, to_synth: Callable[[DataFrame], DataFrame], run_dir: str,
                        glob: str = "*.parquet", max_files_per_trigger: int | None = None, wait_ms: int = WAIT_MS, every: str = "10 seconds") -> StreamingQuery:
    """Start the timeline as a running query: files are read as they arrive and
    timers fire without new turns.  Its results are read with
    :func:`placed_turns` and the side tables."""
    rows = episode_state_stream(_synth(spark, conversations_dir, to_synth, glob, max_files_per_trigger), wait_ms)
    with _rocks(spark):
        return (rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{run_dir}/ckpt")
                .trigger(processingTime=every).start(f"{run_dir}/out"))


def stream_episode_state(spark: SparkSession, conversations_dir: str, to_synth: Callable[[DataFrame], DataFrame], glob: str = "*.parquet",
                         max_files_per_trigger: int | None = None, run_dir: str | None = None, wait_ms: int = WAIT_MS) -> DataFrame:
    """Conversation turns that arrived as Parquet -> ``to_synth`` (a stateless
    mapping to episode_id, seg_idx, speaker, dur_ms, ok) -> the timeline, in one
    finite run that resumes from ``run_dir``; returns the placed turns."""
    base = run_dir or new_folder(spark, "stream-episode")
    rows = episode_state_stream(_synth(spark, conversations_dir, to_synth, glob, max_files_per_trigger), wait_ms)
    make_folder(spark, f"{base}/out")  # without input no batch does it
    with _rocks(spark):
        run_available(rows, f"{base}/out", f"{base}/ckpt")
    return placed_turns(spark, base)


def _sink(spark: SparkSession, run_dir: str) -> DataFrame:
    return spark.read.schema(SINK).parquet(f"{run_dir}/out")


def placed_turns(spark: SparkSession, run_dir: str) -> DataFrame:
    """The timeline so far."""
    return _sink(spark, run_dir).where("kind in ('placed', 'no duration')").select(*PLACED)


def late_turns(spark: SparkSession, run_dir: str) -> DataFrame:
    """The turns that arrived after their gap was given up, each once."""
    return _sink(spark, run_dir).where("kind = 'late'").select(*TURN)


def unplaced_turns(spark: SparkSession, run_dir: str) -> DataFrame:
    """The turns without an episode or index."""
    return _sink(spark, run_dir).where("kind = 'unplaced'").select(*TURN)


def turns_without_duration(spark: SparkSession, run_dir: str) -> DataFrame:
    """The turns placed as failed for want of a duration."""
    return _sink(spark, run_dir).where("kind = 'no duration'").select(*TURN)


def waiting_turns(spark: SparkSession, run_dir: str) -> DataFrame:
    """The turns that still wait behind a gap, read from the state that the
    last run left in ``run_dir``."""
    with _rocks(spark):
        state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{run_dir}/ckpt")
    return state.select("key.episode_id", "user_map_key.seg_idx", "user_map_value.speaker", "user_map_value.dur_ms", "user_map_value.ok")
