"""Episode assembly as table operations: voices, synthesis results, the
three timeline variants, pacing, counters, neighbour pairs and overlaps.

The original appends audio to one growing object in a loop.  Here every
offset is a prefix sum over the segment index (``parley.operators.scan``),
so episodes are processed in parallel and a huge episode is split into
blocks instead of landing in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import fixed as FX
from parley.functions import text as T
from parley.operators.dims import bounded_broadcast
from parley.operators.scan import Linked, running_sum

KEY = "episode_id"
IDX = "seg_idx"


def route(speaker: Column) -> Column:
    """``Speaker 1`` takes the first branch, anything else the second."""
    return F.when(speaker == FX.SPEAKER_1, F.lit("first")).otherwise(F.lit("second"))


def voice_lookup(segments: DataFrame, voices: DataFrame, providers: list[str]) -> DataFrame:
    """Voice per (segment, provider): exact (provider, speaker) match, else
    the provider's default voice.  Providers come from an array literal
    (no cross join); the voice table is broadcast after a size check."""
    v = bounded_broadcast(voices)
    seg = segments.withColumn("provider", F.explode(F.array(*[F.lit(p) for p in providers])))
    exact = v.select("provider", "speaker", F.col("voice").alias("_v"))
    default = v.where("is_default").select("provider", F.col("voice").alias("_d"))
    return (seg.join(exact, ["provider", "speaker"], "left")
            .join(default, ["provider"], "left")
            .withColumn("voice", F.coalesce("_v", "_d")).drop("_v", "_d"))


def made(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Segments with a non-empty synthesis result (left semi join)."""
    ok = results.where(F.col("dur_ms") > 0).select(KEY, IDX)
    return segments.join(ok, [KEY, IDX], "left_semi")


def failed(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Segments without a usable synthesis result (left anti join)."""
    ok = results.where(F.col("dur_ms") > 0).select(KEY, IDX)
    return segments.join(ok, [KEY, IDX], "left_anti")


def timeline_plain(synth: DataFrame) -> DataFrame:
    """Concatenation with a 500 ms gap before every segment after the first
    (also before failed ones).  Adds inc_ms, start_ms, end_ms and
    audio_start_ms (where the audio begins; null for failed segments)."""
    d = synth.withColumn("inc_ms", _plain_advance())
    d = running_sum(d, KEY, IDX, "inc_ms", "end_ms")
    return (d.withColumn("start_ms", F.col("end_ms") - F.col("inc_ms"))
            .withColumn("audio_start_ms", F.when(F.col("ok"), F.col("end_ms") - F.col("dur_ms"))))


def timeline_jitter(synth: DataFrame, pauses: DataFrame | Column) -> DataFrame:
    """Gap of 500 ms before every segment after the first; the segment is
    then appended with a 300 ms crossfade and followed by its pause.  A
    segment shorter than the crossfade fails.  ``pauses`` is a table
    (episode_id, seg_idx, pause_ms) or a column expression such as a keyed
    value (then no join is needed).  Adds ok_eff, inc_ms, start_ms, end_ms,
    xfade_ms and audio_start_ms: the audio begins ``xfade_ms`` before the end
    of its gap (null for failed segments)."""
    if isinstance(pauses, Column):
        d = synth.withColumn("pause_ms", pauses.cast("long"))
    else:
        d = synth.join(pauses, [KEY, IDX], "left")
    later = F.col(IDX) > 0
    ok_eff = F.col("ok") & (~later | (F.col("dur_ms") >= FX.BASE_CROSSFADE_MS))
    inc = (F.when(later, F.lit(FX.GAP_MS)).otherwise(F.lit(0))
           + F.when(ok_eff & later, F.col("dur_ms") - FX.BASE_CROSSFADE_MS + F.col("pause_ms"))
           .when(ok_eff, F.col("dur_ms")).otherwise(F.lit(0)))
    d = d.withColumn("ok_eff", ok_eff).withColumn("inc_ms", inc.cast("long"))
    d = running_sum(d, KEY, IDX, "inc_ms", "end_ms")
    xfade = F.when(ok_eff & later, F.lit(FX.BASE_CROSSFADE_MS)).otherwise(F.lit(0)).cast("long")
    gap = F.when(later, F.lit(FX.GAP_MS)).otherwise(F.lit(0))
    return (d.withColumn("start_ms", F.col("end_ms") - F.col("inc_ms")).withColumn("xfade_ms", xfade)
            .withColumn("audio_start_ms", F.when(F.col("ok_eff"), F.col("start_ms") + gap - F.col("xfade_ms"))))


def dynamic_crossfade(prev: Column, speaker: Column) -> Column:
    """Crossfade of a successful segment, by the previous successful one
    (``prev``: a struct of its speaker, null if there is none)."""
    same = int(min(FX.MAX_CROSSFADE_MS, FX.BASE_CROSSFADE_MS * FX.SAME_SPEAKER_FACTOR))
    return (F.when(prev.isNull(), F.lit(FX.FIRST_CROSSFADE_MS)).when(prev["speaker"] == speaker, F.lit(same))
            .otherwise(F.lit(FX.BASE_CROSSFADE_MS)).cast("long"))


def _dynamic(synth: DataFrame) -> tuple[DataFrame, Linked]:
    """Segments with ``ok_eff``, and the scan of their advances."""
    d = synth.withColumn("ok_eff", F.coalesce(F.col("ok") & (F.col("dur_ms") >= FX.MIN_AMBIENCE_MS), F.lit(False)))
    advance = lambda prev, of: F.when(of("ok_eff"), of("dur_ms") - dynamic_crossfade(prev, of("speaker"))).otherwise(0).cast("long")
    spoken = F.when(F.col("ok_eff"), F.struct("speaker"))
    return d, Linked(KEY, IDX, spoken, {"_adv": advance}, ["speaker", "dur_ms", "ok_eff"])


def timeline_dynamic(synth: DataFrame) -> DataFrame:
    """2,000 ms intro, then every successful segment appended with a crossfade:
    500 ms for the first success, 450 ms when the previous success had the
    same speaker, 300 ms otherwise.  Audio under 1,000 ms fails (its room
    tone cannot be built), as does a segment without a result or duration.  A
    success without a speaker differs from all others.  Adds ok_eff,
    prev_speaker, xfade_ms, start_ms, end_ms.

    The previous speaker and the offsets, which depend on it, come from one
    composite scan."""
    d, scan = _dynamic(synth)
    d = scan.scan(d, "_prev")
    xfade = F.when(F.col("ok_eff"), dynamic_crossfade(F.col("_prev"), F.col("speaker"))).otherwise(0).cast("long")
    d = d.withColumn("prev_speaker", F.col("_prev.speaker")).withColumn("xfade_ms", xfade)
    d = d.withColumn("end_ms", F.col("_adv") + F.lit(FX.INTRO_MS))
    start = F.when(F.col("ok_eff"), F.col("end_ms") - F.col("dur_ms")).otherwise(F.col("end_ms"))
    return d.withColumn("start_ms", start).drop("_adv", "_prev")


def _plain_advance() -> Column:
    gap = F.when(F.col(IDX) > 0, F.lit(FX.GAP_MS)).otherwise(F.lit(0))
    return (gap + F.when(F.col("ok"), F.col("dur_ms")).otherwise(F.lit(0))).cast("long")


def episode_totals(synth: DataFrame) -> DataFrame:
    """Per episode: n_segments, n_ok (of the dynamic timeline), the length of
    the plain timeline (duration_ms) and of the dynamic one
    (duration_dynamic_ms); null lengths for rows without an episode or index.
    The lengths are sums of block totals; no timeline is built."""
    d, scan = _dynamic(synth)
    t = scan.totals(d, n_segments=F.count(F.lit(1)), n_ok=F.count_if("ok_eff"), duration_ms=F.sum(F.when(F.col(IDX).isNotNull(), _plain_advance())),
                    _placed=F.count(IDX))
    length = lambda c: F.when((F.col("_placed") > 0) & F.col(KEY).isNotNull(), c)
    return t.select(KEY, "n_segments", "n_ok", length(F.col("duration_ms")).alias("duration_ms"),
                    length(F.col("_adv") + FX.INTRO_MS).alias("duration_dynamic_ms"))


def pacing(segments: DataFrame) -> DataFrame:
    """Earliest request time of each segment under the original waits:
    max(0.5 s, chars / 1000 s) per OpenAI call, 1 s per ElevenLabs / Bark
    call.  Adds openai_start_s, fixed_start_s."""
    wait_ms = F.greatest(F.lit(int(FX.OPENAI_MIN_PACE_S * 1000)), F.length("text")).cast("long")
    d = running_sum(segments, KEY, IDX, wait_ms, "_w", inclusive=False)
    return (d.withColumn("openai_start_s", F.col("_w") / F.lit(1000.0))
            .withColumn("fixed_start_s", F.col(IDX).cast("double") * F.lit(FX.SEGMENT_PACE_S)).drop("_w"))


def chunk_pacing(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_idx") -> DataFrame:
    """Earliest cleaning request time of each chunk under the 0.1 s wait
    after every call (model time excluded); adds clean_start_s."""
    n = running_sum(chunks, key, order, F.lit(1).cast("long"), "_n", inclusive=False)
    return n.withColumn("clean_start_s", F.col("_n") * F.lit(FX.CLEAN_PACE_S)).drop("_n")


def run_counts(synth: DataFrame) -> DataFrame:
    """Success / failure counters per episode and provider variant.

    ElevenLabs and Bark count every failure.  OpenAI counts exceptions (an
    error, or audio under 1 s) but not a missing reply, which raises
    neither counter.  ``uncounted = total - ok - failed``.
    """
    oa_ok = F.col("ok") & (F.col("dur_ms") >= FX.MIN_AMBIENCE_MS)
    oa_failed = (~F.col("ok") & (F.col("fail_kind") == "error")) | (F.col("ok") & ~oa_ok)
    g = synth.groupBy(KEY).agg(
        F.count("*").alias("n_total"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.count_if(oa_ok).alias("n_ok_openai"),
        F.count_if(oa_failed).alias("n_failed_openai"))
    return g.withColumn("n_uncounted_openai", F.col("n_total") - F.col("n_ok_openai") - F.col("n_failed_openai"))


def success_rank(synth: DataFrame, ok_col: str = "ok") -> DataFrame:
    """Add ``k``: 0-based position among successful segments (null if failed)."""
    d = running_sum(synth, KEY, IDX, F.col(ok_col).cast("long"), "_k")
    return d.withColumn("k", F.when(F.col(ok_col), F.col("_k") - 1)).drop("_k")


def adjacent_pairs(synth: DataFrame, ok_col: str = "ok") -> DataFrame:
    """Each successful segment with the previous successful one (equi-join on
    k = k' + 1 within the episode)."""
    r = success_rank(synth, ok_col).where(F.col(ok_col))
    prev = r.select(KEY, (F.col("k") + 1).alias("k"), F.col(IDX).alias("prev_seg_idx"),
                    F.col("speaker").alias("prev_speaker"))
    return (r.join(prev, [KEY, "k"], "left")
            .select(KEY, IDX, "speaker", "prev_seg_idx", "prev_speaker",
                    F.coalesce(F.col("prev_speaker") == F.col("speaker"), F.lit(False)).alias("same_speaker")))


def overlap_join(intervals: DataFrame, start: str = "start_ms", end: str = "end_ms",
                 bucket_ms: int = 60_000) -> DataFrame:
    """Pairs (a, b), a before b in index order, whose [start, end) intervals
    overlap, within an episode, by a sweep over their starts.

    An interval goes to each time bucket that it covers; the buckets are dealt
    to the tasks and swept in order of the starts with the set of intervals
    that have not ended.  A bucket begins with those that reach into it from
    the one before, and a pair is written in the bucket where its overlap
    begins.  The intervals are computed and shuffled once; a task holds the
    intervals open at one time.  Rows without an episode, index, start or end,
    and empty intervals, are in no pair.
    """
    # Rows without an episode or index are passed over below: a filter here would move into one
    # branch of the timeline's scan, which could then not share its shuffle with the other.
    iv = intervals.where(F.col(end) > F.col(start))
    iv = iv.select(KEY, F.col(IDX).cast("long").alias(IDX), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    b = iv.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket_ms), F.floor((F.col("_e") - 1) / bucket_ms))))
    dealt = b.repartition(KEY, "_b").sortWithinPartitions(KEY, "_b", "_s", IDX)

    def sweep(batches):
        at, open_ = None, []
        for batch in batches:
            keys = batch.column(0)
            rows = []
            for r, (k, i, s, e, bucket) in enumerate(zip(keys.to_pylist(), *(batch.column(c).to_pylist() for c in range(1, 5)))):
                if k is None or i is None:
                    continue
                if (k, bucket) != at:
                    at, open_ = (k, bucket), []
                open_ = [o for o in open_ if o[2] > s]
                if s // bucket_ms == bucket:  # the overlap with each open one begins here
                    rows += [(r, min(i, j), max(i, j), min(e, f) - s) for j, _, f in open_]
                open_.append((i, s, e))
            cols = [pa.array([x[c] for x in rows], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([keys.take(cols[0]), *cols[1:]], names=[KEY, "a_seg_idx", "b_seg_idx", "overlap_ms"])

    kind = iv.schema[KEY].dataType.simpleString()
    return dealt.mapInArrow(sweep, f"{KEY} {kind}, a_seg_idx long, b_seg_idx long, overlap_ms long")


def timeline_parts(synth: DataFrame, pauses: DataFrame | Column) -> DataFrame:
    """Typed parts of the jittered timeline (gap, audio, pause) ordered by
    (segment, part), with their start offsets.

    ``advance_ms`` is how far a part moves the end of the episode (audio
    advances by its duration minus the crossfade, and starts that much before
    the end of its gap).  The parts of a segment
    are built from its row as an array of structs and exploded, a union per
    row without a shuffle; offsets follow from the segment's start on the
    timeline, so no second scan is needed.
    """
    t = timeline_jitter(synth, pauses)
    later = F.col(IDX) > 0
    gap_adv = F.when(later, F.lit(FX.GAP_MS)).otherwise(F.lit(0)).cast("long")
    audio_adv = F.when(later, F.col("dur_ms") - FX.BASE_CROSSFADE_MS).otherwise(F.col("dur_ms")).cast("long")
    seg_start = F.col("start_ms")

    def part(no: int, kind: str, adv: Column, start: Column, keep: Column) -> Column:
        return F.when(keep, F.struct(F.lit(no).alias("part_no"), F.lit(kind).alias("kind"),
                                     adv.alias("advance_ms"), start.alias("start_ms")))
    parts = F.array(
        part(0, "gap", gap_adv, seg_start, later),
        part(1, "audio", audio_adv, F.col("audio_start_ms"), F.col("ok_eff")),
        part(2, "pause", F.col("pause_ms").cast("long"), seg_start + gap_adv + audio_adv,
             F.col("ok_eff") & later))
    return (t.select(KEY, IDX, F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("p"))
            .select(KEY, IDX, "p.part_no", "p.kind", "p.advance_ms", "p.start_ms"))


def previews(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment: previews of its transcript and of its text, and whether it
    is the first of its episode.  Transcripts without segments have one row."""
    t = transcripts.select(KEY, T.preview("text", FX.PREVIEW_TRANSCRIPT_CHARS).alias("transcript_preview"))
    first = segments.groupBy(KEY).agg(F.min(IDX).alias("_first"))
    s = segments.select(KEY, IDX, T.preview("text", FX.PREVIEW_TEXT_CHARS).alias("segment_preview"))
    return (t.join(first, KEY, "left").join(s, KEY, "left")
            .select(KEY, IDX, "transcript_preview", "segment_preview", F.coalesce(F.col(IDX) == F.col("_first"), F.lit(False)).alias("is_first")))


def _manifest_entry(provider: str, run_date: Column, ok_col: str) -> Column:
    tagged = provider == "openai"      # only the OpenAI variant writes tags

    def tag(v):
        return F.lit(v) if tagged else F.lit(None).cast("string")
    return F.struct(
        F.lit(provider).alias("provider"), F.lit(FX.EXPORT_FILES[provider]).alias("file_name"),
        F.lit(FX.EXPORT_FORMAT).alias("format"), F.lit(FX.EXPORT_BITRATE).alias("bitrate"),
        tag(FX.EXPORT_TAGS["title"]).alias("title"), tag(FX.EXPORT_TAGS["artist"]).alias("artist"),
        tag(FX.EXPORT_TAGS["album"]).alias("album"),
        (F.date_format(run_date, FX.DATE_FORMAT) if tagged else F.lit(None).cast("string")).alias("date"),
        F.col(ok_col).alias("n_ok"))


def manifests(counts: DataFrame, run_date: Column, providers=("openai", "bark", "eleven")) -> DataFrame:
    """Export manifest rows per episode and provider variant, for variants
    with at least one successful segment (the OpenAI variant counts its own
    successes).  One counters row per episode feeds all variants (no union
    of re-aggregations)."""
    entries = [_manifest_entry(p, run_date, "n_ok_openai" if p == "openai" else "n_ok") for p in providers]
    m = counts.select(KEY, F.explode(F.array(*entries)).alias("m")).select(KEY, "m.*")
    return m.where(F.col("n_ok") > 0)
