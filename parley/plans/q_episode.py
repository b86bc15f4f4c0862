"""Queries over episodes: voices, synthesis results, timelines, counters,
pacing, parts, manifest and previews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import audio_math as M
from parley.functions import fixed as FXV
from parley.functions import text as T
from parley.operators import episode as E
from parley.operators.scan import blocked_scan, previous_non_null
from parley.plans.q_requests import TRANSCRIPTS_CTE, transcripts
from parley.plans.registry import query
from parley.sources import fixtures as FX

RUN_DATE = "2024-05-17"       # run date used by the manifest query
PROVIDERS = ["openai", "bark", "eleven"]
W_UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
W_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _ok_results(spark, sf_dir):
    """Synthesis results table: rows only for successful segments."""
    return FX.synth(spark, sf_dir).where("ok").select("episode_id", "seg_idx", "dur_ms")


@query("flt_speaker_route", """
    SELECT episode_id, seg_idx, speaker,
           CASE WHEN speaker = 'Speaker 1' THEN 'first' ELSE 'second' END AS route,
           CASE WHEN speaker = 'Speaker 1' THEN 'alloy' ELSE 'echo' END AS voice,
           CAST(CASE WHEN speaker = 'Speaker 1' THEN 4000 ELSE 5000 END AS BIGINT) AS low_pass_hz,
           CAST(CASE WHEN speaker = 'Speaker 1' THEN 100 ELSE 150 END AS BIGINT) AS high_pass_hz
    FROM f_segments""")
def flt_speaker_route(spark, sf_dir):
    s = FX.segments(spark, sf_dir)
    first = F.col("speaker") == FXV.SPEAKER_1
    return s.select("episode_id", "seg_idx", "speaker", E.route(F.col("speaker")).alias("route"),
                    F.when(first, "alloy").otherwise("echo").alias("voice"),
                    F.when(first, FXV.LOW_PASS_HZ["Speaker 1"]).otherwise(FXV.LOW_PASS_HZ["other"]).alias("low_pass_hz"),
                    F.when(first, FXV.HIGH_PASS_HZ["Speaker 1"]).otherwise(FXV.HIGH_PASS_HZ["other"])
                    .alias("high_pass_hz"))


@query("join_voice_lookup", """
    SELECT s.episode_id, s.seg_idx, p.provider, coalesce(v.voice, d.voice) AS voice
    FROM f_segments s CROSS JOIN (VALUES ('openai'), ('bark'), ('eleven')) p(provider)
    LEFT JOIN f_voices v ON v.provider = p.provider AND v.speaker = s.speaker
    LEFT JOIN (SELECT provider, voice FROM f_voices WHERE is_default) d ON d.provider = p.provider""")
def join_voice_lookup(spark, sf_dir):
    s = FX.segments(spark, sf_dir).select("episode_id", "seg_idx", "speaker")
    return E.voice_lookup(s, FX.voices(spark), PROVIDERS).select("episode_id", "seg_idx", "provider", "voice")


@query("join_segment_audio", """
    SELECT s.episode_id, s.seg_idx, coalesce(r.dur_ms > 0, false) AS made, r.dur_ms
    FROM f_segments s LEFT JOIN (SELECT episode_id, seg_idx, dur_ms FROM f_synth WHERE ok) r
         ON s.episode_id = r.episode_id AND s.seg_idx = r.seg_idx""")
def join_segment_audio(spark, sf_dir):
    s = FX.segments(spark, sf_dir).select("episode_id", "seg_idx")
    j = s.join(_ok_results(spark, sf_dir), ["episode_id", "seg_idx"], "left")
    return j.select("episode_id", "seg_idx", F.coalesce(F.col("dur_ms") > 0, F.lit(False)).alias("made"), "dur_ms")


@query("join_failed_segments", """
    SELECT s.episode_id, s.seg_idx, s.speaker FROM f_segments s
    WHERE NOT EXISTS (SELECT 1 FROM f_synth r WHERE r.ok AND r.dur_ms > 0
                      AND r.episode_id = s.episode_id AND r.seg_idx = s.seg_idx)""")
def join_failed_segments(spark, sf_dir):
    s = FX.segments(spark, sf_dir).select("episode_id", "seg_idx", "speaker")
    return E.failed(s, _ok_results(spark, sf_dir))


@query("join_adjacent_pairs", """
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) - 1 AS k FROM f_synth WHERE ok)
    SELECT a.episode_id, a.seg_idx, a.speaker, b.seg_idx AS prev_seg_idx, b.speaker AS prev_speaker,
           coalesce(b.speaker = a.speaker, false) AS same_speaker
    FROM s a LEFT JOIN s b ON a.episode_id = b.episode_id AND b.k + 1 = a.k""")
def join_adjacent_pairs(spark, sf_dir):
    return E.adjacent_pairs(FX.synth(spark, sf_dir))


@query("win_prev_speaker", f"""
    SELECT episode_id, seg_idx, speaker, ok,
           last_value(CASE WHEN ok THEN speaker END IGNORE NULLS)
               OVER (PARTITION BY episode_id ORDER BY seg_idx {W_BEFORE}) AS prev_ok_speaker
    FROM f_synth""")
def win_prev_speaker(spark, sf_dir):
    """Previous successful speaker: set only after a success, so failed
    segments are skipped."""
    s = FX.synth(spark, sf_dir).select("episode_id", "seg_idx", "speaker", "ok")
    return previous_non_null(s, "episode_id", "seg_idx", F.when(F.col("ok"), F.col("speaker")), "prev_ok_speaker")


@query("win_position", f"""
    SELECT episode_id, seg_idx,
           row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) - 1 AS pos,
           CAST(CASE WHEN ok THEN sum(CASE WHEN ok THEN 1 ELSE 0 END)
                OVER (PARTITION BY episode_id ORDER BY seg_idx {W_UPTO}) - 1 END AS BIGINT) AS ok_pos,
           'Processing segment ' || CAST(row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) AS VARCHAR)
               || '/' || CAST(count(*) OVER (PARTITION BY episode_id) AS VARCHAR) AS label
    FROM f_synth""")
def win_position(spark, sf_dir):
    """Enumeration positions (all segments and successes only) and the
    ``i+1/n`` progress label, all from one blocked scan."""
    s = FX.synth(spark, sf_dir).select("episode_id", "seg_idx", "ok")
    one = F.lit(1).cast("long")
    s = blocked_scan(s, "episode_id", "seg_idx", sums={"_n": (one, True), "_k": (F.col("ok").cast("long"), True)},
                     totals={"_total": one})
    return s.select("episode_id", "seg_idx", (F.col("_n") - 1).alias("pos"),
                    F.when(F.col("ok"), F.col("_k") - 1).alias("ok_pos"),
                    F.concat(F.lit("Processing segment "), F.col("_n").cast("string"), F.lit("/"),
                             F.col("_total").cast("string")).alias("label"))


@query("agg_cardinality", """
    SELECT episode_id, count(*) AS n_segments, CAST(count_if(speaker = 'Speaker 1') AS BIGINT) AS n_speaker1,
           CAST(sum(length(text)) AS BIGINT) AS n_chars
    FROM f_segments GROUP BY episode_id""")
def agg_cardinality(spark, sf_dir):
    s = FX.segments(spark, sf_dir)
    return s.groupBy("episode_id").agg(F.count("*").alias("n_segments"),
                                       F.count_if(F.col("speaker") == FXV.SPEAKER_1).alias("n_speaker1"),
                                       F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("agg_run_counts", """
    SELECT episode_id, n_total, n_ok, n_failed, n_ok_openai, n_failed_openai,
           n_total - n_ok_openai - n_failed_openai AS n_uncounted_openai
    FROM (SELECT episode_id, count(*) AS n_total, CAST(count_if(ok) AS BIGINT) AS n_ok,
                 CAST(count_if(NOT ok) AS BIGINT) AS n_failed,
                 CAST(count_if(ok AND dur_ms >= 1000) AS BIGINT) AS n_ok_openai,
                 CAST(count_if((NOT ok AND fail_kind = 'error') OR (ok AND dur_ms < 1000)) AS BIGINT) AS n_failed_openai
          FROM f_synth GROUP BY episode_id)""")
def agg_run_counts(spark, sf_dir):
    return E.run_counts(FX.synth(spark, sf_dir))


_PLAIN_SQL = f"""
    SELECT episode_id, seg_idx, ok, dur_ms, inc_ms,
           CAST(sum(inc_ms) OVER (PARTITION BY episode_id ORDER BY seg_idx {W_UPTO}) AS BIGINT) AS end_ms
    FROM (SELECT *, CAST(CASE WHEN seg_idx > 0 THEN 500 ELSE 0 END + CASE WHEN ok THEN dur_ms ELSE 0 END AS BIGINT)
                    AS inc_ms FROM f_synth)"""


@query("win_timeline_plain", f"""
    SELECT episode_id, seg_idx, ok, inc_ms, end_ms, end_ms - inc_ms AS start_ms,
           CASE WHEN ok THEN end_ms - dur_ms END AS audio_start_ms FROM ({_PLAIN_SQL})""")
def win_timeline_plain(spark, sf_dir):
    t = E.timeline_plain(FX.synth(spark, sf_dir))
    return t.select("episode_id", "seg_idx", "ok", "inc_ms", "start_ms", "end_ms", "audio_start_ms")


_JITTER_SQL = f"""
    SELECT *, CAST(sum(inc_ms) OVER (PARTITION BY episode_id ORDER BY seg_idx {W_UPTO}) AS BIGINT) AS end_ms FROM (
        SELECT *, CAST(CASE WHEN seg_idx > 0 THEN 500 ELSE 0 END
                       + CASE WHEN ok_eff AND seg_idx > 0 THEN dur_ms - 300 + pause_ms
                              WHEN ok_eff THEN dur_ms ELSE 0 END AS BIGINT) AS inc_ms
        FROM (SELECT s.*, p.pause_ms, s.ok AND (s.seg_idx = 0 OR s.dur_ms >= 300) AS ok_eff
              FROM f_synth s LEFT JOIN f_pause p ON s.episode_id = p.episode_id AND s.seg_idx = p.seg_idx))"""


@query("win_timeline_jitter", f"""
    SELECT episode_id, seg_idx, ok_eff, inc_ms, end_ms - inc_ms AS start_ms, end_ms,
           CAST(CASE WHEN ok_eff AND seg_idx > 0 THEN 300 ELSE 0 END AS BIGINT) AS xfade_ms,
           CASE WHEN ok_eff THEN end_ms - inc_ms + CASE WHEN seg_idx > 0 THEN 200 ELSE 0 END END AS audio_start_ms
    FROM ({_JITTER_SQL})""")
def win_timeline_jitter(spark, sf_dir):
    t = E.timeline_jitter(FX.synth(spark, sf_dir), FX.pauses(spark, sf_dir))
    return t.select("episode_id", "seg_idx", "ok_eff", "inc_ms", "start_ms", "end_ms", "xfade_ms",
                    "audio_start_ms")


_DYN_SQL = f"""
    SELECT *, CASE WHEN ok_eff THEN end_ms - dur_ms ELSE end_ms END AS start_ms FROM (
      SELECT *, CAST(2000 + sum(CASE WHEN ok_eff THEN dur_ms - xfade_ms ELSE 0 END)
                     OVER (PARTITION BY episode_id ORDER BY seg_idx {W_UPTO}) AS BIGINT) AS end_ms FROM (
        SELECT *, CAST(CASE WHEN NOT ok_eff THEN 0 WHEN prev_speaker IS NULL THEN 500
                            WHEN prev_speaker = speaker THEN 450 ELSE 300 END AS BIGINT) AS xfade_ms FROM (
          SELECT *, last_value(CASE WHEN ok_eff THEN speaker END IGNORE NULLS)
                        OVER (PARTITION BY episode_id ORDER BY seg_idx {W_BEFORE}) AS prev_speaker
          FROM (SELECT *, ok AND dur_ms >= 1000 AS ok_eff FROM f_synth))))"""


@query("win_timeline_dynamic", f"""
    SELECT episode_id, seg_idx, ok_eff, prev_speaker, xfade_ms, start_ms, end_ms FROM ({_DYN_SQL})""")
def win_timeline_dynamic(spark, sf_dir):
    t = E.timeline_dynamic(FX.synth(spark, sf_dir))
    return t.select("episode_id", "seg_idx", "ok_eff", "prev_speaker", "xfade_ms", "start_ms", "end_ms")


@query("agg_episode_duration", f"""
    SELECT a.episode_id, a.duration_ms, b.duration_dynamic_ms
    FROM (SELECT episode_id, max(end_ms) AS duration_ms FROM ({_PLAIN_SQL}) GROUP BY episode_id) a
    JOIN (SELECT episode_id, max(end_ms) AS duration_dynamic_ms FROM ({_DYN_SQL}) GROUP BY episode_id) b
      ON a.episode_id = b.episode_id""")
def agg_episode_duration(spark, sf_dir):
    """Episode length in ms (``len(audio)``): last end of the plain and of
    the dynamic timeline, from block totals."""
    return E.episode_totals(FX.synth(spark, sf_dir)).select("episode_id", "duration_ms", "duration_dynamic_ms")


@query("win_pacing", f"""
    SELECT episode_id, seg_idx,
           coalesce(sum(greatest(500, length(text))) OVER (PARTITION BY episode_id ORDER BY seg_idx {W_BEFORE}), 0)
               / 1000.0 AS openai_start_s,
           CAST(seg_idx AS DOUBLE) * 1.0 AS fixed_start_s
    FROM f_segments""".replace("/ 1000.0 AS", "/ 1000.0::DOUBLE AS"))
def win_pacing(spark, sf_dir):
    s = FX.segments(spark, sf_dir).select("episode_id", "seg_idx", "text")
    return E.pacing(s).select("episode_id", "seg_idx", "openai_start_s", "fixed_start_s")


@query("win_pacing_chunks", f"""
    SELECT doc_id, chunk_idx,
           CAST(coalesce(count(*) OVER (PARTITION BY doc_id ORDER BY chunk_idx {W_BEFORE}), 0) AS DOUBLE)
               * 0.1::DOUBLE AS clean_start_s
    FROM f_chunks""")
def win_pacing_chunks(spark, sf_dir):
    """Pacing of the cleaning calls: 0.1 s after every chunk, in order."""
    c = FX.chunks(spark, sf_dir).select("doc_id", "chunk_idx")
    return E.chunk_pacing(c).select("doc_id", "chunk_idx", "clean_start_s")


@query("join_overlap_intervals", f"""
    WITH t AS (SELECT episode_id, seg_idx, start_ms, end_ms FROM ({_DYN_SQL}) WHERE end_ms > start_ms)
    SELECT a.episode_id, a.seg_idx AS a_seg_idx, b.seg_idx AS b_seg_idx,
           least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms
    FROM t a JOIN t b ON a.episode_id = b.episode_id AND a.seg_idx < b.seg_idx
                     AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms""")
def join_overlap_intervals(spark, sf_dir):
    """Crossfade overlaps on the dynamic timeline by a sweep over its starts."""
    t = E.timeline_dynamic(FX.synth(spark, sf_dir))
    return E.overlap_join(t, bucket_ms=10_000)


@query("join_overlap_parts", f"""
    WITH t AS (
        SELECT episode_id, seg_idx, end_ms - inc_ms + CASE WHEN seg_idx > 0 THEN 200 ELSE 0 END AS s,
               end_ms - inc_ms + CASE WHEN seg_idx > 0 THEN 200 ELSE 0 END + dur_ms + 3 * pause_ms AS e
        FROM ({_JITTER_SQL}) WHERE ok_eff)
    SELECT a.episode_id, a.seg_idx AS a_seg_idx, b.seg_idx AS b_seg_idx, least(a.e, b.e) - greatest(a.s, b.s) AS overlap_ms
    FROM t a JOIN t b ON a.episode_id = b.episode_id AND a.seg_idx < b.seg_idx AND a.s < b.e AND b.s < a.e""")
def join_overlap_parts(spark, sf_dir):
    """Overlaps on the jittered timeline when each segment rings on for three
    pauses, so that several lie over each other."""
    t = E.timeline_jitter(FX.synth(spark, sf_dir), FX.pauses(spark, sf_dir)).where("ok_eff")
    t = t.withColumn("end_ms", F.col("audio_start_ms") + F.col("dur_ms") + 3 * F.col("pause_ms"))
    return E.overlap_join(t, start="audio_start_ms", bucket_ms=10_000)


@query("set_timeline_parts", f"""
    WITH t AS (
        SELECT s.*, p.pause_ms, s.ok AND (s.seg_idx = 0 OR s.dur_ms >= 300) AS ok_eff
        FROM f_synth s LEFT JOIN f_pause p ON s.episode_id = p.episode_id AND s.seg_idx = p.seg_idx),
    parts AS (
        SELECT episode_id, seg_idx, 0 AS part_no, 'gap' AS kind, CAST(500 AS BIGINT) AS advance_ms
        FROM t WHERE seg_idx > 0
        UNION ALL
        SELECT episode_id, seg_idx, 1, 'audio', CASE WHEN seg_idx > 0 THEN dur_ms - 300 ELSE dur_ms END
        FROM t WHERE ok_eff
        UNION ALL
        SELECT episode_id, seg_idx, 2, 'pause', pause_ms FROM t WHERE ok_eff AND seg_idx > 0)
    SELECT episode_id, seg_idx, CAST(part_no AS BIGINT) AS part_no, kind, advance_ms,
           CAST(coalesce(sum(advance_ms) OVER (PARTITION BY episode_id ORDER BY seg_idx, part_no {W_BEFORE}), 0)
                - CASE WHEN kind = 'audio' AND seg_idx > 0 THEN 300 ELSE 0 END AS BIGINT) AS start_ms
    FROM parts""")
def set_timeline_parts(spark, sf_dir):
    return E.timeline_parts(FX.synth(spark, sf_dir), FX.pauses(spark, sf_dir))


_U = "(({a} * episode_id + {b} * seg_idx) % 10007) / 10007.0::DOUBLE"


def _uniform_sql(lo: float, hi: float, a: int, b: int) -> str:
    return f"({lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * {_U.format(a=a, b=b)})"


@query("math_keyed_uniform", f"""
    SELECT episode_id, seg_idx,
           round({_uniform_sql(0.95, 1.05, 31, 17)}, 6) AS rate,
           round({_uniform_sql(-0.5, 0.5, 13, 7)}, 6) AS pitch,
           CAST(floor({_uniform_sql(200.0, 800.0, 17, 13)}) AS BIGINT) AS pause_ms,
           round({_uniform_sql(-3.0, 3.0, 7, 29)}, 6) AS room_jitter_db
    FROM f_segments""")
def math_keyed_uniform(spark, sf_dir):
    """Deterministic per-key replacements for the random draws (rate,
    pitch, pause, room gain jitter)."""
    s = FX.segments(spark, sf_dir)
    k, i = F.col("episode_id"), F.col("seg_idx")
    return s.select("episode_id", "seg_idx",
                    F.round(M.keyed_uniform(0.95, 1.05, k, i, 31, 17), 6).alias("rate"),
                    F.round(M.keyed_uniform(-0.5, 0.5, k, i, 13, 7), 6).alias("pitch"),
                    F.floor(M.keyed_uniform(200.0, 800.0, k, i, 17, 13)).cast("long").alias("pause_ms"),
                    F.round(M.keyed_uniform(-3.0, 3.0, k, i, 7, 29), 6).alias("room_jitter_db"))


@query("math_db_gain", f"""
    SELECT episode_id, seg_idx, round(db, 6) AS db, round(pow(10.0, db / 20.0), 9) AS gain
    FROM (SELECT episode_id, seg_idx, -50.0::DOUBLE + {_uniform_sql(-3.0, 3.0, 7, 29)} AS db FROM f_segments)""")
def math_db_gain(spark, sf_dir):
    s = FX.segments(spark, sf_dir)
    db = F.lit(FXV.ROOM_VOLUME_DB) + M.keyed_uniform(-3.0, 3.0, F.col("episode_id"), F.col("seg_idx"), 7, 29)
    return s.select("episode_id", "seg_idx", F.round(db, 6).alias("db"), F.round(M.db_to_gain(db), 9).alias("gain"))


@query("math_clip", """
    SELECT episode_id, seg_idx, i, round(greatest(-1.0, least(1.0, amp * 3.0)), 6) AS clipped,
           CAST(trunc(greatest(-32768.0, least(32767.0, amp * 3.0 * 32767.0))) AS BIGINT) AS pcm
    FROM f_frames""")
def math_clip(spark, sf_dir):
    """Bounded arithmetic: amplitude clipped to full scale, PCM clipped to int16."""
    f = FX.frames(spark, sf_dir)
    return f.select("episode_id", "seg_idx", "i",
                    F.round(M.clip(F.col("amp") * 3.0, -1.0, 1.0), 6).alias("clipped"),
                    M.clip(F.col("amp") * 3.0 * 32767.0, -32768.0, 32767.0).cast("long").alias("pcm"))


@query("sink_manifest", f"""
    SELECT episode_id, 'openai' AS provider, '_podcast.mp3' AS file_name, 'mp3' AS format, '192k' AS bitrate,
           'AI Generated Podcast' AS title, 'OpenAI TTS' AS artist, 'AI Podcasts' AS album,
           '{RUN_DATE}' AS date, n_ok FROM (SELECT episode_id, CAST(count_if(ok AND dur_ms >= 1000) AS BIGINT) AS n_ok
                                            FROM f_synth GROUP BY episode_id) WHERE n_ok > 0
    UNION ALL
    SELECT episode_id, provider, CASE provider WHEN 'eleven' THEN 'final_podcast.mp3' ELSE '_podcast.mp3' END,
           'mp3', '192k', NULL, NULL, NULL, NULL, n_ok
    FROM (SELECT episode_id, CAST(count_if(ok) AS BIGINT) AS n_ok FROM f_synth GROUP BY episode_id)
         CROSS JOIN (VALUES ('bark'), ('eleven')) p(provider)
    WHERE n_ok > 0""")
def sink_manifest(spark, sf_dir):
    """Export manifest rows per provider variant (episodes with at least one
    success); the run date is a parameter."""
    counts = E.run_counts(FX.synth(spark, sf_dir))
    return E.manifests(counts, F.to_date(F.lit(RUN_DATE)))


@query("sink_preview", """
    SELECT t.episode_id, s.seg_idx, substring(t.text, 1, 500) || '...' AS transcript_preview,
           substring(s.text, 1, 50) || '...' AS segment_preview, coalesce(s.seg_idx = min(s.seg_idx) OVER (PARTITION BY t.episode_id), false) AS is_first
    FROM (SELECT * FROM q_transcripts UNION ALL SELECT -1, 'An episode without segments') t
    LEFT JOIN f_segments s ON s.episode_id = t.episode_id""", TRANSCRIPTS_CTE)
def sink_preview(spark, sf_dir):
    """Console previews as columns: 500 characters of the transcript and 50 of
    each segment, always followed by ``...``; a transcript without segments
    stays."""
    t = transcripts(spark, sf_dir).select("episode_id", "text")
    t = t.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("episode_id"), F.lit("An episode without segments").alias("text")))
    return E.previews(t, FX.segments(spark, sf_dir))


@query("sort_segments", "SELECT episode_id, seg_idx, speaker FROM f_segments ORDER BY episode_id, seg_idx")
def sort_segments(spark, sf_dir):
    """Order-preserving output: explicit index, sorted only at the sink."""
    return FX.segments(spark, sf_dir).select("episode_id", "seg_idx", "speaker").orderBy("episode_id", "seg_idx")


@query("sort_first_n", """
    SELECT episode_id, seg_idx, speaker FROM (
        SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) AS rn FROM f_segments) WHERE rn <= 2""")
def sort_first_n(spark, sf_dir):
    """First n segments per episode (row_number <= n; Spark applies a
    per-partition group limit before the shuffle)."""
    s = FX.segments(spark, sf_dir).select("episode_id", "seg_idx", "speaker")
    w = Window.partitionBy("episode_id").orderBy("seg_idx")
    return s.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2).drop("_rn")
