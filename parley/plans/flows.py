"""End-to-end flows built from the operators.

Flow A: pages -> capped documents -> chunks -> cleaning requests ->
completion -> fallback -> cleaned documents.
Flow B: transcripts -> rewrite requests -> completion -> strict responses ->
parsed segments.
Flow C: segments + synthesis results -> dynamic timeline -> counters ->
manifest.
Flow D: synthesised segments -> voice chain -> room ambience -> dynamic mix
onto the intro -> master.
Flows E and F: the assembled signals of the two other variants (gaps,
crossfades and pauses; gaps only).

What must not be computed twice (replies of a model, signals that are read
more than once) is written to the shared checkpoint folder (``materialize``).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import fixed as FXV
from parley.operators import audio as A
from parley.operators import blocks as B
from parley.operators import dialogue as D
from parley.operators import episode as E
from parley.operators import requests as R
from parley.operators import text as X
from parley.operators.dims import join_small
from parley.plans.q_dialogue import _HEAD, CANDIDATES_CTE, _ok
from parley.plans.q_episode import _DYN_SQL
from parley.plans.fixture_sql import words
from parley.plans.registry import query
from parley.session import cut_lineage
from parley.sources import fixtures as FX

Completion = Callable[[pd.DataFrame], pd.Series]


def flow_a(pages: DataFrame, complete: Completion, max_chars: int = FXV.MAX_CHARS,
           chunk_words: int = FXV.CHUNK_WORDS, materialize=cut_lineage) -> DataFrame:
    """Pages -> cleaned documents (doc_id, text, n_chunks, n_fallback)."""
    docs = X.cap_document(pages, max_chars)
    chunks = X.word_chunks(docs, n=chunk_words)
    # The chunk text travels with its request and reply, so the fallback is
    # a per-row projection instead of a join of two large tables.  Replies
    # are stored right away: a retried task downstream must not call the
    # model again and see a different answer.
    requests = R.clean_requests(chunks, keep=["text"])
    responses = materialize(R.complete_batches(requests, complete, ["doc_id", "chunk_idx"], passthrough=["text"]),
                            "clean_responses")
    cleaned = R.apply_fallback(responses)
    return X.ordered_concat(cleaned, "doc_id", "chunk_idx", "text", FXV.CHUNK_SEPARATOR, "text",
                            F.count("*").alias("n_chunks"), F.count_if("used_fallback").alias("n_fallback"))


def flow_b(transcripts: DataFrame, complete: Completion, key: str = "episode_id",
           materialize=cut_lineage) -> tuple[DataFrame, DataFrame]:
    """Transcripts -> (segments, failures): strict response handling, then the
    gated reply parser.  A reply that the gate voids is a failure
    (``unparsed``), so every transcript is in one of the two."""
    req = R.rewrite_requests(transcripts, keys=(key,))
    responses = materialize(R.complete_batches(req, complete, [key]), "rewrite_responses")
    accepted, failures = R.strict_responses(responses, [key])
    replies = accepted.withColumnRenamed("content", "reply")
    segments = D.parse_replies(replies, key=key)
    voided = D.parse_gate(replies, key=key, keep=("status",)).where(~F.col("accepted"))
    failures = failures.unionByName(voided.select(key, "status", F.lit("unparsed").alias("reason")))
    return materialize(segments, "segments"), failures


def flow_c(synth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Synthesis results per segment -> (dynamic timeline, per-episode summary)."""
    totals = E.episode_totals(synth)
    return E.timeline_dynamic(synth), totals.select("episode_id", "n_segments", "n_ok", F.col("duration_dynamic_ms").alias("duration_ms"))


def flow_d(waves: DataFrame, tone: list[float], frame_rate: float, materialize=cut_lineage) -> DataFrame:
    """Synthesised segments (episode_id, seg_idx, speaker, samples, ok) -> the
    mastered episode in blocks of a second (:mod:`parley.operators.blocks`): voice
    chain and room ambience of every segment, appended onto the intro with the
    crossfades of the dynamic timeline, then the master chain.  Failed segments and audio too short for
    room ambience are left out; an episode without a segment has no audio."""
    ms = F.floor(F.size("samples") * F.lit(1000.0) / frame_rate).cast("long")
    synth = waves.select("episode_id", "seg_idx", "speaker", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce(ms, F.lit(0)).alias("dur_ms"))
    frames = lambda c: F.floor(c * F.lit(frame_rate) / 1000).cast("long")
    placed = E.timeline_dynamic(synth).where("ok_eff").select("episode_id", "seg_idx", frames(F.col("xfade_ms")).alias("xfade"))
    seg = join_small(waves.select("episode_id", "seg_idx", "speaker", "samples"), placed, ["episode_id", "seg_idx"])
    seg = A.speaker_eq(seg.withColumn("samples", A.normalise(F.col("samples"))), rate=F.lit(frame_rate))
    seg = seg.withColumn("samples", A.compress_samples(F.col("samples"), *FXV.SEGMENT_COMPRESSOR, frame_rate))
    seg = seg.withColumn("samples", A.segment_ambience(F.col("samples"), tone, FXV.ROOM_VOLUME_DB, F.col("episode_id"), F.col("seg_idx"), frame_rate))
    seg = materialize(seg.select("episode_id", "seg_idx", "samples", "xfade"), "voiced")

    first = int(FXV.INTRO_FADE_IN_MS * frame_rate / 1000)
    silence = F.array_repeat(F.lit(0.0), int(FXV.INTRO_MS * frame_rate / 1000))
    intro = seg.groupBy("episode_id").agg(F.min("seg_idx").alias("_first")).select("episode_id", (F.col("_first") - 1).alias("seg_idx"))
    intro = intro.withColumn("samples", A.segment_ambience(silence, tone, FXV.INTRO_ROOM_VOLUME_DB, F.col("episode_id"), F.lit(-1), frame_rate))
    intro = intro.withColumn("samples", F.transform("samples", lambda x, i: x * F.least(F.lit(1.0), i / F.lit(float(max(first, 1))))))
    whole = seg.unionByName(intro.withColumn("xfade", F.lit(0).cast("long")))
    second = int(frame_rate)
    mixed = B.mix(whole, "xfade", second, B.look_back(FXV.MASTER_COMPRESSOR, frame_rate))
    return B.master_chain(mixed, frame_rate, second, materialize)


def flow_e(waves: DataFrame, pause_ms: Column, frame_rate: float, materialize=cut_lineage) -> DataFrame:
    """Synthesised segments (episode_id, seg_idx, samples; no samples where
    synthesis failed) -> the episode in blocks of a second: a gap before every
    segment after the first, into which it fades, a pause of ``pause_ms`` behind
    it, and the whole scaled to its peak."""
    second = int(frame_rate)
    frames = lambda ms: int(ms * frame_rate / 1000)
    pause = F.floor(pause_ms * F.lit(frame_rate) / 1000).cast("long")
    placed = A.place_with_gaps(waves, frames(FXV.GAP_MS), frames(FXV.BASE_CROSSFADE_MS), pause)
    return B.normalise(materialize(B.assemble(placed, second, gaps=True), "assembled"), second)


def flow_f(waves: DataFrame, frame_rate: float) -> DataFrame:
    """Synthesised segments -> the episode in blocks of a second: a gap before
    every segment after the first."""
    return B.assemble(A.place_with_gaps(waves, int(FXV.GAP_MS * frame_rate / 1000)), int(frame_rate), gaps=True)


_PLAN_CTES = {
    **CANDIDATES_CTE,
    "q_parsed": f"""
    SELECT episode_id, k AS seg_idx, regexp_extract(c[k + 1], '{_HEAD}', 1) AS speaker
    FROM (SELECT episode_id, c, unnest(range(len(c))) AS k FROM q_cands
          WHERE len(c) > 0 AND len(list_filter(c, lambda l: NOT {_ok('l')})) = 0)""",
    "q_plan_synth": """
    SELECT s.episode_id, s.seg_idx, s.speaker, f.dur_ms, f.ok
    FROM q_parsed s JOIN f_synth f ON f.episode_id = s.episode_id AND f.seg_idx = s.seg_idx""",
}


@query("flow_episode_plan", f"""
    SELECT episode_id, count(*) AS n_segments, CAST(count_if(ok_eff) AS BIGINT) AS n_ok, max(end_ms) AS duration_ms
    FROM ({_DYN_SQL.replace("FROM f_synth", "FROM q_plan_synth")})
    GROUP BY episode_id""", _PLAN_CTES)
def flow_episode_plan(spark, sf_dir):
    """Flows B and C: replies parsed with the gate, synthesis results joined
    by (episode, segment), dynamic timeline, per-episode summary."""
    seg = D.parse_replies(FX.replies(spark, sf_dir))
    res = FX.synth(spark, sf_dir).select("episode_id", "seg_idx", "dur_ms", "ok")
    synth = seg.join(res, ["episode_id", "seg_idx"])
    return flow_c(synth)[1]


def _stand_in_cleaner(pdf: pd.DataFrame) -> pd.Series:
    """Offline stand-in for the cleaning model: no reply where
    ``(doc_id*7 + chunk_idx*3) % 10 < 4``, else the text with a prefix."""
    r = (pdf["doc_id"] * 7 + pdf["chunk_idx"] * 3) % 10
    return pd.Series([None if k < 4 else f"  [ok] {t} " for k, t in zip(r, pdf["text"])], index=pdf.index, dtype=object)


@query("flow_clean_docs", f"""
    SELECT doc_id,
           string_agg(CASE WHEN (doc_id * 7 + chunk_idx * 3) % 10 < 4 THEN text ELSE '[ok] ' || text END || chr(10) || chr(10),
                      '' ORDER BY chunk_idx) AS text,
           count(*) AS n_chunks, CAST(count_if((doc_id * 7 + chunk_idx * 3) % 10 < 4) AS BIGINT) AS n_fallback
    FROM q_capped_chunks GROUP BY doc_id""", {
    "q_capped": f"SELECT doc_id, {words(f'substring(text || chr(10), 1, {FXV.MAX_CHARS})')} AS w FROM documents",
    "q_capped_chunks": f"""
        SELECT doc_id, i AS chunk_idx, array_to_string(w[i * {FXV.CHUNK_WORDS} + 1 : (i + 1) * {FXV.CHUNK_WORDS}], ' ') AS text
        FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / {FXV.CHUNK_WORDS}.0) AS BIGINT))) AS i FROM q_capped)"""})
def flow_clean_docs(spark, sf_dir):
    """Flow A: pages -> character cap -> chunks -> requests -> batch completion
    -> fallback -> cleaned documents (each chunk + blank line)."""
    return flow_a(FX.pages(spark, sf_dir), _stand_in_cleaner)


def _stand_in_rewriter(pdf: pd.DataFrame) -> pd.Series:
    """Offline stand-in for the rewriting model, by ``episode_id % 10``: no
    reply (0), a broken tuple (1), else two turns that count the transcript's."""
    def one(k: int, messages) -> str | None:
        if k % 10 == 0:
            return None
        if k % 10 == 1:
            return '[\n("Speaker 1", "fine"),\n("Speaker 2", broken)\n]'
        transcript = messages[-1]["content"].removeprefix(FXV.REWRITE_USER_PREFIX)
        turns = sum(line.startswith("Speaker ") for line in transcript.split("\n"))
        return f'[\n("Speaker 1", "Episode {k}"),\n("Speaker 2", "{turns} turns"),\n]'
    return pd.Series([one(k, m) for k, m in zip(pdf["episode_id"], pdf["messages"])], index=pdf.index, dtype=object)


@query("flow_rewrite", """
    SELECT episode_id, seg_idx, speaker, text, reason
    FROM (SELECT episode_id, count(*) AS n FROM (
              SELECT episode_id, unnest(string_split(speaker || ': ' || text, chr(10))) AS line FROM f_segments)
          WHERE starts_with(line, 'Speaker ') GROUP BY episode_id),
         LATERAL (SELECT * FROM (VALUES
             (CAST(0 AS BIGINT), 'Speaker 1', 'Episode ' || episode_id, CAST(NULL AS VARCHAR)),
             (1, 'Speaker 2', n || ' turns', NULL)) v(seg_idx, speaker, text, reason) WHERE episode_id % 10 > 1
         UNION ALL SELECT NULL, NULL, NULL, CASE WHEN episode_id % 10 = 0 THEN 'no content' ELSE 'unparsed' END
         WHERE episode_id % 10 <= 1)""")
def flow_rewrite(spark, sf_dir):
    """Flow B: transcripts -> rewrite requests -> batch completion -> strict
    responses -> parsed segments, and the failed episodes with their reason."""
    segments, failures = flow_b(D.render_transcripts(FX.segments(spark, sf_dir)), _stand_in_rewriter)
    failed = failures.select("episode_id", F.lit(None).cast("long").alias("seg_idx"), F.lit(None).cast("string").alias("speaker"),
                             F.lit(None).cast("string").alias("text"), "reason")
    return segments.select("episode_id", "seg_idx", "speaker", "text", F.lit(None).cast("string").alias("reason")).unionByName(failed)
