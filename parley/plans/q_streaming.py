"""Streaming queries: the same operators on streaming DataFrames."""

from __future__ import annotations

from parley.plans.q_episode import _DYN_SQL
from parley.plans.registry import query
from parley.sources import fixtures as FX
from parley.sources.fixtures import CHUNK_FIXTURE_WORDS
from parley.streaming import ingest, timeline


@query("stream_chunks", "SELECT doc_id, chunk_idx, n_words, text FROM f_chunks")
def stream_chunks(spark, sf_dir):
    """Documents ingested as a file stream (one file per trigger,
    ``availableNow``) and chunked; equals the batch chunks."""
    return ingest.stream_chunks(spark, sf_dir, n=CHUNK_FIXTURE_WORDS, glob="documents.parquet")


@query("stream_episode_state", f"""
    SELECT episode_id, seg_idx, ok_eff, prev_speaker, xfade_ms, end_ms FROM ({_DYN_SQL})""")
def stream_episode_state(spark, sf_dir):
    """Per-episode carried state (previous successful speaker, running end)
    in map state with timers; equals the dynamic timeline."""
    return timeline.stream_episode_state(spark, sf_dir, lambda c: FX.synth_from(FX.segments_from(c)),
                                         glob="conversations.parquet")
