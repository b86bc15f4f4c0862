"""Queries over model requests and responses (flow A step 3, flow B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import fixed as FXV
from parley.operators import dialogue as D
from parley.operators import requests as R
from parley.plans.fixture_sql import strip
from parley.plans.registry import query
from parley.sources import fixtures as FX

COMPLETION_PREFIX = "DONE: "


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CONTENT_SQL = "CASE WHEN json_valid(body) THEN json_extract_string(body, '$.choices[0].message.content') END"

# Transcripts used by flow B: "Speaker N: text" lines per episode.
TRANSCRIPTS_CTE = {"q_transcripts": """
    SELECT episode_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY seg_idx) AS text
    FROM f_segments GROUP BY episode_id"""}


def transcripts(spark, sf_dir):
    return D.render_transcripts(FX.segments(spark, sf_dir))


def _request_cols(req):
    return [F.size("messages").alias("n_messages"),
            F.md5(F.element_at("messages", 1)["content"]).alias("system_md5"),
            F.element_at("messages", 1)["role"].alias("system_role"),
            F.element_at("messages", 2)["role"].alias("user_role"),
            F.element_at("messages", 2)["content"].alias("user_content"),
            "temperature", "max_tokens", "stream"]


def _request_sql(prompt: str, user_expr: str, temperature: float, max_tokens: int, stream: str) -> str:
    return (f"CAST(2 AS BIGINT) AS n_messages, md5({lit(prompt)}) AS system_md5, 'system' AS system_role, "
            f"'user' AS user_role, {user_expr} AS user_content, CAST({temperature} AS DOUBLE) AS temperature, "
            f"CAST({max_tokens} AS BIGINT) AS max_tokens, {stream} AS stream")


@query("req_clean", f"""
    SELECT doc_id, chunk_idx, {_request_sql(FXV.CLEAN_SYSTEM_PROMPT, "'Clean this text: ' || text",
                                            FXV.CLEAN_TEMPERATURE, FXV.CLEAN_MAX_TOKENS, "CAST(NULL AS BOOLEAN)")}
    FROM f_chunks""")
def req_clean(spark, sf_dir):
    req = R.clean_requests(FX.chunks(spark, sf_dir))
    return req.select("doc_id", "chunk_idx", *_request_cols(req))


@query("req_transcript", f"""
    SELECT doc_id, {_request_sql(FXV.TRANSCRIPT_SYSTEM_PROMPT,
                                 "'Convert this text into a natural podcast dialogue: ' || text",
                                 FXV.TRANSCRIPT_TEMPERATURE, FXV.TRANSCRIPT_MAX_TOKENS, "false")}
    FROM documents""")
def req_transcript(spark, sf_dir):
    req = R.transcript_requests(FX.documents(spark, sf_dir))
    return req.select("doc_id", *_request_cols(req))


@query("req_rewrite", f"""
    SELECT episode_id, {_request_sql(FXV.REWRITE_SYSTEM_PROMPT,
                                     "'Please rewrite this transcript into a more natural conversation:'"
                                     " || chr(10) || chr(10) || text",
                                     FXV.REWRITE_TEMPERATURE, FXV.REWRITE_MAX_TOKENS, "false")}
    FROM q_transcripts""", TRANSCRIPTS_CTE)
def req_rewrite(spark, sf_dir):
    req = R.rewrite_requests(transcripts(spark, sf_dir), keys=("episode_id",))
    return req.select("episode_id", *_request_cols(req))


@query("str_prompt_render", "SELECT doc_id, chunk_idx, 'Clean this text: ' || text AS content FROM f_chunks")
def str_prompt_render(spark, sf_dir):
    req = R.clean_requests(FX.chunks(spark, sf_dir))
    return req.select("doc_id", "chunk_idx", F.element_at("messages", -1)["content"].alias("content"))


@query("json_request_payload", f"""
    SELECT doc_id, chunk_idx,
           CAST(json_extract_string(p, '$.temperature') AS DOUBLE) AS temperature,
           CAST(json_extract_string(p, '$.max_tokens') AS BIGINT) AS max_tokens,
           json_exists(p, '$.stream') AS has_stream,
           CAST(json_array_length(p, '$.messages') AS BIGINT) AS n_messages,
           json_extract_string(p, '$.messages[1].content') AS user_content
    FROM (SELECT doc_id, chunk_idx,
                 json_object('messages', json_array(json_object('role', 'system', 'content', {lit(FXV.CLEAN_SYSTEM_PROMPT)}),
                                                    json_object('role', 'user', 'content', 'Clean this text: ' || text)),
                             'temperature', 0.3, 'max_tokens', 2000)::VARCHAR AS p
          FROM f_chunks)""")
def json_request_payload(spark, sf_dir):
    """Request bodies serialised to JSON and read back field by field (the
    ``stream`` key is absent for cleaning requests)."""
    req = R.clean_requests(FX.chunks(spark, sf_dir))
    p = req.select("doc_id", "chunk_idx", R.payload(req).alias("p"))
    return p.select("doc_id", "chunk_idx",
                    F.get_json_object("p", "$.temperature").cast("double").alias("temperature"),
                    F.get_json_object("p", "$.max_tokens").cast("long").alias("max_tokens"),
                    F.get_json_object("p", "$.stream").isNotNull().alias("has_stream"),
                    F.json_array_length(F.get_json_object("p", "$.messages")).cast("long").alias("n_messages"),
                    F.get_json_object("p", "$.messages[1].content").alias("user_content"))


@query("json_response_content", f"SELECT doc_id, chunk_idx, status, {CONTENT_SQL} AS content FROM f_responses")
def json_response_content(spark, sf_dir):
    r = FX.responses(spark, sf_dir)
    return r.select("doc_id", "chunk_idx", "status", R.response_content("body").alias("content"))


_FALLBACK_CONTENT = f"CASE WHEN r.status = 200 THEN {strip(CONTENT_SQL.replace('body', 'r.body'))} END"


@query("flt_response_fallback", f"""
    SELECT c.doc_id, c.chunk_idx, coalesce({_FALLBACK_CONTENT}, c.text) AS text,
           ({_FALLBACK_CONTENT}) IS NULL AS used_fallback
    FROM f_chunks c LEFT JOIN f_responses r ON c.doc_id = r.doc_id AND c.chunk_idx = r.chunk_idx""")
def flt_response_fallback(spark, sf_dir):
    chunks = FX.chunks(spark, sf_dir)
    return R.with_fallback(chunks, FX.responses(spark, sf_dir, chunks))


@query("join_chunk_response", """
    SELECT c.doc_id, c.chunk_idx, r.status, r.status IS NOT NULL AS matched
    FROM f_chunks c LEFT JOIN f_responses r ON c.doc_id = r.doc_id AND c.chunk_idx = r.chunk_idx""")
def join_chunk_response(spark, sf_dir):
    chunks = FX.chunks(spark, sf_dir)
    j = chunks.join(FX.responses(spark, sf_dir, chunks), ["doc_id", "chunk_idx"], "left")
    return j.select("doc_id", "chunk_idx", "status", F.col("status").isNotNull().alias("matched"))


@query("flt_strict_response", f"""
    SELECT doc_id, chunk_idx, status, ok AS accepted,
           CASE WHEN ok THEN NULL WHEN NOT (status BETWEEN 200 AND 399) THEN 'status'
                WHEN content IS NULL THEN 'no content' ELSE 'empty content' END AS reason
    FROM (SELECT *, (status BETWEEN 200 AND 399) AND coalesce(length(content) > 0, false) AS ok
          FROM (SELECT doc_id, chunk_idx, status, {CONTENT_SQL} AS content FROM f_responses))""")
def flt_strict_response(spark, sf_dir):
    """Strict handling (transcript / rewrite): accepted rows and failures with
    a reason, as one table."""
    accepted, failures = R.strict_responses(FX.responses(spark, sf_dir), ["doc_id", "chunk_idx"])
    return (accepted.select("doc_id", "chunk_idx", "status", F.lit(True).alias("accepted"),
                     F.lit(None).cast("string").alias("reason"))
            .unionByName(failures.select("doc_id", "chunk_idx", "status", F.lit(False).alias("accepted"),
                                         "reason")))


@query("udf_batch_complete", f"""
    SELECT doc_id, chunk_idx, CAST(200 AS BIGINT) AS status,
           '{COMPLETION_PREFIX}' || 'Clean this text: ' || text AS content
    FROM f_chunks""")
def udf_batch_complete(spark, sf_dir):
    """Batch completion (``complete_batches``) with an offline callable."""
    req = R.clean_requests(FX.chunks(spark, sf_dir))
    out = R.complete_batches(req, R.prefix_completion(COMPLETION_PREFIX), ["doc_id", "chunk_idx"])
    return out.select("doc_id", "chunk_idx", "status", R.response_content("body").alias("content"))
