"""Model request tables, pluggable batch completion, and response handling.

Requests are plain columns (``messages`` is ``array<struct<role,content>>``)
so that any serving system can consume them.  ``complete_batches`` applies a
user callable to pieces of Arrow batches with ``mapInArrow``: parallelism equals the
number of partitions and errors become status rows, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import fixed as FX
from parley.functions import text as T

CONTENT_PATH = "$.choices[0].message.content"


def _messages(system_prompt: str, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))


def clean_requests(chunks: DataFrame, keys=("doc_id", "chunk_idx"), text: str = "text",
                   keep=()) -> DataFrame:
    """One cleaning request per chunk (temperature 0.3, 2,000 tokens, no
    stream key); ``keep`` lists extra chunk columns to carry along."""
    return chunks.select(*keys, *keep,
                         _messages(FX.CLEAN_SYSTEM_PROMPT,
                                   F.concat(F.lit(FX.CLEAN_USER_PREFIX), F.col(text))).alias("messages"),
                         F.lit(FX.CLEAN_TEMPERATURE).alias("temperature"),
                         F.lit(FX.CLEAN_MAX_TOKENS).alias("max_tokens"),
                         F.lit(None).cast("boolean").alias("stream"))


def transcript_requests(docs: DataFrame, keys=("doc_id",), text: str = "text") -> DataFrame:
    """One transcript request per document (temperature 1.0, 4,000 tokens, stream false)."""
    return docs.select(*keys,
                       _messages(FX.TRANSCRIPT_SYSTEM_PROMPT,
                                 F.concat(F.lit(FX.TRANSCRIPT_USER_PREFIX), F.col(text))).alias("messages"),
                       F.lit(FX.TRANSCRIPT_TEMPERATURE).alias("temperature"),
                       F.lit(FX.TRANSCRIPT_MAX_TOKENS).alias("max_tokens"),
                       F.lit(FX.TRANSCRIPT_STREAM).alias("stream"))


def rewrite_requests(transcripts: DataFrame, keys=("doc_id",), text: str = "text") -> DataFrame:
    """One rewrite request per transcript (temperature 1.0, 4,000 tokens, stream false)."""
    return transcripts.select(*keys,
                              _messages(FX.REWRITE_SYSTEM_PROMPT,
                                        F.concat(F.lit(FX.REWRITE_USER_PREFIX), F.col(text))).alias("messages"),
                              F.lit(FX.REWRITE_TEMPERATURE).alias("temperature"),
                              F.lit(FX.REWRITE_MAX_TOKENS).alias("max_tokens"),
                              F.lit(FX.REWRITE_STREAM).alias("stream"))


def payload(requests: DataFrame) -> Column:
    """JSON request body; the ``stream`` key is omitted when null."""
    return F.to_json(F.struct("messages", "temperature", "max_tokens", "stream"))


def response_content(body: Column | str) -> Column:
    """``choices[0].message.content`` or null (bad JSON, missing path)."""
    b = F.col(body) if isinstance(body, str) else body
    return F.get_json_object(b, CONTENT_PATH)


def apply_fallback(df: DataFrame, keys=("doc_id", "chunk_idx"), text: str = "text") -> DataFrame:
    """Row-wise fallback on a table holding the chunk text and its response
    (status, body; null when there is none).  Status 200 with content gives
    the stripped content; anything else keeps the chunk text.
    Output: keys, text, used_fallback."""
    content = F.when(F.col("status") == FX.OK_STATUS, T.py_strip(response_content("body")))
    return df.select(*keys, F.coalesce(content, F.col(text)).alias(text),
                     content.isNull().alias("used_fallback"))


def with_fallback(chunks: DataFrame, responses: DataFrame, keys=("doc_id", "chunk_idx"),
                  text: str = "text") -> DataFrame:
    """Chunk joined to its response (left join, one to one), then
    :func:`apply_fallback`.  For responses produced by
    :func:`complete_batches` with the text passed through, call
    ``apply_fallback`` directly and skip the join."""
    keys = list(keys)
    return apply_fallback(chunks.join(responses, keys, "left"), keys, text)


def strict_responses(responses: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Split responses into accepted (2xx/3xx status with non-empty content)
    and failures (with a reason); a failure voids the whole item."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    content = response_content("body")
    status_ok = F.col("status").between(200, 399)
    ok = status_ok & F.coalesce(F.length(content) > 0, F.lit(False))
    d = responses.select(*keys, "status", content.alias("content"), ok.alias("_ok"), status_ok.alias("_sok"))
    accepted = d.where("_ok").select(*keys, "status", "content")
    failures = d.where(~F.col("_ok")).select(
        *keys, "status",
        F.when(~F.col("_sok"), "status").when(F.col("content").isNull(), "no content")
        .otherwise("empty content").alias("reason"))
    return accepted, failures


RESPONSE_SCHEMA = "status int, body string"
PIECE_BYTES = 4 << 20  # of requests that a call gets as a pandas frame


def complete_batches(requests: DataFrame, fn: Callable[[pd.DataFrame], pd.Series],
                     keys, *, passthrough=(), out_schema: str | None = None) -> DataFrame:
    """Apply ``fn`` to pieces of requests (``PIECE_BYTES``, a row at least) and
    return (keys, status, body).

    A task holds one Arrow batch and the frame, replies and bodies of one piece.
    ``fn`` gets a pandas frame with the request columns and returns the
    reply contents as a Series (None for no reply).  ``passthrough``
    columns are copied to the output, so a caller can keep e.g. the chunk
    text next to its reply instead of joining it back later.  When a call raises
    or gets a wrong number of replies, its halves are tried again, down to single
    rows; those that still raise become
    status-599 rows carrying the error text, so one bad request never fails
    the job or its neighbours.  Parallelism is the partition count of
    ``requests``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    keep = keys + [c for c in passthrough if c not in keys]
    by_name = {f.name: f for f in requests.schema.fields}
    key_schema = ", ".join(f"{c} {by_name[c].dataType.simpleString()}" for c in keep)
    schema = out_schema or f"{key_schema}, {RESPONSE_SCHEMA}"

    def replies(pdf: pd.DataFrame) -> tuple[list, list]:
        import json
        try:
            content = list(fn(pdf))
            if len(content) != len(pdf):
                raise ValueError(f"{len(content)} replies to {len(pdf)} requests")
            return ([200 if c is not None else 204 for c in content],
                    [json.dumps({"choices": [{"message": {"content": c}}]}) if c is not None else ""
                     for c in content])
        except Exception as exc:
            if len(pdf) == 1:
                return [599], [json.dumps({"error": str(exc)})]
            # Halves isolate the failing requests without calling for every row again.
            (s, b), (s2, b2) = replies(pdf.iloc[:len(pdf) // 2]), replies(pdf.iloc[len(pdf) // 2:])
            return s + s2, b + b2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, PIECE_BYTES * batch.num_rows // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                status, body = replies(piece.to_pandas())
                cols = [piece.column(c) for c in keep] + [pa.array(status, pa.int32()), pa.array(body, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "status", "body"])

    return requests.mapInArrow(run, schema)


def prefix_completion(prefix: str) -> Callable[[pd.DataFrame], pd.Series]:
    """Deterministic offline completion: ``prefix`` + the user message."""
    def fn(pdf: pd.DataFrame) -> pd.Series:
        return pdf["messages"].map(lambda m: prefix + m[-1]["content"])
    return fn
