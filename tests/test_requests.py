"""Request tables, response fallback, strict handling, batch completion."""

import json

import pandas as pd

from parley.functions import fixed as FXV
from parley.operators import requests as R


def _chunks(spark):
    return spark.createDataFrame([(1, i, f"chunk {i}") for i in range(6)], "doc_id long, chunk_idx int, text string")


def test_fallback_cases(spark):
    body = lambda c: json.dumps({"choices": [{"message": {"content": c}}]})
    resp = spark.createDataFrame([
        (1, 0, 200, body("  cleaned \n")),   # stripped content
        (1, 1, 500, body("ignored")),        # bad status -> chunk
        (1, 2, 200, "not json"),             # parse error -> chunk
        (1, 3, 200, "{}"),                   # missing path -> chunk
        (1, 4, 200, body("")),               # empty content stays empty
        # chunk 5: no response row -> chunk
    ], "doc_id long, chunk_idx int, status int, body string")
    got = {r.chunk_idx: (r.text, r.used_fallback) for r in R.with_fallback(_chunks(spark), resp).collect()}
    assert got == {0: ("cleaned", False), 1: ("chunk 1", True), 2: ("chunk 2", True), 3: ("chunk 3", True),
                   4: ("", False), 5: ("chunk 5", True)}


def test_strict_split(spark):
    body = lambda c: json.dumps({"choices": [{"message": {"content": c}}]})
    resp = spark.createDataFrame([(1, 200, body("ok")), (2, 404, body("x")), (3, 200, "{}"), (4, 200, body(""))],
                                 "doc_id long, status int, body string")
    acc, fail = R.strict_responses(resp, "doc_id")
    assert [r.doc_id for r in acc.collect()] == [1]
    assert {r.doc_id: r.reason for r in fail.collect()} == {2: "status", 3: "no content", 4: "empty content"}


def test_requests_and_payload(spark):
    req = R.clean_requests(_chunks(spark))
    r = req.select(R.payload(req).alias("p"), "messages").first()
    p = json.loads(r.p)
    assert "stream" not in p and p["temperature"] == FXV.CLEAN_TEMPERATURE and p["max_tokens"] == FXV.CLEAN_MAX_TOKENS
    assert p["messages"][0] == {"role": "system", "content": FXV.CLEAN_SYSTEM_PROMPT}
    assert p["messages"][1]["content"] == "Clean this text: chunk 0"
    t = R.transcript_requests(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    p = json.loads(t.select(R.payload(t).alias("p")).first().p)
    assert p["stream"] is False and p["max_tokens"] == 4000


def test_complete_batches_turns_errors_into_rows(spark):
    req = R.clean_requests(_chunks(spark))

    def flaky(pdf: pd.DataFrame) -> pd.Series:
        if (pdf["chunk_idx"] == 3).any():
            raise RuntimeError("service unavailable")
        return pdf["chunk_idx"].map(lambda i: None if i == 1 else f"c{i}")

    out = R.complete_batches(req.repartition(6, "chunk_idx"), flaky, ["doc_id", "chunk_idx"])
    got = {r.chunk_idx: (r.status, r.body) for r in out.collect()}
    assert got[3][0] == 599 and "service unavailable" in got[3][1]
    assert got[1] == (204, "")
    assert got[0][0] == 200 and json.loads(got[0][1])["choices"][0]["message"]["content"] == "c0"


def test_wrong_number_of_replies_is_isolated(spark):
    import pandas as pd
    from parley.operators import requests as R
    req = spark.createDataFrame([(i, [{"role": "user", "content": f"t{i}"}]) for i in range(8)], "k long, messages array<struct<role:string,content:string>>").coalesce(1)

    def short(pdf):
        out = pdf["k"].astype(str)
        return out if 5 not in set(pdf["k"]) else out[:-1]

    got = {r.k: r.status for r in R.complete_batches(req, short, "k").collect()}
    assert got == {i: 599 if i == 5 else 200 for i in range(8)}


def test_a_call_gets_few_megabytes(spark):
    """One Arrow batch of 24 MB goes to the callable in pieces; passed columns
    come back as they were, null keys and large ones too."""
    import pandas as pd
    from pyspark.sql import functions as F
    from parley.operators import requests as R
    top = (1 << 63) - 1
    k = F.when(F.col("id") == 7, None).otherwise(F.lit(top) - F.col("id"))
    d = spark.range(300, numPartitions=1).select(k.alias("k"), F.repeat(F.lit("abcdefgh"), 5000).alias("text"))
    req = R.clean_requests(d, keys=("k",), keep=["text"])

    def sizes(pdf):
        n = pdf["messages"].map(lambda m: len(m[-1]["content"])).sum()
        return pd.Series([str(n)] * len(pdf), index=pdf.index)

    got = R.complete_batches(req, sizes, "k", passthrough=["text"]).collect()
    assert sorted(((r.k for r in got)), key=str) == sorted([None] + [top - i for i in range(300) if i != 7], key=str)
    assert all(r.status == 200 and len(r.text) == 40_000 for r in got)
    calls = {int(json.loads(r.body)["choices"][0]["message"]["content"]) for r in got}
    assert max(calls) <= R.PIECE_BYTES and len(calls) <= 2


def test_keyed_uniform_takes_any_key(spark):
    from pyspark.sql import functions as F
    from parley.functions.audio_math import keyed_uniform
    top = (1 << 63) - 1
    u = spark.range(1).select(keyed_uniform(0.0, 1.0, F.lit(top), F.lit(-top), 7919, 104729).alias("u")).first().u
    assert u == ((top * 7919 - top * 104729) % 10007) / 10007
