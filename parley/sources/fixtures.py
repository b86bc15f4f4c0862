"""Derived inputs built from the driver tables by deterministic rules.

Each builder returns a DataFrame computed by Spark from the given tables,
so its size grows with them.  The same rules are written in SQL in
``parley.plans.fixture_sql`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import text as text_ops

CHUNK_FIXTURE_WORDS = 100          # fixture chunk size (the library default is 1,000)
CROSSFADE_FRAMES = 8               # fixture crossfade for 64-frame waveforms
SEGMENTS_PER_EPISODE = 25          # waveform vectors per episode

# Suffixes injected by ``doc_id % 8`` to exercise the cleanup rules.
MARK_SUFFIXES = [
    " $x^2+1$ tail",
    " \\alpha{b} tail",
    " [12, 3] tail",
    " (Smith et al., 2020) tail",
    "\n• bullet item\n1. first",
    "\nHere's the cleaned text:\ntail",
    " Umm, hmm [laughs] tail",
    "\n\n\n\nReferences\n[1] x",
]


# Hash keys used to spread a table whose scan yields too few splits.
SPREAD_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table; see :func:`parley.sources.files.spread`."""
    from parley.sources.files import spread
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), SPREAD_KEYS.get(name))


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def pages(spark, sf_dir) -> DataFrame:
    """One row per line of each document, 0-based ``page_no``."""
    return text_ops.split_pages(documents(spark, sf_dir))


def chunks(spark, sf_dir, n: int = CHUNK_FIXTURE_WORDS) -> DataFrame:
    return text_ops.word_chunks(documents(spark, sf_dir), n=n)


def marked(spark, sf_dir) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(s) for s in MARK_SUFFIXES]),
                          (F.col("doc_id") % 8 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.concat("text", suffix).alias("text"))


def response_body(content) -> "F.Column":
    """Chat-completion JSON with ``choices[0].message.content``."""
    return F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))
                                      ).alias("choices")))


def responses(spark, sf_dir, chunk_df: DataFrame | None = None) -> DataFrame:
    """Stand-in model responses keyed by (doc_id, chunk_idx).

    r = (doc_id*7 + chunk_idx*3) % 10: 0 status 500, 1 body not JSON,
    2 body without choices, 3 no row, otherwise 200 with padded content.
    """
    c = chunk_df if chunk_df is not None else chunks(spark, sf_dir)
    r = (F.col("doc_id") * 7 + F.col("chunk_idx") * 3) % 10
    ok_content = F.concat(F.lit("  [ok] "), F.col("text"), F.lit(" "))
    return (c.where(r != 3)
            .select("doc_id", "chunk_idx",
                    F.when(r == 0, 500).otherwise(200).alias("status"),
                    F.when(r == 0, F.lit('{"error":"server"}'))
                     .when(r == 1, F.lit("not json"))
                     .when(r == 2, F.lit("{}"))
                     .otherwise(response_body(ok_content)).alias("body")))


def segments(spark, sf_dir) -> DataFrame:
    return segments_from(table(spark, sf_dir, "conversations"))


def segments_from(conv: DataFrame) -> DataFrame:
    """Dialogue segments from conversation turns (batch or stream):
    assistant = Speaker 1, user = Speaker 2, system = Speaker 3 (exercises
    the "anything else" branch); every turn with ``turn % 5 = 2`` gains a
    quote and a backslash."""
    speaker = (F.when(F.col("role") == "assistant", "Speaker 1")
               .when(F.col("role") == "user", "Speaker 2").otherwise("Speaker 3"))
    text = F.when(F.col("turn") % 5 == 2, F.concat(F.lit('He said "so\\far" '), F.col("text"))
                  ).otherwise(F.col("text"))
    return conv.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("seg_idx"),
                       speaker.alias("speaker"), text.alias("text"))


def replies(spark, sf_dir) -> DataFrame:
    """One model reply per episode in the tuple-list format, with a header
    line; turn 1 of every episode with ``episode_id % 10 = 3`` is broken."""
    seg = segments(spark, sf_dir)
    line = F.concat(F.lit('("'), F.col("speaker"), F.lit('", "'), T.escape("text"),
                    F.when((F.col("episode_id") % 10 == 3) & (F.col("seg_idx") == 1), F.lit('"x)'))
                    .otherwise(F.lit('"),')))
    body = (seg.groupBy("episode_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("l")))),
                                          lambda s: s["l"]), "\n").alias("lines")))
    return body.select("episode_id",
                       F.concat(F.lit("Sure!\n[\n"), F.col("lines"), F.lit("\n]")).alias("reply"))


def synth(spark, sf_dir) -> DataFrame:
    return synth_from(segments(spark, sf_dir))


def synth_from(seg: DataFrame) -> DataFrame:
    """Synthesis results: duration 60 ms per character, every 7th fails;
    a failure is a missing reply for even (episode_id + seg_idx), else an error."""
    return seg.select("episode_id", "seg_idx", "speaker", "text",
                      (F.length("text") * 60).cast("long").alias("dur_ms"),
                      ((F.col("episode_id") * 31 + F.col("seg_idx")) % 7 != 0).alias("ok"),
                      F.lit(24000).alias("frame_rate"),
                      F.when((F.col("episode_id") * 31 + F.col("seg_idx")) % 7 != 0, F.lit(None).cast("string"))
                      .when((F.col("episode_id") + F.col("seg_idx")) % 2 == 0, F.lit("no_reply"))
                      .otherwise(F.lit("error")).alias("fail_kind"))


def pauses(spark, sf_dir) -> DataFrame:
    seg = segments(spark, sf_dir)
    return seg.select("episode_id", "seg_idx",
                      ((F.col("episode_id") * 17 + F.col("seg_idx") * 13) % 600 + 200).cast("long")
                      .alias("pause_ms"))


def voices(spark) -> DataFrame:
    """Voice dimension (provider, speaker, voice, is_default); the Speaker 2
    row of each provider is its default."""
    from parley.functions.fixed import VOICES
    rows = [(p, s, v, s == "Speaker 2") for p, s, v in VOICES]
    rows += [("eleven", "Speaker 1", "voice_a", False), ("eleven", "Speaker 2", "voice_b", True)]
    return spark.createDataFrame(rows, "provider string, speaker string, voice string, is_default boolean")


def catalog(spark, sf_dir) -> DataFrame:
    """Voice-list JSON bodies, one per conversation, one voice per turn."""
    conv = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    v = F.struct(F.concat(F.lit("Voice "), cid, F.lit("-"), turn).alias("name"),
                 F.concat(F.lit("v"), cid, F.lit("_"), turn).alias("voice_id"))
    return (conv.groupBy("conv_id")
            .agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", v.alias("v")))),
                                                lambda s: s["v"]).alias("voices"))).alias("body")))


def paths(spark, sf_dir) -> DataFrame:
    ext = F.element_at(F.array(F.lit(".pdf"), F.lit(".PDF"), F.lit(".txt"), F.lit("")),
                       (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), ext).alias("path"))


def encoded(spark, sf_dir) -> DataFrame:
    """Document bytes: UTF-8 for even ids, ISO-8859-1 for odd ids (characters
    outside Latin-1 become '?'); every id divisible by 3 uses CRLF line ends."""
    d = documents(spark, sf_dir)
    t = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
               ).otherwise(F.col("text"))
    content = F.when(F.col("doc_id") % 2 == 0, F.encode(t, "UTF-8")).otherwise(F.encode(t, "ISO-8859-1"))
    return d.select("doc_id", content.alias("content"))


def waves(spark, sf_dir) -> DataFrame:
    """Waveforms (64 samples) from ``embeddings``: 25 segments per episode;
    even labels are Speaker 1."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") / SEGMENTS_PER_EPISODE).cast("long").alias("episode_id"),
                    (F.col("vec_id") % SEGMENTS_PER_EPISODE).alias("seg_idx"),
                    F.col("embedding").cast("array<double>").alias("samples"),
                    F.when(F.col("label") % 2 == 0, "Speaker 1").otherwise("Speaker 2").alias("speaker"))


def frames(spark, sf_dir) -> DataFrame:
    w = waves(spark, sf_dir)
    return w.select("episode_id", "seg_idx", "speaker",
                    F.posexplode("samples").alias("i", "amp"))


def tone(spark) -> DataFrame:
    """Room tone loop: 16 frames, amplitude (t - 8) / 80."""
    return spark.range(16).select(F.col("id").cast("int").alias("t"),
                                  ((F.col("id") - 8) / 80.0).alias("amp"))
