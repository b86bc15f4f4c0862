"""Corpus pipeline: language ID, exact and near duplicates, benchmark
decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that stay
(the last one also their topic, tokens, how often each is to be taken on
average, and how often it is); it is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import stored, table
from parley.llm.decontaminate import drop_contaminated
from parley.llm.exact_dedup import drop_exact
from parley.llm.language_id import held_out, predict_language, train
from parley.llm.mixing import mixing_probabilities
from parley.llm.near_dedup import drop_near


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, or without a letter)."""
    model = train(docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull()))
    name = "_" * max(map(len, docs.columns))  # of no column of the documents
    out = predict_language(docs, model, keep=docs.columns, names=(f"{name}lang", f"{name}score"))
    return out.where(F.col(f"{name}lang") != "und").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing_probabilities(docs).where("selected")
    return out.select("doc_id", "text", "lang", "source", "n_chars", "topic", "tokens", F.round("p", 6).alias("p"), "copies")


STAGES = [("language id", known_language), ("exact dedup", exact_copies), ("near dedup", near_copies),
          ("decontamination", benchmark_passages), ("mixing", mix)]

# Language identification and near duplicates are not expressible in SQL; the tests compare run() with a
# plain version of all stages on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
