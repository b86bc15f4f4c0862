"""Sinks: cleaned documents, transcripts, segment tables, episode audio and manifests.

Writers take DataFrames and write with Spark's writers (partitioned
directories, atomic job commit) or the file sink of this package; nothing is collected to the driver.
Empty results write nothing because the rows are filtered beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.fixed import CLEAN_FILE_PREFIX, CLEAN_FILE_SUFFIX
from parley.sinks.files import unique_names, write_files
from parley.sources.files import stem
from parley.sources.pcm import pcm_bytes


def clean_file_name(path: Column) -> Column:
    """``clean_{stem}.txt`` for an input path."""
    return F.concat(F.lit(CLEAN_FILE_PREFIX), stem(path), F.lit(CLEAN_FILE_SUFFIX))


def with_clean_names(docs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Adds ``file_name``: ``clean_{stem}.txt``, told apart where stems clash."""
    return unique_names(docs, path_col, text_col, CLEAN_FILE_PREFIX, CLEAN_FILE_SUFFIX, stem(F.col(path_col)))


def write_clean_docs(docs: DataFrame, out_dir: str, name_col: str = "file_name",
                     text_col: str = "text", mode: str = "overwrite", per_file: bool = False) -> None:
    """Cleaned documents.

    By default one Parquet table ``(file_name, text)``: millions of documents
    need not become millions of files.  With ``per_file=True`` every document
    becomes a UTF-8 file of its name in ``out_dir``, byte for byte its text
    (:mod:`parley.sinks.files`); names must be unique (:func:`with_clean_names`)."""
    if per_file:
        write_files(docs, out_dir, name_col, text_col)
    else:
        docs.select(name_col, text_col).write.mode(mode).parquet(out_dir)


def write_transcripts(transcripts: DataFrame, out_dir: str, key: str = "episode_id", text_col: str = "text",
                      mode: str = "overwrite", per_file: bool = False) -> None:
    """Transcripts that are not empty, as Parquet or as files
    ``transcript_{key}.txt``; keys must be unique."""
    some = transcripts.where(F.coalesce(F.length(text_col), F.lit(0)) > 0)
    if per_file:
        write_files(some.withColumn("_name", F.concat(F.lit("transcript_"), F.col(key).cast("string"), F.lit(".txt"))), out_dir, "_name", text_col)
    else:
        some.select(key, text_col).write.mode(mode).parquet(out_dir)


def write_episode_audio(blocks: DataFrame, out_dir: str, key: str = "episode_id") -> None:
    """Signals in blocks (:mod:`parley.operators.blocks`) as one file
    ``episode_{key}.pcm`` each, mono, 16 bit."""
    own = F.slice("samples", F.col("lead") + 1, F.size("samples"))
    rows = blocks.select(F.concat(F.lit("episode_"), F.col(key).cast("string"), F.lit(".pcm")).alias("name"), "block", pcm_bytes(own).alias("content"))
    write_files(rows, out_dir, order="block")


def write_segments(segments: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Segment table as Parquet, every row of it."""
    segments.write.mode(mode).parquet(out_dir)


def write_manifest(manifest: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    manifest.write.mode(mode).partitionBy("provider").parquet(out_dir)
