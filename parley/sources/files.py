"""File sources: PDF listing, text files with encoding fallback, segment
tables, voice catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.fixed import PDF_SUFFIX

SEGMENTS_SCHEMA = "episode_id long, seg_idx long, speaker string, text string"
CATALOG_SCHEMA = "struct<voices:array<struct<name:string,voice_id:string>>>"
SUFFIX = r"\.[^./]+$"


def spread(df: DataFrame, keys: list[str] | None = None, factor: int = 2) -> DataFrame:
    """Hash-partition a scan that has fewer splits than the cluster has cores.

    A file with a single row group is read by one task, and the per-row text
    work after it (regex splitting, cleanup) would then run on one core.
    When the scan already has at least ``defaultParallelism`` splits (any
    large input) the DataFrame is returned unchanged, so no shuffle is
    added at scale.  Hashing on a unique key keeps partitions even and lets
    a later ``groupBy`` on a prefix of the key reuse the partitioning.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= par:
        return df
    n = par * factor
    return df.repartition(n, *keys) if keys else df.repartition(n)


def suffix(path: Column) -> Column:
    """``Path(p).suffix``: the last extension including the dot, or ''."""
    return F.regexp_extract(path, SUFFIX, 0)


def is_pdf(path: Column) -> Column:
    """Extension equals ``.pdf`` in any case."""
    return F.lower(suffix(path)) == PDF_SUFFIX


def stem(path: Column) -> Column:
    """``Path(p).stem``: file name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_pdfs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """PDF files as rows (path, modificationTime, length, content); the glob
    filter is applied while listing, so other files are never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
            .option("recursiveFileLookup", str(recursive).lower()).load(path))


def decode_text(content: Column) -> Column:
    """Bytes -> struct(text, encoding_used): UTF-8 when the bytes are valid
    UTF-8, else Latin-1 (which accepts every byte); CR LF and lone CR become
    LF as in Python text mode."""
    valid = F.call_function("is_valid_utf8", content.cast("string"))
    text = F.when(valid, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.struct(F.regexp_replace(text, "\r\n?", "\n").alias("text"),
                    F.when(valid, F.lit("utf-8")).otherwise(F.lit("latin-1")).alias("encoding_used"))


def read_text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Text files with encoding fallback: (path, text, encoding_used)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    d = raw.select("path", decode_text(F.col("content")).alias("_d"))
    return d.select("path", "_d.text", "_d.encoding_used")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segment table with a fixed schema, every row of it: the guard is on the
    list, and an episode without segments has no rows; a segment with empty
    text is one of its episode's."""
    return spark.read.schema(SEGMENTS_SCHEMA).parquet(path)


def flatten_catalog(body: Column) -> Column:
    """Voice-list JSON -> array of (name, voice_id) structs (use with ``inline``)."""
    return F.from_json(body, CATALOG_SCHEMA)["voices"]
