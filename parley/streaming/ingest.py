"""Incremental ingest: documents arriving as files -> word chunks.

The jobs run with ``availableNow``, so that a scheduled job processes whatever
arrived and stops.  ``stream_chunks`` is proof against replays: a document that
arrives again within ``horizon`` gives no second chunks, and a batch that is run
again replaces what it wrote.

Checkpoints and outputs live under ``run_dir`` if the caller names one: a later
run with the same folder reads only what arrived since and appends to the same
sink.  Otherwise each call takes a new folder under the shared
``spark.checkpoint.dir`` and reads all input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import fixed as FX
from parley.operators import text as X
from parley.session import make_folder, new_folder

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def arriving(spark: SparkSession, schema: str, source_dir: str, glob: str, max_files: int | None = None) -> DataFrame:
    """Parquet files that arrive in ``source_dir`` as a stream.  What ``glob``
    matches there is a file, or the folder of a table that Spark wrote, whose
    files are read (a filter by name alone would see neither folder nor files)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    at = glob if any(c in glob for c in "*?[{") else f"{{{glob}}}"  # a pattern in any case: a plain path must be a folder
    return reader.parquet(f"{source_dir.rstrip('/')}/{at}")


def chunk_stream(stream: DataFrame, n: int, horizon: str) -> DataFrame:
    """The batch chunk operator on a streaming frame, each document once.

    The time of a row is that of its batch, which a batch that is run again
    keeps; it never lies behind the watermark, so no document is dropped as late.
    Documents without an id are told apart by their text."""
    docs = stream.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.sha2("text", 256)).alias("_text"))
    once = docs.withColumn("_at", F.current_timestamp()).withWatermark("_at", horizon).dropDuplicatesWithinWatermark(["doc_id", "_text"])
    return X.word_chunks(once.select("doc_id", "text"), n=n)


def write_batch(out: str):
    """A ``foreachBatch`` sink: each batch owns a folder, named by its number,
    and replaces it when it is run again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return write


def run_available(query_df: DataFrame, out: str | None, ckpt: str, each=None) -> None:
    """Process what arrived and stop, into Parquet or a ``foreachBatch``
    function.  Batches without data are off while it runs: a state with
    processing-time timers would ask for them for ever."""
    conf, key = query_df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        sink = query_df.writeStream.outputMode("append").option("checkpointLocation", ckpt).trigger(availableNow=True)
        q = sink.foreachBatch(each).start() if each else sink.format("parquet").start(out)
        q.awaitTermination()
    finally:
        conf.set(key, before)


def stream_chunks(spark: SparkSession, source_dir: str, n: int = FX.CHUNK_WORDS, glob: str = "*.parquet",
                  max_files_per_trigger: int | None = None, run_dir: str | None = None, horizon: str = "30 days") -> DataFrame:
    """Documents arriving as Parquet files, or folders of them, (matching ``glob``)
    under ``source_dir`` -> chunks.  ``max_files_per_trigger`` bounds the size of
    a micro-batch.  A document counts once within ``horizon`` (for which its id is
    kept in the state); the first version stays.  Returns the sink contents after
    all available input was processed."""
    base = run_dir or new_folder(spark, "stream-chunks")
    chunks = chunk_stream(arriving(spark, DOCS_SCHEMA, source_dir, glob, max_files_per_trigger), n, horizon)
    out = f"{base}/out"
    make_folder(spark, out)  # without input no batch does it
    run_available(chunks, None, f"{base}/ckpt", each=write_batch(out))
    return spark.read.schema(chunks.schema).parquet(out).select(*chunks.columns)


def stream_text_chunks(spark: SparkSession, text_dir: str, n: int = FX.CHUNK_WORDS,
                       run_dir: str | None = None) -> DataFrame:
    """Whole text files arriving under ``text_dir`` -> chunks keyed by path."""
    base = run_dir or new_folder(spark, "stream-text")
    src = (spark.readStream.format("text").option("wholetext", True).load(text_dir)
           .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    chunks = X.word_chunks(src, n=n, key="path")
    run_available(chunks, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")
