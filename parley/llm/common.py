"""Helpers shared by the operators: reading Arrow columns in bounded pieces,
64-bit hashing on NumPy arrays, tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import checkpoint_dir

ROWS = 1024  # rows taken out of an Arrow batch at a time
MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that the Python copies of
    their texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h = h ^ (h >> np.uint64(29))
    h = h * MIX
    return h ^ (h >> np.uint64(32))


def with_all_columns(df: DataFrame, **cols: Column) -> DataFrame:
    return df.withColumns(cols)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage, and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/parley-llm-{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
