"""PCM files as a data source: mono, 16-bit little-endian samples.

A file is cut into blocks of ``block_frames`` samples and its blocks are dealt to
tasks by byte ranges of about ``partition_bytes``, so one long recording is read
by many tasks; many short files share a task.  Ranges under ``FULL_BYTES`` grow with
the input once there are ``MOST_TASKS`` of them: the start of a task takes longer than
to read a small range.  A task holds the blocks of one Arrow batch (``BATCH_BYTES`` of
the file, one block at least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

from parley.functions import fixed as FX
from parley.sources.paths import files_below, open_store

FORMAT = "parley_pcm"
SCHEMA = "path string, block long, first long, samples array<double>"
WIDTH = 2  # bytes of a sample
FULL_BYTES = 32 << 20
MOST_TASKS = 256
BATCH_BYTES = 1 << 18
TYPES = pa.schema([("path", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("samples", pa.list_(pa.float64()))])


class Ranges(InputPartition):
    """Ranges of blocks: (path, first block, number of blocks)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.frames = int(options.get("block_frames", FX.SAMPLE_RATE))
        self.bytes = int(options.get("partition_bytes", FULL_BYTES))

    def partitions(self) -> list[Ranges]:
        files = files_below(self.path, ".pcm")
        most = max(self.bytes, min(FULL_BYTES, -(-sum(length for _, length in files) // MOST_TASKS)))
        size, out, own, held = self.frames * WIDTH, [], [], 0
        for path, length in files:
            if length % WIDTH:
                raise ValueError(f"{path} ends within a sample")
            at, blocks = 0, -(-length // size)
            while at < blocks:
                take = min(blocks - at, max(1, (most - held) // size))
                own.append((path, at, take))
                at, held = at + take, held + take * size
                if held >= most:
                    out.append(Ranges(own))
                    own, held = [], 0
        return out + ([Ranges(own)] if own or not out else [])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        size = self.frames * WIDTH
        rows: list[tuple] = []
        for path, first, n in partition.value:
            with store.open_input_file(path) as file:
                file.seek(first * size)
                for block in range(first, first + n):
                    rows.append((path, block, block * self.frames, np.frombuffer(file.read(size), "<i2") / float(FX.PCM_MAX)))
                    if len(rows) * size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES.types)], schema=TYPES)


class PcmSource(DataSource):
    """Options: path (a file, or a folder of ``.pcm`` files), block_frames,
    partition_bytes (at least; see above)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PcmReader(self.options)


def read_pcm(spark: SparkSession, path: str, block_frames: int = FX.SAMPLE_RATE, partition_bytes: int = 32 << 20) -> DataFrame:
    """``path, block, first, samples``: a row for each block of each file, with
    the number of its first frame and samples of full scale 1.  A file that ends
    within a sample fails the read; an empty file has no rows."""
    spark.dataSource.register(PcmSource)
    return spark.read.format(FORMAT).option("block_frames", block_frames).option("partition_bytes", partition_bytes).load(path)


def pcm_bytes(samples: Column) -> Column:
    """Samples of full scale 1 as 16-bit little-endian bytes: clamped, and
    truncated toward zero; what is not a number counts as 0."""
    def run(rows: pd.Series) -> pd.Series:
        clamped = lambda x: np.clip(np.nan_to_num(np.asarray(x, float) * FX.PCM_MAX, nan=0.0), FX.PCM_MIN, FX.PCM_MAX)
        return rows.map(lambda x: None if x is None else clamped(x).astype("<i2").tobytes())
    return pandas_udf(run, "binary")(samples)
