"""A data-source sink that writes each row's bytes to a file of its own name.

Rows of the same name that follow each other in a task are one file.  A task
writes to hidden files and gives them their names only when it has read all its
rows; a task that fails removes what it wrote.  Before it names them it stores
their list; if the job fails, the driver removes the files of all lists, also of
tasks whose message never came.  No content passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from parley.sources.paths import open_store

FORMAT = "parley_files"
SCHEMA = "name string, content binary"


@dataclass
class Written(WriterCommitMessage):
    n_files: int


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def _remove(store: fs.FileSystem, path: str) -> None:
    if _exists(store, path):
        store.delete_file(path)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, f"_parley-{uuid.uuid4().hex}"
        store, base = open_store(path)
        store.create_dir(f"{base}/{self.job}", recursive=True)  # on the driver: a task that starts after the job failed finds none

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = open_store(self.path)
        task = TaskContext.get()
        own = f"{base}/{self.job}/task-{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(own, recursive=False)
        names: dict[str, int] = {}
        file, last = None, None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if name != last or file is None:
                        if not name or "/" in name or name[0] in "_.":
                            raise ValueError(f"no file name: {name!r}")
                        if name in names:
                            raise ValueError(f"the rows of {name} do not follow each other")
                        if file is not None:
                            file.close()
                        names[name], last = len(names), name
                        file = store.open_output_stream(f"{own}/{names[name]}")
                    file.write(content or b"")
            if file is not None:
                file.close()
                file = None
            with store.open_output_stream(f"{own}/names") as out:
                out.write(json.dumps(list(names)).encode())
            for name, k in names.items():
                store.move(f"{own}/{k}", f"{base}/{name}")
        except BaseException:
            if file is not None:
                file.close()
            if _exists(store, own):
                for name, k in names.items():  # those that have their names already
                    if not _exists(store, f"{own}/{k}"):
                        _remove(store, f"{base}/{name}")
                store.delete_dir(own)
            else:  # the job was given up meanwhile
                for name in names:
                    _remove(store, f"{base}/{name}")
            raise
        return Written(len(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, base = open_store(self.path)
        if _exists(store, f"{base}/{self.job}"):
            store.delete_dir(f"{base}/{self.job}")
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """Take the lists of all tasks, then their folders, so that a task that
        still runs can name no more files, then the files."""
        store, base = open_store(self.path)
        if not _exists(store, f"{base}/{self.job}"):
            return
        lists = [f"{t.path}/names" for t in store.get_file_info(fs.FileSelector(f"{base}/{self.job}"))]
        names = []
        for at in lists:
            if _exists(store, at):
                with store.open_input_stream(at) as file:
                    names.append(json.loads(file.read()))
        store.delete_dir(f"{base}/{self.job}")
        for own in names:
            for name in own:
                _remove(store, f"{base}/{name}")


class FileSink(DataSource):
    """Option: path, a folder (a new one for each job: files of the same name
    are replaced)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "content", order: str | None = None) -> None:
    """Write ``content`` (bytes, or text as UTF-8; null is empty) of each row to
    the file ``name`` of the folder ``path``.  With ``order`` the rows of a name
    are one file, in that order; else names must be unique.  A null or hidden
    name, or one with a slash, fails the job, which then leaves no file."""
    rows.sparkSession.dataSource.register(FileSink)
    if order is not None:
        rows = rows.repartition(name).sortWithinPartitions(name, order)
    (rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
     .write.format(FORMAT).mode("append").save(path))


def unique_names(docs: DataFrame, path: str, text: str, prefix: str, suffix: str, stem: Column, out: str = "file_name") -> DataFrame:
    """Adds ``out``: ``<prefix><stem><suffix>``; documents whose names clash
    (also in letter case) carry eight digits of the hash of their path and text
    as well, so only rows with equal path and text share a file.  A null or empty
    stem is ``unnamed``."""
    plain = F.coalesce(F.when(stem != "", stem), F.lit("unnamed"))
    named = docs.withColumn("_stem", plain)
    clash = named.groupBy(F.lower("_stem").alias("_low")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_low", F.lit(True).alias("_clash"))
    j = named.join(clash, F.lower("_stem") == F.col("_low"), "left").drop("_low")
    whole = F.concat(F.coalesce(F.col(path), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    mark = F.when(F.col("_clash"), F.concat(F.lit("-"), F.substring(F.md5(whole), 1, 8))).otherwise(F.lit(""))
    return j.withColumn(out, F.concat(F.lit(prefix), F.col("_stem"), mark, F.lit(suffix))).drop("_stem", "_clash")
