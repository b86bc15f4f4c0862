"""Session helpers: a local session for tests and the benchmark, and the
shared checkpoint folder read from the session.

On a cluster the session is created by the platform; library code only
reads ``spark.checkpoint.dir`` from it.  A private folder is created only
when the setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "parley") -> SparkSession:
    """Local session in the configuration used by tests and ``bench.py``."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Arrow batches to Python UDFs carry whole waveforms per row: cap by bytes too.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PARLEY_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_private: dict[str, str] = {}  # folders of local sessions without the setting, by application


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset and the master is
    local a fresh private folder is created, one for the application; on several
    machines such a folder would lose what the others write.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _private:
            _private[app] = tempfile.mkdtemp(prefix="parley-ckpt-")
        path = _private[app]
    spark.sparkContext.setCheckpointDir(path)
    return path


_folders: dict[str, list[str]] = {}  # handed out, by application


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder that nothing uses yet."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/parley-{name}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    """Create the folder ``path`` if it is not there."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(at)


def remove_folders(spark: SparkSession) -> int:
    """Delete what this application has stored in the checkpoint folder so far;
    returns how many folders there were.  To be called when all results that
    read them are written."""
    context, gone = spark.sparkContext, 0
    for path in _folders.pop(context.applicationId, []):
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back.

    The plan runs once (``Dataset.checkpoint`` would run it a second time to
    write the checkpoint), the result is columnar and compressed, and it
    lives on shared storage, so a lost executor costs no recomputation of
    the lineage before it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("error").parquet(path)
    # The schema is passed so that an empty result reads back as well.
    return spark.read.schema(df.schema).parquet(path)
