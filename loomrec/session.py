"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "loomrec") -> SparkSession:
    """A local session as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local
    (tests) a temporary folder is made and set as the checkpoint folder; on a cluster each executor
    would write to a disk of its own, so there an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-loomrec-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _store(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when the driver ends, at the latest."""
    path = os.path.join(shared_dir(spark), "loomrec", f"{name}-{uuid.uuid4().hex}")
    where, store = _store(spark, path)
    store.deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where, store = _store(spark, path)
    store.delete(where, True)


def write_through(df: DataFrame, name: str, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there.

    Values that are not deterministic under recomputation (row numbers) are stable from here on,
    and a lost executor costs a reread instead of a recomputation. Tables in ``drop``, which this
    function has returned before and nothing reads any more, are deleted once ``df`` is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    for old in drop:
        drop_path(spark, old._scratch_path)
    return table
