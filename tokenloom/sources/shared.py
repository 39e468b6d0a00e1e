"""Files in the folder that all executors share: checkpoints and tables between steps."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local
    master, as in tests, which goes with the process; elsewhere an error, for a folder of one
    machine is no use to a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tokenloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: later jobs read files instead of the lineage."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that nothing refers to any more. It does so
    only when the driver's garbage is collected, which else may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system of a path, and the path in its terms."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, there = file_system(spark, path)
    fs.delete(there, True)


class Steps:
    """Tables of a loop, written to a folder of their own in the shared one. A new table of
    a name takes the place of the one before, whose files are removed after the next."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.count = spark, 0
        self.folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.old: dict[str, list[str]] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{name}-{self.count}"
        df.write.parquet(path)
        kept = self.old.setdefault(name, [])
        kept.append(path)
        # The table written may have been read from the one before, never from an older one.
        while len(kept) > 2:
            remove(self.spark, kept.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        remove(self.spark, self.folder)
