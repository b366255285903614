"""Tables in the folder that the driver and all executors share, and the steps of a run that end with it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of a batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python, so that what a worker holds doesn't follow a partition's rows or their lengths.

    The session keeps the bounds, as plans are run after they are made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def session_dir(spark: SparkSession) -> str:
    """This session's own folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session of one machine (tests) gets a temporary
    folder for it once; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the session's folder."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = place(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    store, at = place(spark, path)
    store.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no folder."""
    store, at = place(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that its lineage ends in files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """The tables of one run, which are gone when its result has been written.

    A kept table is written once, whatever number of branches read it: no model
    runs twice, not even after an executor is lost, and each step is planned
    by itself with the sizes of its inputs known. Nothing stays in memory.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_dir(spark), 0

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of this run."""
        self.n += 1
        return written(df, f"{self.folder}/{self.n:03d}")

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that outlives the run, until the session's folder is discarded."""
        return written(df, shared_dir(self.spark))


def discard(spark: SparkSession) -> None:
    """Delete all tables that this session has written to its folder."""
    remove(spark, session_dir(spark))
