"""Shared helpers: cutting lineage in the cluster's shared folder, and reading the tables."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of a batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 22


def _session_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session of one machine (tests) gets a temporary
    folder for it once; on a cluster that is an error.
    """
    return f"{_session_dir(spark)}/{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Delete all tables that this session has materialised: to be called when results have been read or written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python, so that one of long texts fits beside the heap.

    The session keeps the bounds, as what the operators return runs later, when
    its user asks for it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Lineage ends there, any executor can read it again after a loss, and the
    planner knows its size, so that it broadcasts a side only if it is small.
    """
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run: Callable[[Iterator], Iterator], last: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` on the batches of a task, whose memory goes back to the machine at its end.

    Python workers wait for more tasks beside the heap; what they keep is
    lacking to other stages.
    """

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if last is not None:
                last()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner
