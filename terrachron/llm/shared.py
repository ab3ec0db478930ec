"""Cutting lineage through the shared folder, size checks before a broadcast, and Python tasks that hold little memory."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch, unless the session says otherwise; the JVM and the worker hold one or two of each task.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = "file://" + tempfile.mkdtemp(prefix="terrachron-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*settled: DataFrame) -> None:
    """Deletes the files of frames that :func:`settle` made, when nothing that is still to be computed reads them."""
    for df in settled:
        jvm, path = df.sparkSession._jvm, df.settled_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def lean(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in small batches (10,000 rows of text are 35 MB and more, several times in the JVM).

    A worker gives memory that is free back after each task; it lives on, and what it keeps adds to its executor's.
    """
    df.sparkSession.conf.set(BATCH, df.sparkSession.conf.get(BATCH, f"{BATCH_BYTES}b"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return df.mapInArrow(task, schema)


def small(df: DataFrame, rows: int, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` of ``rows`` narrow rows with a broadcast hint only while it is at most ``max_rows``; else Spark shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


def columns_free(df: DataFrame, *names: str) -> list[str]:
    """``names`` prefixed with underscores until none clashes with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
