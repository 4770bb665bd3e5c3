"""Tables that cut lineage, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Of each thread the lists of paths that its open `passing` blocks delete.
_blocks = threading.local()


def place(spark: SparkSession) -> str:
    """A new name in the shared folder; what is stored there goes when the driver ends, or with the `passing` block around."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:  # one machine, as in tests
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cellcast-')}"
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{context.applicationId}-{uuid.uuid4().hex}"
    stored = context._jvm.org.apache.hadoop.fs.Path(path)
    stored.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(stored)
    if open_ := getattr(_blocks, "open", None):
        open_[-1].append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores in the block go at its end, so a stream of many batches leaves none."""
    if not hasattr(_blocks, "open"):
        _blocks.open = []
    _blocks.open.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _blocks.open.pop():
            stored = context._jvm.org.apache.hadoop.fs.Path(path)
            system = stored.getFileSystem(context._jsc.hadoopConfiguration())
            system.delete(stored, True)
            system.cancelDeleteOnExit(stored)  # else the driver's list of them grows


def cut(df: DataFrame) -> DataFrame:
    """`df` as a stored table: loops keep a short plan, and a lost executor costs no earlier round."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
