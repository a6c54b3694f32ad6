"""Tables that a job keeps between its steps, in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset one machine makes its own, as in tests, and a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and lost executors cost no recomputation beyond it.

    Inside ``scratch`` the table goes when that ends, unless it is kept.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    listed = _scratch.get()
    if listed is not None and not keep:
        listed.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, but for kept ones. What is computed later must not read the others."""
    token = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get():
            _remove(spark, path)
        _scratch.reset(token)


def clear(spark: SparkSession) -> None:
    """Remove all tables stored so far. Results that are not written yet can no longer be computed."""
    _remove(spark, f"{shared_folder(spark)}/tables")
