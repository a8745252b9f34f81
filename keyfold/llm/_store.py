"""Tables written to the shared folder, to cut lineage and read a result more than once."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folders that the innermost ``working`` block deletes at its end.
_blocks: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a local master gets a temporary folder, which is then
    set for the session; any other master is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("KEYFOLD_LLM_SHARED")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = os.environ["KEYFOLD_LLM_SHARED"] = tempfile.mkdtemp(prefix="keyfold-llm-")
    return folder


def _write(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/keyfold-llm/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to a new shared folder and read again.

    A lost executor then costs a repeated read, never a repeated computation. The folder
    stays until the end of the :func:`working` block around it, or, without one, until the owner of the
    shared folder clears it, as with ``checkpoint()``.
    """
    table, path = _write(df, purpose)
    if _blocks:
        _blocks[-1].append(path)
    return table


@contextmanager
def working(spark: SparkSession) -> Iterator:
    """A block whose stored tables are deleted at its end, with the shuffle files of its finished jobs.

    Gives a function ``kept(df, purpose)`` that stores a table beyond the block: its result. What
    was stored within the block must not be read behind it.
    """
    own: list[str] = []

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        table, path = _write(df, purpose)
        if len(_blocks) > 1:
            _blocks[-2].append(path)
        return table

    _blocks.append(own)
    try:
        yield kept
    finally:
        _blocks.pop()
        for path in own:
            delete(spark, path)
        sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Deletes the shuffle files of finished jobs: those of plans that nothing refers to any more go behind a collection on both sides.

    On a cluster the scheduler refers to the last job until another one runs, here one of a single row.
    """
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
