"""Scratch tables in the folder that driver and executors share: where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set on the context.

    Where neither is set, a temporary folder of this machine is made and stays set for the session,
    but only where executors are threads of the driver; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="assayer-")
    context.setCheckpointDir(base)
    return base


_SESSIONS: set[str] = set()


def _drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, in a folder of this application that goes when the driver ends."""
    home = f"{shared_folder(spark).rstrip('/')}/assayer/{spark.sparkContext.applicationId}"
    if home not in _SESSIONS:
        _SESSIONS.add(home)

        def leave() -> None:
            if spark.sparkContext._jsc is not None:  # a context that was stopped leaves its files to the folder's owner
                _drop(spark, home)

        atexit.register(leave)
    return f"{home}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str | None = None, parts: int | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: lineage ends here.

    parts: at most so many files, for a table whose size is known to be small for them.
    """
    path = scratch(df.sparkSession, label)
    df = df.coalesce(parts) if parts else df
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """What each job returns, jobs that don't need each other being run at the same time, in threads of the driver.

    All of them end before the first error, in the order of jobs, is raised.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        held = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [h.result() for h in held]


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, path)
