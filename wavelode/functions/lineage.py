"""Cutting the lineage of tables that later steps use several times."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Tables that each unfinished step of a thread has cut so far.
_steps = threading.local()
#: With this setting Spark deletes the shuffle files of an action when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(made: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """A table as a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Of a function that makes the table, what it cuts on the way is deleted once the table is
    written, so a chain of steps holds the tables of one of them at a time.
    Without the setting a single-machine session gets a temporary folder; a cluster
    session is refused.
    """
    if isinstance(made, DataFrame):
        return _noted(_checkpoint(made))
    steps = _steps.__dict__.setdefault("stack", [])
    steps.append([])
    try:
        out = _checkpoint(made())
    finally:
        passed = steps.pop()
    drop(*passed)
    return _noted(out)


def drop(*tables: DataFrame) -> None:
    """Delete checkpoints that nothing reads any more."""
    for df in tables:
        path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if path.isDefined():
            file = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path.get())
            file.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(file, True)


def _noted(df: DataFrame) -> DataFrame:
    steps = _steps.__dict__.get("stack")
    if steps:
        steps[-1].append(df)
    return df


def _checkpoint(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wavelode-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # A plan of its own, made with the setting, as the files of its shuffles go when it is written.
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
