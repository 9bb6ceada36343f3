"""Files that hold result tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that describe a window, in the order in which they lead every feature file.
META = (
    "SubjectID", "Label", "WindowMethod", "WindowID", "StartTime", "EndTime", "CenterTime",
    "StartIndex", "EndIndex", "NumPoints", "EventID", "EventStartTime", "EventEndTime", "EventCoverage",
)
#: Mark at the start of a UTF-8 file, by which spreadsheets know its encoding.
MARK = "\ufeff"


def _marked(df: DataFrame) -> DataFrame:
    """``df`` whose header begins with MARK."""
    return df.withColumnRenamed(df.columns[0], MARK + df.columns[0])


def _publish(spark: SparkSession, parts: str, names: Callable[[str], str | None]) -> list[str]:
    """Move the files of a written folder to the paths that ``names`` gives for theirs, and drop the folder.

    A file is renamed inside the store, over an older one of its name, so a reader sees the
    old or the new file and never a part of one. Only names pass the driver.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    files = folder.getFileSystem(conf)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    found, out = files.listFiles(folder, True), []
    while found.hasNext():
        path = found.next().getPath()
        target = names(path.toString())
        if target:
            context.rename(path, context.makeQualified(jvm.org.apache.hadoop.fs.Path(target)), over)
            out.append(target)
    files.delete(folder, True)
    return sorted(out)


def write_csv(df: DataFrame, path: str, marked: bool = False) -> str:
    """A report as one CSV file named ``path``, with a header, after MARK where asked; reports are a few rows for each model and subject."""
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    (_marked(df) if marked else df).coalesce(1).write.option("header", True).csv(parts)
    return _publish(df.sparkSession, parts, lambda name: path if name.endswith(".csv") else None)[0]


def write_results(results: dict[str, DataFrame], prefix: str) -> list[str]:
    """One CSV file per result, named ``{prefix}_{name}.csv``."""
    return [write_csv(df, f"{prefix}_{name}.csv", marked=True) for name, df in results.items()]


def master_features(event: DataFrame, fixed: DataFrame) -> DataFrame:
    """Union of both kinds of window features, describing columns first; a column that one lacks is null there."""
    both = event.unionByName(fixed, allowMissingColumns=True)
    lead = [c for c in META if c in both.columns]
    return both.select(*lead, *[c for c in both.columns if c not in lead])


def write_master_features(features: DataFrame, path: str) -> list[str]:
    """A file ``{subject}_master_features.csv`` for each subject in the folder ``path``, of all columns in their order, after MARK.

    A subject's windows are few, so they are one task's rows; subjects are dealt over tasks.
    Signs that a file's name cannot have are escaped as Spark escapes them.
    """
    marked = _marked(features)
    by = [c for c in ("WindowMethod", "WindowID") if c in marked.columns]
    rows = marked.withColumn("subject", F.col(marked.columns[0])).repartition("subject").sortWithinPartitions("subject", *by)
    parts = f"{path}/parts-{uuid.uuid4().hex}"
    rows.write.option("header", True).partitionBy("subject").csv(parts)
    named = lambda name: re.search(r"/subject=([^/]*)/[^/]*\.csv$", name)
    return _publish(features.sparkSession, parts, lambda name: f"{path}/{named(name)[1]}_master_features.csv" if named(name) else None)


def method_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("WindowMethod").count()
