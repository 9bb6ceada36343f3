"""Tables that driver and executors share, and the row helpers used by every operator here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder stands in, which is right for a
    single-machine session only; a cluster session without the setting is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="wavelode-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no table has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet and return the written table, which cuts the lineage."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table of the shared folder and read it back."""
    return write_table(df, new_path(df.sparkSession, name))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def named(name: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` that do not have one of ``names``, upper and lower case being the same as they are to Spark."""
    taken = {name.lower() for name in names}
    return [c for c in df.columns if c.lower() not in taken]


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where functions over arrays refer to it many times."""
    return F.transform(F.array(value), use)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
