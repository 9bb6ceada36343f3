"""Scans that give every operator the same shape: (subject, seq, t, p).

``seq`` numbers a subject's samples from 0 in time order; ``t`` is in seconds and ``p`` the
value. Not-a-number and infinite values become null here, once, so that aggregates and
comparisons further on never meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [T.StructField("SubjectID", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in ("Time", "Pressure", "PH", "Temperature")]
)

#: Samples of a task, about, in steps by subject.
SAMPLES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(c: Column | str) -> Column:
    """A number, or null where it is not one or is infinite; text is converted where it can be."""
    c = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp, with or without zone, taken as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / F.lit(1e6)


def read_recordings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw recordings with a declared schema; optional channels that a file lacks read as null."""
    reader = spark.read.schema(RAW_SCHEMA)
    return reader.option("header", True).option("enforceSchema", False).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def series(df: DataFrame, subject: str, time: Column | str, value: Column | str, *tie: str) -> DataFrame:
    """One sample per row: subject, seq, t, p."""
    t = F.col(time) if isinstance(time, str) else time
    p = finite(value)
    order = Window.partitionBy("subject").orderBy("t", *[f"_{c}" for c in tie])
    rows = df.select(F.col(subject).alias("subject"), t.cast("double").alias("t"), p.alias("p"), *[F.col(c).alias(f"_{c}") for c in tie])
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).select("subject", "seq", "t", "p")


def prepare(df: DataFrame, subject: str, time: Column | str, value: Column | str, least: int = 7) -> DataFrame:
    """Samples with a time and a value, one per time: values that share a time are averaged.

    Subjects with fewer than ``least`` samples are left out.
    """
    t = finite(time if isinstance(time, Column) else F.col(time))
    rows = df.select(F.col(subject).alias("subject"), t.alias("t"), finite(value).alias("p")).dropna()
    rows = rows.groupBy("subject", "t").agg(F.avg("p").alias("p"))
    by = Window.partitionBy("subject")
    rows = rows.withColumn("seq", (F.row_number().over(by.orderBy("t")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(by))
    return rows.where(F.col("n") >= least).select("subject", "seq", "t", "p")


def dealt(df: DataFrame, subject: str, samples: int = SAMPLES) -> DataFrame:
    """``df`` in as many partitions by subject as leave about ``samples`` rows to each, where the session's own number would leave more.

    Steps by subject keep these partitions, so what a task sorts and holds does not grow with
    the table, as long as a subject does not. Reads one column to count.
    """
    size = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(subject).alias("subjects")).first()
    parts = min(-(-size.n // samples), size.subjects)
    return df.repartition(parts, subject) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def event_series(spark: SparkSession, sf_dir: str, subject: str = "event_type") -> DataFrame:
    """The ``events`` table as series of one kind of event each, or of one user each."""
    return series(dealt(table(spark, sf_dir, "events"), subject), subject, seconds("ts"), "value", "event_id")


def vector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of ``embeddings`` as a series of its components."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subject"), F.posexplode("embedding").alias("at", "x"))
    return rows.select("subject", F.col("at").cast("long").alias("seq"), F.col("at").cast("double").alias("t"), finite("x").alias("p"))
