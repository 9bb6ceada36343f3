"""Streaming counterparts of the simplest steps, for recordings that are still arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.denoise import GATE
from ..sources.series import finite


def gated_windows(stream: DataFrame, subject: str, ts: str, value: str, low: float = GATE[0], high: float = GATE[1], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean, extremes and share outside the range for each subject and tumbling window; samples later than ``late`` are left out."""
    p = finite(value)
    rows = stream.select(F.col(subject).alias("subject"), F.col(ts).cast("timestamp").alias("ts"), p.alias("p")).withWatermark("ts", late)
    out = rows.groupBy("subject", F.window("ts", width).alias("w")).agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.min("p").alias("min"), F.max("p").alias("max"), F.avg(((F.col("p") < low) | (F.col("p") > high)).cast("double")).alias("outside"))
    return out.select("subject", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "min", "max", "outside")


def bursts(stream: DataFrame, subject: str, ts: str, value: str, least: float, gap: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sessions of samples above ``least`` that follow one another within ``gap``."""
    rows = stream.select(F.col(subject).alias("subject"), F.col(ts).cast("timestamp").alias("ts"), finite(value).alias("p")).where(F.col("p") > least).withWatermark("ts", late)
    out = rows.groupBy("subject", F.session_window("ts", gap).alias("w")).agg(F.count("p").alias("n"), F.max("p").alias("peak"))
    return out.select("subject", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")
