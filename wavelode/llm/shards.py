"""Global shuffle of a corpus into shards by two passes over memory-sized buckets.

The first pass scatters rows over buckets by a seeded hash of their ids; the second
permutes each bucket in memory and lays the buckets end to end. Scattering uniformly and
permuting each bucket uniformly is a uniform permutation of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import new_path

#: Bytes of text that a bucket holds in expectation, at least and at most; least number of buckets, and the number that is
#: aimed at in between. Above 2 TB buckets stay at their largest and their number grows.
BUCKET_BYTES, MOST_BYTES, LEAST_BUCKETS, BUCKETS = 8 << 20, 512 << 20, 8, 4096
#: Bucket starts (16 bytes each) are sent to all tasks up to this many, and joined by a shuffle beyond it.
SENT_BUCKETS = 200_000
#: Rows alike that hold more than this share of a bucket are dealt to all buckets, and so are at most 1 / HOT for each bucket.
HOT = 0.25


def _own(seed: int) -> Column:
    """Seeded hash of a row's id and text."""
    return F.xxhash64(F.lit(seed), "doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)))


def shuffle_to_shards(docs: DataFrame, path: str | None = None, shards: int = 8, seed: int = 20240501, bucket_bytes: int | None = None) -> DataFrame:
    """Write doc_id and text of all rows in random order as ``shards`` shards and read them back.

    Returns doc_id, text, shard and slot from the files under ``path`` (a new folder of
    the shared directory by default), one folder per shard. Shard row counts differ by
    one at most and slots count from 0 without gaps. Null ids and texts are rows like any
    other; rows repeated in full keep their number; other columns are ignored. An empty
    table gives no rows.

    Buckets are sized by measured bytes, MOST_BYTES at most unless ``bucket_bytes`` is given, and
    each is a partition of its own, so a task's memory does not grow with the input. Rows of one id are told apart by
    their texts; where very many rows agree in both they are alike, and are dealt over all
    buckets by their place in the input. Array shuffling uses the Fisher-Yates algorithm;
    buckets are ordered before it, so that a task run again permutes them alike.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 24
    held = rows.agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = int(held.b or 0)
    n_buckets = max(LEAST_BUCKETS, -(-total // (bucket_bytes or min(MOST_BYTES, max(BUCKET_BYTES, total // BUCKETS)))))
    key = _own(seed)
    # Only where some bucket is far too large are its rows counted one by one.
    even = rows.groupBy(F.pmod(key, F.lit(n_buckets)).cast("int").alias("bucket")).agg(F.sum(size).alias("b"))
    limit = max(1.0, HOT * total / n_buckets)
    large = [r.bucket for r in even.where(F.col("b") > 3 * limit / HOT).collect()]
    if large:
        alike = rows.where(F.pmod(key, F.lit(n_buckets)).cast("int").isin(large)).groupBy(key.alias("own")).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
        hot = F.broadcast(alike.where((F.col("b") > limit) & (F.col("n") > 1)).select("own", F.lit(True).alias("hot")))
        salted = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("own", key).join(hot, "own", "left")
        rows = salted.select("doc_id", "text", F.when(F.col("hot"), F.xxhash64("own", "place")).otherwise(F.col("own")).alias("own"))
    else:
        rows = rows.withColumn("own", key)
    rows = rows.withColumn("bucket", F.pmod("own", F.lit(n_buckets)).cast("int")).drop("own")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    # One row per bucket: the running total needs no more than that in one task.
    before = F.sum("rows").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("first"))

    gathered = rows.repartitionById(n_buckets, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("rows"))
    placed = gathered.join(F.broadcast(starts) if n_buckets <= SENT_BUCKETS else starts, "bucket").sortWithinPartitions("bucket")
    each = placed.select("first", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
    place = F.col("first") + F.col("at")
    base, more = divmod(held.n, shards)
    wide = more * (base + 1)
    shard = F.when(place < wide, F.floor(place / (base + 1))).otherwise(more + F.floor((place - wide) / max(base, 1)))
    slot = F.when(place < wide, place % (base + 1)).otherwise((place - wide) % max(base, 1))
    out = each.select("row.doc_id", "row.text", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    path = path or new_path(spark, "shards")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)


def shard_digest(written: DataFrame) -> DataFrame:
    """Sizes, checksums and places of written shards under the law of equal row counts."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return written.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
