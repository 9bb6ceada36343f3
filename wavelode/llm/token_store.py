"""Token ids of a corpus as shards of raw payload with a minimal perfect hash index.

``payload`` holds blocks: ids of consecutive documents in ascending doc_id order, each id
as a little-endian unsigned integer of the width that the vocabulary needs. ``index`` maps
a document key to its place by hash and displace: keys are dealt to partitions, every
partition has one pilot per small bucket of keys such that all its keys land on different
slots, and a slot stores the key's fingerprint with block, offset, length and the number
of ids before it. A lookup is one pilot, one slot and one fingerprint.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, write_table
from .tokens import encoder

#: Text bytes of a range of documents, ids of a payload block, keys of an index partition in expectation.
RANGE_BYTES, BLOCK_IDS, INDEX_KEYS = 16 << 20, 1 << 20, 50_000
#: Keys of a pilot's bucket, on average.
BUCKET_KEYS = 4
PAYLOAD = "part int, block int, ids_before long, doc_ids array<long>, repeats array<int>, lengths array<long>, width int, data binary"
INDEX = "partition int, n int, pilots binary, fingerprints binary, part binary, block binary, offset binary, length binary, start binary"
PLACE = ("part", "block", "offset", "length", "start")
_M1, _M2, _NULL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def key_hash(doc_ids: np.ndarray, null: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """64-bit hash of document keys: id, whether it is null, and which of the rows with that id."""
    h = (doc_ids.astype(np.int64).view(np.uint64) + repeats.astype(np.uint64) * _M2 + null.astype(np.uint64) * _NULL) * _M1
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * _M2
    return h ^ (h >> np.uint64(32))


def _slot(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (pilots.astype(np.uint64) * _M2)) * _M1
    return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def build_pilots(h: np.ndarray) -> np.ndarray:
    """Pilots that send ``n`` distinct hashes to ``n`` distinct slots, larger buckets first."""
    n = len(h)
    if len(np.unique(h)) < n:
        raise ValueError("two keys of an index partition have the same hash")
    n_buckets = -(-n // BUCKET_KEYS)
    bucket = ((h >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    pilots, taken = np.zeros(n_buckets, np.uint32), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        keys = h[order[ends[b] - sizes[b] : ends[b]]]
        for base in range(0, 1 << 32, 64):
            tried = np.arange(base, base + 64, dtype=np.uint64)
            slots = _slot(keys[None, :], tried[:, None], n)
            free = ~taken[slots].any(1)
            if len(keys) > 1:
                s = np.sort(slots, 1)
                free &= (s[:, 1:] != s[:, :-1]).all(1)
            if free.any():
                k = int(free.argmax())
                pilots[b] = base + k
                taken[slots[k]] = True
                break
    return pilots


def find_slots(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Slots of hashes in a partition of ``n`` keys."""
    return _slot(h, pilots[((h >> np.uint64(20)) % np.uint64(len(pilots))).astype(np.int64)], n)


def fingerprints(h: np.ndarray) -> np.ndarray:
    return ((h * _M2) >> np.uint64(32)).astype(np.uint32)


def _blocks(path: str, end_id: int, width: int):
    kind = np.dtype(f"<u{width}")
    end = np.array([end_id], kind).tobytes()

    def run(batches):
        tool = encoder(path, spaced=False)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, repeats, lengths, data, held, last, seen = [], [], [], [], 0, "none yet", 0

        def flush():
            row = [[part], [block], [before], [ids], [repeats], [lengths], [width], [b"".join(data)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "block", "ids_before", "doc_ids", "repeats", "lengths", "width", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(tool.encode(text), "<u4").astype(kind).tobytes() + end
                seen = seen + 1 if doc_id == last else 0
                if held and held + len(own) > BLOCK_IDS * width:
                    yield flush()
                    block, before = block + 1, before + held // width
                    ids, repeats, lengths, data, held = [], [], [], [], 0
                ids.append(doc_id)
                repeats.append(seen)
                lengths.append(len(own) // width)
                data.append(own)
                held, last = held + len(own), doc_id
        if data:
            yield flush()

    return run


def _index_partition(pdf: pd.DataFrame) -> pd.DataFrame:
    null = pdf["doc_id"].isna().to_numpy()
    h = key_hash(pdf["doc_id"].fillna(0).to_numpy(np.int64), null, pdf["repeat"].to_numpy())
    n, pilots = len(h), build_pilots(h)
    slots = find_slots(h, pilots, n)
    row = {"partition": pdf["partition"].iloc[0], "n": n, "pilots": pilots.astype("<u4").tobytes()}
    for name, values in ({"fingerprints": fingerprints(h)} | {k: pdf[k].to_numpy() for k in PLACE}).items():
        placed = np.zeros(n, "<u4" if name == "fingerprints" else "<i8")
        placed[slots] = values
        row[name] = placed.tobytes()
    return pd.DataFrame([row])


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id on disk: 2 where all of the vocabulary's ids fit, else 4."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()
    return 2 if max(end_id, *ids) < 1 << 16 else 4


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Write the ids of all documents, each with ``end_id`` after it, under ``path``.

    Rows go in ascending doc_id order, null ids first and rows that repeat an id in any
    order; they are numbered from 0 in that order. An id that very many rows repeat is
    split over several ranges. A null text is the empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    ranges = max(48, -(-int(held) // RANGE_BYTES))
    salted = rows.withColumn("salt", F.xxhash64("text", F.monotonically_increasing_id()))
    ordered = salted.repartitionByRange(ranges, "doc_id", "salt").sortWithinPartitions("doc_id", "salt").drop("salt")
    payload = write_table(ordered.mapInArrow(_blocks(tokenizer, end_id, id_width(tokenizer, end_id)), PAYLOAD), f"{path}/payload")

    places = _renumbered(_places(payload), payload)
    n = payload.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    partitions = max(16, -(-n // INDEX_KEYS))
    dealt = places.withColumn("partition", _partition(partitions))
    write_table(dealt.groupBy("partition").applyInPandas(_index_partition, INDEX), f"{path}/index")


def _partition(n: int):
    return F.pmod(F.xxhash64("doc_id", "repeat"), F.lit(n)).cast("int")


def _renumbered(rows: DataFrame, payload: DataFrame) -> DataFrame:
    """Rows (part, doc_id, repeat, ...) with repeats counted on from the parts before.

    Only an id that ends one part and begins another has rows in both, and such an id is
    the first or the last of every block that it is in.
    """
    ends = F.explode(F.array_distinct(F.array(F.col("doc_ids")[0], F.element_at("doc_ids", -1))))
    held = payload.select("part", "doc_ids", ends.alias("doc_id")).select("part", "doc_id", F.size(F.filter("doc_ids", lambda x: x.eqNullSafe(F.col("doc_id")))).alias("n"))
    held = held.groupBy("part", "doc_id").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    on = held.select(F.col("part").alias("p"), F.col("doc_id").alias("d"), before.cast("int").alias("more")).where("more > 0")
    if on.isEmpty():
        return rows
    found = rows.join(on, (rows.part == on.p) & rows.doc_id.eqNullSafe(on.d), "left")
    return found.withColumn("repeat", F.col("repeat") + F.coalesce("more", F.lit(0))).select(*rows.columns)


def _places(payload: DataFrame) -> DataFrame:
    """Where each document's ids are: block and offset, and the ids of all documents before it."""
    # One row per range of documents: few enough for one running total.
    totals = payload.groupBy("part").agg(F.max(F.col("ids_before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = totals.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("first"))
    rows = payload.select("part", "block", "ids_before", F.posexplode(F.arrays_zip("doc_ids", "repeats", "lengths")).alias("at", "d"))
    ahead = F.sum("d.lengths").over(Window.partitionBy("part", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("part", "block", "ids_before", F.col("d.doc_ids").alias("doc_id"), F.col("d.repeats").alias("repeat"), F.col("d.lengths").alias("length"), F.coalesce(ahead, F.lit(0).cast("long")).alias("offset"))
    return rows.join(firsts, "part").select("doc_id", "repeat", "part", "block", "offset", "length", (F.col("first") + F.col("ids_before") + F.col("offset")).alias("start"))


def _look_up(key, keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = keys.copy()
    if index.empty:
        return out.iloc[:0].reindex(columns=[*keys.columns, *PLACE])
    row = index.iloc[0]
    h = key_hash(keys["doc_id"].fillna(0).to_numpy(np.int64), keys["doc_id"].isna().to_numpy(), keys["repeat"].to_numpy())
    slots = find_slots(h, np.frombuffer(row["pilots"], "<u4"), int(row["n"]))
    for name in PLACE:
        out[name] = np.frombuffer(row[name], "<i8")[slots]
    return out[np.frombuffer(row["fingerprints"], "<u4")[slots] == fingerprints(h)]


def look_up(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Places of the documents named by ``keys`` (doc_id, repeat and any columns).

    A key that the store lacks gives no row, unless its fingerprint of 32 bits agrees with
    that of the key in its slot.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    dealt = keys.withColumn("partition", _partition(_index_size(spark, path)))
    found = T.StructType([*dealt.schema.fields, *(T.StructField(name, T.LongType()) for name in PLACE)])
    return dealt.groupBy("partition").cogroup(index.groupBy("partition")).applyInPandas(_look_up, found).drop("partition")


def _index_size(spark: SparkSession, path: str) -> int:
    """The number of partitions that keys are dealt to, which the number of documents decides."""
    n = spark.read.schema(INDEX).parquet(f"{path}/index").agg(F.sum("n")).first()[0] or 0
    return max(16, -(-n // INDEX_KEYS))


def _slice(key, places: pd.DataFrame, payload: pd.DataFrame) -> pd.DataFrame:
    row = payload.iloc[0]
    ids = np.frombuffer(row["data"], f"<u{row['width']}")
    cuts = [ids[o : o + n].astype("<u4").tobytes() for o, n in zip(places["offset"], places["length"], strict=True)]
    return places[["doc_id", "repeat", "start", "length"]].assign(ids=cuts)


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Ids of the documents named by ``keys``: doc_id, repeat, start, length, ids (32-bit little-endian)."""
    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload").select("part", "block", "width", "data")
    places = look_up(spark, path, keys.select("doc_id", "repeat"))
    wanted = payload.join(places.select("part", "block").distinct(), ["part", "block"], "left_semi")
    return places.groupBy("part", "block").cogroup(wanted.groupBy("part", "block")).applyInPandas(_slice, "doc_id long, repeat int, start long, length long, ids binary")


def _checksums(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, at, sums, offsets = np.frombuffer(row["data"], f"<u{row['width']}"), 0, [], []
            for n in row["lengths"]:
                sums.append(zlib.crc32(ids[at : at + n].astype("<u4").tobytes()))
                offsets.append(at)
                at += n
            k = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["repeats"], pa.int32()), pa.array([row["part"]] * k, pa.int64()), pa.array([row["block"]] * k, pa.int64()), pa.array(offsets, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "repeat", "part", "in_block", "at", "ids_crc32"],
            )


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Place and checksum of every document, from the files.

    Payload blocks are read in place and only checksums are moved. Each document's place
    comes from the index, and must be where its block has it.
    """
    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    sums = payload.mapInArrow(_checksums, "doc_id long, repeat int, part long, in_block long, at long, ids_crc32 long")
    found = look_up(spark, path, _renumbered(sums, payload).withColumnRenamed("part", "in_part"))
    agree = (F.col("part") == F.col("in_part")) & (F.col("block") == F.col("in_block")) & (F.col("offset") == F.col("at"))
    held = F.when(agree, F.col("start")).otherwise(F.raise_error(F.lit("index and payload disagree")).cast("long"))
    return found.select("doc_id", held.alias("start"), F.col("length").alias("n_tokens"), "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the store of ``docs`` and read its digest back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer)
    return read_digest(docs.sparkSession, path)
