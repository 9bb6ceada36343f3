"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys are computed per document. Every pair of one half key
from each collection is the key of one table, so ``side * side`` tables cost only
``2 * side`` half keys. Candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stage

#: Half keys in each collection, minhashes in a half key, words in a shingle. A pair at 0.85
#: shares one of the 81 tables with probability 0.9996, a pair at 0.80 with 0.997.
SIDE, WIDTH, WORDS = 9, 3, 5
#: Members of a table's bucket that all other members are compared with first.
HUBS = 3
#: 64-bit words of a set's bitmap, and members of a bucket's block when pairs are completed.
MAP, BLOCK = 32, 512
#: Words whose hashes a worker remembers.
CACHE = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_GOLD = np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _GOLD
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of anything but space and tab to carriage return, A-Z lower-cased; a
    text of fewer than five words has its whole word sequence as one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    m = n - WORDS + 1
    h = ids[:m].copy()
    for k in range(1, WORDS):
        h = _mix(h * _ODD + ids[k : k + m])
    return np.unique(h)


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(hashes: np.ndarray, side: int = SIDE, width: int = WIDTH, seed: int = 7) -> np.ndarray:
    """2 * side half keys, each folded from ``width`` minhashes of the set."""
    by = _multipliers(2 * side * width, seed)
    least = None
    for k in range(0, len(hashes), 2048):
        part = (hashes[k : k + 2048, None] * by).min(0)
        least = part if least is None else np.minimum(least, part)
    parts, key = least.reshape(2 * side, width), np.zeros(2 * side, np.uint64)
    for k in range(width):
        key = _mix(key * _ODD + parts[:, k])
    return key


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """MAP words in which every hash of the set turns one bit over, so that bits of large sets tell as much as those of small ones."""
    bits = np.zeros(MAP, np.uint64)
    np.bitwise_xor.at(bits, (hashes >> np.uint64(6)) % np.uint64(MAP), np.uint64(1) << (hashes & np.uint64(63)))
    return bits


def _sketch(batches):
    for batch in batches:
        n, h1, h2, keys, bits = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            n.append(len(s))
            h1.append(int(s.sum(dtype=np.uint64)))
            h2.append(int(_mix(s * _ODD).sum(dtype=np.uint64)))
            keys.append(half_keys(s).astype(np.int64) if len(s) else None)
            bits.append(bitmap(s).astype(np.int64) if len(s) else None)
        signed = lambda x: pa.array(np.array(x, np.uint64).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), signed(h1), signed(h2), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
            ["doc_id", "text_hash", "n_shingles", "h1", "h2", "keys", "bits"],
        )


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["cls", "hashes"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (x.size + y.size - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _table_keys(keys: Column, side: int) -> Column:
    """All side * side table keys of a row."""
    return F.array(*[F.xxhash64(keys[i], keys[side + j], F.lit(i * side + j)) for i in range(side) for j in range(side)])


def _buckets(classes: DataFrame) -> DataFrame:
    """Members (key, cls, n_shingles, w) of all buckets of two or more classes; w is how central a class is."""
    entries = classes.select("cls", "n_shingles", F.explode(_table_keys(F.col("keys"), SIDE)).alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(entries.join(shared, "key"), "buckets")
    weight = members.groupBy("cls").agg(F.sum("n").alias("w"))
    return stage(members.join(weight, "cls").select("key", "cls", "n_shingles", "w"), "buckets")


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a table key, each with the hubs of its bucket.

    A class is the more central the more rows its buckets hold, so a bucket's hubs are
    its classes nearest to what the bucket has in common. Counts and maxima are
    aggregated before the shuffle, and a bucket of g classes gives at most HUBS * g pairs.
    """
    order = F.struct("w", "cls", "n_shingles")
    hubs = members.groupBy("key").agg(F.max(order).alias("h"))
    found = hubs
    for _ in range(HUBS - 1):
        rest = members.join(hubs, "key").where(order < F.col("h"))
        hubs = rest.groupBy("key").agg(F.max(order).alias("h"))
        found = found.union(hubs)
    pairs = members.join(stage(found, "hubs"), "key").where("cls <> h.cls")
    small, large = F.least("n_shingles", "h.n_shingles"), F.greatest("n_shingles", "h.n_shingles")
    return pairs.where(100 * small >= percent * large).select(F.least("cls", "h.cls").alias("a"), F.greatest("cls", "h.cls").alias("b")).distinct()


def _crossing(members: DataFrame, parts: DataFrame, faces: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a table key, are of different components and can be linked.

    In a bucket, every class outside the bucket's largest component meets all classes of
    other components, so that no such pair is left out. Bits in which two bitmaps differ
    are at most the shingles that only one set has; too many of them rule a link out, so
    the join gives few pairs besides links. Classes that share several tables meet in the first
    of them alone. Large buckets meet block by block.
    """
    member = members.select("key", "cls").join(parts.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    member = stage(member, "buckets")
    size = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = size.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("m")).where("parts > 1")
    open_ = member.join(main.select("key", F.col("m.component").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    open_ = stage(open_.join(faces.select("cls", "n_shingles", "bits", "keys"), "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")), "open")
    left = open_.where("component <> main").drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("l")
    right = open_.alias("r")
    differ = sum((F.bit_count(F.col("l.bits")[i].bitwiseXOR(F.col("r.bits")[i])) for i in range(MAP)), F.lit(0))
    n, m = F.col("l.n_shingles"), F.col("r.n_shingles")
    once = (F.col("r.component") == F.col("r.main")) | (F.col("l.cls") < F.col("r.cls"))
    can = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))
    # Half keys that both have: the first of either side name the first table that they share.
    shared = lambda lo: F.coalesce(*[F.when(F.col("l.keys")[lo + i] == F.col("r.keys")[lo + i], F.lit(i)) for i in range(SIDE)])
    i, j = shared(0), shared(SIDE)
    first = F.col("l.key") == F.xxhash64(F.get("l.keys", i), F.get("l.keys", SIDE + j), i * SIDE + j)
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.component") != F.col("r.component"))
    return left.join(right, met & once & can & first).select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b")).distinct()


def _links(pairs: DataFrame, faces: DataFrame, source: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are near enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = faces.join(wanted, "cls", "left_semi").select("cls", "text_hash", F.col("doc_id").alias("of"))
    texts = source.join(wanted, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("of")))
    # Rows that repeat the one that stands for a class bring its set once.
    sets = stage(texts.select("cls", "text").mapInArrow(_sets, "cls long, hashes binary").dropDuplicates(["cls"]), "sets")
    full_pairs = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return stage(full_pairs.mapInArrow(_confirm(percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Label every row with its group of near-duplicate documents.

    Takes doc_id and text of ``docs`` (other columns are ignored) and returns one row per
    input row: doc_id, n_shingles, component_id (smallest doc_id of the group) and kept
    (whether the row's id is that smallest one). Documents are linked when
    100 * intersection >= percent * union over their full sets of 5-word shingles.

    Null and word-less texts have n_shingles 0 and are linked with nothing. A null doc_id
    never becomes a component while the group has another id. Rows that repeat a doc_id
    share its answer when their texts are linked, and are judged apart otherwise.

    Documents with equal sets form a class and only one row of a class is compared, so a
    large group of copies costs no pairs. Classes are linked with the hubs of their buckets
    first; pairs of a bucket that then are in different components are all examined, so
    components are those of all links between classes that share a bucket.
    """
    text_hash = F.xxhash64("text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = source.withColumn("text_hash", text_hash).mapInArrow(_sketch, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, keys array<long>, bits array<long>")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "sketches")

    full = rows.where("n_shingles > 0")
    classes = stage(
        full.groupBy("h1", "h2", "n_shingles").agg(F.min("row").alias("cls"), F.min("doc_id").alias("least_id")),
        "classes",
    )
    # The row that stands for a class brings its keys; row numbers are unique.
    faces = stage(full.join(classes.select(F.col("cls").alias("row")), "row", "left_semi").withColumnRenamed("row", "cls"), "faces")
    members = _buckets(faces)
    source = source.withColumn("text_hash", text_hash)
    links = _links(stage(_candidates(members, percent), "pairs"), faces, source, percent)
    pairs = stage(_crossing(members, connected_components(links), faces, percent), "pairs")
    links = links.union(_links(pairs, faces, source, percent))

    parts = connected_components(links)
    whole = classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("part", F.coalesce("component", "cls"))
    least = whole.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = stage(whole.join(least, "part").select("h1", "h2", F.col("n_shingles").alias("n"), "component_id"), "named")
    out = rows.join(named, (rows.h1 == named.h1) & (rows.h2 == named.h2) & (rows.n_shingles == named.n), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all columns.

    Of rows that agree in doc_id and text one stays, whichever of them it is where their other columns differ.
    """
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(["doc_id", "text"])
