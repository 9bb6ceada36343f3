"""Packing of token sequences by hierarchical best fit over residual bins.

Every partition packs its own pieces by best fit and gives out the bins that are nearly
full. Bins with room left become the items of the next round, in fewer and fewer groups,
until one group has packed what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage
from .tokens import encoder

#: Tokens of a sequence, and the room with which a bin counts as full.
CAPACITY, NEAR = 2048, 2
#: Bins that one task packs at most in the rounds after the first.
GROUP = 50_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full pieces at the end, what is over first."""
    first = n % capacity
    starts = ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]
    return starts


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tool = encoder(path, spaced=True)
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tool.encode(text) + end
                    rows += [(doc_id, k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: largest item first, each into the fullest bin that has room."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, []
    for i in order:
        size = sizes[i]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, bin_ = capacity, []
            bins.append(bin_)
        bin_.append(i)
        left = room - size
        if left:
            by_room[left].append(bin_)
            open_rooms |= 1 << left
    return bins


_BINS = "fill long, members array<long>, sizes array<long>"


def _pack(capacity: int):
    """Packs all bins of a task's input; a bin is its members and their sizes in order."""

    def run(batches):
        fills, members, sizes = [], [], []
        for batch in batches:
            fills += batch.column(0).to_pylist()
            members += batch.column(1).to_pylist()
            sizes += batch.column(2).to_pylist()
        packed = best_fit(fills, capacity)
        for lo in range(0, len(packed), 10_000):
            part = packed[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sum(fills[i] for i in b) for b in part], pa.int64()),
                    pa.array([[m for i in b for m in members[i]] for b in part], pa.list_(pa.int64())),
                    pa.array([[s for i in b for s in sizes[i]] for b in part], pa.list_(pa.int64())),
                ],
                ["fill", "members", "sizes"],
            )

    return run


def plan_residuals(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, largest first, of ``counts`` bins by fill: (bins alike, their fills as (fill, number) in order).

    Bins alike are packed together, so the work grows with the number of fills, not of bins.
    """
    open_: dict[int, list[list]] = {}
    done = []

    def put(times: int, held: list, room: int) -> None:
        if room:
            open_.setdefault(room, []).append([times, held])
        else:
            done.append((times, held))

    for fill, left in sorted(counts.items(), reverse=True):
        while left:
            fitting = [r for r in open_ if r >= fill]
            if fitting:
                room = min(fitting)
                times, held = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                room, times, held = capacity, left, []
            each = min(room // fill, left)
            used = min(times, left // each)
            if used < times and held:
                put(times - used, held, room)
            put(used, [*held, (fill, each)], room - each * fill)
            left -= used * each
    return done + [(times, held) for bins in open_.values() for times, held in bins]


def _join_residuals(left: DataFrame, capacity: int) -> DataFrame:
    """All underfull bins packed at once, by a plan over the number of bins of each fill.

    The plan needs one count per fill, ``capacity`` of them at most, whatever the number of bins. Bins of
    one fill are interchangeable: they are numbered, and the plan says which numbers make
    which bin.
    """
    spark = left.sparkSession
    numbered = stage(left.withColumn("part", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(1024)).cast("int")), "residuals")
    cells = stage(numbered.groupBy("fill", "part").agg(F.count(F.lit(1)).alias("n")), "cells")
    plan = plan_residuals({r.fill: r.n for r in cells.groupBy("fill").agg(F.sum("n").alias("n")).collect()}, capacity)
    slots, taken, bins = [], {}, 0
    for times, held in plan:
        for at, (fill, each) in enumerate(held):
            first = taken.get(fill, 0)
            taken[fill] = first + times * each
            slots.append((fill, first, taken[fill], each, at, bins))
        bins += times
    own = F.row_number().over(Window.partitionBy("fill", "part").orderBy(F.col("members")[0])) - 1
    before = F.sum("n").over(Window.partitionBy("fill").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select("fill", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = numbered.withColumn("own", own).join(starts, ["fill", "part"]).withColumn("number", F.col("own") + F.col("before"))
    table = spark.createDataFrame(slots, "fill long, first long, until long, each long, at long, bin long")
    rows = rows.join(F.broadcast(table), "fill").where("number >= first and number < until")
    # ``each`` bins in turn make one new bin.
    rows = rows.withColumn("bin", F.col("bin") + F.floor((F.col("number") - F.col("first")) / F.col("each")))
    parts = F.sort_array(F.collect_list(F.struct("at", "number", "fill", "members", "sizes")))
    packed = rows.groupBy("bin").agg(parts.alias("parts"))
    flat = lambda c: F.flatten(F.transform("parts", lambda x: x[c]))
    return packed.select(F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["fill"]).alias("fill"), flat("members").alias("members"), flat("sizes").alias("sizes"))


def assign(items: DataFrame, capacity: int = CAPACITY, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """Sequence and offset of every item: rows (uid, sequence_id, offset).

    ``items`` has a unique uid and a length from 1 to ``capacity``. A sequence is named by
    the uid of its first item. Groups of the later rounds are sized by the number of bins
    left, so no task holds more than ``group`` of them in expectation. Rounds end when one
    group has packed all that is left; where many groups hardly join any more bins, what
    is left is packed as a whole by the number of bins of each fill.
    """
    bins = stage(items.select(F.col("length").alias("fill"), F.array("uid").alias("members"), F.array("length").alias("sizes")).mapInArrow(_pack(capacity), _BINS), "bins")
    done = [bins.where(F.col("fill") >= capacity - near)]
    left = bins.where(F.col("fill") < capacity - near)
    n = left.count()
    while n:
        groups = -(-n // group)
        # Bins that no other bin can join are done as well; the rest meet in new groups.
        least = left.agg(F.min("fill")).first()[0]
        done.append(left.where(F.col("fill") > capacity - least))
        left = left.where(F.col("fill") <= capacity - least)
        dealt = left.repartition(groups, F.xxhash64(F.col("members")[0], F.lit(groups))) if groups > 1 else left.coalesce(1)
        bins = stage(dealt.mapInArrow(_pack(capacity), _BINS), "bins")
        after = bins.where(F.col("fill") < capacity - near).count()
        if groups == 1:
            done.append(bins)
            break
        if after > 0.99 * n:
            done += [bins.where(F.col("fill") >= capacity - near), stage(_join_residuals(bins.where(F.col("fill") < capacity - near), capacity), "bins")]
            break
        done.append(bins.where(F.col("fill") >= capacity - near))
        left, n = bins.where(F.col("fill") < capacity - near), after
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    each = whole.select("members", "sizes", F.posexplode("members").alias("at", "uid"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, b: a + b)
    return each.select("uid", F.col("members")[0].alias("sequence_id"), before.alias("offset"))


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of all documents, written once: uid, doc_id, piece, start, length and ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids binary")
    return stage(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, carry: Column | str = "ids") -> DataFrame:
    """Pack whole texts into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, what ``carry`` makes of its
    ids (little-endian unsigned 32-bit; themselves by default), sequence_id and offset.
    ``carry`` is applied where the piece is read, before anything is shuffled. Documents longer than ``capacity`` are cut, the first
    piece taking what full pieces leave over; others stay whole. A null text is an empty
    one, which still has its end id. Other columns of ``docs`` are ignored, and rows
    repeated in full are packed as often as they occur.
    """
    pieces = tokenize(docs, path, capacity, end_id)
    carried = pieces.select("uid", "doc_id", "piece", "start", "length", carry)
    full = carried.where(F.col("length") == capacity).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = assign(pieces.where(F.col("length") < capacity).select("uid", "length"), capacity)
    rest = carried.where(F.col("length") < capacity).join(placed, "uid")
    out = [*carried.columns[1:], "sequence_id", "offset"]
    return full.select(*out).union(rest.select(*out))


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, length and ids in order."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", "length", ids.alias("ids"))
