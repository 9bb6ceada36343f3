"""Hard negatives by exact search over one-dimensional distance keys.

Every vector x is augmented by one coordinate that gives all of them the same length M, and
an anchor q by a zero; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and high scores are small
distances. The index stores each vector under its nearest pivot, sorted by (pivot, distance
to the pivot). By the triangle inequality an interval of such keys lies in an annulus around
the anchor, which bounds the scores in it from both sides. A search scans the intervals of
best bounds first, and more in every round, until what is left cannot hold a better row than
those found. The bounds only save work: whatever the pivots are, results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Pivots beside the origin, rows that they are fitted on (about; twice as many at most), rounds of fitting.
PIVOTS, SAMPLE, FITS = 32, 2048, 6
#: Key intervals of a pivot at most, rows of one at least, rows of an interval that one group holds, anchors of a block.
RINGS, LEAST, WIDE, BLOCK = 64, 512, 1024, 4096
#: Share of the rows that searches may scan up to each round; the last is all that bounds leave.
SHARES = (1 / 16, 1 / 4, 1.0)
#: Integer lengths up to which float arithmetic on integers is exact, and up to which that of longs is.
EXACT, LARGEST = 1 << 53, 1 << 59
#: Stands for a null id, which comes last.
LAST = (1 << 63) - 1


def integer_rows(vectors: DataFrame, scale: int, relabel: Column) -> DataFrame:
    """(row, ord, label, dim, vec, sq): rows that take part, with integer components and their sum of squares."""
    v = F.transform(F.col("embedding"), lambda x: scale * x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("vec"), finite.alias("finite"))
    rows = rows.where(F.col("label").isNotNull() & F.col("finite"))
    vec = F.transform("vec", lambda x: F.floor(x).cast("double"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(LAST)).alias("ord"), relabel.alias("label"), F.size("vec").alias("dim"), vec.alias("vec"))
    return stage(rows.withColumn("sq", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), "vectors")


@dataclass
class Keys:
    """What a search knows of the index: pivots by vector length, and the key intervals of each."""

    pivots: dict[int, np.ndarray]
    cells: dict[int, pd.DataFrame]
    top: float

    def distances(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distances of vectors with the given added coordinates to the pivots of their length."""
        p = self.pivots[x.shape[1]] if x.shape[1] in self.pivots else np.zeros((1, x.shape[1] + 1))
        sq = (x * x).sum(1) + last * last
        near = sq[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p[:, :-1].T + last[:, None] * p[:, -1][None, :])
        return np.sqrt(np.maximum(near, 0))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row of each interval can have with each anchor."""
        cells = self.cells[x.shape[1]]
        at = self.distances(x, np.zeros(len(x)))[:, cells["pivot"].to_numpy()]
        low, high = cells["low"].to_numpy()[None, :], cells["high"].to_numpy()[None, :]
        nearest, farthest = np.maximum(0, np.maximum(at - high, low - at)), at + high
        twice = (x * x).sum(1)[:, None] + self.top
        slack = 1e-6 * self.top + 1e-3
        return (twice - farthest * farthest) / 2 - slack, (twice - nearest * nearest) / 2 + slack


def _matrix(vectors, kind=np.float64) -> np.ndarray:
    return np.array(list(vectors), dtype=kind).reshape(len(vectors), -1)


def _fit_pivots(rows: DataFrame, top: float, seed: int) -> dict[int, np.ndarray]:
    """Pivots from a bounded sample: the origin, and centres of a few rounds of k-means."""
    n = rows.count()
    share = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < share).select("dim", "vec", "sq").limit(2 * SAMPLE).toPandas()
    pivots = {}
    for dim, part in some.groupby("dim"):
        x = np.hstack([_matrix(part["vec"]).reshape(len(part), dim), np.sqrt(np.maximum(top - part["sq"].to_numpy(), 0))[:, None]])
        centres = x[np.random.default_rng(seed).permutation(len(x))[:PIVOTS]]
        for _ in range(FITS):
            near = ((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
            centres = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        pivots[int(dim)] = np.vstack([np.zeros(dim + 1), centres])
    return pivots


def build_index(rows: DataFrame, seed: int = 23) -> tuple[DataFrame, Keys]:
    """Rows stored sorted by (pivot, distance) in numbered key intervals, and the intervals' bounds.

    Intervals are cut at quantiles, so that each holds LEAST rows or more, and at most
    PIVOTS * RINGS of them describe a vector length however many rows there are. An interval of
    many rows, also where they have the same key, is dealt to groups (sub) of about WIDE.
    """
    top = float(rows.agg(F.max("sq")).first()[0] or 0)
    if top >= LARGEST:
        raise ValueError("scores of these vectors do not fit a long; scale them down")
    keys = Keys(_fit_pivots(rows, top, seed), {}, top)

    def place(batches):
        for pdf in batches:
            for _, part in pdf.groupby("dim", sort=False):
                part = part.reset_index(drop=True)
                d = keys.distances(_matrix(part["vec"]), np.sqrt(np.maximum(top - part["sq"].to_numpy(), 0)))
                pivot = d.argmin(1)
                yield part.assign(pivot=pivot.astype(np.int32), dist=d[np.arange(len(d)), pivot])

    shape = "row long, ord long, label long, dim int, vec array<double>, sq double, pivot int, dist double"
    placed = stage(rows.mapInPandas(place, shape), "placed")
    of = ["dim", "pivot"]
    sizes = placed.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
    rings = F.least(F.lit(RINGS), F.greatest(F.lit(1), F.floor(F.col("n") / LEAST))).cast("int")
    # Every (RINGS / rings)-th cut; a row's interval is the number of cuts below its distance.
    sizes = sizes.select(*of, F.transform(F.sequence(F.lit(1), rings), lambda i: F.when(i == rings, float("inf")).otherwise(F.get("cuts", F.floor(i * RINGS / rings).cast("int") - 1))).alias("cuts"))
    ringed = placed.join(F.broadcast(sizes), of).withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
    cells = ringed.groupBy(*of, "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("n")).toPandas()
    cells = cells.sort_values([*of, "ring"]).reset_index(drop=True)
    cells["cell"] = np.arange(len(cells), dtype=np.int32)
    cells["subs"] = np.maximum(1, -(-cells["n"] // WIDE)).astype(np.int32)
    keys.cells.update({int(dim): part.reset_index(drop=True) for dim, part in cells.groupby("dim")})
    named = rows.sparkSession.createDataFrame(cells[[*of, "ring", "cell", "subs"]], "dim int, pivot int, ring int, cell int, subs int")
    index = ringed.join(F.broadcast(named), [*of, "ring"])
    index = index.select("cell", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int").alias("sub"), "dist", "row", "ord", "label", "vec")
    return stage(index.repartitionByRange("cell", "dist", "row").sortWithinPartitions("cell", "dist"), "index"), keys


def _to_visit(keys: Keys, share: float):
    """(anchor, cell, asks): intervals to scan this round, with a bit for each of the anchor's searches, and the new bars."""

    def plan(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                cells = keys.cells.get(int(dim))
                if cells is None:
                    continue
                n, most = cells["n"].to_numpy(), share * cells["n"].sum()
                for lo in range(0, len(part), 512):
                    some = part.iloc[lo : lo + 512]
                    low, high = keys.bounds(_matrix(some["vec"]))
                    order = np.argsort(-high, 1, kind="stable")
                    for i, (anchor, asks) in enumerate(zip(some["anchor"], some["asks"], strict=True)):
                        bits, bars = np.zeros(len(cells), np.int64), []
                        for a, ask in enumerate(asks):
                            open_ = (low[i] <= ask["hi"]) & (high[i] >= ask["floor"]) & (high[i] < ask["bar"])
                            ranked = order[i][open_[order[i]]]
                            taken = ranked if share >= 1 else ranked[: np.searchsorted(np.cumsum(n[ranked]), most) + 1]
                            # Intervals of the same bound go together, so that the bar parts scanned from unscanned.
                            bar = high[i][taken[-1]] if len(taken) else ask["bar"]
                            bits[open_ & (high[i] >= bar)] |= 1 << a
                            bars.append(bar)
                        at = np.nonzero(bits)[0]
                        if len(at):
                            yield pd.DataFrame({"anchor": anchor, "cell": cells["cell"].to_numpy()[at], "bits": bits[at], "bars": [bars] * len(at)})

    return plan


def _scan(k: int, same: bool, kind):
    """The first ``k`` rows of a group of an interval for every search of a block of anchors that asks for it."""

    def run(key, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "ask", "score", "ord", "row")})
        if asked.empty or rows.empty:
            return none
        rows = rows.sort_values(["ord", "row"])
        scores = _matrix(asked["vec"], kind) @ _matrix(rows["vec"], kind).T
        ids, own, bits = rows["row"].to_numpy(), asked["anchor"].to_numpy(), asked["bits"].to_numpy()
        fits = ((asked["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]) == same) & (own[:, None] != ids[None, :])
        out = [none]
        for a in range(int(bits.max()).bit_length()):
            who = np.nonzero(bits >> a & 1)[0]
            if not len(who):
                continue
            limits = [asks[a] for asks in asked["asks"].iloc[who]]
            hi, floor = (np.array([x[c] for x in limits], np.int64)[:, None] for c in ("hi", "floor"))
            s = scores[who].astype(np.int64)
            ok = fits[who] & (s <= hi) & (s >= floor)
            least = np.iinfo(np.int64).min
            s = np.where(ok, s, least)
            cut = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else np.full((len(s), 1), least)
            q, r = np.nonzero(ok & (s >= cut))
            found = pd.DataFrame({"anchor": own[who][q], "ask": a, "score": s[q, r], "ord": rows["ord"].to_numpy()[r], "row": ids[r]})
            # Rows are in the order of their ids, so a stable sort by score puts the smaller id first.
            found = found.sort_values(["anchor", "score"], ascending=[True, False], kind="stable")
            out.append(found[found.groupby("anchor").cumcount() < k])
        return pd.concat(out)

    return run


def search(anchors: DataFrame, index: DataFrame, keys: Keys, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows (anchor, ask, score, ord, row, r) of every search, by score and then by id.

    ``anchors`` has anchor (a row), label, dim, vec and asks, an array of (lo, hi): each
    search wants rows of the anchor's label (``same``) or of others, whose score is from lo
    to hi. Rounds go on until the bounds of all intervals that were not scanned rule out
    a better row. Anchors go to their intervals in blocks; each of the two sides of a group
    has a bounded size, and a search keeps k rows of a group.
    """
    kind = np.float64 if keys.top < EXACT else np.int64
    ask = "array<struct<lo: long, hi: long, floor: long, bar: double>>"
    blocks = max(1, -(-anchors.count() // BLOCK))
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")
    begin = F.transform("asks", lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"), a["lo"].alias("floor"), F.lit(float("inf")).alias("bar"))).cast(ask)
    now = stage(anchors.select("anchor", "label", "dim", "vec", begin.alias("asks"), block.alias("block")), "searches")
    cells = pd.concat([*keys.cells.values(), pd.DataFrame({"cell": [], "subs": []})])[["cell", "subs"]]
    subs = F.broadcast(now.sparkSession.createDataFrame(cells.astype(np.int32), "cell int, subs int"))
    hits = now.sparkSession.createDataFrame([], "anchor long, ask int, score long, ord long, row long, r int")
    for share in SHARES:
        visits = stage(now.mapInPandas(_to_visit(keys, share), "anchor long, cell int, bits long, bars array<double>"), "visits")
        if visits.isEmpty():
            break
        group = ["cell", "sub", "block"]
        asked = visits.drop("bars").join(subs, "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).join(now.drop("dim"), "anchor")
        wanted = asked.select("cell", "sub", F.col("block").alias("to")).distinct()
        rows = index.drop("dist").join(wanted, ["cell", "sub"])
        new = asked.drop("subs").groupBy(*group).cogroup(rows.groupBy("cell", "sub", "to")).applyInPandas(_scan(k, same, kind), "anchor long, ask int, score long, ord long, row long")
        best = F.row_number().over(Window.partitionBy("anchor", "ask").orderBy(F.col("score").desc(), "ord", "row"))
        hits = stage(hits.drop("r").unionByName(new).withColumn("r", best).where(F.col("r") <= k), "hits")
        # A search that has k rows needs no interval whose bound is below the last of them.
        last = hits.where(F.col("r") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("last"))
        bars = visits.groupBy("anchor").agg(F.first("bars").alias("bars"))
        asks = F.transform("asks", lambda a, i: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"), F.coalesce(F.col("last")[i], a["floor"]).alias("floor"), F.coalesce(F.get("bars", i), a["bar"]).alias("bar")))
        # What no interval was scanned for is certified, and does not come back.
        now = stage(now.join(bars, "anchor").join(last, "anchor", "left").select("anchor", "label", "dim", "vec", asks.cast(ask).alias("asks"), "block"), "searches")
    return hits


def mine(vectors: DataFrame, anchor_every: int = 100, shift_every: int = 7, scale: int = 256, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Hard negatives of every anchor and positive: a row (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) each.

    Takes vec_id, embedding and label; other columns are ignored. Components become
    floor(scale * x); scores are integer inner products, exactly. Anchors are the rows whose
    vec_id is divisible by ``anchor_every``; where it is divisible by ``shift_every``, the label
    counts as (label + 1) % 10. An anchor's positives are its first rows of the same label,
    by falling score and then by vec_id, and the negatives of a positive are in the same order the
    first rows of other labels with 30 * positive_score <= 100 * score <= 90 * positive_score.

    Rows with a null label or vector or a component that is null or not finite take no part;
    vectors of different lengths are not compared; empty and zero vectors score 0. A null
    vec_id is no anchor and comes last where scores tie. Rows that repeat an id count each: as
    anchors, positives (never of themselves) and negatives, and rows alike in id and score
    are in any order. Without positives, or negatives in the range, as for positives below
    zero, an anchor has no rows; nor has an empty table. Components of 2^29 and more raise an error.
    """
    relabel = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integer_rows(vectors, scale, relabel)
    index, keys = build_index(rows)
    anchors = rows.where((F.col("ord") % anchor_every == 0) & (F.col("ord") != LAST)).withColumnRenamed("row", "anchor")
    ask = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    every = F.array(ask(F.lit(-LAST), F.lit(LAST)))
    near = search(anchors.withColumn("asks", every), index, keys, positives, True)
    # Negative scores leave no range; of the others the bounds are rounded inwards.
    near = stage(near.where("score >= 0").select("anchor", "score", "ord", F.row_number().over(Window.partitionBy("anchor").orderBy("r")).alias("at")), "positives")
    ranges = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("near"))
    asks = F.expr("transform(near, p -> named_struct('lo', (3 * p.score + 9) div 10, 'hi', (9 * p.score) div 10))")
    far = search(anchors.join(ranges, "anchor").withColumn("asks", asks), index, keys, negatives, False)
    named = far.withColumn("at", F.col("ask") + 1).join(near.select("anchor", "at", F.col("score").alias("positive_score"), F.col("ord").alias("positive_ord")), ["anchor", "at"])
    named = named.join(anchors.select("anchor", F.col("ord").alias("anchor_id")), "anchor")
    known = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return named.select("anchor_id", known("positive_ord").alias("positive_id"), F.col("r").alias("rank"), known("ord").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_sql() -> str:
    """The same rows in DuckDB SQL, by comparing all anchors with all rows."""
    return """
    with v as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v, row_number() over () as row
      from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
      select a.row as a, a.vec_id as anchor_id, b.row as b, b.vec_id, a.label = b.label as same, case when len(a.v) = 0 then 0 else list_inner_product(a.v, b.v)::bigint end as score
      from v a join v b on a.vec_id % 100 = 0 and a.row <> b.row and len(a.v) = len(b.v)),
    p as (select * from (select *, row_number() over (partition by a order by score desc, vec_id, b) as r from s where same) where r <= 5),
    n as (
      select p.a, p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (partition by p.a, p.b order by s.score desc, s.vec_id, s.b) as rank
      from p join s on s.a = p.a and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
    select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 10
    """
