"""Near-duplicate vectors by NN-descent.

Equal vectors form a class and one of them stands for it. Random hyperplanes give each
class a first neighbour list; rounds of neighbours-of-neighbours joins refine the lists
and enlarge those that are full of links; samples of vectors are compared with all others
to audit the recall. Classes with more links than the largest list holds are compared
with all of their label in blocks, which counts their links and joins components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stage

#: Neighbours in a list, links in an enlarged one, trees of hyperplanes, vectors of a leaf, rounds at least and at most.
NEIGHBOURS, MOST, TREES, LEAF, ROUNDS, MOST_ROUNDS = 12, 48, 5, 160, 2, 6
#: New neighbours that one block proposes in a round to a vector whose list is not being enlarged, and salts of a large leaf.
PROPOSED, SALTS = 3, 64
#: Vectors of each of the audit's two samples, the recall that ends the rounds, vectors of a block of the exact search.
AUDITED, ENOUGH, WIDE = 1000, 0.999, 2048


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _valid(v: Column) -> Column:
    """Whether a vector can be compared: no null, no component that isn't finite, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _leaves(classes: DataFrame, seed: int) -> DataFrame:
    """(cls, tree, leaf, block, vec): leaves are sides of hyperplanes through the label's mean.

    A label has as many hyperplanes as halve its classes down to LEAF. Leaves that stay
    larger, as those of dense groups do, are dealt to blocks of about LEAF at random.
    """
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    units = classes.select("space", F.posexplode("vec").alias("at", "x"), size.alias("size"))
    mean = units.groupBy("space", "at").agg(F.coalesce(F.avg(F.try_divide(F.col("x").cast("double"), F.col("size"))), F.lit(0.0)).alias("x"))
    mean = mean.groupBy("space").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m")).select("space", F.col("m.x").alias("mean"))
    size = classes.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int")
    rows = classes.select("cls", "space", "vec").join(mean.join(size, "space").select("space", "mean", bits.alias("bits")), "space")

    def sides(batches):
        for pdf in batches:
            for (_, bits), part in pdf.groupby(["space", "bits"], sort=False):
                x = _unit(part["vec"]) - np.asarray(part["mean"].iloc[0])[None, :]
                for tree in range(TREES):
                    planes = np.random.default_rng((seed, tree, x.shape[1])).standard_normal((x.shape[1], 48))[:, :bits]
                    code = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    yield pd.DataFrame({"cls": part["cls"].to_numpy(), "space": part["space"].to_numpy(), "tree": tree, "leaf": code, "vec": part["vec"].to_numpy()})

    placed = stage(rows.mapInPandas(sides, f"cls long, space long, tree int, leaf long, vec {classes.schema['vec'].dataType.simpleString()}"), "sides")
    leaf = ["space", "tree", "leaf"]
    large = placed.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).alias("blocks")).where("blocks > 1")
    # A leaf may hold very many vectors, so each large one is joined under all salts.
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(large, [*leaf, "salt"], "left")
    return salted.withColumn("block", F.pmod(F.xxhash64("cls", "tree"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks", "salt")


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row."""
    return np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]


def _leaf_lists(threshold: float):
    """The nearest NEIGHBOURS of every vector of a block, and its links beyond them up to MOST."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unit(pdf["vec"]), pdf["cls"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        out = []
        for lo in range(0, len(ids), 1024):
            sims = x[lo : lo + 1024] @ x.T
            rows = np.arange(len(sims))
            sims[rows, lo + rows] = -2
            best = _top(sims, min(MOST, len(ids) - 1))
            near = np.take_along_axis(sims, best, 1)
            order = np.argsort(-near, 1, kind="stable")
            near, best = np.take_along_axis(near, order, 1), np.take_along_axis(best, order, 1)
            u, w = np.nonzero((near >= threshold) | (np.arange(near.shape[1]) < NEIGHBOURS)[None, :])
            out.append(pd.DataFrame({"a": ids[lo + u], "b": ids[best[u, w]], "sim": near[u, w]}))
        return pd.concat(out)

    return run


def _nearest(edges: DataFrame, threshold: float) -> DataFrame:
    """The NEIGHBOURS nearest of every list, and of a list with more links than that its MOST nearest links."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))
    kept = (F.col("r") <= NEIGHBOURS) | ((F.col("r") <= MOST) & (F.col("sim") >= threshold))
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", rank).where(kept).drop("r")


def _local_join(key, edges: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """All pairs of neighbours of a block's classes that improve on a list."""
    none = pd.DataFrame({"a": [], "b": [], "sim": []})
    if edges.empty or near.empty:
        return none
    ids = near["cls"].to_numpy()
    order = np.argsort(ids)
    ids, low, most, x = ids[order], near["low"].to_numpy()[order], near["most"].to_numpy()[order], _unit(near["vec"])[order]
    at = np.searchsorted(ids, edges["b"].to_numpy())
    found = []
    for members in pd.Series(at).groupby(edges["a"].to_numpy()).agg(list):
        m = np.array(members)
        sims = x[m] @ x[m].T
        u, w = np.nonzero((sims > low[m][:, None]) & ~np.eye(len(m), dtype=bool))
        found.append((m[u], m[w], sims[u, w]))
    pairs = pd.DataFrame({k: np.concatenate([f[i] for f in found]) for i, k in enumerate(("a", "b", "sim"))})
    pairs = pairs.drop_duplicates(["a", "b"]).sort_values("sim", ascending=False)
    pairs = pairs[pairs.groupby("a").cumcount().to_numpy() < most[pairs["a"].to_numpy(np.int64)]]
    return pd.DataFrame({"a": ids[pairs["a"].to_numpy(np.int64)], "b": ids[pairs["b"].to_numpy(np.int64)], "sim": pairs["sim"]})


def _refine(lists: DataFrame, homes: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """One round: every class introduces its neighbours, in both directions, to one another.

    Work is grouped by blocks of near classes, so that a vector travels once to a block
    however many lists of the block it is on. A class that very many lists name takes
    part with MOST of those, chosen by hash. A list full of links is offered all further
    links, until it has MOST of them.
    """
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    some = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))
    limit = F.when(F.col("sim") >= threshold, MOST).otherwise(NEIGHBOURS)
    back = back.withColumn("r", some).where(F.col("r") <= limit)
    both = lists.select("a", "b").union(back.select("a", "b")).distinct()
    at = stage(both.join(homes.withColumnRenamed("cls", "a"), "a"), "rounds")
    full = (F.col("n") >= NEIGHBOURS) & (F.col("least") >= threshold)
    low = F.when(F.col("n") < NEIGHBOURS, -1.0).when(full & (F.col("n") < MOST), F.lit(threshold)).otherwise(F.col("least"))
    low = lists.groupBy("a").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("cls"), low.alias("low"), F.when(full, MOST).otherwise(PROPOSED).alias("most"))
    near = at.select(F.col("home").alias("to"), F.col("b").alias("cls")).distinct().join(classes.select("cls", "vec").join(low, "cls"), "cls")
    new = at.groupBy("home").cogroup(near.groupBy("to")).applyInPandas(_local_join, "a long, b long, sim double")
    return stage(_nearest(lists.union(new), threshold), "lists")


def _saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """(a): classes whose list has MOST links, so that it may lack some."""
    return lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low")).where((F.col("n") >= MOST) & (F.col("low") >= threshold)).select("a")


def _sample(classes: DataFrame, n: int, seed: int) -> pd.DataFrame:
    """About AUDITED of ``n`` classes, chosen by hash; never more than twice as many."""
    share = int(min(1.0, AUDITED / max(n, 1)) * (1 << 30))
    return classes.where(F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(1 << 30)) < share).select("cls", "space", "vec").limit(2 * AUDITED).toPandas()


def _audit(lists: DataFrame, classes: DataFrame, threshold: float) -> bool:
    """Whether lists hold enough of the links of two samples of classes, found by comparing them with all.

    One sample is of all classes, one of those that have a link, so that sparse data is
    audited by its links too. All links count, except those of classes with a list of MOST links,
    which are compared with all later.
    """
    links = stage(lists.where(F.col("sim") >= threshold).select("a", "b"), "links")
    linked = stage(classes.join(links.select(F.col("a").alias("cls")).distinct(), "cls", "left_semi").select("cls", "space", "vec"), "linked")
    asked = pd.concat([_sample(classes, classes.count(), 3), _sample(linked, linked.count(), 5)]).drop_duplicates("cls")
    groups = {s: (g["cls"].to_numpy(), _unit(g["vec"])) for s, g in asked.groupby("space")} if len(asked) else {}
    shared = classes.sparkSession.sparkContext.broadcast(groups)

    def found(batches):
        for pdf in batches:
            for space, part in pdf.groupby("space"):
                if space in shared.value:
                    ids, x = shared.value[space]
                    own = part["cls"].to_numpy()
                    q, r = np.nonzero(x @ _unit(part["vec"]).T >= threshold)
                    keep = ids[q] != own[r]
                    yield pd.DataFrame({"a": ids[q][keep], "b": own[r][keep]})

    true = classes.select("cls", "space", "vec").mapInPandas(found, "a long, b long")
    true = true.join(_saturated(lists, threshold), "a", "left_anti")
    # A link counts as held by either end's list, as the lists are read in both directions.
    have = links.union(links.select("b", "a")).distinct().withColumn("hit", F.lit(1))
    got = true.join(have, ["a", "b"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return got[0] >= ENOUGH * got[1]


def neighbour_lists(classes: DataFrame, threshold: float, seed: int = 17) -> tuple[DataFrame, bool]:
    """Lists (a, b, sim) of near classes, refined until the audit finds their links complete; and whether it did."""
    placed = stage(_leaves(classes, seed), "leaves")
    groups = ["space", "tree", "leaf", "block"]
    lists = stage(_nearest(placed.groupBy(*groups).applyInPandas(_leaf_lists(threshold), "a long, b long, sim double"), threshold), "lists")
    homes = stage(placed.where("tree = 0").select("cls", F.xxhash64(*groups).alias("home")), "homes")
    for round_ in range(1, MOST_ROUNDS + 1):
        lists = _refine(lists, homes, classes, threshold)
        if round_ >= ROUNDS and _audit(lists, classes, threshold):
            return lists, True
    return lists, False


def _compare_block(threshold: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []})
        own, other = left["component"].to_numpy(), right["component"].to_numpy()
        a, b = left["cls"].to_numpy(), right["cls"].to_numpy()
        near = _unit(left["vec"]) @ _unit(right["vec"]).T >= threshold
        near &= a[:, None] != b[None, :]
        u, w = np.nonzero(near & (own[:, None] != other[None, :]))
        crossing = pd.DataFrame({"a": a[u], "b": b[w], "of": own[u], "to": other[w]}).drop_duplicates(["of", "to"])
        counts = pd.DataFrame({"a": a, "n": near @ right["size"].to_numpy(np.int64)})
        return pd.concat([counts[counts["n"] > 0].assign(b=-1), crossing[["a", "b"]].assign(n=0)])[["a", "b", "n"]]

    return run


def _compare_with_all(asked: DataFrame, whole: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows linked with each class that ``asked`` names, (cls, n), and links (a, b) from them to other components.

    Every block of asked classes meets every block of its space, and gives counts and one
    link for each pair of components, never all pairs.
    """
    left = stage(whole.join(asked.select(F.col("a").alias("cls")), "cls", "left_semi").select("cls", "space", "vec", "component"), "asked")
    n = lambda rows, name: rows.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias(name))
    sizes = stage(n(left, "lefts").join(n(whole, "rights"), "space"), "sizes")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    left = left.join(sizes, "space").select("space", "cls", "vec", "component", own("lefts").alias("p"), every("rights").alias("q"))
    right = whole.join(sizes, "space").select("space", "cls", "vec", "size", "component", own("rights").alias("q"), every("lefts").alias("p"))
    met = left.groupBy("space", "p", "q").cogroup(right.groupBy("space", "p", "q")).applyInPandas(_compare_block(threshold), "a long, b long, n long")
    met = stage(met, "compared")
    counts = met.where("b < 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    return counts, met.where("b >= 0").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Label every vector with its links and its group.

    Takes vec_id, embedding and label (other columns are ignored) and returns one row per
    input row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    of the group) and kept. Rows are linked when their labels are equal and not null, their
    vectors have the same length, and the cosine in double precision is at least
    ``threshold``. Vectors that are null, zero, or hold a null or a component that isn't
    finite are linked with nothing. Rows that repeat a vector are linked with one another,
    whatever their ids. A null vec_id is never a component's id while the group has another.
    An empty table gives no rows; vectors of floats are compared as such, others as doubles.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"), "label")
    usable = F.col("label").isNotNull() & _valid(F.col("vec"))
    rows = stage(rows.select("vec_id", "label", F.when(usable, F.col("vec")).alias("vec")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    key = [F.col("label").alias("label"), F.col("vec").alias("vec")]
    classes = rows.where("vec is not null").groupBy(*key).agg(F.min("row").alias("cls"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("size"))
    classes = stage(classes.withColumn("space", F.xxhash64("label", F.size("vec"))), "classes")

    lists, complete = neighbour_lists(classes, threshold)
    near = stage(lists.where(F.col("sim") >= threshold).select("a", "b"), "links")
    near = stage(near.union(near.select("b", "a")).distinct(), "links")
    grouped = lambda parts: classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # Lists that stay poor are not relied on: all classes are then compared with all of their space.
    full = stage(_saturated(lists, threshold) if complete else classes.select(F.col("cls").alias("a")), "full")
    whole = stage(grouped(connected_components(near)), "whole")
    if not full.isEmpty():
        counted, bridges = _compare_with_all(full, whole, threshold)
        whole = stage(grouped(connected_components(near.union(bridges))), "whole")
    else:
        counted = full.select(F.col("a").alias("cls"), F.lit(0).cast("long").alias("n"))
    sparse = near.join(classes.select(F.col("cls").alias("b"), "size"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("listed"))
    least = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    other = F.coalesce("n", "listed", F.lit(0)) + F.col("size") - 1
    named = whole.join(counted, "cls", "left").join(sparse, "cls", "left").join(stage(least, "least"), "component").select(*key, other.cast("long").alias("links"), "component_id")
    named = stage(named, "named")

    out = rows.join(named, (rows.label == named.label) & (rows.vec == named.vec), "left")
    component = F.when(rows.vec.isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
