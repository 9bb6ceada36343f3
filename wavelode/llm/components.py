"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (a, b): neighbours move to the smallest node of their star.

    The larger step looks at all neighbours and moves those above the centre; the smaller
    step looks at neighbours below the centre and moves the centre with them.
    """
    both = edges
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join deals both sides itself and Spark can split a node of very many edges.
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        moved = both.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Component of every node that has an edge: rows (node, component).

    ``edges`` has two long columns (a, b); direction, repeats and loops are ignored.
    ``component`` is the smallest node reachable. Every round is written to the shared
    folder, so neither the lineage nor the driver grows with the graph; stars meet only as
    minima, which are aggregated before the shuffle, and equi-joins, of which those over all neighbours can be split.
    """
    a, b = edges.columns[:2]
    now = stage(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = stage(_contract(_contract(now, True), False), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
