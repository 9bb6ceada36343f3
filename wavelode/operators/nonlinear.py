"""Entropy, recurrence, phase-space and fractal features of short series, as Spark plans.

Input is (subject, seq, p), a subject being one window of bounded length with seq from 0
without gaps. Pairs of samples only ever meet inside their window: neighbours and recurrent
pairs in the task that holds the window's vectors as one row, so that no pairs are shuffled;
windows with missing values by an equi-join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import window_kernel
from ..functions.lineage import cut
from .series import ordered

TINY = 1e-12
#: Rows that a task's windows give before they go on.
ROWS = 1 << 16


def embed(df: DataFrame, m: int = 3, tau: int | DataFrame = 1) -> DataFrame:
    """Delay vectors (subject, i, x): x(i), x(i + tau), ... of m values, numbered from 0.

    ``tau`` is one delay, or a table (subject, tau) of each window's own. A window too short
    for a vector has none.
    """
    if isinstance(tau, int):
        w = ordered()
        parts = [F.col("p")] + [F.lead("p", k * tau).over(w) for k in range(1, m)]
        rows = df.select("subject", F.col("seq").alias("i"), *[c.alias(f"_{k}") for k, c in enumerate(parts)])
        return rows.where(F.col(f"_{m - 1}").isNotNull()).select("subject", "i", F.array(*[f"_{k}" for k in range(m)]).alias("x"))
    whole = df.groupBy("subject").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "p"))), lambda v: v["p"]).alias("a"))
    last = F.size("a") - (m - 1) * F.col("tau")
    vectors = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.array(*[F.get("a", (i + k * F.col("tau")).cast("int")) for k in range(m)]))
    rows = whole.join(tau.select("subject", F.col("tau").cast("int").alias("tau")), "subject").where(last > 0)
    return rows.select("subject", F.posexplode(vectors).alias("i", "x")).select("subject", F.col("i").cast("long").alias("i"), "x")


def _pairs(vectors: DataFrame, apart: int = 0, both: bool = False) -> DataFrame:
    """Pairs (subject, i, j, a, b) of a window more than ``apart`` samples from each other."""
    left = vectors.select("subject", "i", F.col("x").alias("a"))
    right = vectors.select("subject", F.col("i").alias("j"), F.col("x").alias("b"))
    far = F.abs(F.col("i") - F.col("j")) > apart if both else F.col("j") - F.col("i") > apart
    return left.join(right, "subject").where(far)


def _distance(m: int):
    """Euclidean distance of vectors a and b of m values."""
    return F.sqrt(sum((F.pow(F.col("a")[k] - F.col("b")[k], F.lit(2.0)) for k in range(m)), F.lit(0.0)))


def _by_window(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subject, v), all vectors of a window in one row, and the vectors of windows where one has a missing value or is missing itself."""
    rows = vectors.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.max("i").alias("_last"), F.bool_or(F.exists("x", lambda c: c.isNull())).alias("_holes"))
    whole = (F.col("_last") + 1 == F.size("v")) & ~F.col("_holes")
    # Written, as it is read for both and for both sides of a join, whose tasks would gather it side by side.
    rows = cut(rows)
    others = rows.where(~whole).select("subject", F.inline("v"))
    return rows.where(whole).select("subject", F.transform("v", lambda r: r["x"]).alias("v")), others


def _gathered(df: DataFrame, *stats) -> DataFrame:
    """Each window as one row: its values in order as the array ``v``, with aggregates of it."""
    held = F.transform(F.sort_array(F.collect_list(F.struct("seq", "p"))), lambda r: r["p"])
    return df.groupBy("subject").agg(held.alias("v"), *stats)


def autocorrelation(df: DataFrame, most: int = 10) -> DataFrame:
    """(subject, lag, acf): mean product of centred values over the population variance."""

    @F.pandas_udf("array<struct<lag: int, acf: double>>")
    def by_lag(v: pd.Series, m: pd.Series, var: pd.Series, n: pd.Series) -> pd.Series:
        def of(values, mean, variance, count):
            c, out = np.asarray(values, float) - mean, []
            for k in range(most + 1):
                products = c[: len(c) - k] * c[k:] if k < len(c) else c[:0]
                products, over = products[~np.isnan(products)], (count - k) * variance
                out.append({"lag": k, "acf": float(products.sum() / over) if len(products) and over else None})
            return out

        return pd.Series([of(*row) for row in zip(v, m.astype(float), var.astype(float), n, strict=True)])

    rows = _gathered(df, F.avg("p").alias("_m"), F.var_pop("p").alias("_v"), F.count("p").alias("_n"))
    return rows.select("subject", F.inline_outer(by_lag("v", "_m", "_v", "_n")))


def tau_from_autocorrelation(acf: DataFrame, threshold: float = math.exp(-1), least: int = 1) -> DataFrame:
    """(subject, tau): first lag at or below the threshold, else the first local minimum, else ``least``."""
    w = Window.partitionBy("subject").orderBy("lag")
    low = (F.col("acf") < F.lag("acf").over(w)) & (F.col("acf") < F.lead("acf").over(w))
    rows = acf.withColumn("_low", low).where("lag >= 1")
    first = rows.groupBy("subject").agg(F.min(F.when(F.col("acf") <= threshold, F.col("lag"))).alias("a"), F.min(F.when(F.col("_low"), F.col("lag"))).alias("b"))
    return first.select("subject", F.greatest(F.coalesce("a", "b", F.lit(least)), F.lit(least)).cast("long").alias("tau"))


def _bin(y: np.ndarray, bins: int) -> np.ndarray:
    """Equal-width bins over the values' own range, the last one closed; missing values are in the first."""
    known = y[~np.isnan(y)]
    span = known.max() - known.min() if len(known) else 0.0
    if not span > 0:
        return np.zeros(len(y), np.int64)
    at = np.minimum(np.floor((y - known.min()) / span * bins), bins - 1)
    return np.where(np.isnan(at), 0, at).astype(np.int64)


def _entropy(bins: np.ndarray) -> float:
    # Sorted, so that equal counts give equal sums.
    counts = np.sort(np.bincount(bins))
    p = counts[counts > 0] / len(bins)
    return float(-(p * np.log(p + TINY)).sum())


def mutual_information(df: DataFrame, most: int = 5) -> DataFrame:
    """(subject, lag, ami): entropies of both sub-series less their joint entropy, each binned over its own range.

    Bins follow the Freedman-Diaconis width, 8 to 64 of them. All lags of a window are counted
    in the task that has its values as one row.
    """

    @F.pandas_udf("array<struct<lag: int, ami: double>>")
    def by_lag(v: pd.Series, bins: pd.Series) -> pd.Series:
        def of(values, many):
            x, out = np.asarray(values, float), []
            for k in range(1, min(most, len(x) - 1) + 1):
                both = ~np.isnan(x[k:])
                if both.any():
                    a, b = _bin(x[:-k][both], many), _bin(x[k:][both], many)
                    out.append({"lag": k, "ami": _entropy(a) + _entropy(b) - _entropy(a * many + b)})
            return out

        return pd.Series([of(*row) for row in zip(v, bins, strict=True)])

    rows = _gathered(df, F.percentile("p", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("p").alias("n"))
    width = 2 * (F.col("q")[1] - F.col("q")[0]) / (F.pow(F.col("n").cast("double"), F.lit(1 / 3)) + TINY)
    bins = F.when(width <= TINY, F.floor(F.sqrt("n"))).otherwise(F.ceil((F.col("hi") - F.col("lo")) / width))
    rows = rows.select("subject", "v", F.least(F.greatest(F.coalesce(bins, F.lit(8)), F.lit(8)), F.lit(64)).cast("int").alias("bins"))
    # The outer form, as the plain one would have every window counted twice.
    return rows.select("subject", F.inline_outer(by_lag("v", "bins"))).where("lag is not null")


def sample_entropy(df: DataFrame, m: int = 2, r: float = 0.2) -> DataFrame:
    """(subject, sampen): -ln of the share of matches of m + 1 values over that of m values.

    Values match within r standard deviations in each place; both lengths are counted over
    all their own templates. A constant window has 0.
    """
    w = ordered()
    stat = df.groupBy("subject").agg((r * F.stddev_pop("p")).alias("r"), F.count("p").alias("n"))
    rows = df.select("subject", F.col("seq").alias("i"), F.array("p", *[F.lead("p", k).over(w) for k in range(1, m + 1)]).alias("x"))
    rows = rows.where(F.col("x")[m - 1].isNotNull())
    pairs = _pairs(rows).join(stat, "subject")
    near = lambda k: F.abs(F.col("a")[k] - F.col("b")[k]) <= F.col("r")
    short = near(0)
    for k in range(1, m):
        short = short & near(k)
    counts = pairs.groupBy("subject").agg(F.count_if(short).alias("b"), F.count_if(short & near(m)).alias("a"))
    nb, na = F.col("n") - m + 1, F.col("n") - m
    ratio = F.try_divide(F.col("a") / (na * (na - 1) / 2), F.col("b") / (nb * (nb - 1) / 2))
    return stat.join(counts, "subject").select("subject", F.when(F.col("r") <= TINY, 0.0).otherwise(-F.log(ratio + TINY)).alias("sampen"))


def permutation_entropy(df: DataFrame, delay: int = 1) -> DataFrame:
    """(subject, permen): entropy of the order of three values, over ln 6; ties keep their place."""
    rows = embed(df, 3, delay).select("subject", (F.col("x")[0] <= F.col("x")[1]).alias("u"), (F.col("x")[0] <= F.col("x")[2]).alias("v"), (F.col("x")[1] <= F.col("x")[2]).alias("w"))
    counts = rows.groupBy("subject", "u", "v", "w").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("subject"))
    return counts.withColumn("q", p).groupBy("subject").agg((-F.sum(F.col("q") * F.log(F.col("q") + TINY)) / math.log(6)).alias("permen"))


def _by_task(whole: DataFrame, fields: dict[str, str], of, *own: str) -> DataFrame:
    """Rows (subject, fields) of windows given as (subject, v); ``of`` a window's vectors, and its value in a column ``own``, gives their columns.

    Windows are measured one by one, and rows go on before they are more than ``ROWS`` and one window's.
    """
    types = T.StructType([whole.schema["subject"], *[T.StructField(c, T.LongType() if kind == "long" else T.DoubleType()) for c, kind in fields.items()]])
    names = list(fields)

    def run(batches):
        for batch in batches:
            subjects, v, rest = batch.column(0), batch.column(1), [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
            ends = np.cumsum(np.r_[0, v.value_lengths().to_numpy(zero_copy_only=False)])
            values = np.asarray(v.flatten().flatten().to_numpy(zero_copy_only=False), float)
            values = values.reshape(ends[-1], -1) if ends[-1] else values.reshape(0, 1)
            rows, many = [], 0

            def made(held):
                at = np.concatenate([np.full(len(c[0]), i) for i, c in held])
                columns = [pa.concat_arrays([c[k] for _, c in held]) for k in range(len(names))]
                return pa.RecordBatch.from_arrays([subjects.take(pa.array(at)), *columns], ["subject", *names])

            for i in range(len(v)):
                columns = of(values[ends[i] : ends[i + 1]], *[c[i] for c in rest])
                if columns and len(columns[0]):
                    rows.append((i, columns))
                    many += len(columns[0])
                if many >= ROWS:
                    yield made(rows)
                    rows, many = [], 0
            if rows:
                yield made(rows)

    return whole.select("subject", "v", *own).mapInArrow(run, types)


def _near_pairs(vectors: DataFrame, m: int, rate: float, theiler: int) -> DataFrame:
    """``recurrence`` of windows with missing values, by a join."""
    pairs = _pairs(vectors, theiler, both=True).select("subject", "i", "j", _distance(m).alias("d"))
    eps = pairs.groupBy("subject").agg(F.percentile("d", rate).alias("epsilon"))
    n = vectors.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(eps.join(n, "subject"), "subject").where("d <= epsilon").select("subject", "i", "j", "epsilon", "n")


def recurrence(df: DataFrame, m: int = 3, tau: int = 1, rate: float = 0.05, theiler: int = 1) -> DataFrame:
    """Recurrent pairs (subject, i, j, epsilon, n): nearer than the ``rate`` quantile of all pairs outside the Theiler band."""

    def near(x: np.ndarray) -> list[pa.Array]:
        held = window_kernel.held_distances(x)
        epsilon = window_kernel.distance_quantile(x, rate, theiler, held)
        i, j = window_kernel.recurrent_pairs(x, epsilon, theiler, held)
        many = 2 * len(i)
        return [pa.array(np.r_[i, j], pa.int64()), pa.array(np.r_[j, i], pa.int64()), pa.array(np.full(many, epsilon)), pa.array(np.full(many, len(x)), pa.int64())]

    whole, vectors = _by_window(embed(df, m, tau))
    return _by_task(whole, {"i": "long", "j": "long", "epsilon": "double", "n": "long"}, near).unionByName(_near_pairs(vectors, m, rate, theiler))


#: Columns of ``rqa``.
RQA = {"rr": "double", "det": "double", "lam": "double", "l_mean": "double", "l_max": "long", "tt": "double", "epsilon": "double"}


def recurrence_measures(df: DataFrame, m: int = 3, tau: int = 1, rate: float = 0.05, theiler: int = 1, least: int = 2) -> DataFrame:
    """``rqa`` of the ``recurrence`` of every window, measured in the task that has its vectors, so that no pairs leave it."""

    def of(x: np.ndarray) -> list[pa.Array] | None:
        found = window_kernel.rqa(x, rate, theiler, least, window_kernel.held_distances(x))
        if not found:
            return None
        return [pa.array([None if found[c] is None else int(found[c]) if kind == "long" else float(found[c])], pa.int64() if kind == "long" else pa.float64()) for c, kind in RQA.items()]

    whole, vectors = _by_window(embed(df, m, tau))
    return _by_task(whole, RQA, of).unionByName(rqa(_near_pairs(vectors, m, rate, theiler), least))


def line_lengths(edges: DataFrame, direction: str = "diagonal", least: int = 2) -> DataFrame:
    """Lengths of diagonal or vertical lines of recurrent pairs, one row per line."""
    line = (F.col("j") - F.col("i")) if direction == "diagonal" else F.col("j")
    rows = edges.select("subject", "i", line.alias("line"))
    run = F.col("i") - F.row_number().over(Window.partitionBy("subject", "line").orderBy("i"))
    return rows.withColumn("run", run).groupBy("subject", "line", "run").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)


def rqa(edges: DataFrame, least: int = 2) -> DataFrame:
    """Recurrence rate, determinism, laminarity, line means and maximum for each window."""
    total = edges.groupBy("subject").agg(F.count(F.lit(1)).alias("r"), F.first("n").alias("n"), F.first("epsilon").alias("epsilon"))
    lines = lambda d, p: line_lengths(edges, d, least).groupBy("subject").agg(F.sum("length").alias(f"{p}s"), F.avg("length").alias(f"{p}m"), F.max("length").alias(f"{p}x"))
    rows = total.join(lines("diagonal", "d"), "subject", "left").join(lines("vertical", "v"), "subject", "left")
    share = lambda c: F.coalesce(c, F.lit(0)) / (F.col("r") + TINY)
    return rows.select(
        "subject", (F.col("r") / (F.col("n") * F.col("n") - F.col("n") + TINY)).alias("rr"), share(F.col("ds")).alias("det"), share(F.col("vs")).alias("lam"),
        F.col("dm").alias("l_mean"), F.col("dx").alias("l_max"), F.col("vm").alias("tt"), "epsilon",
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _spectrum(cov: pd.Series) -> pd.Series:
    """Eigenvalues of flattened symmetric matrices, largest first."""
    out = []
    for c in cov:
        k = math.isqrt(len(c))
        out.append(np.linalg.eigvalsh(np.asarray(c, float).reshape(k, k))[::-1].tolist() if np.isfinite(np.asarray(c, float)).all() else [None] * k)
    return pd.Series(out)


def geometry(df: DataFrame, m: int = 2, tau: int = 1) -> DataFrame:
    """Step lengths, spread and covariance spectrum of the trajectory in ``m`` dimensions, 2 or more.

    A window with fewer than two vectors has null for its spectrum.
    """
    w = ordered()
    x = [F.col("x")[k] for k in range(m)]
    v = embed(df, m, tau).select("subject", F.col("i").alias("seq"), *[c.alias(f"x{k}") for k, c in enumerate(x)])
    far = lambda parts: F.sqrt(sum((F.pow(c, F.lit(2.0)) for c in parts), F.lit(0.0)))
    mid = v.groupBy("subject").agg(*[F.avg(f"x{k}").alias(f"m{k}") for k in range(m)])
    v = v.withColumn("step", far([F.col(f"x{k}") - F.lag(f"x{k}").over(w) for k in range(m)])).join(mid, "subject")
    cov = F.array(*[F.coalesce(F.covar_samp(f"x{min(i, j)}", f"x{max(i, j)}"), F.lit(float("nan"))) for i in range(m) for j in range(m)])
    rows = v.groupBy("subject").agg(
        F.sum("step").alias("trajectory_length"), F.avg("step").alias("mean_step"), F.stddev_pop("step").alias("step_std"), F.avg(far([F.col(f"x{k}") - F.col(f"m{k}") for k in range(m)])).alias("state_spread"), cov.alias("cov"),
    )
    if m == 2:
        c = lambda k: F.col("cov")[k]
        half, root = (c(0) + c(3)) / 2, F.sqrt(F.pow((c(0) - c(3)) / 2, F.lit(2.0)) + F.pow(c(1), F.lit(2.0)))
        spectrum = F.array(half + root, half - root)
    else:
        spectrum = _spectrum("cov")
    value = lambda k: F.when(~F.isnan(F.col("e")[k]), F.greatest(F.col("e")[k], F.lit(TINY)))
    rows = rows.withColumn("e", spectrum).withColumn("eig1", value(0)).withColumn("eig2", value(1))
    volume = sum((F.log(value(k)) for k in range(m)), F.lit(0.0))
    return rows.withColumn("eig_ratio", F.col("eig1") / (F.col("eig2") + TINY)).withColumn("log_volume", volume).drop("cov", "e")


def higuchi(df: DataFrame, kmax: int = 10) -> DataFrame:
    """(subject, hfd): slope of ln curve length over ln of the inverse step."""
    w = ordered()
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.abs(F.col("p") - F.lag("p", k).over(w)).alias("d")) for k in range(1, kmax + 1)])
    n = F.count(F.lit(1)).over(Window.partitionBy("subject"))
    rows = df.withColumn("n", n).withColumn("_s", steps).select("subject", "seq", "n", F.explode("_s").alias("s")).select("subject", "n", F.col("s.k").alias("k"), (F.col("seq") % F.col("s.k")).alias("m"), F.col("s.d").alias("d"))
    per = rows.groupBy("subject", "n", "k", "m").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("c")).where("c >= 2")
    per = per.select("subject", "k", (F.col("d") * ((F.col("n") - 1) / (F.col("c") * F.col("k"))) / F.col("k")).alias("l"))
    mean = per.groupBy("subject", "k").agg(F.avg("l").alias("l")).where("l > 0")
    return mean.groupBy("subject").agg(F.regr_slope(F.log("l"), F.log(1.0 / F.col("k"))).alias("hfd"))


def fractals(df: DataFrame) -> DataFrame:
    """Katz and Petrosian dimensions: kfd, null without change, and pfd, 1 without turns."""
    w = ordered()
    d = F.col("p") - F.lag("p").over(w)
    first = F.first("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("d", d).withColumn("far", F.abs(F.col("p") - first)).withColumn("turn", F.col("d") * F.lag("d").over(w) < 0)
    s = rows.groupBy("subject").agg(F.sum(F.abs("d")).alias("l"), F.max("far").alias("far"), F.count(F.lit(1)).alias("n"), F.count_if("turn").alias("turns"))
    log_n = F.log10("n")
    kfd = F.when((F.col("l") > TINY) & (F.col("far") > TINY), log_n / (F.log10(F.col("far") / F.col("l")) + log_n))
    pfd = F.when(F.col("turns") == 0, 1.0).otherwise(log_n / (log_n + F.log10(F.col("n") / (F.col("n") + 0.4 * F.col("turns")))))
    return s.select("subject", kfd.alias("kfd"), pfd.alias("pfd"))


def basic(df: DataFrame) -> DataFrame:
    """Moments, quantiles and differences of each window; skewness and kurtosis are the unbiased ones, a normal's kurtosis 3."""
    d = df.withColumn("d", F.col("p") - F.lag("p").over(ordered()))
    mid = d.groupBy("subject").agg(F.percentile("d", 0.5).alias("md"))
    d = d.join(mid, "subject")
    n, g1, g2 = F.col("n").cast("double"), F.col("g1"), F.col("g2")
    rows = d.groupBy("subject").agg(
        F.count("p").alias("n"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.percentile("p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min("p").alias("min"), F.max("p").alias("max"),
        F.skewness("p").alias("g1"), F.kurtosis("p").alias("g2"), (F.percentile(F.abs(F.col("d") - F.col("md")), 0.5) * 1.4826).alias("diff_mad"), F.sum(F.col("d") * F.col("d")).alias("diff_energy"),
    )
    skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3
    q = F.col("q")
    return rows.where("n > 3").select("subject", "mean", "std", q[1].alias("median"), (q[2] - q[0]).alias("iqr"), "min", "max", (F.col("max") - F.col("min")).alias("range"), skew.alias("skewness"), kurt.alias("kurtosis"), "diff_mad", "diff_energy")


def nearest(vectors: DataFrame, m: int, theiler: int | DataFrame, cap: int) -> DataFrame:
    """(subject, i, j, d): nearest vector by the first ``m`` values outside the Theiler band, among the ``cap`` nearest, itself included.

    The band is one number, or a table (subject, tau). Distances that tie go to the earlier vector.
    """

    def near(x: np.ndarray, theiler: int) -> list[pa.Array]:
        x = x[:, :m]
        i, j, d = window_kernel.nearest(x, int(theiler), cap, window_kernel.held_distances(x))
        return [pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(d, pa.float64())]

    whole, vectors = _by_window(vectors)
    whole = whole.withColumn("tau", F.lit(theiler)) if isinstance(theiler, int) else whole.join(theiler, "subject")
    found = _by_task(whole, {"i": "long", "j": "long", "d": "double"}, near, "tau")
    pairs = _pairs(vectors, -1, both=True).select("subject", "i", "j", _distance(m).alias("d"))
    apart = F.abs(F.col("i") - F.col("j"))
    rank = F.row_number().over(Window.partitionBy("subject", "i").orderBy("d", apart, "j"))
    near_ = pairs.withColumn("r", rank).where(F.col("r") <= cap)
    near_ = near_.where(apart > theiler) if isinstance(theiler, int) else near_.join(theiler, "subject").where(apart > F.col("tau"))
    best = near_.groupBy("subject", "i").agg(F.min(F.struct("r", "j", "d")).alias("b"))
    return found.unionByName(best.select("subject", "i", F.col("b.j").alias("j"), F.col("b.d").alias("d")))


def false_neighbours(df: DataFrame, m: int = 2, tau: int | DataFrame = 1, rtol: float = 10.0, atol: float = 2.0, cap: int = 20, least: int = 10) -> DataFrame:
    """(subject, m, fnn): share of nearest neighbours in m dimensions that part in m + 1.

    Null where fewer than ``least`` vectors have m + 1 values.
    """
    longer = embed(df, m + 1, tau)
    near = nearest(longer, m, tau, cap).withColumn("d", F.greatest("d", F.lit(TINY)))
    sigma = df.groupBy("subject").agg((F.stddev_pop("p") + TINY).alias("sigma"))
    size = longer.groupBy("subject").agg(F.count(F.lit(1)).alias("_n"))
    rows = near.join(longer.select("subject", "i", F.col("x").alias("a")), ["subject", "i"]).join(longer.select("subject", F.col("i").alias("j"), F.col("x").alias("b")), ["subject", "j"]).join(sigma, "subject")
    parts = (F.abs(F.col("a")[m] - F.col("b")[m]) / F.col("d") > rtol) | (_distance(m + 1) / F.col("sigma") > atol)
    share = rows.groupBy("subject").agg(F.avg(parts.cast("double")).alias("fnn")).join(size, "subject")
    return share.select("subject", F.lit(m).alias("m"), F.when(F.col("_n") >= least, F.col("fnn")).alias("fnn"))


def embedding_dimension(df: DataFrame, tau: int | DataFrame = 1, most: int = 8, threshold: float = 0.05) -> DataFrame:
    """(subject, m): the first dimension with few enough false neighbours, else the one with the fewest, 3 where none is known."""
    found = None
    for m in range(1, most + 1):
        part = false_neighbours(df, m, tau)
        found = part if found is None else found.union(part)
    n = df.groupBy("subject").agg(F.count("p").alias("_n"))
    step = F.lit(tau) if isinstance(tau, int) else F.col("tau")
    n = n if isinstance(tau, int) else n.join(tau, "subject")
    # Short windows have fewer dimensions to choose from.
    limit = F.when(F.col("_n") < (most + 2) * step + 10, F.greatest(F.lit(2), F.floor((F.col("_n") - 10) / F.greatest(step, F.lit(1))) - 1)).otherwise(most)
    rows = n.withColumn("_most", limit).join(found, "subject", "left").where("m is null or m <= _most")
    first, fewest = F.min(F.when(F.col("fnn") <= threshold, F.col("m"))), F.min(F.when(F.col("fnn").isNotNull(), F.struct("fnn", "m")))["m"]
    return n.select("subject").join(rows.groupBy("subject").agg(F.coalesce(first, fewest, F.lit(3)).alias("m")), "subject", "left").select("subject", F.coalesce("m", F.lit(3)).alias("m"))


def tau_from_mutual_information(ami: DataFrame, fallback: DataFrame, least: int = 1) -> DataFrame:
    """(subject, tau): lag of the first local minimum of the mutual information (subject, lag, ami), else that of ``fallback``.

    The lag before a minimum must be ``least`` at least, and five lags must be known.
    """
    w = Window.partitionBy("subject").orderBy("lag")
    rows = ami.where(F.col("lag") >= least)
    low = (F.col("ami") < F.lag("ami").over(w)) & (F.col("ami") < F.lead("ami").over(w))
    first = rows.withColumn("_low", low).groupBy("subject").agg(F.min(F.when(F.col("_low"), F.col("lag"))).alias("_a"), F.count("ami").alias("_n"))
    return fallback.join(first, "subject", "left").select("subject", F.coalesce(F.when(F.col("_n") >= 5, F.col("_a")), F.col("tau")).cast("long").alias("tau"))


def embedding_parameters(df: DataFrame, by: str = "ami", most_tau: int = 120, most_dim: int = 8, least: int = 100, threshold: float = 0.05) -> DataFrame:
    """(subject, tau, m) of every window: delay by mutual information or autocorrelation, dimension by false neighbours.

    Delays go up to a tenth of the window. A window that is short or constant has 1 and 3.
    """
    stat = df.groupBy("subject").agg(F.count("p").alias("_n"), F.stddev_pop("p").alias("_s"))
    stat = cut(stat.withColumn("_most", F.least(F.lit(most_tau), F.greatest(F.lit(2), F.floor(F.col("_n") / 10)))))
    longest = stat.agg(F.max("_most")).first()[0] or 2
    usable = stat.where((F.col("_n") >= least) & (F.col("_s") >= TINY))
    rows = df.join(usable.select("subject", "_most"), "subject")
    series = rows.drop("_most")
    within = lambda table: table.join(usable.select("subject", "_most"), "subject").where(F.col("lag") <= F.col("_most")).drop("_most")
    tau = tau_from_autocorrelation(within(autocorrelation(series, longest)))
    if by == "ami":
        tau = tau_from_mutual_information(within(mutual_information(series, longest)), tau)
    elif by != "autocorr":
        raise ValueError("by must be ami or autocorr")
    tau = cut(tau)
    found = tau.join(embedding_dimension(series, tau, most_dim, threshold), "subject")
    return stat.select("subject").join(found, "subject", "left").select("subject", F.coalesce("tau", F.lit(1)).cast("long").alias("tau"), F.coalesce("m", F.lit(3)).cast("long").alias("m"))


def divergence(df: DataFrame, m: int = 3, tau: int = 1, theiler: int = 5, horizon: int = 10, cap: int = 30, start: int = 1) -> DataFrame:
    """(subject, lle): slope of the mean log distance of nearest neighbours as both move on."""
    vectors = embed(df, m, tau)
    last = vectors.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    pairs = nearest(vectors, m, theiler, cap).join(last, "subject").where((F.col("i") + horizon < F.col("n")) & (F.col("j") + horizon < F.col("n")))
    moved = pairs.select("subject", "i", "j", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("k")).select("subject", "k", (F.col("i") + F.col("k")).alias("i"), (F.col("j") + F.col("k")).alias("j"))
    moved = moved.join(vectors.select("subject", "i", F.col("x").alias("a")), ["subject", "i"]).join(vectors.select("subject", F.col("i").alias("j"), F.col("x").alias("b")), ["subject", "j"])
    mean = moved.withColumn("d", _distance(m)).where(F.col("d") > TINY).groupBy("subject", "k").agg(F.avg(F.log("d")).alias("y"), F.count(F.lit(1)).alias("c")).where("c >= 5")
    until = min(horizon, max(start + 5, horizon // 2))
    return mean.where((F.col("k") >= start) & (F.col("k") < until)).groupBy("subject").agg(F.when(F.count(F.lit(1)) >= 3, F.regr_slope("y", F.col("k").cast("double"))).alias("lle"))
