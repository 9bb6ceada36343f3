"""Two-sample statistics over long tables (feature, grp, value): grp 1 against grp 0.

Ranks come from counts of distinct values, dealt over all tasks by ranges of the value:
nothing compares every value with every other, and no group is ranked in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.lineage import cut

TINY = 1e-12


def counts_before(df: DataFrame, value: str, by: tuple[str, ...], **counted) -> DataFrame:
    """One row per distinct value of a group: how many rows meet each condition, and how many of the group's smaller values do.

    ``counted`` names conditions; ``x`` gives columns x and before_x. Distinct values are
    counted before they move, ranges of them are added up side by side, and a table of
    one row per group and range carries the sums on.
    """
    names = list(counted)
    rows = df.groupBy(*by, value).agg(*[F.count_if(c).cast("double").alias(n) for n, c in counted.items()])
    rows = cut(rows.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    over = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranges = rows.groupBy(*by, "_part").agg(*[F.sum(n).alias(n) for n in names])
    earlier = ranges.select(*by, "_part", *[over(Window.partitionBy(*by).orderBy("_part"), n).alias(f"_{n}") for n in names])
    inside = Window.partitionBy(*by, "_part").orderBy(value)
    rows = rows.select("*", *[over(inside, n).alias(f"before_{n}") for n in names]).join(earlier, [*by, "_part"])
    return rows.select(*by, value, *names, *[(F.col(f"before_{n}") + F.col(f"_{n}")).alias(f"before_{n}") for n in names])


def average_rank(df: DataFrame, value: str, *by: str, out: str = "rank") -> DataFrame:
    """Add ranks from 1 in which equal values share their mean rank, and ties, how many share it; nulls have none."""
    ranks = counts_before(df.where(F.col(value).isNotNull()), value, by, n=F.lit(True))
    ranks = ranks.select(*by, value, F.col("n").cast("long").alias("ties"), (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value], "left")


def _moments(df: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    one = lambda g, c: F.when(F.col("grp") == g, F.col(c))
    parts = [f(one(g, "value")).alias(f"{n}{g}") for g in (1, 0) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp), ("median", F.median))]
    return df.where("value is not null").groupBy(*by).agg(*parts)


def cohens_d(df: DataFrame, floor: bool = False, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Mean difference over the pooled deviation: null without variation, or floored at 1e-12 where asked."""
    m = _moments(df, by)
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0")) / (F.col("n1") + F.col("n0") - 2)
    d = (F.col("mean1") - F.col("mean0")) / (F.sqrt(pooled + TINY) if floor else F.sqrt(pooled))
    return m.select(*by, (d if floor else F.when(pooled > TINY * TINY, d)).alias("cohens_d"))


def rank_sums(df: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by, n1, n0, u, delta, z): Mann-Whitney U of group 1, Cliff's delta, and z with continuity and tie correction."""
    rows = counts_before(df.where("value is not null and grp in (0, 1)"), "value", by, a=F.col("grp") == 1, b=F.col("grp") == 0)
    size = F.col("a") + F.col("b")
    rank = F.col("before_a") + F.col("before_b") + (size + 1) / 2
    s = rows.groupBy(*by).agg(F.sum("a").cast("long").alias("n1"), F.sum("b").cast("long").alias("n0"), F.sum(F.when(F.col("a") > 0, F.col("a") * rank)).alias("r1"), F.sum(size * (size * size - 1)).alias("tied"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sigma = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("tied"), n * (n - 1))))
    top = F.greatest(F.col("u"), n1 * n0 - F.col("u"))
    z = F.try_divide(top - n1 * n0 / 2 - 0.5, sigma)
    return s.select(*by, "n1", "n0", "u", (F.try_divide(2 * F.col("u"), n1 * n0) - 1).alias("delta"), z.alias("z"), (F.col("tied") > 0).alias("has_ties"))


def welch(df: DataFrame) -> DataFrame:
    """(feature, t, df): Welch's statistic and degrees of freedom."""
    m = _moments(df)
    a, b = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    t = F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    return m.select("feature", t.alias("t"), dof.alias("df"))


@F.pandas_udf(T.DoubleType())
def welch_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([kernels.t_two_sided(a, b) if a == a and b == b else None for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n0: pd.Series, z: pd.Series, has_ties: pd.Series) -> pd.Series:
    """Exact for up to 8 values in a group without ties, else normal."""
    out = []
    for a, b, c, d, tied in zip(u, n1, n0, z, has_ties, strict=True):
        if not b or not c:
            out.append(None)
        elif not tied and min(b, c) <= 8:
            out.append(kernels.exact_rank_sum(a, int(b), int(c)))
        else:
            out.append(min(1.0, kernels.normal_two_sided(max(d, 0.0))) if d == d else None)
    return pd.Series(out, dtype="float64")


def benjamini_hochberg(df: DataFrame, p: str = "p", *by: str, out: str = "fdr_q") -> DataFrame:
    """Add q values: smallest p m / rank from the rank on, at most 1; a null p stays out and has none."""
    known = F.col(p).isNotNull()
    group = Window.partitionBy(*by, known)
    order = group.orderBy(p)
    df = df.withColumn("_r", F.rank().over(order) + F.count(F.lit(1)).over(Window.partitionBy(*by, known, p)) - 1).withColumn("_m", F.count(p).over(group))
    q = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(group.orderBy(F.col("_r").desc()).rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(known, F.least(q, F.lit(1.0)))).drop("_r", "_m")


def compare(df: DataFrame, least: int = 3) -> DataFrame:
    """All of the above for every feature, strongest effect first; tests need ``least`` values in both groups."""
    m = _moments(df)
    rows = m.join(rank_sums(df).drop("n1", "n0"), "feature").join(cohens_d(df), "feature").join(welch(df), "feature")
    enough = (F.col("n1") >= least) & (F.col("n0") >= least)
    gated = lambda c: F.when(enough, c)
    rows = rows.select(
        "feature", "n1", "n0", "mean1", "mean0", "median1", "median0", F.sqrt("var1").alias("std1"), F.sqrt("var0").alias("std0"), (F.col("mean1") - F.col("mean0")).alias("mean_diff"),
        gated(F.col("cohens_d")).alias("cohens_d"), gated(F.col("delta")).alias("cliffs_delta"), gated(F.col("z")).alias("z"), gated(F.col("t")).alias("t"), gated(F.col("df")).alias("df"), "u", "has_ties",
    )
    return rows.withColumn("abs_delta", F.abs("cliffs_delta")).withColumn("abs_d", F.abs("cohens_d"))


def compare_with_p(df: DataFrame, least: int = 3) -> DataFrame:
    """``compare`` with probabilities and q values, in order of effect."""
    rows = compare(df, least)
    rows = rows.withColumn("p", F.when(F.col("z").isNotNull(), rank_sum_p("u", "n1", "n0", "z", "has_ties"))).withColumn("p_t", F.when(F.col("t").isNotNull(), welch_p("t", "df")))
    return benjamini_hochberg(rows).orderBy(F.col("abs_delta").desc_nulls_last(), F.col("abs_d").desc_nulls_last(), "feature")


def balanced_sample(event: DataFrame, fixed: DataFrame, key: str, n_event: int | None = None) -> DataFrame:
    """Both kinds of windows, the fixed ones cut to as many as the event ones if they are more, in hash order.

    Counts of the hash's ranges say which range holds the last row: those before it stay as they
    are, and only its own rows are ordered, so no task gets all that are chosen.
    """
    n = n_event if n_event is not None else event.count()
    hashed = fixed.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.coalesce(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), F.lit(-1)))
    upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    # At most 65,537 rows.
    ranges = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", upto).select("_b", (F.lit(n) - F.col("_upto") + F.col("_n")).alias("_room"), "_n").where("_room > 0")
    rows = hashed.join(F.broadcast(ranges), "_b")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    last = rows.where(F.col("_n") > F.col("_room")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_room"))
    chosen = rows.where(F.col("_n") <= F.col("_room")).select(*fixed.columns).unionByName(last.select(*fixed.columns))
    return event.unionByName(chosen, allowMissingColumns=True)


def two_sided_normal(z: Column) -> Column:
    """Probability that a standard normal value is as far from 0 as ``z``.

    The error function by its series of positive terms up to 2 root 2, its complement by the continued fraction
    beyond, so small probabilities keep their digits.
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    root_pi = math.sqrt(math.pi)
    start = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda a, n: F.struct((a["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    near = 1 - 2 / root_pi * F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)["sum"]
    far = F.exp(-x * x) / (root_pi * F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda a, n: x + n / 2 / a))
    return F.when(x < 2, near).when(x >= 2, far)


def _placements(scores: DataFrame) -> DataFrame:
    """(id, y, model, v) of scores (id, y, model, s): the share of the other label's scores on the wrong side, those that tie counting half."""
    known = scores.where("s is not null and y in (0, 1)")
    below = counts_before(known, "s", ("model",), a=F.col("y") == 1, b=F.col("y") == 0)
    size = known.groupBy("model").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    # One row a model.
    place = known.join(below, ["model", "s"]).join(F.broadcast(size), "model")
    under = lambda n: F.col(f"before_{n}") + F.col(n) / 2
    return place.select("id", "y", "model", F.when(F.col("y") == 1, F.try_divide(under("b"), F.col("n0"))).otherwise(1 - F.try_divide(under("a"), F.col("n1"))).alias("v"))


def auc_covariance(scores: DataFrame) -> DataFrame:
    """Areas under the curve of several models over the same rows, and their covariance: a row for each two models.

    ``scores`` is (id, y, model, s), a row for each id and model. Returns a and b (models, a <= b),
    auc_a, auc_b, cov, diff, z and p; a model with itself has its variance in cov and no z.
    Placements of the models meet by id, and the sums of products are added up before they move.
    """
    rows = _placements(scores).groupBy("id", "y").agg(F.sort_array(F.collect_list(F.struct("model", "v"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["model"] >= a["model"]), lambda b: F.struct(a["model"].alias("a"), b["model"].alias("b"), a["v"].alias("va"), b["v"].alias("vb")))))
    pairs = rows.select("y", F.inline(pairs))
    of = lambda label, c: F.when(F.col("y") == label, F.col(c))
    size = lambda label: F.count(of(label, "va"))
    cov = lambda x, y: F.try_divide(F.covar_samp(of(1, x), of(1, y)), size(1)) + F.try_divide(F.covar_samp(of(0, x), of(0, y)), size(0))
    out = pairs.groupBy("a", "b").agg(F.avg(of(1, "va")).alias("auc_a"), F.avg(of(1, "vb")).alias("auc_b"), cov("va", "vb").alias("cov"), (cov("va", "va") + cov("vb", "vb") - 2 * cov("va", "vb")).alias("_var"))
    diff = F.col("auc_a") - F.col("auc_b")
    out = out.withColumn("diff", diff).withColumn("z", F.when(F.col("a") != F.col("b"), F.try_divide(diff, F.sqrt(F.greatest("_var", F.lit(0.0))))))
    return out.drop("_var").withColumn("p", two_sided_normal(F.col("z")))


def delong(scores: DataFrame) -> DataFrame:
    """Paired comparison of two scores (id, y, s1, s2) by area under the curve: auc1, auc2, diff, z and the two-sided p.

    A positive's placement is the share of negatives below its score, those at it counting
    half; a negative's is the share of positives above it.
    """
    long = scores.select("id", "y", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("s1").alias("s")), F.struct(F.lit(2).alias("k"), F.col("s2").alias("s")))).alias("e")).select("id", "y", "e.k", "e.s")
    below = counts_before(long.where("s is not null"), "s", ("k",), a=F.col("y") == 1, b=F.col("y") == 0)
    size = scores.agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    place = long.join(below, ["k", "s"]).crossJoin(F.broadcast(size))
    under = lambda n: F.col(f"before_{n}") + F.col(n) / 2
    place = place.withColumn("v", F.when(F.col("y") == 1, under("b") / F.col("n0")).otherwise(1 - under("a") / F.col("n1")))
    wide = place.groupBy("id", "y", "n1", "n0").agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("v1"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias("v2"))
    pos = lambda c: F.when(F.col("y") == 1, F.col(c))
    neg = lambda c: F.when(F.col("y") == 0, F.col(c))
    s = wide.groupBy("n1", "n0").agg(F.avg(pos("v1")).alias("auc1"), F.avg(pos("v2")).alias("auc2"), F.var_samp(pos("v1") - pos("v2")).alias("a"), F.var_samp(neg("v1") - neg("v2")).alias("b"))
    # Variance of the difference: both groups' variances of the paired difference of placements.
    out = s.select("auc1", "auc2", (F.col("auc1") - F.col("auc2")).alias("diff"), F.try_divide(F.col("auc1") - F.col("auc2"), F.sqrt(F.col("a") / F.col("n1") + F.col("b") / F.col("n0"))).alias("z"))
    return out.withColumn("p", two_sided_normal(F.col("z")))


def mcnemar(df: DataFrame) -> DataFrame:
    """(b, c, statistic, p) of paired right and wrong answers (right1, right2): exact, two-sided."""
    s = df.agg(F.count_if(F.col("right1") & ~F.col("right2")).alias("b"), F.count_if(~F.col("right1") & F.col("right2")).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    # Binomial terms by their ratio, summed up to the smaller count, each as a logarithm.
    logs = F.aggregate(
        F.sequence(F.lit(0), k), F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["log"] + F.log((n - i) / (i + F.lit(1.0)) + F.when(n == i, 1e-300).otherwise(0.0))).alias("log"), (a["sum"] + F.exp(a["log"] - n * F.log(F.lit(2.0)))).alias("sum")),
    )["sum"]
    return s.select("b", "c", k.alias("statistic"), F.least(F.lit(1.0), 2 * logs).alias("p"))


def _poisson(*key: Column | str) -> Column:
    """A count drawn from the Poisson distribution of mean 1 by a hash of ``key``."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    steps, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for i in range(1, 12):
        total += term
        steps = steps + (u >= total).cast("int")
        term /= i
    return steps


def bootstrap_interval(df: DataFrame, value: str, key: str, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(estimate, low, high) of a mean by the Poisson bootstrap: each row counts a random number of times in each draw.

    Weights come from a hash of ``key``, the row's id, and the draw: they do not depend on
    how rows are dealt to tasks, and rows are added up draw by draw before anything moves.
    """
    rows = df.select(F.col(value).alias("v"), F.col(key).alias("id")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    mean = rows.withColumn("w", _poisson("id", "k", F.lit(seed))).groupBy("k").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("m"))
    return _interval(df.agg(F.avg(value).alias("estimate")), mean, level)


def _interval(estimate: DataFrame, drawn: DataFrame, level: float) -> DataFrame:
    tail = (1 - level) / 2
    return estimate.crossJoin(F.broadcast(drawn.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))))


def bootstrap_auc(df: DataFrame, key: str, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(estimate, low, high) of the area under the curve of scores (y, score), over the same kind of draws.

    A draw's area needs its weights of both labels at each distinct score, in order: a
    table of one row per draw and distinct score.
    """
    def area(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        s = rows.groupBy(*by, "score").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("b"))
        before = F.coalesce(F.sum("b").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        s = s.withColumn("below", before + F.col("b") / 2)
        return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("a") * F.col("below")), (F.sum("a") * F.sum("b")).cast("double")).alias("m"))

    rows = df.select("y", "score", F.col(key).alias("id"))
    drawn = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", _poisson("id", "k", F.lit(seed)))
    whole = area(rows.withColumn("w", F.lit(1)).withColumn("k", F.lit(0)), ("k",))
    return _interval(whole.select(F.col("m").alias("estimate")), area(drawn.where("w > 0"), ("k",)).where("m is not null"), level)
