"""Aggregation to subjects, missing values, and feature selection, over long tables.

A long table has (subject, feature, value) and may have label, method and fold. Fitting
groups carry every column in ``by``, so a fold's statistics never see its test rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import average_rank, cohens_d, rank_sum_p, rank_sums

#: Endings of feature names that describe the embedding, not the signal.
NON_BIOMARKERS = ("Tau", "EmbeddingDim", "EmbeddedVectors", "NumPoints", "RQA_epsilon")
#: Signals whose features are extracted, in this order.
SIGNALS = ("Pressure_Clean", "VMD_Reconstructed", "VMD_Mode3", "VMD_Mode4")


def available_signals(df: DataFrame, preferred: tuple[str, ...] = SIGNALS) -> list[str]:
    """Those of ``preferred`` that are columns of ``df``, in their order."""
    return [c for c in preferred if c in df.columns]


def recommended_signals(clean: bool = True, rebuilt: bool = True, modes: tuple[int, ...] = (3, 4)) -> list[str]:
    """Signals to extract features of: the clean one, the rebuilt one, and single modes."""
    return [SIGNALS[0]] * clean + [SIGNALS[1]] * rebuilt + [f"VMD_Mode{m}" for m in modes]


def drop_non_biomarkers(df: DataFrame, endings: tuple[str, ...] = NON_BIOMARKERS) -> DataFrame:
    """Rows of a long table without the features (or aggregates of features) that only describe the embedding."""
    return df.where(~F.col("feature").rlike(rf"_({'|'.join(endings)})(__[A-Za-z0-9]+)?$"))


def feature_group(feature: Column) -> Column:
    """Kind of measure that a feature name tells: phase space, recurrence, entropy, fractal, divergence, or basic."""
    return (
        F.when(feature.contains("_PS_"), "phase_space").when(feature.contains("_RQA_"), "recurrence").when(feature.rlike("_(SampEn|PermEn)"), "entropy")
        .when(feature.rlike("_(HFD|KFD|PFD)"), "fractal").when(feature.contains("_ApproxLLE"), "divergence").otherwise("basic")
    )


def _position(feature: str, columns: list[str] | None) -> Column:
    """What orders features: their place in ``columns``, or their names without it."""
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(feature)) if columns else F.col(feature)


def to_long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Unpivot numeric columns; what is not a finite number becomes null."""
    values = [c for c in features]
    clean = df.select(*keys, *[F.when(~F.isnan(F.col(c).try_cast("double")) & (F.abs(F.col(c).try_cast("double")) < float("inf")), F.col(c).try_cast("double")).alias(c) for c in values])
    return clean.unpivot(keys, values, "feature", "value")


def to_wide(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot("feature", features).agg(F.first("value"))


def feature_columns(df: DataFrame, prefixes: list[str], suffixes: list[str], numeric: bool = True) -> list[str]:
    """Columns named by a signal's prefix and a feature's suffix, with a number in some row where asked: one pass."""
    found = [c for c in df.columns if any(c.startswith(f"{p}_") for p in prefixes) and any(c.endswith(f"_{s}") for s in suffixes)]
    if not numeric or not found:
        return found
    counts = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in found]).first()
    return [c for c in found if counts[c]]


def subject_aggregate(df: DataFrame, by: tuple[str, ...] = ("subject",), iqr: bool = False) -> DataFrame:
    """mean, std, median, min, max (and iqr) of every feature for each subject, with the number of windows."""
    parts = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max")]
    if iqr:
        parts.append((F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    return df.groupBy(*by, "feature").agg(*parts, F.count(F.lit(1)).alias("num_windows"))


def missingness(df: DataFrame) -> DataFrame:
    return df.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))


def drop_high_missing(df: DataFrame, most: float = 0.3, protected: tuple[str, ...] = ()) -> DataFrame:
    """Rows of features of which no more than ``most`` is missing, or that are protected."""
    keep = missingness(df).where((F.col("missing_rate") <= most) | F.col("feature").isin(*protected) if protected else F.col("missing_rate") <= most)
    return df.join(keep.select("feature"), "feature", "left_semi")


def missing_variance(df: DataFrame, by: tuple[str, ...] = (), most: float = 0.3, least: float = 1e-10) -> DataFrame:
    """(by, feature) that pass both limits; where none does, all of them."""
    s = df.groupBy(*by, "feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.var_samp("value").alias("var"))
    s = s.withColumn("ok", F.coalesce((F.col("missing") <= most) & (F.col("var") > least), F.lit(False)))
    any_ok = F.max("ok").over(Window.partitionBy(*by))
    return s.withColumn("any", any_ok).where(F.col("ok") | ~F.col("any")).select(*by, "feature")


def impute(df: DataFrame, by: tuple[str, ...] = (), train: str | None = None, how: str = "median") -> DataFrame:
    """Fill nulls with the feature's median or mean over training rows, 0 where it has no value."""
    value = F.when(F.col(train), F.col("value")) if train else F.col("value")
    fill = df.groupBy(*by, "feature").agg((F.median(value) if how == "median" else F.avg(value)).alias("_fill"))
    return df.join(fill, [*by, "feature"]).withColumn("value", F.coalesce("value", "_fill", F.lit(0.0))).drop("_fill")


def standardize(df: DataFrame, by: tuple[str, ...] = (), train: str | None = None) -> DataFrame:
    """Centre and scale by the population deviation over training rows; a constant is only centred."""
    value = F.when(F.col(train), F.col("value")) if train else F.col("value")
    s = df.groupBy(*by, "feature").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return df.join(s, [*by, "feature"]).withColumn("value", (F.col("value") - F.col("_m")) / scale).drop("_m", "_s")


def spearman(df: DataFrame, by: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """Rank correlation (a, b, rho) of features, each pair once, a before b in the order of ``columns`` or of names."""
    ranked = average_rank(df, "value", *by, "feature").select(*by, "subject", "feature", "rank")
    left, right = ranked.withColumnRenamed("feature", "a").withColumnRenamed("rank", "x"), ranked.withColumnRenamed("feature", "b").withColumnRenamed("rank", "y")
    pairs = left.join(right, [*by, "subject"]).where(_position("a", columns) < _position("b", columns))
    varied = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return pairs.groupBy(*by, "a", "b").agg(F.when(varied, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("rho"))


def correlation_filter(df: DataFrame, by: tuple[str, ...] = (), most: float = 0.9, columns: list[str] | None = None) -> DataFrame:
    """(by, feature) that no earlier feature, kept or not, correlates with beyond ``most``.

    Earlier is by place in ``columns``, or by name without it.
    """
    bad = spearman(df, by, columns).where(F.abs("rho") > most).select(*by, F.col("b").alias("feature")).distinct()
    return df.select(*by, "feature").distinct().join(bad, [*by, "feature"], "left_anti")


def effect_scores(df: DataFrame, how: str = "cliff_abs", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, feature, score) of label 1 against 0: absolute Cliff's delta or Cohen's d, or -log10 of the rank test's p.

    A score that cannot be computed is 0.
    """
    keys = (*by, "feature")
    rows = df.select(*keys, F.col("label").alias("grp"), "value")
    if how == "cliff_abs":
        found = rank_sums(rows, keys).select(*keys, F.abs("delta").alias("score"))
    elif how == "cohen_abs":
        found = cohens_d(rows, True, keys).select(*keys, F.abs("cohens_d").alias("score"))
    elif how == "mw_neglogp":
        found = rank_sums(rows, keys).withColumn("p", rank_sum_p("u", "n1", "n0", "z", "has_ties")).select(*keys, (-F.log10(F.col("p") + 1e-12)).alias("score"))
    else:
        raise ValueError("how must be cliff_abs, cohen_abs or mw_neglogp")
    return found.withColumn("score", F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)))


def effect_top(df: DataFrame, k: int = 15, how: str = "cliff_abs", least: float | None = None, by: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """The k features (by, feature, score, r) of the largest effect, by place in ``columns`` or by name among equals.

    With ``least`` features below that score are left out; where that is all of them, the best one stays.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), _position("feature", columns)))
    ranked = effect_scores(df, how, by).withColumn("r", rank).where(F.col("r") <= k)
    return ranked if least is None else ranked.where((F.col("score") >= least) | (F.col("r") == 1))


def anova_f(df: DataFrame) -> DataFrame:
    """(feature, f): one-way F over labels, from group sums."""
    g = df.where("value is not null").groupBy("feature", "label").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    s = g.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = g.join(s.select("feature", "gm"), "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), F.lit(2.0))).alias("between"))
    return s.join(between, "feature").select("feature", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def label_audit(subjects: DataFrame, event: DataFrame, fixed: DataFrame) -> DataFrame:
    """Which subjects have windows of either kind."""
    has = lambda df, out: df.select("subject").distinct().withColumn(out, F.lit(True))
    rows = subjects.join(has(event, "has_event"), "subject", "left").join(has(fixed, "has_fixed"), "subject", "left")
    return rows.fillna(False, ["has_event", "has_fixed"])


def quality_report(df: DataFrame) -> DataFrame:
    """One row about a long table: subjects, rows, features, constant features and the largest share missing."""
    per = df.groupBy("feature").agg(F.count_distinct("value").alias("d"), F.avg(F.col("value").isNull().cast("double")).alias("m"))
    top = per.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("d") <= 1).alias("n_constant"), F.max("m").alias("max_missing_rate"))
    return df.agg(F.count_distinct("subject").alias("n_subjects"), F.count(F.lit(1)).alias("n_values")).crossJoin(F.broadcast(top))


def group_summary(effects: DataFrame) -> DataFrame:
    """Effects (grp, effect, p) of each group of features: count, median and largest size, smallest p, and how many are below 0.05."""
    return effects.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_features"), F.median(F.abs("effect")).alias("median_abs_effect"), F.max(F.abs("effect")).alias("max_abs_effect"), F.min("p").alias("min_p"), F.count_if(F.col("p") < 0.05).alias("n_below")
    )
