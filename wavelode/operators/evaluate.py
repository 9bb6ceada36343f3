"""Quality of masks, events, signals and classifiers against known truth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import series as S
from .stats import rank_sums

EPS = 1e-9


def mask_metrics(df: DataFrame, predicted: str, true: str, *by: str) -> DataFrame:
    """Counts, precision, recall, F1 and overlap of a predicted mask."""
    p, t = F.col(predicted), F.col(true)
    s = df.groupBy(*(by or ("subject",))).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    s = s.withColumn("precision", tp / (tp + fp + EPS)).withColumn("recall", tp / (tp + fn + EPS))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS)
    return s.withColumn("f1", f1).withColumn("iou", tp / (tp + fp + fn + EPS))


def event_timing(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """For each true run its best overlapping predicted run, with errors of onset, offset and duration.

    Overlaps are counted sample by sample after numbering both masks' runs, so runs meet
    by their samples and no interval join is needed. Equal overlaps go to the earlier run.
    """
    a = S.runs(df, true).withColumnRenamed("run", "_a")
    both = S.runs(a, predicted).withColumnRenamed("run", "_b")
    span = lambda flag, run, name: both.where(F.col(flag)).groupBy("subject", run).agg(F.min("seq").alias(f"{name}_start"), F.min("t").alias(f"{name}_on"), F.max("t").alias(f"{name}_off"), F.count(F.lit(1)).alias(f"{name}_n"))
    hits = both.where(F.col(true) & F.col(predicted)).groupBy("subject", "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    t, p = span(true, "_a", "true"), span(predicted, "_b", "pred")
    rows = t.join(hits, ["subject", "_a"], "left").join(p, ["subject", "_b"], "left")
    rows = rows.withColumn("iou", F.coalesce(F.col("n") / (F.col("true_n") + F.col("pred_n") - F.col("n")), F.lit(0.0)))
    best = F.row_number().over(Window.partitionBy("subject", "true_start").orderBy(F.col("iou").desc(), "pred_start"))
    rows = rows.withColumn("r", best).where("r = 1")
    return rows.select(
        "subject", "true_start", "pred_start", "iou", (F.col("pred_on") - F.col("true_on")).alias("onset_error"), (F.col("pred_off") - F.col("true_off")).alias("offset_error"),
        ((F.col("pred_off") - F.col("pred_on")) - (F.col("true_off") - F.col("true_on"))).alias("duration_error"),
    )


def signal_metrics(df: DataFrame, estimate: str, truth: str, event: str) -> DataFrame:
    """RMSE, mean absolute error and correlation, and RMSE inside and outside events."""
    e = F.col(estimate) - F.col(truth)
    rmse = lambda c: F.sqrt(F.avg(c))
    return df.groupBy("subject").agg(
        rmse(e * e).alias("rmse"), F.avg(F.abs(e)).alias("mae"), S.safe_corr(F.col(estimate), F.col(truth)).alias("corr"), rmse(F.when(F.col(event), e * e)).alias("event_rmse"), rmse(F.when(~F.col(event), e * e)).alias("other_rmse")
    )


def event_fidelity(df: DataFrame, reference: str, rebuilt: str, baseline: str, event: str, least: int = 3) -> DataFrame:
    """For each event run: ratios of peak and area above baseline, and overlap of samples above 5% of the reference's peak."""
    up = lambda c: F.greatest(F.col(c) - F.col(baseline), F.lit(0.0))
    rows = S.runs(df, event).where(F.col(event)).withColumn("a", up(reference)).withColumn("b", up(rebuilt))
    run = Window.partitionBy("subject", "run")
    w = run.orderBy("seq")
    area = lambda c: (F.col(c) + F.lag(c).over(w)) / 2 * (F.col("t") - F.lag("t").over(w))
    rows = rows.withColumn("aa", area("a")).withColumn("ba", area("b")).withColumn("limit", 0.05 * F.max("a").over(run))
    x, y = F.col("a") > F.col("limit"), F.col("b") > F.col("limit")
    s = rows.groupBy("subject", "run").agg(
        F.min("seq").alias("start"), F.count(F.lit(1)).alias("n"), (F.max("b") / (F.max("a") + EPS)).alias("peak_ratio"), (F.coalesce(F.sum("ba"), F.lit(0.0)) / (F.coalesce(F.sum("aa"), F.lit(0.0)) + EPS)).alias("area_ratio"),
        F.try_divide(F.count_if(x & y).cast("double"), F.count_if(x | y).cast("double")).alias("iou"),
    )
    return s.where(F.col("n") >= least).drop("run")


def binary_metrics(df: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and rates of predictions (y, pred)."""
    y, p = F.col("y") == 1, F.col("pred") == 1
    s = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = s.withColumn("acc", F.try_divide(tp + tn, tp + fp + fn + tn)).withColumn("precision", zero(F.try_divide(tp, tp + fp))).withColumn("recall", zero(F.try_divide(tp, tp + fn)))
    s = s.withColumn("specificity", zero(F.try_divide(tn, tn + fp))).withColumn("f1", zero(F.try_divide(2 * tp, 2 * tp + fp + fn)))
    return s.withColumn("balanced_acc", (F.col("recall") + F.col("specificity")) / 2)


def roc_auc(df: DataFrame, *by: str) -> DataFrame:
    """Area under the curve of scores (y, score), from average ranks."""
    rows = df.select(*by, F.col("y").cast("int").alias("grp"), F.col("score").alias("value"), F.lit(0).alias("_all"))
    return rank_sums(rows, by or ("_all",)).select(*by, F.try_divide(F.col("u"), F.col("n0").cast("double") * F.col("n1")).alias("auc"))


def clean_reference(df: DataFrame, columns: tuple[str, ...] = ("preclean", "clean"), seconds: float = 9.0, baseline: float = 60.0) -> DataFrame:
    """Samples with reference, a relatively clean signal, and event, where it rises above its noise.

    The first of ``columns`` that is there is the reference; without one it is p smoothed by
    a parabola over ``seconds``. A column event is taken as it is; without it, events are
    samples above the median over ``baseline`` seconds by three times the noise.
    Windows are counted by the smallest sampling interval of all subjects.
    """
    held = next((c for c in columns if c in df.columns), None)
    if not held or "event" not in df.columns:
        # One row: the interval by which seconds become samples.
        dt = S.sampling_interval(df).agg(F.min("dt")).first()[0] or 1.0
    df = df.withColumn("reference", F.col(held)) if held else S.savgol(df, S.odd(round(seconds / dt), 7), "p", "reference")
    if "event" in df.columns:
        return df
    df = S.rolling_median(df, S.odd(round(baseline / dt), 9), "reference", "_base")
    step = df.select("subject", "seq", F.col("reference").alias("p"))
    noise = S.robust_mad(S.differences(step), "dp").select("subject", (F.col("mad") / F.sqrt(F.lit(2.0))).alias("_noise"))
    return df.join(noise, "subject").withColumn("event", F.col("reference") - F.col("_base") > 3 * F.col("_noise")).drop("_base", "_noise")


def evaluate_semisynthetic(df: DataFrame, estimate: str = "clean", truth: str = "true", found: str = "artifact", artifact: str = "true_artifact", event: str = "event", true_event: str = "true_event") -> dict[str, DataFrame]:
    """A denoised series against its known truth, sample by sample.

    Returns clean_signal, artifact_detection, event_timing, and summary: one row for each
    subject with the main figures of all three.
    """
    clean, masks, timing = signal_metrics(df, estimate, truth, true_event), mask_metrics(df, found, artifact), event_timing(df, event, true_event)
    mean = timing.groupBy("subject").agg(F.avg("iou").alias("mean_event_iou"), F.avg(F.abs("onset_error")).alias("mean_abs_onset_error"), F.avg(F.abs("offset_error")).alias("mean_abs_offset_error"))
    short = clean.select("subject", "rmse", "corr").join(masks.select("subject", F.col("f1").alias("artifact_f1"), F.col("recall").alias("artifact_recall")), "subject").join(mean, "subject", "left")
    return {"clean_signal": clean, "artifact_detection": masks, "event_timing": timing, "summary": short}


def selection_frequency(selected: DataFrame, folds: int) -> DataFrame:
    """How often each feature was selected, and whether in at least 0.6 of the folds."""
    s = selected.groupBy("feature").agg(F.count_distinct("fold").alias("selected"))
    return s.withColumn("frequency", F.col("selected") / F.lit(float(folds))).withColumn("stable", F.col("frequency") >= 0.6)


#: Artifacts of each kind that a recording gets, spans of pulses and flat lines in seconds, ranges of their sizes.
COUNTS = {"isolated_spike": 40, "short_pulse": 20, "flatline_dropout": 6, "hard_range_outlier": 12}
PULSE_S, FLAT_S, SPIKE_SIZE, PULSE_SIZE, BELOW, ABOVE = 4.8, (8.0, 18.0), (4.0, 12.0), (3.0, 9.0), (60.0, 82.0), (132.0, 155.0)


def _drawn(use: str, seed: int) -> list[Column]:
    """Four numbers from 0 to 1 for a sample and a use of them, from an MD5 sum, so that they are the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.col("subject").cast("string"), F.col("seq").cast("string"), F.lit(str(seed)), F.lit(use)).cast("binary"))
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) for i in range(4)]


def counted_artifacts(df: DataFrame, counts: dict[str, int] | None = None, seed: int = 42, event: str | None = None) -> DataFrame:
    """The interval table of artifacts to inject: subject, kind, start, end (exclusive), t_start, n, amplitude and rank.

    Samples outside events, and not next to an end, are ordered by a hash; the first of them begin
    as many artifacts of each kind as ``counts`` says, so no sample begins two. A recording of
    too few such samples has as many as there are, those of later kinds missing. The amplitude of a
    spike or pulse is added, of an outlier it is the value itself, of a flat line 0.
    """
    counts = counts or COUNTS
    step = S.sampling_interval(df)
    n = df.groupBy("subject").agg(F.count(F.lit(1)).alias("_n"))
    digest = F.md5(F.concat_ws(":", F.col("subject").cast("string"), F.col("seq").cast("string"), F.lit(str(seed)), F.lit("place")).cast("binary"))
    free = df.join(n, "subject").where((F.col("seq") > 5) & (F.col("seq") < F.col("_n") - 6))
    free = free.where(~F.coalesce(F.col(event), F.lit(False))) if event else free
    # The limit on ranks reaches the tasks' own samples before they move.
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(digest, "seq"))
    chosen = free.select("subject", "seq", "t", "_n").withColumn("rank", rank).where(F.col("rank") <= sum(counts.values())).join(step, "subject")
    kind, upto = None, 0
    for name, many in counts.items():
        upto += many
        kind = F.when(F.col("rank") <= upto, name) if kind is None else kind.when(F.col("rank") <= upto, name)
    length, sign, size, side = _drawn("shape", seed)
    between = lambda u, low, high: F.lit(low) + u * (F.lit(high) - F.lit(low))
    whole = lambda low, high: (low + F.floor(length * (high - low + 1))).cast("int")
    in_samples = lambda s, least: F.greatest(F.lit(least), F.bround(F.lit(s) / F.col("dt")).cast("int"))
    is_ = lambda name: F.col("kind") == name
    shortest, longest = in_samples(FLAT_S[0], 2), in_samples(FLAT_S[1], 3)
    many = F.when(is_("short_pulse"), whole(F.lit(2), in_samples(PULSE_S, 2))).when(is_("flatline_dropout"), whole(shortest, F.greatest(shortest, longest))).otherwise(1)
    signed = lambda span: F.when(sign < 0.5, -1.0).otherwise(1.0) * between(size, *span)
    amplitude = F.when(is_("isolated_spike"), signed(SPIKE_SIZE)).when(is_("short_pulse"), signed(PULSE_SIZE)).when(is_("hard_range_outlier"), F.when(side < 0.5, between(size, *BELOW)).otherwise(between(size, *ABOVE))).otherwise(0.0)
    rows = chosen.withColumn("kind", kind).withColumn("end", F.least(F.col("seq") + many, F.col("_n"))).withColumn("amplitude", amplitude)
    return rows.select("subject", "kind", F.col("seq").alias("start"), F.col("end").cast("long").alias("end"), F.col("t").alias("t_start"), (F.col("end") - F.col("seq")).cast("long").alias("n"), "amplitude", "rank")


def semisynthetic_counted(df: DataFrame, counts: dict[str, int] | None = None, seed: int = 42, event: str | None = None, noise: float | None = None) -> dict[str, DataFrame]:
    """A clean series (subject, seq, t, p) with artifacts of exact number: the samples, and the table of intervals.

    Samples get observed and artifact: Gaussian noise (0.35 of the scaled median deviation of the
    differences unless given), spikes and half-sine pulses added, flat lines that hold the value of their
    first sample, and values far out of range, in this order; of intervals of a kind that
    overlap, pulses add up and the last by rank holds. The table has one row for each artifact, and the mask is
    their union. An empty table gives no rows.
    """
    table = cut(counted_artifacts(df, counts, seed, event))
    d = S.robust_mad(S.differences(df), "dp", 0.0).withColumnRenamed("mad", "_sd")
    u = _drawn("noise", seed)
    normal = F.sqrt(-2 * F.log(1 - u[0])) * F.cos(2 * math.pi * u[1])
    sd = F.lit(float(noise)) if noise is not None else 0.35 * F.col("_sd")
    rows = df.join(d, "subject").withColumn("_v", F.col("p") + sd * normal).drop("_sd")
    # Intervals as their samples: a few for each artifact.
    held = table.select("*", F.explode(F.sequence("start", F.col("end") - 1)).alias("seq"))
    part = F.when(F.col("kind") == "isolated_spike", F.col("amplitude")).when(F.col("kind") == "short_pulse", F.col("amplitude") * F.sin(math.pi * (F.col("seq") - F.col("start")) / F.greatest(F.col("n") - 1, F.lit(1))))
    last = lambda name: F.max(F.when(F.col("kind") == name, F.struct("rank", "start", "amplitude")))
    marks = held.groupBy("subject", "seq").agg(F.sum(part).alias("_add"), last("flatline_dropout").alias("_flat"), last("hard_range_outlier").alias("_out"))
    rows = cut(rows.join(marks, ["subject", "seq"], "left").withColumn("_v", F.col("_v") + F.coalesce("_add", F.lit(0.0))))
    first = table.where(F.col("kind") == "flatline_dropout").select("subject", F.col("start").alias("seq")).distinct()
    first = rows.join(first, ["subject", "seq"], "left_semi").select("subject", F.col("seq").alias("_start"), F.col("_v").alias("_held"))
    rows = rows.withColumn("_start", F.col("_flat.start")).join(first, ["subject", "_start"], "left")
    artifact = F.col("_add").isNotNull() | F.col("_flat").isNotNull() | F.col("_out").isNotNull()
    rows = rows.withColumn("observed", F.coalesce(F.col("_out.amplitude"), F.col("_held"), F.col("_v"))).withColumn("artifact", artifact)
    return {"samples": rows.select(*df.columns, "observed", "artifact"), "table": table.drop("rank")}


def semisynthetic(df: DataFrame, seed: int = 42, spikes: float = 0.01, flat: int = 12, event: str | None = None) -> DataFrame:
    """Known artifacts in a clean series: adds observed and artifact.

    A hash of subject and sample decides where spikes and pulses go and how large they
    are, so the truth is the same wherever and however often it is made. Each block of
    512 samples has one flat line, and one sample far outside the range. Spikes and pulses
    leave samples alone where the column ``event`` is true.
    """
    u = lambda k: F.pmod(F.xxhash64("subject", "seq", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    block = F.pmod(F.xxhash64("subject", F.floor(F.col("seq") / 512), F.lit(seed)), F.lit(400))
    at = F.col("seq") % 512 - block
    sign = F.when(u(2) < 0.5, -1).otherwise(1)
    held = F.last(F.when(at == 0, F.col("p")), ignorenulls=True).over(S.ordered().rowsBetween(-flat, 0))
    calm = ~F.col(event) if event else F.lit(True)
    pulse = F.when((u(4) < spikes / 2) & calm, 3 + 6 * u(5))
    w = S.ordered()
    df = df.withColumn("_pulse", pulse).withColumn("_near", F.coalesce(F.max("_pulse").over(w.rowsBetween(-1, 1)), F.lit(0.0)))
    spike = (u(1) < spikes) & calm
    observed = F.when(at == 60, F.when(u(3) < 0.5, 60 + 22 * u(6)).otherwise(132 + 23 * u(6))).when((at >= 0) & (at < flat), F.coalesce(held, "p")).when(spike, F.col("p") + sign * (4 + 8 * u(7))).otherwise(F.col("p") + F.col("_near"))
    mark = (at == 60) | ((at >= 0) & (at < flat)) | spike | (F.col("_near") > 0)
    return df.withColumn("observed", observed).withColumn("artifact", mark).drop("_pulse", "_near")
