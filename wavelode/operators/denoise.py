"""Denoising that keeps physiological events: gate, baseline, noise, events, artifacts, smoothing.

Every step is a window or aggregate over a subject's samples, so the steps share one
exchange by subject. Thresholds are arguments; the defaults suit a capsule's pressure.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, drop
from . import series as S

GATE, GATE_GAP = (85.0, 130.0), 30.0


class Limits(NamedTuple):
    """Multiples of the local noise beyond which samples are artifacts or events, and the least spike."""

    amp: float = 6.0
    slope: float = 6.0
    curve: float = 6.0
    spike: float = 3.0
    back: float = 4.0
    event_amp: float = 3.0
    event_area: float = 1.5


DEFAULT = Limits()


def range_gate(df: DataFrame, low: float = GATE[0], high: float = GATE[1], max_gap: float = GATE_GAP) -> DataFrame:
    """Rebuild values outside a range: adds out_of_range, gated and low_confidence.

    A run longer than ``max_gap`` seconds, or one at an end of the recording, is rebuilt
    with low confidence.
    """
    p = F.col("p")
    df = df.withColumn("out_of_range", F.coalesce((p < low) | (p > high), F.lit(True)))
    df = S.interpolate(df, ~F.col("out_of_range"), out="gated")
    return low_confidence(df, "out_of_range", max_gap)


def low_confidence(df: DataFrame, flag: str, max_gap: float, out: str = "low_confidence") -> DataFrame:
    """True in runs of ``flag`` that last longer than ``max_gap`` or touch an end of the recording."""
    step = S.sampling_interval(df)
    ends = df.groupBy("subject").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last")).join(step, "subject")
    run = Window.partitionBy("subject", flag, "run")
    df = S.runs(df.join(ends, "subject"), flag)
    lasts = F.max("t").over(run) - F.min("t").over(run) + F.col("dt") > max_gap
    edge = (F.min("seq").over(run) == F.col("_first")) | (F.max("seq").over(run) == F.col("_last"))
    return df.withColumn(out, F.col(flag) & (lasts | edge)).drop("run", "_first", "_last", "dt")


def local_noise(df: DataFrame, width: int = 17, column: str = "p") -> DataFrame:
    """Add dp, ddp and the local noise of values and of both differences: s_p, s_dp, s_ddp."""
    df = cut(S.differences(df, column))
    df = S.rolling(df, ("mad", width, "dp", "s_dp"), ("mad", width, "ddp", "s_ddp"))
    return df.withColumn("s_p", F.col("s_dp") / F.sqrt(F.lit(2.0)))


def baseline_and_noise(df: DataFrame, baseline: int | str, noise: int | str) -> DataFrame:
    """Add baseline, residual and the local noise of p, all by one pass over blocks of samples."""
    df = cut(S.differences(df))
    df = S.rolling(df, ("median", baseline, "p", "baseline"), ("mad", noise, "dp", "s_dp"), ("mad", noise, "ddp", "s_ddp"))
    return df.withColumn("residual", F.col("p") - F.col("baseline")).withColumn("s_p", F.col("s_dp") / F.sqrt(F.lit(2.0)))


def events(df: DataFrame, least_samples: int = 2, amp_k: float = DEFAULT.event_amp, area_k: float = DEFAULT.event_area, max_gap: int = 1, residual: str = "residual", noise: str = "s_p") -> DataFrame:
    """Physiological events: subject, start, end (exclusive), times, n, peak and area.

    Samples rise above amp_k times the noise; short gaps between them are closed; a run
    stays if it has enough samples, its peak exceeds amp_k times the median noise, and
    its area exceeds area_k times the median noise times its duration.
    """
    df = df.withColumn("_hot", F.coalesce(F.col(residual) > amp_k * F.col(noise), F.lit(False)))
    df = S.runs(S.fill_short_gaps(df, "_hot", max_gap), "filled").where("filled").withColumn("_up", F.greatest(residual, F.lit(0.0)))
    w = Window.partitionBy("subject", "run").orderBy("seq")
    df = df.withColumn("_part", (F.col("_up") + F.lag("_up").over(w)) / 2 * (F.col("t") - F.lag("t").over(w)))
    found = df.groupBy("subject", "run").agg(
        F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count(F.lit(1)).alias("n"),
        F.max(residual).alias("peak"), F.coalesce(F.sum("_part"), F.lit(0.0)).alias("area"), F.percentile(noise, 0.5).alias("_noise"), _own(amp_k).alias("_amp_k"), _own(area_k).alias("_area_k"),
    )
    strong = (F.col("n") >= least_samples) & (F.col("peak") > F.col("_amp_k") * F.col("_noise"))
    wide = F.col("area") > F.col("_area_k") * F.col("_noise") * (F.col("t_end") - F.col("t_start"))
    return found.where(strong & wide).drop("run", "_noise", "_amp_k", "_area_k")


def _own(limit: float | Column) -> Column:
    """A limit as an aggregate: a number, or a column that is the same for a subject's samples."""
    return F.first(limit if isinstance(limit, Column) else F.lit(limit))


def mark(df: DataFrame, found: DataFrame, out: str) -> DataFrame:
    """True for samples inside a run of ``found``; runs are numbered edges, so a running sum finds them."""
    up = found.select("subject", F.col("start").alias("seq"), F.lit(1).alias("_step"))
    down = found.select("subject", F.col("end").alias("seq"), F.lit(-1).alias("_step"))
    steps = up.union(down).groupBy("subject", "seq").agg(F.sum("_step").alias("_step"))
    inside = F.sum(F.coalesce("_step", F.lit(0))).over(S.ordered().rowsBetween(Window.unboundedPreceding, 0)) > 0
    return df.join(steps, ["subject", "seq"], "left").withColumn(out, inside).drop("_step")


def _bridge() -> Column:
    """The value on the line between both neighbours, null at the ends."""
    w = S.ordered()
    t0, t1, p0, p1 = F.lag("t").over(w), F.lead("t").over(w), F.lag("p").over(w), F.lead("p").over(w)
    return p0 + (p1 - p0) * F.try_divide(F.col("t") - t0, t1 - t0)


def isolated_spikes(df: DataFrame, out: str = "spike", k: Limits = DEFAULT) -> DataFrame:
    """One sample away from both neighbours, which agree with each other.

    Jumps to and from it have opposite signs and exceed the slope threshold, it is off the
    bridge by more than the amplitude threshold, and the neighbours differ by no more
    than ``back`` times the median noise of five samples plus the least spike.
    """
    w = S.ordered()
    left, right = F.col("p") - F.lag("p").over(w), F.lead("p").over(w) - F.col("p")
    amp, slope = F.greatest(k.amp * F.col("s_p"), F.lit(k.spike)), F.greatest(k.slope * F.col("s_dp"), F.lit(k.spike))
    near = F.percentile("s_p", 0.5).over(w.rowsBetween(-2, 2))
    back = F.abs(F.lag("p").over(w) - F.lead("p").over(w)) <= k.back * near + k.spike
    found = (left * right < 0) & (F.abs(F.col("p") - _bridge()) > amp) & (F.abs(left) > slope) & (F.abs(right) > slope) & back
    return df.withColumn(out, F.coalesce(found, F.lit(False)))


def curvature_spikes(df: DataFrame, out: str = "curved", k: Limits = DEFAULT) -> DataFrame:
    """A large second difference at a sample that is off the bridge of its neighbours."""
    amp, curve = F.greatest(k.amp * F.col("s_p"), F.lit(k.spike)), F.greatest(k.curve * F.col("s_ddp"), F.lit(k.spike))
    return df.withColumn(out, F.coalesce((F.abs("ddp") > curve) & (F.abs(F.col("p") - _bridge()) > amp), F.lit(False)))


def short_pulses(df: DataFrame, most: int = 4, max_seconds: float = 4.8, event: str | None = None, k: Limits = DEFAULT) -> DataFrame:
    """Runs of large residuals, of either sign, that return to where they began: subject, start, end, peak.

    Runs need both outside neighbours, whose gap is at most ``back`` times the median
    noise plus the least spike, and a peak above the median threshold. Longer runs that are
    mostly event are skipped.
    """
    step = S.sampling_interval(df)
    w = S.ordered()
    df = df.withColumn("_amp", F.greatest(k.amp * F.col("s_p"), F.lit(k.spike))).withColumn("_large", F.coalesce(F.abs("residual") > F.col("_amp"), F.lit(False)))
    df = S.runs(df.withColumn("_l", F.lag("p").over(w)).withColumn("_r", F.lead("p").over(w)), "_large").where("_large")
    share = F.avg(F.col(event).cast("int")) if event else F.lit(0.0)
    found = df.groupBy("subject", "run").agg(
        F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("_span"), share.alias("_event"),
        F.min_by("_l", "seq").alias("_l"), F.max_by("_r", "seq").alias("_r"), F.max(F.abs("residual")).alias("peak"), F.percentile("s_p", 0.5).alias("_noise"), F.percentile("_amp", 0.5).alias("_amp"),
    ).join(step, "subject")
    short = (F.col("n") <= most) & (F.col("_span") + F.col("dt") <= max_seconds + F.col("dt"))
    skipped = (F.col("_event") > 0.5) & (F.col("_span") + F.col("dt") > max_seconds)
    returns = F.abs(F.col("_l") - F.col("_r")) <= k.back * F.col("_noise") + k.spike
    return found.where(short & ~skipped & returns & (F.col("peak") > F.col("_amp"))).select("subject", "start", "end", "peak")


def reverse_edges(df: DataFrame, most: int = 4, k: Limits = DEFAULT) -> DataFrame:
    """Pulses between a large edge and the first large edge back: subject, start, end.

    For each edge only the first opposite one within ``most`` + 1 samples counts, whether
    or not the samples between leave the bridge by more than the median threshold. The
    samples ahead are gathered by a bounded window, so no join of samples is needed.
    """
    w = S.ordered()
    amp, slope = F.greatest(k.amp * F.col("s_p"), F.lit(k.spike)), F.greatest(k.slope * F.col("s_dp"), F.lit(k.spike))
    df = df.withColumn("_slope", slope).withColumn("_amp", amp)
    edge = F.lead("p").over(w) - F.col("p")
    limit = F.greatest(F.col("_slope"), F.lead("_slope").over(w))
    df = df.withColumn("_edge", F.when(F.abs(edge) > limit, edge)).withColumn("_p1", F.lead("p").over(w))
    ahead = F.collect_list(F.struct("seq", "t", "p", F.coalesce("_edge", F.lit(0.0)).alias("edge"), "_p1", F.lead("t").over(w).alias("t1"), "_amp")).over(w.rowsBetween(1, most + 1))
    df = df.withColumn("_ahead", ahead).where("_edge is not null")
    first = F.filter("_ahead", lambda x: x["edge"] * F.col("_edge") < 0)
    df = df.withColumn("_back", F.get(first, F.lit(0))).where("_back is not null")
    inside = F.filter("_ahead", lambda x: x["seq"] <= F.col("_back.seq"))
    line = lambda x: F.col("p") + (F.col("_back._p1") - F.col("p")) * F.try_divide(x["t"] - F.col("t"), F.col("_back.t1") - F.col("t"))
    off = F.array_max(F.transform(inside, lambda x: F.abs(x["p"] - line(x))))
    limit = S.array_median(F.transform(inside, lambda x: x["_amp"]))
    return df.where(off > limit).select("subject", (F.col("seq") + 1).alias("start"), (F.col("_back.seq") + 1).alias("end"))


def flatlines(df: DataFrame, least: int = 10, eps: float = 1e-6, k: Limits = DEFAULT) -> DataFrame:
    """Runs without change, entered or left by a jump above ``amp`` times the median noise: subject, start, end."""
    w = S.ordered()
    flat = F.coalesce(F.abs(F.col("p") - F.lag("p").over(w)) <= eps, F.lit(True))
    df = df.withColumn("_flat", flat).withColumn("_l", F.abs(F.col("p") - F.lag("p").over(w))).withColumn("_r", F.abs(F.lead("p").over(w) - F.col("p")))
    df = df.withColumn("_l0", F.lag("_l").over(w))
    df = S.runs(df, "_flat").where("_flat")
    found = df.groupBy("subject", "run").agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), F.count(F.lit(1)).alias("n"), F.min_by("_l0", "seq").alias("_in"), F.max_by("_r", "seq").alias("_out"), F.percentile("s_p", 0.5).alias("_noise"), _own(k.amp).alias("_amp_k"))
    jump = F.col("_amp_k") * F.col("_noise")
    return found.where((F.col("n") >= least) & ((F.coalesce("_in", F.lit(0.0)) > jump) | (F.coalesce("_out", F.lit(0.0)) > jump))).select("subject", "start", "end")


def adaptive_parameters(df: DataFrame, low: float = GATE[0], high: float = GATE[1]) -> DataFrame:
    """Parameters for each subject from how bad its signal is, on a scale from 0 to 1."""
    d = S.differences(df)
    noise = S.robust_mad(d, "dp", 0.0).withColumnRenamed("mad", "mad_dp").join(S.robust_mad(df, "p", 0.0).withColumnRenamed("mad", "mad_p"), "subject")
    share = df.groupBy("subject").agg(F.avg(((F.col("p") < low) | (F.col("p") > high)).cast("int")).alias("outside")).join(S.sampling_interval(df), "subject")
    b = F.col("badness")
    raw = 0.65 * F.col("mad_dp") / (F.col("mad_p") + 1e-9) + 3 * F.col("outside")
    rows = share.join(noise, "subject").withColumn("badness", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    k = (6.5 - b).alias
    return rows.select(
        "subject", "badness", k("amp_k"), k("slope_k"), k("curv_k"), (3 + 0.8 * b).alias("event_amp_k"), (1.5 + 0.5 * b).alias("event_area_k"),
        F.greatest(3 * F.col("dt"), 4.8 + 3 * b).alias("smooth_s"), F.greatest(10 * F.col("dt"), 20 + 10 * b).alias("noise_s"),
    )


def quality_flag(low: Column, ranged: Column, artifact: Column) -> Column:
    """The worst that holds of a sample: low confidence, out of range, artifact, or good."""
    return F.when(low, "low_confidence").when(ranged, "hard_range_reconstructed").when(artifact, "artifact_reconstructed").otherwise("good")


def artifacts(df: DataFrame, most: int = 4, max_seconds: float = 4.8, flat: int = 10, event: str = "event", k: Limits = DEFAULT) -> DataFrame:
    """Add artifact: samples that any of the five rules marks, in runs that last no longer than artifacts do.

    Longer runs stay only where events cover less than a fifth of them.
    """
    pulses = short_pulses(df, most, max_seconds, event, k).select("subject", "start", "end")
    spans = pulses.union(reverse_edges(df, most, k)).union(flatlines(df, flat, k=k)).distinct()
    df = cut(mark(curvature_spikes(isolated_spikes(df, k=k), k=k), spans, "_span"))
    df = S.runs(df.withColumn("_any", F.col("spike") | F.col("curved") | F.col("_span")), "_any").join(S.sampling_interval(df), "subject")
    run = Window.partitionBy("subject", "_any", "run")
    lasts = F.max("t").over(run) - F.min("t").over(run) + F.col("dt")
    calm = F.avg(F.col(event).cast("int")).over(run) < 0.2
    return df.withColumn("artifact", F.col("_any") & ((lasts <= max_seconds + F.col("dt")) | calm)).drop("spike", "curved", "_span", "_any", "run", "dt")


def smooth(df: DataFrame, width: int | str = 5, column: str = "p", event: str = "event", out: str = "smoothed") -> DataFrame:
    """Blend with a local quadratic fit: events keep 0.85 of their value at least, samples next to them 0.65.

    ``width`` is one number of samples, or the name of a column with each subject's own.
    """
    df = S.savgol_by_width(df, width, column, "_fit") if isinstance(width, str) else S.savgol(df, width, column, "_fit")
    df = S.expand_mask(df, event, 1, "_near")
    weight = F.when(F.col(event), 0.85).when(F.col("_near"), 0.65).otherwise(0.0)
    weight = F.greatest(weight, F.least(F.greatest(F.coalesce(F.col("score"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return df.withColumn(out, weight * F.col(column) + (1 - weight) * F.col("_fit")).drop("_fit", "_near")


def denoise(df: DataFrame, low: float = GATE[0], high: float = GATE[1], passes: int = 2, baseline: int = 51, noise: int = 17, smooth_width: int = 5, k: Limits = DEFAULT) -> DataFrame:
    """The whole chain over prepared series, sample by sample; ``denoise_uniform`` has it on a uniform grid.

    Gate, then ``passes`` times: baseline, noise, events, artifacts, and interpolation
    over artifacts widened by a sample outside events. A subject in which a pass finds no
    new artifact keeps what it has. Returns the samples with raw, range_fixed, preclean,
    clean, baseline, residual, noise, three masks and quality_flag. Steps that look at
    their input several times have it checkpointed, so plans stay short.
    """
    df = smooth(_reconstructed(df, low, high, passes, baseline, noise, k), smooth_width)
    flag = quality_flag(F.col("low_confidence"), F.col("out_of_range"), F.col("done"))
    return df.select(
        "subject", "seq", "t", "raw", "range_fixed", F.col("p").alias("preclean"), F.col("smoothed").alias("clean"), "baseline", "residual", F.col("s_p").alias("noise"),
        "out_of_range", F.col("done").alias("artifact"), "event", flag.alias("quality_flag"),
    )


def _reconstructed(df: DataFrame, low: float, high: float, passes: int, baseline: int | str, noise: int | str, k: Limits, kept: tuple[str, ...] = (), gap: float | None = None) -> DataFrame:
    """Gated samples with artifacts rebuilt, estimates of the result, and the columns ``kept`` of ``df``.

    Widths may name columns of these. With ``gap``, artifacts that last longer, in seconds, are rebuilt with low confidence.
    """
    given = df

    def gated() -> DataFrame:
        rows = range_gate(cut(given), low, high).withColumnRenamed("p", "raw").withColumnRenamed("gated", "range_fixed")
        return rows.withColumn("p", F.col("range_fixed")).withColumn("done", F.lit(False))

    df = cut(gated)
    base = ["subject", "seq", "t", "raw", "range_fixed", "out_of_range", "low_confidence", "p", "done", *kept]

    def passed(df: DataFrame) -> DataFrame:
        now = artifacts(_estimates(df.select(*base), baseline, noise, k), k=k)
        now = S.expand_mask(now, "artifact", 1, "_wide").withColumn("_wide", F.col("artifact") | (F.col("_wide") & ~F.col("event")))
        by = Window.partitionBy("subject")
        now = now.withColumn("_new", F.max(F.col("_wide") & ~F.col("done")).over(by))
        now = now.withColumn("done", F.when(F.col("_new"), F.col("done") | F.col("_wide")).otherwise(F.col("done")))
        now = S.interpolate(now, ~F.col("done"), y="range_fixed", out="_fixed")
        return now.withColumn("p", F.when(F.col("_new"), F.coalesce("_fixed", "p")).otherwise(F.col("p"))).select(*base)

    for _ in range(passes):
        before, df = df, cut(lambda rows=df: passed(rows))
        drop(before)
    if gap is not None:
        df = low_confidence(df, "done", gap, "_poor")
        df = df.withColumn("low_confidence", F.col("low_confidence") | F.col("_poor")).select(*base)
    return _estimates(df, baseline, noise, k)


#: Spans of the chain in seconds, for the baseline, the noise, smoothing, and artifacts that are rebuilt with confidence.
BASELINE_S, NOISE_S, SMOOTH_S, REBUILT_S = 60.0, 20.0, 4.8, 8.0


def denoise_uniform(df: DataFrame, low: float = GATE[0], high: float = GATE[1], channels: tuple[str, ...] = ("ph", "temperature"), passes: int = 2, parameters: DataFrame | None = None, dt: DataFrame | None = None, seconds: tuple[float, float, float] = (BASELINE_S, NOISE_S, SMOOTH_S), k: Limits = DEFAULT) -> DataFrame:
    """The whole chain with its result on a uniform grid, a row per grid point.

    ``df`` has (subject, seq, t, p) and may have the channels, which are carried along: gaps in
    them are filled by position, then they are put on the grid. Widths of the baseline, the
    noise and smoothing are in ``seconds`` and become each subject's own number of samples by its
    sampling interval. ``parameters`` (as ``adaptive_parameters`` gives them) replaces limits and
    widths subject by subject. ``dt`` (subject, dt) sets the grid, the sampling interval by default.

    Returns subject, k, t, the channels, raw, range_fixed, preclean, clean, baseline, residual
    (of clean), noise, out_of_range, artifact (samples out of range among them), event and
    quality_flag. A channel that ``df`` lacks, or that a subject never has, is null. An empty table gives no rows.
    """
    step = S.sampling_interval(df)
    carried = tuple(c for c in channels if c in df.columns)
    for c in carried:
        df = S.interpolate(df, F.col(c).isNotNull(), x="seq", y=c, out=c)
    limits = step
    if parameters is not None:
        limits = limits.join(parameters, "subject")
        k = k._replace(amp=F.col("amp_k"), slope=F.col("slope_k"), curve=F.col("curv_k"), event_amp=F.col("event_amp_k"), event_area=F.col("event_area_k"))
        seconds = (seconds[0], F.col("noise_s"), F.col("smooth_s"))
    own = [c for c in limits.columns if c.endswith("_k")]
    widths = {"baseline_n": (seconds[0], 9), "noise_n": (seconds[1], 7), "smooth_n": (seconds[2], 5)}
    limits = cut(limits.select("subject", *own, *[S.samples(s, F.col("dt"), least).alias(name) for name, (s, least) in widths.items()]))
    rows = df.select("subject", "seq", "t", "p", *carried).join(limits, "subject")

    def rebuilt() -> DataFrame:
        made = _reconstructed(rows, low, high, passes, "baseline_n", "noise_n", k, (*carried, *own, *widths), REBUILT_S)
        return made.withColumn("artifact", F.col("done") | F.col("out_of_range")).withColumnRenamed("s_p", "noise").withColumnRenamed("p", "preclean")

    rows = cut(rebuilt)
    values = ("raw", "range_fixed", "preclean", "baseline", "noise", "score", *carried)
    grid = S.uniform(rows, values, ("out_of_range", "artifact", "low_confidence", "event"), dt if dt is not None else step)
    grid = grid.withColumnRenamed("k", "seq").join(limits.select("subject", "smooth_n"), "subject")
    grid = smooth(cut(grid), "smooth_n", "preclean", out="clean")
    flag = quality_flag(F.col("low_confidence"), F.col("out_of_range"), F.col("artifact"))
    channel = lambda c: F.col(c) if c in carried else F.lit(None).cast("double").alias(c)
    return grid.select(
        "subject", F.col("seq").alias("k"), "t", *map(channel, channels), "raw", "range_fixed", "preclean", "clean", "baseline", (F.col("clean") - F.col("baseline")).alias("residual"), "noise",
        "out_of_range", "artifact", "event", flag.alias("quality_flag"),
    )


def _estimates(df: DataFrame, baseline: int | str, noise: int | str, k: Limits) -> DataFrame:
    """Add baseline, residual, noise, event and score."""
    given = df

    def marked() -> DataFrame:
        rows = cut(lambda: baseline_and_noise(given, baseline, noise))
        return mark(rows, events(rows, amp_k=k.event_amp, area_k=k.event_area), "event")

    df = cut(marked)
    return df.withColumn("score", F.when(F.col("event"), F.greatest(F.col("residual") / (k.event_amp * F.col("s_p") + 1e-9), F.lit(0.0))).otherwise(0.0))
