"""Operators on small series whose answers are known."""

import math

import pytest
from pyspark.sql import functions as F

from wavelode.operators import denoise, evaluate, features, nonlinear, series, stats, vmd, windows
from wavelode.sources.series import dealt, finite, prepare


def _series(spark, values, subject="a", dt=1.0):
    rows = [(subject, i, i * dt, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "subject string, seq long, t double, p double")


def test_scan_turns_what_is_not_finite_into_null_and_averages_equal_times(spark):
    rows = [("a", float(i), float(i)) for i in range(8)] + [("a", 3.0, 5.0), ("a", 4.0, float("nan")), ("a", 5.0, float("inf")), ("b", 1.0, 1.0)]
    out = prepare(spark.createDataFrame(rows, "s string, t double, v double"), "s", "t", "v").orderBy("seq").collect()
    assert [(r.seq, r.p) for r in out] == [(i, 4.0 if i == 3 else float(i)) for i in range(8)]
    assert [r[0] for r in spark.range(1).select(finite(F.lit("x"))).collect()] == [None]


def test_runs_gaps_and_dilation(spark):
    mask = [c == "1" for c in "0011100110"]
    df = _series(spark, range(10)).withColumn("flag", F.element_at(F.array(*[F.lit(b) for b in mask]), F.col("seq").cast("int") + 1))
    assert [(r.start, r.end) for r in series.run_table(df, "flag").orderBy("start").collect()] == [(2, 5), (7, 9)]
    filled = series.fill_short_gaps(df, "flag", 2).orderBy("seq").collect()
    assert [r.filled for r in filled] == [c == "1" for c in "0011111110"]
    wide = series.expand_mask(df, "flag", 1).orderBy("seq").collect()
    assert [r.expanded for r in wide] == [c == "1" for c in "0111111111"]


def test_interpolation_is_linear_inside_and_level_outside(spark):
    out = series.interpolate(_series(spark, [None, 1, None, 3, None]), F.col("p").isNotNull()).orderBy("seq").collect()
    assert [r.filled for r in out] == [1, 1, 2, 3, 3]


def test_gate_marks_long_and_edge_runs(spark):
    values = [60, 100, 101, 155, 102, 103, 20, 20, 20, 100]
    out = denoise.range_gate(_series(spark, values), max_gap=2.5).orderBy("seq").collect()
    assert [r.out_of_range for r in out] == [v < 85 or v > 130 for v in values]
    assert [r.low_confidence for r in out] == [i in (0, 6, 7, 8) for i in range(10)]
    assert out[3].gated == pytest.approx(101.5)


def test_isolated_spike_is_found(spark):
    values = [100 + 0.1 * (i % 3) for i in range(60)]
    values[30] += 10
    df = denoise.local_noise(_series(spark, values).withColumn("residual", F.col("p") - 100))
    assert [r.seq for r in denoise.isolated_spikes(df).where("spike").collect()] == [30]


def test_fixed_windows_keep_a_long_enough_tail(spark):
    out = windows.fixed_windows(_series(spark, range(100)), 40, 30, 25).orderBy("window_id").collect()
    assert [(r.start_idx, r.end_idx) for r in out] == [(0, 40), (30, 70), (60, 100)]


def test_constant_ramp_and_turns(spark):
    flat, ramp = _series(spark, [5] * 60, "flat"), _series(spark, range(60), "ramp")
    both = flat.union(ramp)
    assert {r.subject: r.sampen for r in nonlinear.sample_entropy(both).collect()}["flat"] == 0.0
    assert {r.subject: round(r.permen, 9) for r in nonlinear.permutation_entropy(both).collect()} == {"flat": 0.0, "ramp": 0.0}
    assert {r.subject: r.pfd for r in nonlinear.fractals(both).collect()} == {"flat": 1.0, "ramp": 1.0}
    assert {r.subject: r.kfd for r in nonlinear.fractals(both).collect()}["flat"] is None


def test_sine_delay(spark):
    df = _series(spark, [math.sin(2 * math.pi * i / 24) for i in range(240)])
    assert nonlinear.tau_from_autocorrelation(nonlinear.autocorrelation(df)).first().tau == 5


def test_ties_and_effects(spark):
    rows = [("f", 1, v) for v in (1.0, 2.0, 2.0)] + [("f", 0, v) for v in (2.0, 3.0)]
    s = stats.rank_sums(spark.createDataFrame(rows, "feature string, grp int, value double")).first()
    assert s.delta == pytest.approx((0 - 4) / 6)
    q = stats.benjamini_hochberg(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double")).orderBy("id").collect()
    assert [r.fdr_q for r in q][:3] == pytest.approx([0.03, 0.04, 0.04]) and q[3].fdr_q is None


def test_exact_mcnemar(spark):
    rows = [(True, False)] * 2 + [(False, True)] * 2 + [(True, True)] * 5
    out = stats.mcnemar(spark.createDataFrame(rows, "right1 boolean, right2 boolean")).first()
    assert (out.b, out.c, out.statistic) == (2, 2, 2) and out.p == pytest.approx(1.0)


def test_first_mode_takes_the_last_place(spark):
    rows = [("a", 1, 0.1, 0.0), ("a", 2, 0.5, 0.0), ("a", 3, 0.4, 0.0), ("a", 4, 0.3, 0.9)]
    out = vmd.select_modes(spark.createDataFrame(rows, "subject string, mode int, keep_score double, artifact_energy double"), most=2)
    assert sorted(r.mode for r in out.where("selected").collect()) == [1, 2]


def test_metrics_of_masks_and_scores(spark):
    df = _series(spark, range(6)).withColumn("a", F.col("seq") < 3).withColumn("b", F.col("seq").between(1, 3))
    m = evaluate.mask_metrics(df, "a", "b").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 2) and m.iou == pytest.approx(0.5)
    auc = evaluate.roc_auc(spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "y int, score double")).first().auc
    assert auc == pytest.approx((1 + 1 + 0.5 + 1) / 4)


def test_correlated_features_are_dropped(spark):
    rows = [(i, f, float(v)) for i in range(20) for f, v in (("a", i), ("b", 2 * i + 1), ("c", (i * 7) % 20))]
    out = features.correlation_filter(spark.createDataFrame(rows, "subject int, feature string, value double"))
    assert sorted(r.feature for r in out.collect()) == ["a", "c"]


def test_a_chain_of_steps_deletes_the_tables_that_it_has_passed(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from wavelode.functions.lineage import cut

    df = cut(_series(spark, [100 + i % 3 + 20 * (i == 30) for i in range(64)]))
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    before = set(folder.glob("rdd-*"))
    out = denoise.denoise(df, passes=1)
    # What is left is the last estimates and the samples that they were made from.
    assert len(set(folder.glob("rdd-*")) - before) <= 2
    assert out.count() == 64 and out.where("artifact").select("seq").first().seq in (29, 30, 31)


def test_lags_of_a_window_are_counted_without_joins_of_samples(spark):
    df = _series(spark, [1, 5, 2, 8, None, 3, 9, 4, 7, 6, 2, 5])
    acf, ami = nonlinear.autocorrelation(df, 3), nonlinear.mutual_information(df, 3)
    for out in (acf, ami):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    known = [1, 5, 2, 8, None, 3, 9, 4, 7, 6, 2, 5]
    mean = sum(x for x in known if x is not None) / 11
    c = [None if x is None else x - mean for x in known]
    var = sum(x * x for x in c if x is not None) / 11
    want = [sum(a * b for a, b in zip(c, c[k:]) if a is not None and b is not None) / ((11 - k) * var) for k in range(4)]
    assert [r.acf for r in acf.orderBy("lag").collect()] == pytest.approx(want)
    assert [r.lag for r in ami.orderBy("lag").collect()] == [1, 2, 3]
    assert nonlinear.autocorrelation(_series(spark, [2, 2, 2]), 4).where("acf is not null").count() == 0


def test_partitions_of_series_grow_with_the_table_and_stay_by_subject(spark):
    rows = spark.range(2000).select((F.col("id") % 50).alias("who"), "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = dealt(rows, "who", 100)
    assert many.rdd.getNumPartitions() == 20 > parts
    placed = many.withColumn("part", F.spark_partition_id())
    assert placed.groupBy("who").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0 and many.count() == 2000
    # No more partitions than subjects, and the session's own where these are enough.
    assert dealt(rows.where("who < 7"), "who", 10).rdd.getNumPartitions() == 7
    assert dealt(rows, "who", 2000 // parts) is rows


def test_rolling_medians_equal_plain_ones():
    import numpy as np

    from wavelode.functions.kernels import rolling_medians

    r = np.random.default_rng(2)
    x, held = r.normal(size=200).round(1), r.random(200) < 0.7
    held[60:80] = False
    at = np.arange(20, 190)
    for half in (1, 4, 150):
        near = [x[max(0, i - half) : i + half + 1][held[max(0, i - half) : i + half + 1]] for i in at]
        median = lambda v: np.median(v) if len(v) else np.nan
        for cells in (1, 1 << 20):
            value, n = rolling_medians(x, held, half, at, False, cells)
            assert n.tolist() == [len(v) for v in near] and np.array_equal(value, [median(v) for v in near], equal_nan=True)
            assert np.array_equal(rolling_medians(x, held, half, at, True, cells)[0], [median(np.abs(v - median(v))) for v in near], equal_nan=True)


def test_rolling_holds_no_arrays_of_neighbours(spark):
    """Windows of fixed and of each subject's own width, evaluated by one grouped step, without an array for each sample."""
    df = _series(spark, [1, None, 5, 2, 9, 4, 4, None, 7]).withColumn("w", F.lit(5))
    out = series.rolling(df, ("median", 3, "p", "a"), ("mad", "w", "p", "b"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "collect_list" not in plan and out.columns == ["subject", "seq", "t", "p", "w", "a", "b"]
    assert [r.a for r in out.orderBy("seq").collect()] == [5, 5, 5, 5, 4, 4, 4, 4, 4]
