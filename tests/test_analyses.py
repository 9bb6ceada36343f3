"""Whole analyses, files, folds and streams on small tables whose answers are known."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.operators import denoise, evaluate, features, kernel_models, ml, nonlinear, series, stats, vmd, windows
from wavelode import catalog
from wavelode.functions import window_kernel
from wavelode.plans import reports
from wavelode.sources import sinks
from wavelode.sources.series import read_recordings
from wavelode.streaming import monitor


def table(spark, values, subject="a", dt=1.0):
    return spark.createDataFrame([(subject, i, i * dt, None if v is None else float(v)) for i, v in enumerate(values)], "subject string, seq long, t double, p double")


def walk(n, seed=1):
    return np.cumsum(np.random.default_rng(seed).standard_normal(n)) + 100


# series


def test_parabolas_reach_the_ends(spark):
    x = walk(40)
    out = [r.s for r in series.savgol(table(spark, x), 7, "p", "s").orderBy("seq").collect()]
    for i in range(40):
        lo = min(max(i - 3, 0), 33)
        at = np.arange(lo, lo + 7)
        assert out[i] == pytest.approx(np.polyval(np.polyfit(at - lo, x[at], 2), i - lo))
    assert [r.s for r in series.savgol(table(spark, x[:4]), 7, "p", "s").orderBy("seq").collect()] == pytest.approx(x[:4].tolist())


def test_blocks_give_what_one_task_gives(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 16)
    x = [None if i in (0, 1, 2, 20, 50, 51, 52, 53, 54, 99) else v for i, v in enumerate(walk(100))]
    known = [v for v in x if v is not None]
    out = series.rolling_mad(series.rolling_median(table(spark, x), 9), 9).orderBy("seq").collect()
    whole = 1.4826 * np.median(np.abs(np.array(known) - np.median(known)))
    near = lambda i: [v for v in x[max(0, i - 4) : i + 5] if v is not None]
    mid = [np.median(near(i)) if len(near(i)) >= 3 else None for i in range(100)]
    mad = [1.4826 * np.median(np.abs(np.array(near(i)) - np.median(near(i)))) if len(near(i)) >= 3 else None for i in range(100)]
    fill = lambda y, i: next((v for v in y[i:] if v is not None), None) or next(v for v in y[i::-1] if v is not None)
    assert [r["median"] for r in out] == pytest.approx([fill(mid, i) for i in range(100)])
    assert [r.mad for r in out] == pytest.approx([max(fill(mad, i), 0.05 * whole) for i in range(100)])
    filled = [r.f for r in series.bfill_ffill(table(spark, x), "p", "f").orderBy("seq").collect()]
    assert filled == pytest.approx([fill(x, i) for i in range(100)])


def test_seconds_become_samples(spark):
    assert (series.odd(6), series.odd(7), series.odd(1)) == (7, 7, 3)
    row = spark.range(1).select(series.samples(4.8, F.lit(1.2)).alias("a"), series.samples(60.0, F.lit(1.2), 9).alias("b"), series.samples(1.0, F.lit(1.2), 2, False).alias("c")).first()
    assert (row.a, row.b, row.c) == (5, 51, 2)


# ranks, effects and intervals


def test_ranks_and_areas_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, i % 2, float(r.randint(0, 9)), float(r.randint(0, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, y int, s1 double, s2 double").repartition(5)
    ranked = {x.id: x.rank for x in stats.average_rank(df, "s1").collect()}
    assert ranked == {i: sum(b < a for _, _, b, _ in rows) + (sum(b == a for _, _, b, _ in rows) + 1) / 2 for i, _, a, _ in rows}
    pos, neg = [x for x in rows if x[1]], [x for x in rows if not x[1]]
    psi = lambda k, p, n: (p[k] > n[k]) + (p[k] == n[k]) / 2
    auc = [np.mean([psi(k, p, n) for p in pos for n in neg]) for k in (2, 3)]
    v = [np.array([np.mean([psi(k, p, n) for n in neg]) for p in pos]) for k in (2, 3)]
    w = [np.array([np.mean([psi(k, p, n) for p in pos]) for n in neg]) for k in (2, 3)]
    z = (auc[0] - auc[1]) / math.sqrt(np.var(v[0] - v[1], ddof=1) / len(pos) + np.var(w[0] - w[1], ddof=1) / len(neg))
    got = stats.delong(df).first()
    assert (got.auc1, got.auc2, got.z) == pytest.approx((*auc, z))
    one = stats.bootstrap_auc(df.withColumn("score", F.col("s1")), "id", 300).first()
    again = stats.bootstrap_auc(df.repartition(3).withColumn("score", F.col("s1")), "id", 300).first()
    assert one == again and one.estimate == pytest.approx(auc[0]) and one.low < auc[0] < one.high
    mean = stats.bootstrap_interval(df, "s1", "id", 300).first()
    assert mean == stats.bootstrap_interval(df.repartition(2), "s1", "id", 300).first() and mean.low < mean.estimate < mean.high


def test_scores_and_order_of_features(spark):
    rows = [(i, i % 2, f, float(v)) for i in range(20) for f, v in (("b", i % 2 * 5 + i / 20), ("a", i % 2 * 5 + i / 20), ("c", (i * 7) % 20), ("d", 1.0))]
    df = spark.createDataFrame(rows, "subject int, label int, feature string, value double")
    top = lambda **how: [r.feature for r in features.effect_top(df, 3, **how).orderBy("r").collect()]
    assert top() == ["a", "b", "c"] and top(columns=["d", "c", "b", "a"])[:2] == ["b", "a"]
    assert top(how="cohen_abs")[:2] == ["a", "b"] and top(how="mw_neglogp", least=2.0) == ["a", "b"]
    assert top(least=9.0) == ["a"]
    with pytest.raises(ValueError):
        features.effect_scores(df, "other")
    kept = lambda columns: sorted(r.feature for r in features.correlation_filter(df, columns=columns).collect())
    assert kept(None) == ["a", "c", "d"] and kept(["d", "c", "b", "a"]) == ["b", "c", "d"]


# folds and models


def test_neighbours_in_blocks_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, i // 4, i % 2, r.integers(0, 4, 3).astype(float).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, grp int, y int, x array<double>")
    got = {(x.id, x.r): x.other for x in ml.nearest_neighbours(df, df, 3, block=13).collect()}
    for i, g, _, x in rows:
        order = sorted((math.dist(x, b), j) for j, h, _, b in rows if h != g)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in order]


def test_selection_never_sees_the_test_subject(spark):
    """A feature that tells only one subject apart is chosen in no fold that leaves it out."""
    rows = []
    for s in range(12):
        rows += [(s, s % 2, "good", s % 2 * 3 + 0.1 * s), (s, s % 2, "leak", 50.0 * (s == 0)), (s, s % 2, "flat", 1.0), (s, s % 2, "holes", None if s % 3 else 1.0 * s)]
    df = spark.createDataFrame(rows, "subject long, label int, feature string, value double")
    out = ml.subject_level(df, ["leak", "good", "flat", "holes"], top=2)
    assert {r.fold: r.pred for r in out["predictions"].collect()} == {s: s % 2 for s in range(12)}
    chosen = {(r.fold, r.feature) for r in out["selected"].collect()}
    assert (0, "leak") not in chosen and (0, "good") in chosen and not {f for _, f in chosen} & {"flat", "holes"}
    assert out["summary"].first().acc == 1.0 and {r.feature: r.stable for r in out["frequency"].collect()}["good"]
    by_model = ml.subject_level(df.where("subject < 6"), ["good"], ml.classifiers()["logistic"], top=1)["predictions"]
    assert {r.fold: r.pred for r in by_model.collect()} == {s: s % 2 for s in range(6)}


def test_windows_of_a_subject_are_tested_together(spark):
    rows = [(s, 10 * s + w, s % 2, f, v + 0.01 * w + 0.001 * s) for s in range(6) for w in range(3) for f, v in (("x", 5.0 * (s % 2)), ("own", 7.0 * s))]
    df = spark.createDataFrame(rows, "subject long, window_id long, label int, feature string, value double")
    out = ml.window_level(df, ["x", "own"], top=1)["predictions"].collect()
    assert len(out) == 18 and all(r.id // 10 == r.fold and r.pred == r.y for r in out)
    groups = ml.group_ablation(df.drop("window_id").groupBy("subject", "label", "feature").agg(F.avg("value").alias("value")), ["x", "own"], {"one": ["x"], "other": ["own"]}, top=1)
    assert {r.group: (r.n_features, r.acc) for r in groups.collect()}["one"] == (1, 1.0)


def test_workflow_over_models(spark):
    r = np.random.default_rng(4)
    rows = [(i, i % 2, [float(4 * (i % 2) + r.standard_normal()), 1000.0 * float(r.standard_normal())]) for i in range(60)]
    df = spark.createDataFrame(rows, "subject long, y int, x array<double>")
    out = ml.workflow(df, {k: ml.classifiers()[k] for k in ("logistic", "linear_svm")}, folds=2)
    assert out["predictions"].count() == 120 and all(r.acc > 0.9 and r.auc > 0.95 for r in out["summary"].collect())


def test_held_out_means(spark):
    df = spark.createDataFrame([(1, "f", 1.0), (1, "f", 3.0), (2, "f", 5.0), (3, "g", None), (3, "f", None)], "subject int, feature string, value double")
    got = {(r.fold, r.feature): (r.rows, r.n, r["mean"]) for r in ml.held_out_means(df).collect()}
    assert got[1, "f"] == (2, 1, 5.0) and got[2, "f"] == (3, 2, 2.0) and got[3, "f"] == (3, 3, 3.0) and got[3, "g"] == (0, 0, None) and got[1, "g"] == (1, 0, None)


# windows and modes


def test_window_features_of_any_subject_name(spark):
    x, y = walk(300).tolist(), (50 + 10 * np.sin(np.arange(300) / 5)).tolist()
    df = spark.createDataFrame([("a:b", i, float(i), x[i], y[i]) for i in range(270)], "subject string, seq long, t double, p double, q double")
    spans = windows.fixed_windows(df, 120, 90, 40).select("subject", "window_id", "start_idx", "end_idx")
    out = reports.window_features(df, spans, ("p", "q"))
    rows = {(r.window_id, r.feature): r.value for r in out.collect()}
    assert {r.subject for r in out.select("subject").distinct().collect()} == {"a:b"}
    assert len([k for k in rows if k[0] == 0]) == 2 * 37 and rows[0, "p_NumPoints"] == 120 and rows[0, "p_Mean"] == pytest.approx(np.mean(x[:120])) and rows[0, "q_EmbeddedVectors"] == 118
    assert rows[0, "p_Diff_Energy"] == pytest.approx((np.diff(x[:120]) ** 2).sum())
    assert rows[0, "q_RQA_DET"] > 0.9 > rows[0, "p_RQA_DET"] or rows[0, "q_RQA_DET"] > rows[0, "p_RQA_DET"]
    z = np.array(x[:120])
    z = (z - np.median(z)) / (1.4826 * np.median(np.abs(z - np.median(z))))
    v = np.stack([z[i : 118 + i] for i in range(3)], 1)
    assert rows[0, "p_PS_Eig1"] == pytest.approx(np.linalg.eigvalsh(np.cov(v, rowvar=False))[-1])
    # The last window is too short for anything but its size.
    assert {k for k in rows if k[0] == 2} == {(2, "p_NumPoints"), (2, "q_NumPoints")}


def test_embedding_of_a_sine(spark):
    df = table(spark, np.sin(2 * np.pi * np.arange(240) / 24) + 1e-3 * walk(240))
    out = {r.subject: (r.tau, r.m) for r in nonlinear.embedding_parameters(df.union(table(spark, [5] * 200, "flat")).union(table(spark, range(50), "short")), "autocorr", most_dim=4).collect()}
    assert out["flat"] == out["short"] == (1, 3) and out["a"][0] == 5 and 1 <= out["a"][1] <= 4
    per = spark.createDataFrame([("a", 5)], "subject string, tau long")
    same = lambda rows: sorted((r.i, tuple(r.x)) for r in rows.collect())
    assert same(nonlinear.embed(df, 3, per)) == same(nonlinear.embed(df, 3, 5))


def test_rebuilding_keeps_the_event(spark):
    t = np.arange(300)
    x = 100 + 5 * np.sin(2 * np.pi * t / 100) + np.where((t > 100) & (t < 130), 8.0, 0) + 0.5 * np.random.default_rng(1).standard_normal(300)
    df = table(spark, [None if i == 7 else v for i, v in enumerate(x)]).withColumn("baseline", F.lit(100.0)).withColumn("residual", F.col("p") - 100)
    df = df.withColumn("event", F.col("seq").between(101, 129)).withColumn("artifact", F.lit(False))
    out = vmd.reconstruct(df, 4, 2000.0)
    rebuilt = np.array([r.rebuilt for r in out["rebuilt"].orderBy("seq").collect()])
    assert len(rebuilt) == 300 and np.corrcoef(rebuilt, x)[0, 1] > 0.85 and abs(rebuilt.mean() - x.mean()) < 1
    table_ = out["table"].collect()
    assert len(table_) == 4 and any(r.selected for r in table_ if r.mode == 1)
    wide = vmd.with_modes(df, out["modes"], out["rebuilt"], (2, 3))
    assert {"VMD_Reconstructed", "VMD_Mode2", "VMD_Mode3"} <= set(wide.columns) and wide.count() == 300
    found = vmd.search(df, (2, 3), (1500.0, 3000.0)).orderBy("place").collect()
    scores = [r.objective for r in found]
    assert len(found) == 4 and scores == sorted(scores, reverse=True)
    best = found[0]
    assert best.objective == pytest.approx(0.25 * (1 - best.nrmse) + 0.25 * best["corr"] + 0.2 * best.iou + 0.15 * (1 - abs(best.peak_ratio - 1)) + 0.15 * (1 - abs(best.area_ratio - 1)))


def test_denoising_and_its_ablation(spark):
    clean = 100 + 4 * np.sin(np.arange(400) / 40)
    df = evaluate.semisynthetic(table(spark, clean, dt=1.2).withColumn("event", F.lit(False)), event="event")
    out = reports.ablation(df, smooth_width=7, passes=1).collect()
    assert [r.variant for r in sorted(out, key=lambda r: reports.VARIANTS.index(r.variant))] == list(reports.VARIANTS)
    by = {r.variant: r for r in out}
    assert by["full_model"].energy_reduction > 50 and by["full_model"].rmse < by["no_hard_range_gate"].rmse
    whole = denoise.denoise(df.select("subject", "seq", "t", F.col("observed").alias("p")), passes=1, smooth_width=7)
    assert whole.where("quality_flag <> 'good'").count() > 0 and whole.where("quality_flag = 'hard_range_reconstructed' and range_fixed not between 85 and 130").count() == 0


def test_ablation_without_final_smoothing_and_variant_by_variant(spark):
    clean = 100 + 4 * np.sin(np.arange(300) / 40)
    df = evaluate.semisynthetic(table(spark, clean, dt=1.2).withColumn("event", F.lit(False)), event="event")
    # The default width is the least one, which is no reason not to leave smoothing out.
    out = {r.variant: r for r in reports.ablation(df, passes=1, together=0).collect()}
    assert set(out) == set(reports.VARIANTS)
    plain = denoise.denoise(df.select("subject", "seq", "t", F.col("observed").alias("p")), passes=1).orderBy("seq").collect()
    energy = lambda c: sum((b[c] - a[c]) ** 2 for a, b in zip(plain, plain[1:]))
    assert out["full_model"].energy_clean == pytest.approx(energy("clean")) and out["no_final_smoothing"].energy_clean == pytest.approx(energy("preclean"))
    assert out["no_final_smoothing"].energy_clean > out["full_model"].energy_clean


def test_a_cut_leaves_no_shuffle_files(spark):
    import glob
    import time

    from wavelode.functions import lineage

    def files():
        places = [str(p) for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
        return {f for p in places for f in glob.glob(f"{p}/**/shuffle_*", recursive=True)}

    before = files()
    made = lineage.cut(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")).repartition(3, "n"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and made.count() == 10
    assert spark.conf.get(lineage.CLEANUP, "false") == "false"


def test_recurrence_is_measured_in_tasks_and_its_rows_go_on_in_parts(spark, monkeypatch):
    from wavelode.operators import nonlinear

    monkeypatch.setattr(nonlinear, "ROWS", 50)
    rng = np.random.default_rng(8)
    rows = [(s, i, None if s == 2 and i == 7 else float(v)) for s in range(6) for i, v in enumerate(np.round(rng.normal(size=40), 1))] + [(9, 0, 1.0)]
    df = spark.createDataFrame(rows, "subject long, seq long, p double")
    key = lambda r: {c: round(v, 9) if isinstance(v, float) else v for c, v in r.asDict().items()}
    want = {r.subject: key(r) for r in nonlinear.rqa(nonlinear.recurrence(df)).collect()}
    got = {r.subject: key(r) for r in nonlinear.recurrence_measures(df).collect()}
    assert got == want and set(got) == set(range(6))
    # Pairs of whole windows meet in no join, and no rows of pairs are shuffled.
    plan = nonlinear.recurrence_measures(df.where("p is not null and subject <> 2"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CheckpointFile" not in plan and plan.index("MapInArrow") < plan.index("Join")


def test_tables_of_modes_are_sent_to_no_task(spark):
    modes = spark.range(40).select(F.when(F.col("id") >= 0, "a").otherwise("b").alias("subject"), (F.col("id") % 2 + 1).cast("int").alias("mode"), F.floor(F.col("id") / 2).alias("seq"), F.rand(1).alias("value"))
    signal = spark.range(20).select(F.when(F.col("id") >= 0, "a").otherwise("b").alias("subject"), F.col("id").alias("seq"), F.col("id").cast("double").alias("t"), F.rand(2).alias("p"), F.rand(3).alias("residual"), (F.col("id") > 5).alias("event"), (F.col("id") < 3).alias("artifact"))
    found = vmd.mode_features(modes, signal)
    chosen = found.select("subject", "mode", (F.col("mode") == 1).alias("selected"))
    for df in (found, vmd.rebuild(modes, chosen, signal)):
        rows = df.collect()
        assert len(rows) in (2, 20) and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_reference_and_report(spark):
    df = table(spark, walk(200)).withColumn("clean", F.col("p") * 2).withColumn("event", F.col("p") > 100)
    assert all(r.reference == 2 * r.p for r in evaluate.clean_reference(df).collect())
    plain = evaluate.clean_reference(table(spark, walk(200))).collect()
    assert len(plain) == 200 and all(r.event is not None for r in plain)
    long = lambda n, by: spark.createDataFrame([("a", w, "f", float(w * by)) for w in range(n)], "subject string, window_id long, feature string, value double")
    out = reports.event_against_fixed(long(4, 1), long(9, 2), balanced=True)
    row = out["comparison"].first()
    assert (row.n1, row.n0) == (4, 4) and out["subject_level"].count() == 2


# columns and files


def test_long_and_wide_columns(spark):
    df = spark.createDataFrame([(1, "2.5", float("inf"), "x"), (2, "3", 1.0, None)], "subject int, a_SampEn string, a_Tau double, b_SampEn string")
    long = features.to_long(df, ["subject"], ["a_SampEn", "a_Tau"])
    assert {(r.subject, r.feature): r.value for r in long.collect()} == {(1, "a_SampEn"): 2.5, (1, "a_Tau"): None, (2, "a_SampEn"): 3.0, (2, "a_Tau"): 1.0}
    assert {r.subject: (r.a_SampEn, r.a_Tau) for r in features.to_wide(long, ["subject"], ["a_SampEn", "a_Tau"]).collect()} == {1: (2.5, None), 2: (3.0, 1.0)}
    assert features.feature_columns(df, ["a", "b"], ["SampEn"]) == ["a_SampEn"] and features.feature_columns(df, ["a", "b"], ["SampEn"], False) == ["a_SampEn", "b_SampEn"]
    assert features.available_signals(spark.createDataFrame([(1, 2)], "VMD_Mode3 int, Pressure_Clean int")) == ["Pressure_Clean", "VMD_Mode3"]
    assert features.recommended_signals() == list(features.SIGNALS) and features.recommended_signals(modes=(1,), rebuilt=False) == ["Pressure_Clean", "VMD_Mode1"]


def test_files_begin_with_the_describing_columns(spark, tmp_path):
    rows = [(s, 1, m, w, 0.5) for s in ("s1", "s2") for m in ("event_guided", "fixed300") for w in range(3)]
    df = spark.createDataFrame(rows, "SubjectID string, x int, WindowMethod string, WindowID int, StartTime double")
    out = sinks.master_features(df.where("WindowMethod = 'event_guided'"), df.where("WindowMethod = 'fixed300'").withColumn("y", F.lit(1)))
    assert out.columns == ["SubjectID", "WindowMethod", "WindowID", "StartTime", "x", "y"]
    assert list(sinks.META)[:4] == ["SubjectID", "Label", "WindowMethod", "WindowID"] and len(sinks.META) == 14
    for _ in range(2):  # written again over the first files
        sinks.write_master_features(out, str(tmp_path / "m"))
        sinks.write_results({"summary": sinks.method_counts(out)}, str(tmp_path / "r"))
    subjects = {r.SubjectID for r in out.select("SubjectID").distinct().collect()}
    shown = lambda folder: {f.name for f in folder.iterdir() if not f.name.startswith(".")}
    assert shown(tmp_path / "m") == {f"{s}_master_features.csv" for s in subjects} and shown(tmp_path) == {"m", "r_summary.csv"}
    text = (tmp_path / "m" / "s1_master_features.csv").read_text("utf-8")
    assert text.startswith("\ufeffSubjectID,WindowMethod,WindowID") and len(text.splitlines()) == 7
    assert (tmp_path / "r_summary.csv").read_text("utf-8").splitlines()[0] == "\ufeffWindowMethod,count"


def test_recordings_are_read_by_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SubjectID,Time,Pressure,PH,Temperature\na,0,100.5,,\na,1,NaN,7.1,36\n")
    rows = read_recordings(spark, str(tmp_path / "a.csv")).orderBy("Time").collect()
    assert rows[0].Pressure == 100.5 and rows[0].PH is None and math.isnan(rows[1].Pressure)


# streams


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{i // 60}:{i % 60:02d}", 60.0 if i == 5 else 100.0 + i % 7) for i in range(0, 400, 5)]
    df = spark.createDataFrame(rows, "s string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, step in (("gated", lambda d: monitor.gated_windows(d, "s", "ts", "v")), ("bursts", lambda d: monitor.bursts(d, "s", "ts", "v", 105.0))):
        query = step(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, step(df).collect()))


# models of all folds at once


def plain_kernel_machine(x, y, tx, steps=60):
    """Squared-hinge machine with a radial kernel and an unpenalised intercept, by Newton's method on the dual weights."""
    n = len(x)
    gamma = 1 / (x.shape[1] * x.var())
    kern = lambda a, b: np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
    k = kern(x, x)
    weight = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    beta, b = np.zeros(n), 0.0
    for _ in range(steps):
        short = y * (k @ beta + b) < 1
        w = 2 * weight * short
        # Stationarity of the penalised loss: beta + w * (k beta + b - y) = 0 and its sum over rows is 0.
        a = np.block([[np.eye(n) + w[:, None] * k, w[:, None]], [(w @ k)[None, :], np.array([[w.sum()]])]])
        new = np.linalg.solve(a + 1e-12 * np.eye(n + 1), np.r_[w * y, w @ y])
        if np.allclose(new, np.r_[beta, b], atol=1e-10):
            break
        beta, b = new[:n], new[n]
    return kern(tx, x) @ beta + b


def fold_table(spark, n=40, d=3, folds=4):
    r = np.random.default_rng(12)
    x = r.standard_normal((n, d))
    y = ((x**2).sum(1) + 0.3 * r.standard_normal(n) > d * 0.8).astype(int)
    rows = [(f, i, i % folds != f, int(y[i]), x[i].tolist()) for f in range(folds) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "fold long, id long, train boolean, y int, x array<double>")


def test_radial_machine_is_within_a_millionth_of_a_plain_one(spark):
    """Landmarks that are all training rows: margins of held-out rows agree to 1e-6, and the labels are told apart."""
    x, y, rows = fold_table(spark)
    got = {(r.fold, r.id): r.score for r in kernel_models.fit_and_predict(rows.repartition(5), kernel_models.Margin(kernel="rbf")).collect()}
    right = 0
    for f in range(4):
        train, test = np.arange(40) % 4 != f, np.arange(40) % 4 == f
        want = plain_kernel_machine(x[train], np.where(y[train] == 1, 1.0, -1.0), x[test])
        mine = np.array([got[f, i] for i in np.nonzero(test)[0]])
        assert np.abs(mine - want).max() < 1e-6
        right += ((mine > 0) == y[test]).sum()
    assert len(got) == 40 and right >= 30


def test_few_landmarks_still_tell_labels_apart(spark):
    _, y, rows = fold_table(spark, 200)
    got = kernel_models.fit_and_predict(rows, kernel_models.Margin(kernel="rbf", landmarks=40)).collect()
    assert np.mean([r.pred == y[r.id] for r in got]) > 0.8


def test_logistic_margins_solve_their_equations(spark):
    """The gradient of the penalised loss over a fold's training rows is nothing at the weights found."""
    x, y, rows = fold_table(spark)
    weights, _ = kernel_models.fit_weights(rows, kernel_models.Margin(loss="logistic"))
    for f, w in weights.items():
        t = np.arange(40) % 4 != f
        z, s = np.hstack([x[t], np.ones((t.sum(), 1))]), np.where(y[t] == 1, 1.0, -1.0)
        c = np.where(s > 0, t.sum() / (2 * (s > 0).sum()), t.sum() / (2 * (s < 0).sum()))
        g = z.T @ (-c * s / (1 + np.exp(s * (z @ w)))) + np.r_[w[:-1], 0]
        assert np.abs(g).max() < 1e-6


def test_folds_are_equal_in_size(spark):
    df = spark.range(103).select(F.col("id").alias("subject"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("w"))
    sizes = ml.equal_folds(df, 5).groupBy("own_fold").agg(F.count_distinct("subject").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert sorted(r.n for r in sizes) == [20, 20, 21, 21, 21] and all(r.rows == 3 * r.n for r in sizes)


def test_every_model_selects_inside_folds(spark):
    rows = [(s, s % 2, f, v) for s in range(20) for f, v in (("good", s % 2 * 3 + 0.1 * (s % 7)), ("leak", 50.0 * (s == 0)), ("noise", float((s * 7) % 5)))]
    df = spark.createDataFrame(rows, "subject long, label int, feature string, value double")
    assert ml.classifiers()["gbt"].getMaxIter() == 100
    for name in ("rbf_svm", "logistic_l1"):
        out = ml.k_fold_level(df, ["leak", "good", "noise"], ml.classifiers()[name], top=1)
        pred = out["predictions"].collect()
        assert len(pred) == 20 and np.mean([r.pred == r.y for r in pred]) == 1.0
        assert {r.feature for r in out["selected"].collect()} == {"good"}


# one window, one recording


def plain_blocks(v):
    yield np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2))


def plain_rqa(v, rate, theiler):
    """Recurrence measures from the whole distance matrix, line by line."""
    n = len(v)
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2))
    far = np.abs(np.subtract.outer(np.arange(n), np.arange(n))) > theiler
    eps = np.quantile(d[far], rate)
    r = (d <= eps) & far
    lengths = lambda flags: [len(x) for x in "".join("x" if f else " " for f in flags).split() if len(x) >= 2]
    diagonal = [x for k in range(-n + 1, n) for x in lengths(np.diag(r, k))]
    vertical = [x for j in range(n) for x in lengths(r[:, j])]
    mean = lambda x: float(np.mean(x)) if x else None
    return {"rr": r.sum() / (n * n - n), "det": sum(diagonal) / r.sum(), "lam": sum(vertical) / r.sum(), "l_mean": mean(diagonal), "l_max": max(diagonal, default=None), "tt": mean(vertical), "v_mean": mean(vertical), "epsilon": eps}


@pytest.mark.parametrize(("n", "m", "tau", "held"), [(120, 3, 1, 1 << 20), (150, 2, 4, 500), (90, 5, 3, 1000)])
def test_a_window_s_recurrence_equals_the_whole_matrix(monkeypatch, n, m, tau, held):
    monkeypatch.setattr(window_kernel, "HELD", held)
    x = np.round(np.sin(np.arange(n) / 5) + np.random.default_rng(n).standard_normal(n) / 4, 2)
    v = window_kernel.embed(x, m, tau)
    want = {k: pytest.approx(w, rel=1e-9) if w is not None else None for k, w in plain_rqa(v, 0.05, tau).items()}
    assert want == window_kernel.rqa(v, 0.05, tau) and want == window_kernel.rqa(v, 0.05, tau, held=[(0, next(iter(plain_blocks(v))))])
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2))
    i, j, near = window_kernel.nearest(v, tau, 20)
    for a, b, s in zip(i, j, near, strict=True):
        order = sorted(range(len(v)), key=lambda c: (d[a, c], abs(a - c), c))[:20]
        assert b == next(c for c in order if abs(a - c) > tau) and s == pytest.approx(d[a, b])


def test_windows_without_content_have_few_measures():
    assert window_kernel.measures(np.ones(300)) == {"num_points": 300} and window_kernel.measures(np.array([np.nan, 1.0])) == {"num_points": 1}
    found = window_kernel.measures(np.random.default_rng(1).standard_normal(104), tau=20, m=5)
    assert found["vectors"] == 24 and "rr" not in found and found["sampen"] is not None


def test_windows_have_their_own_embedding(spark):
    """A slow and a fast wave in one table: each window's delay follows its wave."""
    x = [math.sin(i / (2 if i < 400 else 9)) + 0.05 * math.sin(i * i) for i in range(800)]
    spans = spark.createDataFrame([("a", 0, 0, 400), ("a", 1, 400, 800)], "subject string, window_id long, start_idx long, end_idx long")
    out = reports.window_features(table(spark, x), spans, tau=None, m=None).where("feature in ('p_Tau', 'p_EmbeddingDim')").collect()
    tau = {r.window_id: r.value for r in out if r.feature == "p_Tau"}
    assert tau[0] < tau[1] and len(out) == 4
    want = [window_kernel.embedding_parameters(window_kernel.robust_z(np.array(x[lo : lo + 400]))) for lo in (0, 400)]
    assert [tau[0], tau[1]] == [w[0] for w in want]


def test_event_report_runs_on_given_tables(spark):
    out = catalog.queries()["event_vs_fixed_report"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.feature for r in out}) == len(out) and "p_NumPoints" in {r.feature for r in out}


def test_grid_carries_channels_and_masks(spark):
    """Irregular samples on a grid of 1 s: values by time, a channel's gaps by position, masks between and beside samples."""
    rows = [("a", 0, 0.0, 10.0, None, False), ("a", 1, 1.5, 13.0, 7.0, True), ("a", 2, 2.5, 11.0, None, True), ("a", 3, 6.0, 18.0, 8.0, False), ("a", 4, 7.2, None, None, False)]
    df = spark.createDataFrame(rows, "subject string, seq long, t double, p double, ph double, bad boolean")
    df = series.interpolate(df, F.col("ph").isNotNull(), x="seq", y="ph", out="ph")
    dt = spark.createDataFrame([("a", 1.0)], "subject string, dt double")
    out = series.uniform(df, ("p", "ph"), ("bad",), dt).orderBy("k").collect()
    assert [r.t for r in out] == [float(i) for i in range(8)]
    assert [r.p for r in out] == pytest.approx([10.0, 12.0, 12.0, 12.0, 14.0, 16.0, 18.0, 18.0])
    ph = [7.0, 7.0, 7.5, 8.0, 8.0]
    assert [r.ph for r in out] == pytest.approx(np.interp(np.arange(8.0), [0.0, 1.5, 2.5, 6.0, 7.2], ph).tolist())
    assert [r.bad for r in out] == [False, True, True, True, False, False, False, False]


def test_uniform_denoising_agrees_with_the_chain_on_an_even_recording(spark):
    """Where samples are the grid, widths in seconds are the same numbers, and both give one result."""
    x = walk(300, 5)
    x[[50, 120, 121, 200]] += [9, 7, 7, -11]
    df = table(spark, x).withColumn("ph", F.when(F.col("seq") % 3 == 0, F.col("seq").cast("double")))
    whole = {r.seq: r for r in denoise.denoise(df.drop("ph"), 60.0, 140.0, passes=1, baseline=61, noise=21, smooth_width=5).collect()}
    out = denoise.denoise_uniform(df, 60.0, 140.0, passes=1).orderBy("k").collect()
    assert len(out) == 300 and out[0].asDict().keys() == {"subject", "k", "t", "ph", "temperature", "raw", "range_fixed", "preclean", "clean", "baseline", "residual", "noise", "out_of_range", "artifact", "event", "quality_flag"}
    for r in out:
        w = whole[r.k]
        assert (r.raw, r.preclean, r.clean, r.baseline, r.noise) == pytest.approx((w.raw, w.preclean, w.clean, w.baseline, w.noise))
        assert r.artifact == (w.artifact or w.out_of_range) and r.event == w.event and r.temperature is None and r.residual == pytest.approx(r.clean - r.baseline)
    assert [r.ph for r in out][:7] == pytest.approx([0, 1, 2, 3, 4, 5, 6])


def test_widths_by_column_equal_one_width(spark):
    df = table(spark, walk(60)).union(table(spark, walk(1500, 2), "b")).withColumn("width", F.when(F.col("subject") == "a", 7).otherwise(11))
    for f, g in ((series.rolling_median, series.rolling_median), (series.rolling_mad, series.rolling_mad), (series.savgol, series.savgol_by_width)):
        got = {(r.subject, r.seq): r.x for r in g(df, "width", "p", "x").collect()}
        for subject, width in (("a", 7), ("b", 11)):
            for r in f(df.where(F.col("subject") == subject), width, "p", "x").collect():
                assert got[subject, r.seq] == pytest.approx(r.x)


def test_artifacts_are_as_many_as_asked(spark):
    df = table(spark, walk(3000), dt=1.2).union(table(spark, walk(30), "short", 1.2)).withColumn("event", (F.col("seq") % 500 < 40) & (F.col("subject") == "a"))
    out = evaluate.semisynthetic_counted(df, event="event")
    found = out["table"].where("subject = 'a'").toPandas()
    assert found["kind"].value_counts().to_dict() == evaluate.COUNTS and found["start"].is_unique and not (found["start"] % 500 < 40).any()
    flat, pulse = found[found["kind"] == "flatline_dropout"], found[found["kind"] == "short_pulse"]
    assert flat["n"].between(7, 15).all() and flat["n"].nunique() > 1 and pulse["n"].between(2, 4).all() and (pulse["amplitude"] < 0).any() and (pulse["amplitude"] > 0).any()
    rows = out["samples"].where("subject = 'a'").orderBy("seq").toPandas()
    covered = {s for lo, hi in zip(found["start"], found["end"], strict=True) for s in range(lo, hi)}
    assert set(rows.index[rows["artifact"]]) == covered
    rest = ~rows["artifact"]
    noise = (rows["observed"] - rows["p"])[rest]
    assert abs(noise.mean()) < 0.05 and noise.std() == pytest.approx(0.35 * 1.4826 * np.median(np.abs(np.diff(rows["p"]) - np.median(np.diff(rows["p"])))), rel=0.1)
    outlier = found[found["kind"] == "hard_range_outlier"]
    assert (rows["observed"].to_numpy()[outlier["start"]] == pytest.approx(outlier["amplitude"].to_numpy()))
    assert out["table"].where("subject = 'short'").count() == 18 and evaluate.semisynthetic_counted(df.limit(0))["samples"].count() == 0


def test_windows_are_measured_once_and_after_they_are_dealt(spark):
    spans = spark.createDataFrame([("a", 0, 0, 120)], "subject string, window_id long, start_idx long, end_idx long")
    plan = reports.window_features(table(spark, walk(120)), spans)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Repartition")


@pytest.mark.parametrize("n", [700, 900])
def test_a_wide_window_s_distances_are_not_kept(n):
    """Windows beyond the distances that are kept, with ties: one pass and bounds give what the whole matrix gives."""
    x = np.repeat(np.round(np.random.default_rng(n).standard_normal(n), 1), 3)[:n]
    v = window_kernel.embed(x, 3, 1)
    assert window_kernel.held_distances(v) is None
    want = {k: pytest.approx(w, rel=1e-9) if w is not None else None for k, w in plain_rqa(v, 0.05, 1).items()}
    assert want == window_kernel.rqa(v, 0.05, 1)
    d = next(plain_blocks(v))
    i, j, _ = window_kernel.nearest(v, 1, 30)
    for a, b in list(zip(i, j, strict=True))[::37]:
        order = sorted(range(len(v)), key=lambda c: (d[a, c], abs(a - c), c))[:30]
        assert b == next(c for c in order if abs(a - c) > 1)
    assert 2 * len(window_kernel.recurrent_pairs(v, 0.5, 1)[0]) == ((d <= 0.5) & (np.abs(np.subtract.outer(np.arange(len(v)), np.arange(len(v)))) > 1)).sum()


def test_neighbours_among_copies_and_far_away_equal_brute_force(spark):
    """Distances by products of matrices lose digits: near copies far from the origin still keep their order."""
    r = np.random.default_rng(5)
    x = [[1e6 + float(v) / 1024 for v in r.integers(0, 3, 3)] for _ in range(50)]
    df = spark.createDataFrame([(i, i, i % 2, v) for i, v in enumerate(x)], "id long, grp long, y int, x array<double>")
    got = {(g.id, g.r): g.other for g in ml.nearest_neighbours(df, df, 3).collect()}
    for i, a in enumerate(x):
        order = sorted((round(math.dist(a, b), 9), j) for j, b in enumerate(x) if i != j)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in order]


def test_a_block_of_neighbours_is_large():
    """Rows are sent once for each block, so that few blocks keep what is shuffled small."""
    assert ml.BLOCK >= 16_384


def test_balanced_sample_orders_one_range_of_the_hash(spark):
    fixed = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    event = spark.range(5000, 5700).select(F.col("id").cast("string").alias("id"))
    out = stats.balanced_sample(event, fixed, "id")
    want = sorted((hashlib.md5(str(i).encode()).hexdigest(), str(i)) for i in range(3000))[:700]
    assert sorted(r.id for r in out.collect()) == sorted([v for _, v in want] + [str(i) for i in range(5000, 5700)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert stats.balanced_sample(event, fixed.limit(5), "id").count() == 705 and stats.balanced_sample(event.limit(0), fixed, "id").count() == 0
    with_null = fixed.limit(2).union(spark.createDataFrame([(None,)], "id string"))
    assert stats.balanced_sample(event.limit(1), with_null, "id").where("id is null").count() == 1


def test_pairs_of_a_whole_window_are_not_joined(spark):
    """Recurrent pairs and neighbours come from the row of a window; a window with a missing value keeps its pairs beside it."""
    x = walk(40)
    df = table(spark, x).union(table(spark, [None if i == 7 else v for i, v in enumerate(x)], "holes"))
    v = np.stack([np.array(x)[i : 38 + i] for i in range(3)], 1)
    d = next(plain_blocks(v))
    far = np.abs(np.subtract.outer(np.arange(38), np.arange(38))) > 1
    eps = np.quantile(d[far], 0.05)
    out = nonlinear.recurrence(df).collect()
    assert {(r.i, r.j) for r in out if r.subject == "a"} == {(i, j) for i, j in zip(*np.nonzero((d <= eps) & far), strict=True)}
    assert all(r.n == 38 and r.epsilon == pytest.approx(eps) for r in out if r.subject == "a") and any(r.subject == "holes" for r in out)
    whole, others = nonlinear._by_window(nonlinear.embed(df))
    assert [r.subject for r in whole.collect()] == ["a"] and {r.subject for r in others.collect()} == {"holes"}
