"""Leakage-safe classification: folds by subject, nearest neighbours, and MLlib models."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import evaluate, features, kernel_models

#: Rows of a block in the nearest-neighbour search, folds whose models are fitted at a time, and buckets in which subjects are ranked.
BLOCK, AT_ONCE, RANKED = 16_384, 8, 4096
#: Pairs whose distances are held at a time.
PAIRS = 1 << 20
#: Rows of a partition that a fold's model is fitted from, so that a small fold is no more tasks than it needs.
PART_ROWS = 20_000


def held_out_means(df: DataFrame, value: str = "value") -> DataFrame:
    """(fold, feature, n, mean) of all rows but the fold's own, for every subject as fold.

    A fold's sums are the total's less the subject's own, so nothing is copied: the
    result has a row for each subject and feature, and so has the work.
    """
    own = df.groupBy("subject", "feature").agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.count(F.lit(1)).alias("rows"))
    total = own.groupBy("feature").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("rows").alias("trows"))
    every = own.select(F.col("subject").alias("fold")).distinct().crossJoin(total)
    mine = own.withColumnRenamed("subject", "fold")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = every.join(mine, ["fold", "feature"], "left")
    n = F.col("tn") - zero("n")
    return out.select("fold", "feature", (F.col("trows") - zero("rows")).alias("rows"), n.alias("n"), F.try_divide(F.col("ts") - zero("s"), n).alias("mean"))


def fold_rows(df: DataFrame, group: str = "subject") -> DataFrame:
    """Rows of all leave-one-group-out folds: every row once for each group, as fold, with whether it trains there.

    For groups that are few, as patients are: the table is the input times their number.
    Where they are many ``fold_of`` deals them to a fixed number of folds first.
    """
    folds = df.select(F.col(group).alias("fold")).distinct()
    return df.crossJoin(folds).withColumn("train", F.col(group) != F.col("fold"))


def fold_of(subject, k: int):
    """Fold of a subject from 0 to k - 1, by hash; all rows of a subject share it."""
    return F.pmod(F.xxhash64(subject), F.lit(k)).cast("int")


def equal_folds(df: DataFrame, k: int = 5, subject: str = "subject") -> DataFrame:
    """Add own_fold from 0 to k - 1: subjects in hash order are dealt in turn, so folds differ by one subject at most.

    Places come from counts of buckets of the hash and the order inside each bucket, so no task orders all subjects.
    """
    h = F.pmod(F.xxhash64(subject), F.lit(1 << 40))
    bucket = F.floor(h / ((1 << 40) // RANKED)).cast("int")
    subjects = cut(df.select(subject).distinct().select(subject, h.alias("_h"), bucket.alias("_b")))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    # At most RANKED rows.
    offsets = subjects.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", subject)) - 1
    placed = subjects.withColumn("_place", place).join(F.broadcast(offsets), "_b").select(subject, ((F.col("_place") + F.col("_before")) % k).cast("long").alias("own_fold"))
    return df.join(placed, subject)


def k_fold_rows(df: DataFrame, k: int = 5) -> DataFrame:
    """Rows of k folds of subjects, equal in size: every row once for each fold, with whether it trains there."""
    folds = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    rows = equal_folds(df, k).withColumn("fold", folds)
    return rows.withColumn("train", F.col("own_fold") != F.col("fold")).drop("own_fold")


def _nearest_block(k: int):
    def run(key, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"fold": [], "id": [], "other": [], "y_other": [], "distance": []})
        if asked.empty or rows.empty:
            return none
        q, x = np.stack(asked["x"]).astype(float), np.stack(rows["x"]).astype(float)
        # Vectors without a finite length are near nothing.
        finite = lambda v: np.isfinite((v * v).sum(1))
        asked, rows, q, x = asked[finite(q)], rows[finite(x)], q[finite(q)], x[finite(x)]
        if asked.empty or rows.empty:
            return none
        ids, length, size = rows["id"].to_numpy(), (q * q).sum(1), (x * x).sum(1)
        codes = pd.factorize(pd.concat([rows["grp"], asked["grp"]], ignore_index=True), use_na_sentinel=False)[0]
        own, of = codes[: len(x)], codes[len(x) :]
        by_group = np.argsort(own, kind="stable")
        begins, ends = np.searchsorted(own[by_group], of, "left"), np.searchsorted(own[by_group], of, "right")
        columns = np.ascontiguousarray(np.vstack([-2 * x.T, size]))
        out, step = [], max(1, PAIRS // len(x))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            # Squares, less the query's own, by a product of matrices, whose error is far below the slack: what can be among the best is measured exactly.
            square = np.hstack([part, np.ones((len(part), 1))]) @ columns
            for i in range(len(part)):
                if begins[lo + i] < ends[lo + i]:
                    square[i, by_group[begins[lo + i] : ends[lo + i]]] = np.inf
            # The k-th best of some rows is a bound for that of all.
            some = square[:, :: max(1, len(x) // 2048)]
            bound = np.partition(some, min(k, some.shape[1]) - 1, axis=1)[:, min(k, some.shape[1]) - 1]
            if some.shape[1] < k:
                bound = np.full(len(part), np.inf)
            worst = np.maximum(bound + length[lo : lo + step], 0.0)
            slack = 1e-11 * (length[lo : lo + step] + size.max()) + 1e-8 * np.sqrt(worst) + 1e-17
            limit = np.where(np.isfinite(bound), bound + slack, np.finfo(float).max)
            at = np.flatnonzero(square <= limit[:, None])
            i, j = at // len(x), at % len(x)
            d = np.empty(len(at))
            for a in range(0, len(at), PAIRS // 8):
                d[a : a + PAIRS // 8] = np.round(np.sqrt(((part[i[a : a + PAIRS // 8]] - x[j[a : a + PAIRS // 8]]) ** 2).sum(1)), 9)
            # Ties go to the smaller id, as they do where blocks are merged.
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            best = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(d)
            i, j = i[best], j[best]
            out.append(pd.DataFrame({"fold": asked["fold"].to_numpy()[lo + i], "id": asked["id"].to_numpy()[lo + i], "other": ids[j], "y_other": rows["y"].to_numpy()[j], "distance": d[best]}))
        return pd.concat(out) if out else none

    return run


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """The k nearest rows (id, grp, y, x) of every query that belong to other groups: (id, other, y_other, distance, r).

    Distances that agree to nine digits tie, and the smaller id comes first. Where ``rows`` has a column fold, queries meet the rows of their own fold only, and the
    result has it too. Every block of queries meets every block of rows of its fold and
    gives the k best of each query, which are merged: a task holds two blocks.
    """
    folded = "fold" in rows.columns
    own = lambda df: df if folded else df.withColumn("fold", F.lit(0).cast("long"))
    kind = rows.schema["fold"].dataType.simpleString() if folded else "long"
    size = lambda df, name: own(df).groupBy("fold").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = cut(size(queries, "lefts").join(size(rows, "rights"), "fold"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    asked = own(queries).join(sizes, "fold").select("fold", "id", "grp", "x", deal("lefts").alias("p"), every("rights").alias("q"))
    # Renamed, as queries may be rows of the same table.
    renamed = [F.col(c).alias(c) for c in ("fold", "id", "grp", "x")]
    against = own(rows).join(sizes, "fold").select(*renamed, F.col("y").cast("int").alias("y"), deal("rights").alias("q"), every("lefts").alias("p"))
    found = asked.groupBy("fold", "p", "q").cogroup(against.groupBy("fold", "p", "q")).applyInPandas(_nearest_block(k), f"fold {kind}, id long, other long, y_other int, distance double")
    rank = F.row_number().over(Window.partitionBy("fold", "id").orderBy("distance", "other"))
    found = found.withColumn("r", rank).where(F.col("r") <= k)
    return found if folded else found.drop("fold")


def knn_vote(neighbours: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, pred, score): majority label of the neighbours and the share of label 1."""
    s = neighbours.groupBy(*by, "id").agg(F.avg((F.col("y_other") == 1).cast("double")).alias("score"))
    return s.select(*by, "id", (F.col("score") > 0.5).cast("int").alias("pred"), "score")


def select_in_folds(df: DataFrame, columns: list[str], top: int = 15, most_missing: float = 0.3, least_variance: float = 1e-10, most_corr: float = 0.9, how: str = "cliff_abs", least: float | None = None) -> DataFrame:
    """Features chosen and scaled inside each fold, from its training rows alone.

    ``df`` is long: (fold, train, subject, label, feature, value), where subject is the
    row's id and ``columns`` the order of features. In turn: missing values and variance,
    medians for missing values, rank correlation, effect size, and standard scaling. Folds
    whose training rows have one label are left out. Returns the chosen features' rows of all
    rows of a fold, with their place r by effect.
    """
    train = df.where("train")
    both = train.groupBy("fold").agg(F.count_distinct("label").alias("n")).where("n = 2").select("fold")
    df = cut(df.join(both, "fold"))
    kept = features.missing_variance(df.where("train"), ("fold",), most_missing, least_variance)
    filled = cut(features.impute(df.join(kept, ["fold", "feature"], "left_semi"), ("fold",), "train"))
    apart = features.correlation_filter(filled.where("train"), ("fold",), most_corr, columns)
    filled = cut(filled.join(apart, ["fold", "feature"], "left_semi"))
    chosen = cut(features.effect_top(filled.where("train"), top, how, least, ("fold",), columns).select("fold", "feature", "r"))
    return features.standardize(filled.join(chosen, ["fold", "feature"]), ("fold",), "train")


def _vectors(selected: DataFrame) -> DataFrame:
    """(fold, id, train, y, x): a row's chosen features in the order of their effect."""
    x = F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda v: v["value"])
    return selected.groupBy("fold", F.col("subject").alias("id"), "train", F.col("label").alias("y")).agg(x.alias("x"))


def evaluate_folds(df: DataFrame, columns: list[str], model="knn", k: int = 3, **selection) -> dict[str, DataFrame]:
    """Selection inside folds and one model: predictions, summary, selected features and how often each was.

    ``df`` is what ``fold_rows`` or ``k_fold_rows`` makes of a long table. ``model`` is "knn"; a
    ``kernel_models.Margin``, which is fitted for all folds at once; or an MLlib classifier,
    of which one is fitted per fold, AT_ONCE of them side by side.
    """
    selected = cut(select_in_folds(df, columns, **selection))
    vectors = cut(_vectors(selected))
    if model == "knn":
        rows = vectors.where("train").withColumn("grp", F.lit(0))
        asked = vectors.where("not train").withColumn("grp", F.lit(1))
        pred = knn_vote(nearest_neighbours(rows, asked, k), ("fold",)).join(vectors.where("not train").select("fold", "id", "y"), ["fold", "id"])
    elif isinstance(model, kernel_models.Margin):
        pred = kernel_models.fit_and_predict(vectors, model)
    else:
        pred = _in_parallel(df.sparkSession, lambda fold: _fit_and_predict(vectors.where(F.col("fold") == fold), F.col("train"), model), [r.fold for r in vectors.select("fold").distinct().orderBy("fold").collect()])
    pred = pred.select("fold", "id", F.col("y").cast("int").alias("y"), "pred", "score")
    per_fold = selected.select("fold", "feature").distinct()
    folds = pred.select("fold").distinct().count()
    return {"predictions": pred, "summary": evaluate.binary_metrics(pred).crossJoin(evaluate.roc_auc(pred)), "selected": per_fold, "frequency": evaluate.selection_frequency(per_fold, folds)}


def _in_parallel(spark, run: Callable, folds: list) -> DataFrame:
    """The union of what ``run`` gives for each fold; folds submit their jobs side by side, each with its plan cut."""
    if not folds:
        raise ValueError("no fold has training rows of both labels")
    with ThreadPool(min(AT_ONCE, len(folds))) as pool:
        parts = pool.map(inheritable_thread_target(spark)(lambda fold: cut(run(fold))), folds)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _completed(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for every key and each of ``columns``, with null where the long table has none."""
    every = df.select(*keys).distinct().withColumn("feature", F.explode(F.array(*map(F.lit, columns))))
    return every.join(df.select(*keys, "feature", "value"), [*keys, "feature"], "left")


def subject_level(df: DataFrame, columns: list[str], model="knn", **selection) -> dict[str, DataFrame]:
    """Leave one subject out, over a long table with one value per subject and feature (subject, label, feature, value).

    Features are those of ``columns``; one that a subject lacks is missing there.
    """
    rows = _completed(df.where("label is not null"), ["subject", "label"], columns)
    return evaluate_folds(fold_rows(rows), columns, model, **selection)


def window_level(df: DataFrame, columns: list[str], model="knn", **selection) -> dict[str, DataFrame]:
    """Leave one subject out, over windows: (subject, window_id, label, feature, value), window_id being unique.

    All windows of a subject are tested together and never train for one another.
    """
    rows = fold_rows(_completed(df.where("label is not null and subject is not null"), ["subject", "window_id", "label"], columns))
    return evaluate_folds(rows.drop("subject").withColumnRenamed("window_id", "subject"), columns, model, **selection)


def k_fold_level(df: DataFrame, columns: list[str], model="knn", folds: int = 5, **selection) -> dict[str, DataFrame]:
    """Folds of subjects, equal in size, over a long table with one value per subject and feature, as ``subject_level``."""
    rows = _completed(df.where("label is not null"), ["subject", "label"], columns)
    return evaluate_folds(k_fold_rows(rows, folds), columns, model, **selection)


def group_ablation(df: DataFrame, columns: list[str], groups: dict[str, list[str]], model="knn", **selection) -> DataFrame:
    """Subject-level results with the features of one group at a time: group, n_features and the summary's columns."""
    out = None
    for name, members in groups.items():
        own = [c for c in columns if c in members]
        part = subject_level(df.where(F.col("feature").isin(own)), own, model, **selection)["summary"].select(F.lit(name).alias("group"), F.lit(len(own)).alias("n_features"), "*")
        out = part if out is None else out.unionByName(part)
    return out


#: Names of the models, which need a session to be made.
MODELS = ("logistic", "logistic_l1", "linear_svm", "rbf_svm", "random_forest", "gbt")


def classifiers() -> dict:
    """The usual models by name: margins fitted for all folds at once, MLlib's trees, and nearest neighbours."""
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    return {
        "logistic": LogisticRegression(regParam=0.01, **common),
        "logistic_l1": LogisticRegression(regParam=0.05, elasticNetParam=1.0, **common),
        "linear_svm": LinearSVC(regParam=0.01, **common),
        "rbf_svm": kernel_models.Margin(loss="hinge", kernel="rbf"),
        "random_forest": RandomForestClassifier(numTrees=300, minInstancesPerNode=2, seed=42, **common),
        "gbt": GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=42, **common),
    }


def _fit_and_predict(rows: DataFrame, train, model) -> DataFrame:
    """Fit on the rows where ``train`` holds, labels weighted to balance, and predict the others: (fold, id, y, pred, score)."""
    counts = {r.y: r.n for r in rows.where(train).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    rows = rows.coalesce(max(1, -(-total // PART_ROWS)))
    weight = F.when(F.col("y") == 1, float(total / (2 * counts[1]))).otherwise(float(total / (2 * counts[0])))
    rows = rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>"))).withColumn("weight", weight).withColumn("y", F.col("y").cast("double"))
    pred = model.fit(rows.where(train)).transform(rows.where(~train))
    score = vector_to_array("probability")[1] if "probability" in pred.columns else vector_to_array("rawPrediction")[1]
    return pred.select("fold", "id", F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"), score.alias("score"))


def cross_validate(df: DataFrame, model, folds: int = 5) -> DataFrame:
    """Out-of-fold predictions (subject, fold, y, pred, score) of one model over rows (subject, y, x).

    Components are scaled and labels weighted from each fold's training rows. A fold whose
    training rows have one label is skipped.
    """
    df = cut(df.withColumn("fold", fold_of("subject", folds)))
    if isinstance(model, kernel_models.Margin):
        each = df.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        rows = each.select("fold", F.col("subject").alias("id"), (F.col("_own") != F.col("fold")).alias("train"), "y", "x")
        return kernel_models.fit_and_predict(kernel_models.standardized(rows), model).withColumnRenamed("id", "subject")
    counts = df.groupBy("fold", "y").count().toPandas()

    def one(k: int) -> DataFrame:
        # One row: mean and deviation of every component of the training rows.
        parts = df.where(F.col("fold") != k).select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        scale = parts.agg(F.sort_array(F.collect_list(F.struct("at", "m", "s"))).alias("scale"))
        scaled = F.transform("x", lambda v, i: (v - F.col("scale")[i]["m"]) / F.when(F.col("scale")[i]["s"] > 0, F.col("scale")[i]["s"]).otherwise(1.0))
        rows = cut(df.crossJoin(F.broadcast(scale)).select(F.col("subject").alias("id"), "fold", "y", scaled.alias("x")))
        return _fit_and_predict(rows, F.col("fold") != k, model).withColumnRenamed("id", "subject").withColumn("fold", F.lit(k))

    usable = [k for k in range(folds) if len(counts[counts["fold"] != k].groupby("y")["count"].sum()) == 2 and len(counts[counts["fold"] == k])]
    return _in_parallel(df.sparkSession, one, usable)


def workflow(df: DataFrame, models: dict | None = None, folds: int = 5) -> dict[str, DataFrame]:
    """Predictions and summary of all models over the same folds."""
    pred = None
    for name, model in (models or classifiers()).items():
        part = cross_validate(df, model, folds).withColumn("model", F.lit(name))
        pred = part if pred is None else pred.unionByName(part)
    summary = evaluate.binary_metrics(pred, "model").join(evaluate.roc_auc(pred, "model"), "model")
    return {"predictions": pred, "summary": summary}


def pca(df: DataFrame, k: int = 2) -> DataFrame:
    """(id, pc1, pc2, ...) of vectors (id, x); a component's sign is such that its largest loading is positive."""
    rows = df.select("id", array_to_vector(F.col("x").cast("array<double>")).alias("v"))
    fitted = PCA(k=k, inputCol="v", outputCol="c").fit(rows)
    loadings = fitted.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    parts = vector_to_array("c")
    return fitted.transform(rows).select("id", *[(parts[i] * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)])
