"""Margin classifiers of all folds at once: logistic loss or squared hinge, linear or with a radial kernel.

A step of Newton's method needs two sums over a fold's training rows, the gradient and the
curvature, which are added up inside tasks and then by fold; so one job per step serves all
folds, and nothing but sums and weights leaves the tasks. The radial kernel is that of a few
landmarks of each fold: rows become their similarities to the landmarks, whitened, and a linear
margin of these is a kernel machine (exactly so where the landmarks are all training rows).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


class Margin(NamedTuple):
    """Loss ("logistic" or "hinge", squared), kernel ("linear" or "rbf"), penalty C of the rows' loss, landmarks of a fold, and steps at most."""

    loss: str = "hinge"
    kernel: str = "linear"
    c: float = 1.0
    landmarks: int = 256
    steps: int = 30
    settled: float = 1e-8


def standardized(rows: DataFrame) -> DataFrame:
    """Rows (fold, id, train, y, x) with each component scaled by its fold's training rows."""
    parts = rows.where("train").select("fold", F.posexplode("x").alias("at", "v")).groupBy("fold", "at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = parts.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("at", "m", "s"))).alias("scale"))
    scaled = F.transform("x", lambda v, i: (v - F.col("scale")[i]["m"]) / F.when(F.col("scale")[i]["s"] > 0, F.col("scale")[i]["s"]).otherwise(1.0))
    # One row a fold.
    return rows.join(F.broadcast(scale), "fold").select("fold", "id", "train", "y", scaled.alias("x"))


def _landmarks(rows: DataFrame, model: Margin) -> dict:
    """By fold: landmarks, gamma and the whitening of their kernel. At most ``landmarks`` rows of each fold, by hash of their id."""
    train = rows.where("train")
    spread = train.select("fold", F.explode("x").alias("v")).groupBy("fold").agg(F.var_pop("v").alias("var")).toPandas().set_index("fold")["var"]
    sizes = {r.fold: r.n for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(sizes.values(), default=0)
    share = int(min(1.0, 2 * model.landmarks / max(most, 1)) * (1 << 30))
    some = train.where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1 << 30)) < share)
    some = some.groupBy("fold").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("id", F.lit(31)).alias("h"), "id", "x"))), 1, model.landmarks).alias("held"))
    found = {}
    for r in some.collect():
        z = np.array([h.x for h in r.held], float)
        gamma = 1.0 / (z.shape[1] * spread[r.fold]) if spread[r.fold] > 0 else 1.0
        values, vectors = np.linalg.eigh(_kernel(z, z, gamma))
        kept = values > 1e-10 * values.max()
        found[r.fold] = (z, gamma, vectors[:, kept] / np.sqrt(values[kept]))
    return found


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(sq, 0))


def _mapped(x: np.ndarray, marks) -> np.ndarray:
    """Features of rows with a one at the end for the intercept."""
    if marks is not None:
        x = _kernel(x, marks[0], marks[1]) @ marks[2]
    return np.hstack([x, np.ones((len(x), 1))])


def _sums(loss: str, z: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of rows with labels -1 and 1, in one array."""
    margin = y * (z @ w)
    if loss == "logistic":
        p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
        value, slope, bend = np.logaddexp(0, -margin), -p * y, p * (1 - p)
    else:
        short = np.maximum(0, 1 - margin)
        value, slope, bend = short**2, -2 * short * y, 2.0 * (short > 0)
    return np.concatenate([[(weight * value).sum()], z.T @ (weight * slope), (z.T @ (z * (weight * bend)[:, None])).ravel()])


def fit_weights(rows: DataFrame, model: Margin) -> tuple[dict, dict]:
    """Weights of each fold, the intercept last and unpenalised, and its landmarks; labels are weighted to balance."""
    train = rows.where("train")
    counts: dict = {}
    for r in train.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.fold, {})[int(r.y)] = r.n
    counts = {f: c for f, c in counts.items() if len(c) == 2}
    marks = _landmarks(rows, model) if model.kernel == "rbf" else {}
    width = {r.fold: r.d for r in train.groupBy("fold").agg(F.max(F.size("x")).alias("d")).collect()}
    weights = {f: np.zeros((marks[f][2].shape[1] if f in marks else width[f]) + 1) for f in counts}
    tried = dict(weights)
    before: dict = {}
    steps = dict.fromkeys(weights)
    open_ = set(weights)
    for _ in range(model.steps):
        if not open_:
            break
        now = {f: tried[f] for f in open_}

        def partial(batches):
            for pdf in batches:
                for fold, part in pdf.groupby("fold", sort=False):
                    if fold in now:
                        y = np.where(part["y"].to_numpy() == 1, 1.0, -1.0)
                        n = counts[fold]
                        weight = model.c * np.where(y > 0, sum(n.values()) / (2 * n[1]), sum(n.values()) / (2 * n[0]))
                        z = _mapped(np.array(list(part["x"]), float), marks.get(fold))
                        yield pd.DataFrame({"fold": [fold], "sums": [_sums(model.loss, z, y, weight, now[fold])]})

        kind = rows.schema["fold"].dataType.simpleString()
        found = train.select("fold", "y", "x").mapInPandas(partial, f"fold {kind}, sums array<double>")
        # A few thousand numbers a fold.
        added = found.select("fold", F.posexplode("sums").alias("at", "v")).groupBy("fold", "at").agg(F.sum("v").alias("v")).groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s"))
        for r in added.collect():
            f, s = r.fold, np.array([x.v for x in r.s])
            d = len(weights[f])
            penalty = np.r_[np.ones(d - 1), 0.0]
            value = s[0] + 0.5 * (penalty * tried[f] ** 2).sum()
            if f in before and value > before[f] + 1e-12 * abs(before[f]):
                # Too far: half the step is tried.
                steps[f] = steps[f] / 2
                tried[f] = weights[f] + steps[f]
                if np.abs(steps[f]).max() < model.settled:
                    open_.discard(f)
                continue
            gradient, curvature = s[1 : d + 1] + penalty * tried[f], s[d + 1 :].reshape(d, d) + np.diag(penalty + 1e-9)
            weights[f], before[f] = tried[f], value
            steps[f] = -np.linalg.solve(curvature, gradient)
            tried[f] = weights[f] + steps[f]
            if np.abs(steps[f]).max() < model.settled:
                open_.discard(f)
    return weights, marks


def fit_and_predict(rows: DataFrame, model: Margin) -> DataFrame:
    """Predictions (fold, id, y, pred, score) for the rows that do not train, by a model fitted for each fold.

    ``rows`` is (fold, id, train, y, x). The score is the margin. Folds whose training rows have one
    label are left out. Landmarks, weights and sums are bounded by the model's parameters and
    the number of folds.
    """
    rows = cut(rows)
    weights, marks = fit_weights(rows, model)

    def predict(batches):
        for pdf in batches:
            for fold, part in pdf.groupby("fold", sort=False):
                if fold in weights:
                    score = _mapped(np.array(list(part["x"]), float), marks.get(fold)) @ weights[fold]
                    yield part[["fold", "id", "y"]].assign(pred=(score > 0).astype(np.int32), score=score)

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("fold", "id")}
    return rows.where("not train").select("fold", "id", F.col("y").cast("int").alias("y"), "x").mapInPandas(predict, f"fold {kinds['fold']}, id {kinds['id']}, y int, pred int, score double")
