"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over all bytes of a text. Each overlapping chunk is max-pooled into
one value per filter and passed through a hidden layer; the mean over all chunks gives
the logit of one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_mod

#: Filters, their width in bytes, hidden units, and the step of chunks that are two steps long.
FILTERS, WIDTH, HIDDEN, STEP = 24, 6, 16, 128
#: Labelled documents that a model is fitted on, in expectation, where there are more, each by its whole text; chunks of
#: one that a training pass looks at, or more where the passes would not get to all of them; chunks held at a time.
SAMPLE, SEEN_CHUNKS, HELD_CHUNKS = 3000, 8, 4096
THRESHOLD = 0.3


class ByteNetwork:
    """Filters by byte and position, hidden layer and output weights."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "filters": (r.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32),
            "w1": (r.standard_normal((FILTERS, HIDDEN)) * FILTERS**-0.5).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": (r.standard_normal(HIDDEN) * HIDDEN**-0.5).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Response of every filter at every position that has WIDTH bytes."""
        n = len(data) - WIDTH + 1
        filters = self.p["filters"]
        out = filters[0].take(data[:n], 0)
        for k in range(1, WIDTH):
            out += filters[k].take(data[k : k + n], 0)
        return out

    def score(self, text: str | None) -> float:
        """Probability of label 1; the whole text counts, an empty one as bytes of zero."""
        data = _padded(text)
        steps = []
        for lo in range(0, len(data) - WIDTH + 1, 32 * STEP):
            part = self.responses(data[lo : lo + 32 * STEP + WIDTH - 1])
            steps.append(part.reshape(-1, STEP, FILTERS).max(1))
        pooled = np.concatenate(steps)
        pooled = np.maximum(pooled[:-1], pooled[1:])
        hidden = np.maximum(pooled @ self.p["w1"] + self.p["b1"], 0).mean(0)
        return float(1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"][0], -30, 30))))

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 1300, batch: int = 32, rate: float = 0.01, seed: int = 5) -> "ByteNetwork":
        """Fit by Adam on the log loss; each pass looks at some chunks of each document, and all passes together at all of them."""
        r = np.random.default_rng(seed)
        data = [_padded(t) for t in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        parts = -(-len(data) // batch)
        step, total = 0, parts * -(-steps // parts)
        passes = total // parts
        for turn in range(passes):
            for rows in np.array_split(r.permutation(len(data)), parts):
                chunks, owner = [], []
                for at, i in enumerate(rows):
                    n = (len(data[i]) - WIDTH + 1) // STEP - 1
                    for c in range(n) if n <= SEEN_CHUNKS else _turn(n, turn, passes, r):
                        chunks.append(data[i][c * STEP : (c + 2) * STEP + WIDTH - 1])
                        owner.append(at)
                grads = self._gradients(chunks, np.array(owner), labels[rows])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def _forward(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each filter responds most in each chunk, how much, and the hidden layer before its threshold."""
        p, wide = self.p, chunks.shape[1] - WIDTH + 1
        out = p["filters"][0].take(chunks[:, :wide], 0)
        for k in range(1, WIDTH):
            out += p["filters"][k].take(chunks[:, k : k + wide], 0)
        best = out.argmax(1)
        pooled = np.take_along_axis(out, best[:, None], 1)[:, 0]
        return best, pooled, pooled @ p["w1"] + p["b1"]

    def _gradients(self, chunks: list[np.ndarray], owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a batch, HELD_CHUNKS at a time: a long text needs the sum over its chunks before any of them."""
        p, held = self.p, [slice(lo, lo + HELD_CHUNKS) for lo in range(0, len(chunks), HELD_CHUNKS)]
        size = np.bincount(owner, minlength=len(labels)).astype(np.float32)
        mean = np.zeros((len(labels), HIDDEN), np.float32)
        for some in held:
            data = np.stack(chunks[some])
            found = self._forward(data)
            np.add.at(mean, owner[some], np.maximum(found[2], 0))
        mean /= size[:, None]
        prob = 1 / (1 + np.exp(-np.clip(mean @ p["w2"] + p["b2"], -30, 30)))
        error = ((prob - labels) / len(labels)).astype(np.float32)
        grads = {"filters": 1e-5 * p["filters"], "w1": np.zeros_like(p["w1"]), "b1": np.zeros_like(p["b1"]), "w2": mean.T @ error, "b2": error.sum(keepdims=True)}
        own = np.arange(FILTERS)
        for some in held:
            if len(held) > 1:
                data = np.stack(chunks[some])
                found = self._forward(data)
            best, pooled, before = found
            to_hidden = (error[:, None] * p["w2"] / size[:, None])[owner[some]] * (before > 0)
            to_pooled = to_hidden @ p["w1"].T
            rows = np.arange(len(data))[:, None]
            for k in range(WIDTH):
                np.add.at(grads["filters"][k], (data[rows, best + k], own), to_pooled)
            grads["w1"] += pooled.T @ to_hidden
            grads["b1"] += to_hidden.sum(0)
        return grads


def _turn(n: int, turn: int, passes: int, r) -> np.ndarray:
    """Chunks of a text of ``n`` chunks for one of the passes: its share, and drawn ones up to SEEN_CHUNKS."""
    share = np.arange(turn, n, passes)
    return share if len(share) >= SEEN_CHUNKS else np.union1d(share, r.choice(n, SEEN_CHUNKS - len(share), replace=False))


def _padded(text: str | None) -> np.ndarray:
    """A text's bytes, with zeros after them up to a whole number of steps, two at least."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    steps = max(2, -(-max(len(data) - WIDTH + 1, 1) // STEP))
    return np.concatenate([data, np.zeros(steps * STEP + WIDTH - 1 - len(data), np.uint8)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteNetwork:
    """Fit a network on the documents that ``labels`` (doc_id, quality) marks 0 or 1.

    Of more than ``sample`` labelled ids, those whose hash falls below a threshold are
    used, about ``sample`` of them at every size, with one whole text for each id, so the driver
    gets a bounded number of texts. An id with two
    different labels is left out. Without labels of both kinds the network stays as
    initialised.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).where("y = most").select("doc_id", "y")
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(sample / n * (1 << 24)))
    # About ``sample`` ids at most, so sending them to all tasks has a bound.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    # Of rows that repeat an id the smallest text counts, whatever their order.
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values("doc_id")
    y = rows["y"].to_numpy(np.float32)
    network = ByteNetwork()
    return network.fit(rows["text"].tolist(), y) if len(set(y.tolist())) == 2 else network


def score(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """doc_id and score of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            found = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    out = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document by a network fitted on those whose id leaves a remainder by 5.

    Returns doc_id, held_out, score and predicted, one row per row of ``docs``; other
    columns are ignored and rows that repeat a text have the same score. Null and empty
    texts are scored like a text of no bytes. A null id counts as held out. An empty table
    gives no rows.
    """
    remainder = crc_mod(F.col("doc_id"), 5)
    network = fit(docs.where(remainder != 0), labels.where(remainder != 0))
    return score(docs, network).select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
