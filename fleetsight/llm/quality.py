"""Quality: naive-Bayes support vectors over word n-gram indicators, fitted by dual coordinate descent.

A text is the set of its hashed word and punctuation n-grams. Each indicator is scaled by its class log-count ratio; a
linear hinge-loss model over the scaled indicators is fitted by dual coordinate descent; a logistic fit over rows that had
no part in it turns the margin into a score whose threshold balances both kinds of error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.toxicity import logistic, training_rows
from fleetsight.llm.words import ODD, WordHashes, mixed

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes.
TRAIN_ROWS = 12_000
#: Hashed indicators.
BUCKETS = 1 << 18
#: Words, and runs of one kind of other characters.
TOKEN = re.compile(r"\w+|[^\w\s]+")
SMOOTH = 1.0
COST = 1.0
PASSES = 12
#: Scores from here on are predicted good.
THRESHOLD = 0.7


def held_out(id_col: str) -> F.Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


class Indicators:
    """Text to the sorted bucket numbers of its n-grams of one and two tokens."""

    def __init__(self):
        self.hashes = WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        found = TOKEN.findall(text) if text else []
        h = self.hashes.of([w.encode() for w in found])
        pairs = mixed(h[:-1] * ODD + h[1:])
        return np.unique(np.r_[h, pairs] >> np.uint64(64 - 18)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum()) / math.sqrt(max(len(ids), 1)) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.margin(ids) + self.offset, -30), 30)))


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log of each indicator's share among good rows over its share among others."""
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for ids, g in zip(rows, good):
        (p if g else q)[ids] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, weight: np.ndarray, passes: int = PASSES, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights over indicators (scaled) and bias of the hinge-loss model; ``weight`` bounds each row's dual variable."""
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    norm = [1 / math.sqrt(max(len(x), 1)) for x in rows]
    square = [float((scale[x] ** 2).sum()) * n * n + 1 for x, n in zip(rows, norm)]
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            x, r = rows[i], scale[rows[i]] * norm[i]
            gradient = y[i] * (float(w[x] @ r) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), weight[i])
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * y[i] * r
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w * scale, bias


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    indicators = Indicators()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([indicators.of(t.as_py()).tobytes() for t in batch.column(0)], pa.binary()), batch.column(1), batch.column(2)], names=["ids", "label", "fold"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample of labelled documents. Without labels of both kinds every text scores alike."""
    train = training_rows(docs, labels, id_col, text_col, label_col, rows)
    found = train.select("text", "label", F.col("fold").cast("int")).mapInArrow(_packed, "ids binary, label int, fold int").collect()
    found.sort(key=lambda r: bytes(r["ids"]))  # the order of arrival does not matter
    sets = [np.frombuffer(r["ids"], np.int32) for r in found]
    good = np.array([r["label"] > 0 for r in found], bool)
    fitting = np.array([r["fold"] != 0 for r in found], bool)
    share = good[fitting].mean() if fitting.any() else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0)
    fit_sets = [s for s, f in zip(sets, fitting) if f]
    scale = ratios(fit_sets, good[fitting])
    # both kinds weigh alike, however rare the poor ones are
    weight = COST * np.where(good[fitting], 0.5 / share, 0.5 / (1 - share))
    weights, bias = dual_descent(fit_sets, np.where(good[fitting], 1.0, -1.0), scale, weight)
    model = Model(weights.astype(np.float32), bias, 1.0, 0.0)
    rest = [(model.margin(s), g) for s, g, f in zip(sets, good, fitting) if not f]
    x, y = np.array([m for m, _ in rest] or [0.0]), np.array([float(g) for _, g in rest] or [0.0])
    model.slope, model.offset = logistic(x, y)
    # the margin that errs least, both kinds weighing alike, is where the score passes the threshold
    cuts = np.unique(x)
    middles = (cuts[:-1] + cuts[1:]) / 2
    if len(middles) and 0 < y.sum() < len(y):
        poor, fine = np.sort(x[y == 0]), np.sort(x[y == 1])
        miss = np.searchsorted(fine, middles) / len(fine) + 1 - np.searchsorted(poor, middles) / len(poor)
        model.offset = math.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * float(middles[int(np.argmin(miss))])
    return model


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            scores = [model.score(indicators.of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``score``) of every row, null and empty texts (no indicator: the bias alone) and repeated rows included."""
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return mine.mapInArrow(_scorer(model), "id long, score double").withColumnRenamed("id", id_col)
