"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

1. Token scores: log-odds of a token in toxic against other texts under a Dirichlet prior in proportion to its share of
   all texts, moved towards zero by ``SHRINK`` standard deviations, less a constant drift per token.
2. A linear scan finds all maximal-scoring segments of a text.
3. Over clean text the best segment of a random text follows an extreme-value law: its rate ``lam`` solves
   ``sum p_i exp(lam s_i) = 1``, its constant ``K`` is fitted to the best segments of clean calibration texts.
4. A text's statistic sums ``lam S - ln(K n)`` over its significant segments; a logistic fit on calibration texts, which
   had no part in the token scores, turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes.
TRAIN_ROWS = 20_000
#: One training row in so many calibrates; the others score tokens.
CALIBRATION_SHARE = 4
#: Weight of the prior, as a share of all training tokens.
PRIOR = 1.0
SHRINK = 1.0
#: Tokens seen less often in the training texts have no weight of their own.
LEAST_SEEN = 3
DRIFT = 0.2
#: A segment is significant if so few are expected by chance in a clean text.
E_VALUE = 1.0
TOKEN = re.compile(r"[^\W_]+")


def held_out(id_col: str) -> F.Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    weights: dict[str, float]
    lam: float
    k: float
    slope: float
    offset: float

    def score(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Probability that a text of ``n`` tokens with these segments is toxic."""
        value = squashed(statistic(segments, n, self.lam, self.k))
        return 1 / (1 + math.exp(-min(max(self.slope * value + self.offset, -30), 30)))


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def maximal_segments(hits: list[tuple[int, float]], n: int, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a text of ``n`` tokens.

    ``hits``: (token number, weight) of the tokens with a weight; each token also costs ``drift``. One pass; every
    candidate remembers the nearest earlier one that starts lower, so each is looked at a bounded number of times.
    """
    first, last, left, right, lower = [], [], [], [], []
    total, done = 0.0, 0
    for at, weight in hits:
        total -= drift * (at - done)
        done = at + 1
        score = weight - drift
        low = total
        total += score
        if score <= 0:
            continue
        begin, high = at, total
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = lower[j]
            if j < 0 or right[j] >= high:
                break
            begin, low = first[j], left[j]
            del first[j:], last[j:], left[j:], right[j:], lower[j:]
            j = len(left) - 1
        first.append(begin)
        last.append(at)
        left.append(low)
        right.append(high)
        lower.append(j)
    return [(a, b, r - low) for a, b, r, low in zip(first, last, right, left)]


def token_weights(toxic: Counter, clean: Counter) -> dict[str, float]:
    """Log-odds of tokens that differ by more than SHRINK standard deviations from none, moved towards zero by as much."""
    nt, nc = sum(toxic.values()), sum(clean.values())
    prior = PRIOR * (nt + nc)
    out = {}
    for word in toxic.keys() | clean.keys():
        t, c = toxic[word], clean[word]
        alpha = prior * (t + c) / (nt + nc)
        odds = math.log((t + alpha) / (nt + prior - t - alpha + 1e-9)) - math.log((c + alpha) / (nc + prior - c - alpha + 1e-9))
        sure = abs(odds) - SHRINK * math.sqrt(1 / (t + alpha) + 1 / (c + alpha))
        if sure > 0:
            out[word] = math.copysign(sure, odds)
    return out


def decay_rate(weights: dict[str, float], clean: Counter) -> float:
    """The positive root of sum p exp(lam s) = 1 over the scores of clean tokens; 1 if no token scores above zero."""
    total = sum(clean.values())
    known = [(clean[w], x) for w, x in weights.items() if clean[w]]
    best = max((x for x in weights.values()), default=0.0) - DRIFT
    if total == 0 or best <= 0:
        return 1.0
    counts = np.array([c for c, _ in known] + [total - sum(c for c, _ in known), 0.5], float)
    scores = np.array([x - DRIFT for _, x in known] + [-DRIFT, best])
    share = counts / counts.sum()
    lo, hi = 1e-6, 1.0
    grown = lambda lam: float(share @ np.exp(np.minimum(lam * scores, 500)))
    while grown(hi) < 1 and hi < 1e3:
        hi *= 2
    if grown(lo) >= 1:
        return 0.1  # clean text drifts upwards: too few labels to tell
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if grown(mid) < 1 else (lo, mid)
    return hi


def statistic(segments: list[tuple[int, int, float]], n: int, lam: float, k: float) -> float:
    """Sum of ``lam S - ln(K n)`` over significant segments; the best one's value if none is significant."""
    chance = math.log(max(k * max(n, 1), 1e-12))
    values = [lam * s - chance for _, _, s in segments]
    strong = [v for v in values if v > -math.log(E_VALUE)]
    return sum(strong) if strong else max(values, default=min(-chance, 0.0) - 1.0)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a regularised logistic fit by Newton steps."""
    w = np.zeros(2)
    design = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def squashed(t: float) -> float:
    """Grows like a logarithm on either side, so that one long text does not rule the fit."""
    return math.copysign(math.log1p(abs(t)), t)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, label, fold) of at most ``rows`` labelled documents, those with the smallest hashes of their id.

    A document labelled more than once is toxic if any of its labels says so.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    fold = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(CALIBRATION_SHARE)).alias("fold")
    mine = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    # the chosen ids are at most ``rows`` rows of two numbers, so their size is bounded by a parameter
    return mine.join(F.broadcast(chosen), "__id").select("text", F.col("__label").cast("int").alias("label"), fold)


_COUNTS = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[label > 0].update(tokens(text.as_py()))
    words = list(counts[0].keys() | counts[1].keys())
    if words:
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], schema=_COUNTS)


_STATS = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64()))])


def _found(text: str | None, weights: dict[str, float]) -> tuple[list[str], list[tuple[int, int, float]]]:
    words = tokens(text)
    hits = [(k, x) for k, x in enumerate(map(weights.get, words)) if x is not None]
    return words, maximal_segments(hits, len(words))


def _scanned(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words, segments = _found(text.as_py(), weights)
                made.append({"label": label, "n": len(words), "segments": [s for _, _, s in segments]})
            yield pa.RecordBatch.from_pylist(made, schema=_STATS)

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample of labelled documents. Without labels of both kinds every text scores alike."""
    train = training_rows(docs, labels, id_col, text_col, label_col, rows)
    counted = train.where("fold <> 0").select("text", "label").mapInArrow(_counted, "word string, toxic long, clean long")
    # rare words are summed up on the executors; totals keep all words
    counts = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.withColumn("word", F.when(F.col("toxic") + F.col("clean") >= LEAST_SEEN, F.col("word")).otherwise(""))
    toxic, clean = Counter(), Counter()
    for word, t, c in counts.groupBy("word").agg(F.sum("toxic"), F.sum("clean")).collect():
        toxic[word], clean[word] = t, c
    weights = token_weights(toxic, clean) if toxic.total() and clean.total() else {}
    weights.pop("", None)
    lam = decay_rate(weights, clean)
    scanned = train.where("fold = 0").select("text", "label").mapInArrow(_scanned(weights), "label int, n long, segments array<double>").collect()
    best = [(r["n"], max(r["segments"], default=0.0)) for r in scanned if not r["label"] and r["n"]]
    k = (len(best) + 1) / (sum(n * math.exp(-min(lam * m, 500)) for n, m in best) + 1e3)
    k = min(k, 1.0)
    segments = [[(0, 0, s) for s in r["segments"]] for r in scanned]
    x = np.array([squashed(statistic(s, r["n"], lam, k)) for s, r in zip(segments, scanned)] or [0.0])
    y = np.array([float(r["label"] > 0) for r in scanned] or [0.0])
    return Model(weights, lam, k, *logistic(x, y))


_PASSAGE = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())])


def _scorer(model: Model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                words, segments = _found(text, model.weights)
                n = len(words)
                scores.append(model.score(segments, n))
                chance = math.log(max(model.k * max(n, 1), 1e-12))
                strong = [(a, b, s) for a, b, s in segments if model.lam * s - chance > -math.log(E_VALUE)]
                if strong:
                    low = text.lower()
                    at = [m.span() for m in TOKEN.finditer(low)]
                    same = len(low) == len(text)  # lower-casing a few characters makes two of one
                    passages.append([{"start": at[a][0], "length": at[b][1] - at[a][0], "score": s} for a, b, s in strong] if same else [{"start": 0, "length": len(text), "score": s} for _, _, s in strong[:1]])
                else:
                    passages.append([])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(passages, pa.list_(_PASSAGE))], schema=schema)

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``score`` and the significant ``passages`` (start and length in code points, score).

    One row per input row. Null and empty texts have no passages and the score of a text without evidence. Extra columns
    are ignored unless kept; none of them enters the score. Where lower-casing changes a text's length, its passage is
    the whole text.
    """
    mine = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    passage = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("score", T.DoubleType())])
    out = T.StructType([*mine.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    return mine.mapInArrow(_scorer(model, to_arrow_schema(out)), out)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score below one half, with the columns of ``docs`` as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text in batch.column(at):
                words, segments = _found(text.as_py(), model.weights)
                kept.append(model.score(segments, len(words)) < 0.5)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose labels may be learnt from."""
    return docs.where(~held_out(id_col))
